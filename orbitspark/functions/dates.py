"""Dates as Column expressions: lenient parsing, differences, calendar shifts, buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO, _YMD, _YM, _MDY, _YEAR = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})\s+([A-Za-z]{3})\s+(\d{1,2})", r"(\d{4})\s+([A-Za-z]{3})", r"(\d{1,2})/(\d{1,2})/(\d{4})", r"^\s*(\d{4})\s*\??\s*$"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _month(c: Column) -> Column:
    """1 to 12 of a three-letter name, null for another."""
    at = F.position(F.lower(c), F.lit(_MONTHS))
    return F.when((at > 0) & (at % 3 == 1), F.floor(at / 3) + 1)


def _date(y: Column, m: Column, d: Column) -> Column:
    s = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.try_to_date(s, "yyyy-MM-dd")


def parse_date_loose(c: Column) -> Column:
    """ISO, 'YYYY Mon DD', 'YYYY Mon', 'M/D/YYYY', 'YYYY' or 'YYYY?', found anywhere in the text but for the last two.

    The first form that matches decides, even if its date does not exist (then null); blanks, '-' and decades give null.
    """
    t = F.trim(c)
    g = lambda p, i: F.regexp_extract(t, p, i)
    one = F.lit("1")
    return (
        F.when(t.isin("", "-"), None)
        .when(t.rlike(_ISO), _date(g(_ISO, 1), g(_ISO, 2), g(_ISO, 3)))
        .when(t.rlike(_YMD) & _month(g(_YMD, 2)).isNotNull(), _date(g(_YMD, 1), _month(g(_YMD, 2)), g(_YMD, 3)))
        .when(t.rlike(_YM) & _month(g(_YM, 2)).isNotNull(), _date(g(_YM, 1), _month(g(_YM, 2)), one))
        .when(t.rlike(_MDY), _date(g(_MDY, 3), g(_MDY, 1), g(_MDY, 2)))
        .when(t.rlike(_YEAR), _date(g(_YEAR, 1), one, one))
    )


def legacy_datetime(c: Column) -> Column:
    """Date of 'Jun  8 2025  4:50:24:023PM', null where it is malformed."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.trim(c), " +", " "), F.lit("MMM d yyyy h:mm:ss:SSSa")))


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def plus_years(c: Column, years: int) -> Column:
    """Calendar years later; 29 February gives the 28th."""
    return F.add_months(c, 12 * years)


def months_before(c: Column, months: int) -> Column:
    return F.add_months(c, -months)


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def decade(c: Column) -> Column:
    return F.coalesce((F.floor(F.year(c) / 10) * 10).cast("int"), F.lit(-1))


def lifetime_days(status: Column, launch: Column, decay: Column) -> Column:
    """Days from launch to decay of what has decayed, where both are known and in order."""
    d = F.datediff(decay, launch)
    return F.when((status == "DECAYED") & (d >= 0), d)


def month_windows(spark, start: dt.date, end: dt.date):
    """Half-open monthly windows that cover [start, end): window_start, window_end. The first and last may be shorter."""
    months = F.explode(F.expr(f"sequence(trunc(date '{start}', 'MM'), date '{end}', interval 1 month)")).alias("m")
    w = spark.range(1).select(months)
    return w.select(F.greatest("m", F.lit(start)).alias("window_start"), F.least(F.add_months("m", 1), F.lit(end)).alias("window_end")).where("window_start < window_end")
