"""Text measures that no built-in expresses: gestalt similarity and whole-token support."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, in Arrow batches; each first string is prepared once while it repeats."""
    from difflib import SequenceMatcher

    m, out, last = SequenceMatcher(None), [], None
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            m.set_seq2(y)
            last = y
        m.set_seq1(x)
        out.append(m.ratio())
    return pd.Series(out, dtype="float64")


def _alone(token: Column) -> Column:
    """A pattern for the token between no digits or points."""
    return F.concat(F.lit(r"(?<![\d.])(?:"), token, F.lit(r")(?![\d.])"))


def page_supports_number(page: Column | str, value: Column | str) -> Column:
    """Whether the number stands on the page as a token of its own: 25 is not in 525.0. A whole number may be written with `.0`. Null is
    never supported."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    whole = F.concat(v.cast("bigint").cast("string"), F.lit(r"(?:\.0)?"))
    token = F.when(F.isnan(v), None).when(v == F.floor(v), whole).otherwise(F.replace(v.cast("string"), F.lit("."), F.lit(r"\.")))
    return F.coalesce(F.regexp_like(page, _alone(token)), F.lit(False))


def page_supports_text(page: Column, value: Column) -> Column:
    """The same for text, as an expression: the quoted value between no digits or points."""
    quoted = F.regexp_replace(value, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.coalesce(F.regexp_like(page, _alone(quoted)), F.lit(False))
