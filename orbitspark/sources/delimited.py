"""Delimited sources: text columns first, typed by expressions that give null for a bad cell, with the drift policy stated.

Policies for columns that a source has and the schema lacks: OVERFLOW keeps them in a map, FAIL raises, KEYWORD finds columns by
words in their headers, POSITIONAL takes them by place, IGNORE drops them.
"""

from __future__ import annotations

import csv
import enum
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class DriftPolicy(enum.Enum):
    OVERFLOW = "overflow"
    FAIL = "fail"
    KEYWORD = "keyword"
    POSITIONAL = "positional"
    IGNORE = "ignore"


class SchemaDrift(ValueError):
    """A source's header does not fit."""


def snake(header: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", header.strip().lower()).strip("_")


def missing(c: Column) -> Column:
    """Blank and '-' cells are null."""
    return F.nullif(F.nullif(F.trim(c), F.lit("-")), F.lit(""))


def typed(c: Column, kind: str) -> Column:
    """Tolerant cast of a trimmed cell: null where it does not parse."""
    return F.try_to_date(F.trim(c), "yyyy-MM-dd") if kind == "date" else F.trim(c).try_cast(kind)


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise SchemaDrift(f"{path} is empty")
    return next(csv.reader([first[0][0].lstrip("﻿")], delimiter=sep))


def read_text_columns(spark: SparkSession, path: str, sep: str = ",", names: list[str] | None = None) -> DataFrame:
    """Every column as text, under the header's names; short rows end in nulls, longer ones are cut."""
    names = names or _header(spark, path, sep)
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=True, mode="PERMISSIVE", multiLine=False)


def read_catalogue_csv(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """A CSV by header name in snake case, typed per column; other columns are ignored, absent ones null."""
    raw = read_text_columns(spark, path)
    raw = raw.toDF(*(snake(c) for c in raw.columns))
    return raw.select(*((typed(F.col(n), k) if n in raw.columns else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()))


def bad_cells(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """How many cells of each column are not blank and do not parse, in one pass."""
    raw = read_text_columns(spark, path)
    raw = raw.toDF(*(snake(c) for c in raw.columns))
    cols = [n for n in kinds if n in raw.columns]
    counts = raw.agg(*(F.count_if((F.trim(F.col(n)) != "") & typed(F.col(n), kinds[n]).isNull()).alias(n) for n in cols))
    return counts.select(F.expr(f"stack({len(cols)}, " + ", ".join(f"'{n}', `{n}`" for n in cols) + ") as (column, bad)"))


def read_commented_tsv(spark: SparkSession, path: str, fields: dict[str, str], numeric: dict[str, str] | None = None) -> DataFrame:
    """A TSV whose header starts with '#' and whose comment rows do too. fields maps headers to columns; the rest go to `extra`.

    A numeric column that does not parse is null, its text kept in extra under _unparsed_NAME.
    """
    numeric = numeric or {}
    names = [n.lstrip("#").strip() for n in _header(spark, path, "\t")]
    raw = read_text_columns(spark, path, "\t", names)
    raw = raw.where(~F.coalesce(F.col(f"`{names[0]}`"), F.lit("")).startswith("#"))
    kept = {h: c for h, c in fields.items() if h in names}
    rest = [n for n in names if n not in kept]
    extra = F.map_filter(F.map_from_arrays(F.array(*(F.lit(n) for n in rest)), F.array(*(missing(F.col(f"`{n}`")) for n in rest))), lambda k, v: v.isNotNull()) if rest else F.expr("cast(map() as map<string,string>)")
    cols = []
    for h, c in kept.items():
        cell = missing(F.col(f"`{h}`"))
        if c in numeric:
            value = cell.try_cast(numeric[c])
            extra = F.map_concat(extra, F.when(value.isNull() & cell.isNotNull(), F.create_map(F.lit(f"_unparsed_{c}"), cell)).otherwise(F.expr("cast(map() as map<string,string>)")))
            cols.append(value.alias(c))
        else:
            cols.append(cell.alias(c))
    return raw.select(*cols, extra.alias("extra"))


def require(df: DataFrame, column: str) -> DataFrame:
    """Rows whose key is there."""
    return df.where(F.col(column).isNotNull())


def read_mapped_csv(spark: SparkSession, path: str, mapping: dict[str, str], kinds: dict[str, str]) -> DataFrame:
    """A CSV whose every header must be known (FAIL); rows without their first typed column go."""
    names = _header(spark, path, ",")
    unknown = [n for n in names if n not in mapping]
    if unknown:
        raise SchemaDrift(f"unknown columns {unknown}")
    raw = read_text_columns(spark, path, ",", names)
    out = raw.select(*(typed(F.col(f"`{n}`"), kinds[mapping[n]]).alias(mapping[n]) for n in names))
    return require(out, mapping[names[0]])


def map_headers(headers: list[str], keywords: dict[str, tuple[str, ...]]) -> dict[int, str]:
    """KEYWORD: place → column; a column takes the first header that holds all its words."""
    out: dict[int, str] = {}
    for column, words in keywords.items():
        for i, h in enumerate(headers):
            if i not in out and all(w in (h or "").lower() for w in words):
                out[i] = column
                break
    return out


def read_keyword_table(rows: DataFrame, cells: str, order: str, keywords: dict[str, tuple[str, ...]], least: int = 2) -> DataFrame:
    """rows(order, cells array<string>) of an exported sheet: the header is the first row in which at least `least` columns are
    found; later rows with a blank first column found are section lines and go; 'N/A' is null."""
    for r in rows.orderBy(order).limit(50).collect():
        found = map_headers(list(r[cells]), keywords)
        if len(found) >= least:
            at = r[order]
            break
    else:
        raise SchemaDrift("no header row")
    cell = lambda i: F.nullif(F.nullif(F.trim(F.get(F.col(cells), i)), F.lit("N/A")), F.lit(""))
    out = rows.where(F.col(order) > at).select(*(cell(i).alias(c) for i, c in sorted(found.items())))
    return require(out, found[min(found)])


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter of a seed file, from its first lines; a workbook is refused."""
    if path.endswith((".xlsx", ".xls")):
        raise SchemaDrift("export the workbook to a delimited file")
    head = "\n".join(r[0] for r in spark.read.text(path).limit(5).collect())
    return csv.Sniffer().sniff(head, delimiters=",\t;|").delimiter


def read_seed(spark: SparkSession, path: str, mapping: dict[str, str], name: str, designator: str) -> DataFrame:
    """A delimited seed with any delimiter: mapped columns, the rest in extra, and row_key = SHA-1 of 'name|designator'."""
    sep = sniff(spark, path)
    names = _header(spark, path, sep)
    raw = read_text_columns(spark, path, sep, names)
    rest = [n for n in names if n not in mapping]
    extra = F.map_filter(F.map_from_arrays(F.array(*(F.lit(n) for n in rest)), F.array(*(missing(F.col(f"`{n}`")) for n in rest))), lambda k, v: v.isNotNull()) if rest else F.expr("cast(map() as map<string,string>)")
    out = raw.select(*(missing(F.col(f"`{h}`")).alias(c) for h, c in mapping.items() if h in names), extra.alias("extra"))
    return out.withColumn("row_key", F.sha1(F.concat_ws("|", F.coalesce(name, F.lit("")), F.coalesce(designator, F.lit("")))))
