"""Record dumps with their own terminator and a single-byte encoding, plain or zipped.

A plain dump is split by Spark's text reader at the record ends, so one of any size is read by many tasks from any file system.
Columns are taken by place: a short record ends in nulls, what follows the last column is ignored.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the dumps: record end, field separator, encoding.
RECORD_END, FIELD_END, ENCODING = "|^|\r\n", "|", "cp1252"
#: Records of a zip's member that are handed on at once.
TOGETHER = 20_000


def _decoded(raw: Column) -> Column:
    """Text of bytes in the dumps' encoding, which differs from Latin-1 in the bytes from 0x80 to 0x9F."""
    special = {chr(b): bytes([b]).decode(ENCODING, "ignore") for b in range(0x80, 0xA0)}
    known = {k: v for k, v in special.items() if v}
    return F.translate(F.decode(raw.cast("binary"), "ISO-8859-1"), "".join(known), "".join(known.values()))


def _columns(records: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """Fields by place; blank ones are null, and so is a blank record's row: it goes."""
    cells = F.split(text, "\\" + FIELD_END, -1)
    strip = lambda i: F.nullif(F.regexp_replace(F.get(F.col("_f"), i), r"^\s+|\s+$", ""), F.lit(""))
    return records.where(F.trim(F.regexp_replace(text, r"\s+", "")) != "").select(cells.alias("_f")).select(*(strip(i).alias(n) for i, n in enumerate(names)))


def read_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The records of a plain dump, all columns as text. Line breaks inside a record belong to their field."""
    lines = spark.read.option("lineSep", RECORD_END).text(path)
    return _columns(lines, _decoded(F.col("value")), names)


def read_zipped_records(spark: SparkSession, path: str, names: list[str], member: str | None = None) -> DataFrame:
    """The same for the members of zips (or one of them). A zip cannot be split: each is read by one task, which hands its records on
    in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith("/") or member not in (None, name):
                            continue
                        with z.open(name) as f:
                            rest, found = "", []
                            for piece in iter(lambda f=f: f.read(1 << 20), b""):
                                *whole, rest = (rest + piece.decode(ENCODING, "replace")).split(RECORD_END)
                                found += whole
                                if len(found) >= TOGETHER:
                                    yield pd.DataFrame({"value": found})
                                    found = []
                            yield pd.DataFrame({"value": [*found, rest]})

    records = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")
    return _columns(records, F.col("value"), names)
