"""Connected components of links that no single machine can hold: alternating large-star and small-star rounds.

Each partition first contracts its own links with a union-find, so that most chains are gone before the first shuffle.
Rounds are written to the shared folder; nothing but two sums a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, tidy


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    def flush() -> Iterator[pa.RecordBatch]:
        out = [(x, find(x)) for x in list(root) if find(x) != x]
        root.clear()
        if out:
            u, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root.setdefault(a, a)
            root.setdefault(b, b)
            root[max(a, b)] = min(a, b)
        if len(root) > 2_000_000:
            yield from flush()
    yield from flush()


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(links: DataFrame) -> DataFrame:
    """links(u, v: long) → (u, v): every node but each component's smallest, with that smallest. Loops and repeats are allowed."""
    spark = links.sparkSession
    edges, path = materialize(links.select("u", "v").where("u <> v").mapInArrow(tidy(_contract), "u long, v long"))
    before = None
    while (now := _sums(edges)) != before and now[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        new, new_path = materialize(small)
        drop(spark, path)
        edges, path, before = new, new_path, now
    return edges
