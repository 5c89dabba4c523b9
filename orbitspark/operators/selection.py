"""Exact percentiles of groups of any size.

`percentile` counts a group's distinct values in one buffer, which a group of billions outgrows. Here a large group is sorted across
tasks: rows are dealt out by ranges of (group, value), a run of a group in a range knows how many of its rows come before it, and so each
row its rank. The rows at the wanted ranks are looked up and interpolated. No group meets in one task and no value in a buffer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .written import written

#: Rows of a group from which it is sorted across tasks.
LARGE = 1_000_000


def _matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which nulls are values like others; b's keys are dropped."""
    b = b.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    out = a.join(b, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), how)
    return out.drop(*(f"_k{i}" for i in range(len(keys))))


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], large: int = LARGE) -> DataFrame:
    """keys, n (values that are not null) and a double for each name in wanted: the continuous percentile of its share, as SQL's
    percentile_cont. A group without values has n 0 and nulls. NaN counts as the largest value. Groups of more than `large` values are
    sorted across tasks, the others aggregated; both are exact."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = written(rows.groupBy(*keys).agg(F.count("_v").alias("n")))
    if not sizes.where(F.col("n") > large).limit(1).count():
        return _aggregated(rows, keys, wanted)
    few, many = sizes.where(F.col("n") <= large), sizes.where(F.col("n") > large)
    return _aggregated(_matched(rows, few.select(*keys), keys), keys, wanted).unionByName(_selected(_matched(rows, many.select(*keys), keys), many, keys, wanted))


def _aggregated(rows: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("_v").alias("n"), *(F.percentile("_v", p).alias(name) for name, p in wanted.items()))


def _selected(rows: DataFrame, sizes: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    # equal values are dealt out by chance, so that one which a third of all rows have fills no range alone
    ranged = rows.where("_v is not null").repartitionByRange(*keys, "_v", F.rand(7)).sortWithinPartitions(*keys, "_v")
    placed = written(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    runs = placed.groupBy("_p", *keys).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))

    at = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in wanted.items()}
    asked = [F.struct(F.lit(name).alias("name"), side(x).cast("long").alias("rank"), (x - F.floor(x)).alias("rest")) for name, x in at.items() for side in (F.floor, F.ceil)]
    asked = sizes.select(*keys, "n", F.explode(F.array(*asked)).alias("a")).select(*keys, "n", "a.*").distinct()
    # the run in which a rank lies, then the row: runs are few, and a run's rows are numbered without gaps
    found = _matched(asked, runs, keys).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_m")))
    found = found.select(*keys, "n", "name", "rank", "rest", (F.col("rank") - F.col("_before") + F.col("_first")).alias("_i"))
    found = found.join(placed.select("_i", "_v"), "_i")
    low, high, rest = F.min_by("_v", "rank"), F.max_by("_v", "rank"), F.max("rest")
    value = F.when(rest == 0, low).otherwise((F.lit(1.0) - rest) * low + rest * high)
    names = found.groupBy(*keys, "n", "name").agg(value.alias("_x"))
    return names.groupBy(*keys, "n").agg(*(F.max(F.when(F.col("name") == name, F.col("_x"))).alias(name) for name in wanted))
