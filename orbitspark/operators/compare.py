"""Comparing versions of a table: churn, differences, gates, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CheckFailed, assert_unique


def referent_changes(previous: DataFrame, current: DataFrame, key: str, referent: str) -> DataFrame:
    """Keys that both snapshots have under different referents: key, previous_referent, current_referent. A null differs from a value."""
    p = previous.select(key, F.col(referent).alias("previous_referent"))
    c = current.select(key, F.col(referent).alias("current_referent"))
    return p.join(c, key).where(~F.col("previous_referent").eqNullSafe(F.col("current_referent")))


def stability(previous: DataFrame, current: DataFrame, key: str, referent: str) -> DataFrame:
    """One row: keys in both snapshots, and how many changed their referent."""
    both = previous.select(key).join(current.select(key), key).agg(F.count(F.lit(1)).alias("observations"))
    changed = referent_changes(previous, current, key, referent).agg(F.count(F.lit(1)).alias("referent_changes"))
    return both.crossJoin(changed)


def diff(baseline: DataFrame, live: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, change ('vanished', 'appeared' or 'changed'), metric, before, after; metrics are compared as text, nulls as values."""
    gone = baseline.join(live, key, "left_anti").select(key, F.lit("vanished").alias("change"), *(F.lit(None).cast("string").alias(c) for c in ("metric", "before", "after")))
    new = live.join(baseline, key, "left_anti").select(key, F.lit("appeared").alias("change"), *(F.lit(None).cast("string").alias(c) for c in ("metric", "before", "after")))
    j = baseline.alias("b").join(live.alias("l"), key)
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").cast("string").alias("before"), F.col(f"l.{m}").cast("string").alias("after")) for m in metrics))
    changed = j.select(key, F.lit("changed").alias("change"), F.inline(F.filter(cells, lambda s: ~s["before"].eqNullSafe(s["after"]))))
    return reduce(DataFrame.unionByName, [gone, new, changed])


def unresolved_slugs(archived: DataFrame, live: DataFrame, aliases: DataFrame) -> DataFrame:
    """Archived (kind, slug) pairs that are neither live nor an alias of a live slug."""
    through = aliases.join(live.withColumnRenamed("slug", "new_slug"), ["kind", "new_slug"], "left_semi").select("kind", F.col("old_slug").alias("slug"))
    return archived.select("kind", "slug").distinct().join(live, ["kind", "slug"], "left_anti").join(through, ["kind", "slug"], "left_anti")


def gate_slugs(archived: DataFrame, live: DataFrame, aliases: DataFrame) -> None:
    bad = unresolved_slugs(archived, live, aliases).orderBy("kind", "slug").limit(5).collect()
    if bad:
        raise CheckFailed(f"slugs that resolve nowhere: {[tuple(r) for r in bad]}")
    assert_unique(live, ["kind", "slug"])


def set_conflicts(assertions: DataFrame, key: str, value, source: str = "source") -> DataFrame:
    """Keys whose sources give more than one distinct parsed value: key, values_n, claims ('source=value; ...' in order)."""
    v = assertions.withColumn("_v", value).where("_v is not null")
    return v.groupBy(key).agg(F.count_distinct("_v").alias("values_n"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", source, F.col("_v").cast("string")))), "; ").alias("claims")).where("values_n > 1")


def two_source_conflicts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose two sources both have a value, and not the same."""
    return a.select(key, F.col(value).alias("a_value")).join(b.select(key, F.col(value).alias("b_value")), key).where("a_value <> b_value")
