"""Relational building blocks: latest per key, temporal joins, islands, rule cascades, paging, unpivoting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .written import written


# ------------------------------------------------------------------ latest rows and runs
def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order. The limit is pushed before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_ok_run(runs: DataFrame, source: str | None = None) -> int | None:
    """The newest finished run; a scalar, so a scan that filters by it prunes partitions."""
    ok = runs.where("status = 'ok'")
    return (ok if source is None else ok.where(F.col("source") == source)).agg(F.max("ingest_run_id")).first()[0]


def rows_of_latest_ok_run(raw: DataFrame, runs: DataFrame, source: str | None = None) -> DataFrame:
    return raw.where(F.col("ingest_run_id") == F.lit(latest_ok_run(runs, source)))


def last_two_ok_runs(runs: DataFrame, source: str) -> tuple[int | None, int | None]:
    """(previous, current)."""
    got = [r[0] for r in runs.where((F.col("status") == "ok") & (F.col("source") == source)).select("ingest_run_id").distinct().orderBy(F.desc("ingest_run_id")).limit(2).collect()]
    return (got[1] if len(got) > 1 else None, got[0] if got else None)


# ------------------------------------------------------------------ temporal
def valid_on(day: Column, start: str | Column = "valid_from", end: str | Column = "valid_to") -> Column:
    """Half-open: from <= day < to, an open end holding for ever."""
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (s <= day) & (e.isNull() | (day < e))


def scd2_join(fact: DataFrame, versions: DataFrame, key: str, day: str = "day") -> DataFrame:
    """fact with the version valid on its day, or nulls: an equi-join on key with the range as residue."""
    v = versions.withColumnRenamed(key, "_k")
    return fact.join(v, (fact[key] == v["_k"]) & valid_on(fact[day], v["valid_from"], v["valid_to"]), "left").drop("_k", "valid_from", "valid_to")


# ------------------------------------------------------------------ windows
def rolling_stddev(df: DataFrame, key: str, day: str, value: str, days: int, out: str) -> DataFrame:
    """stddev_samp over the rows of the last `days` days and today: a frame of values, not of rows."""
    n = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    return df.withColumn(out, F.stddev_samp(value).over(Window.partitionBy(key).orderBy(n).rangeBetween(-days, 0)))


def islands(df: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days per key: key, run_start, run_end, run_length. Days must be distinct per key."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(day))
    return df.withColumn("_g", F.date_sub(F.col(day), rn)).groupBy(key, "_g").agg(F.min(day).alias("run_start"), F.max(day).alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("_g")


def consecutive_delta(df: DataFrame, key: str, day: str, value: str, clamp: float | None = None) -> DataFrame:
    """df plus delta to the day before, only where that day is present and the step is below clamp."""
    w = Window.partitionBy(key).orderBy(day)
    out = df.withColumn("delta", F.col(value) - F.lag(value).over(w)).withColumn("_p", F.lag(day).over(w)).where(F.col("_p") == F.date_sub(F.col(day), 1)).drop("_p")
    return out if clamp is None else out.where(F.abs("delta") < clamp)


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """n rows, one of each group in turn: a top-n over (rank in group, group)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).orderBy("_rn", group).limit(n)


def group_ids(df: DataFrame, partition: list[str], order: list[str], label: str) -> DataFrame:
    """df plus group_id, from 0: in order, a row whose label the current group has already closes it and opens the next one.

    A fold over the sorted labels of each partition, whose rows are one array while it runs: a report's fields, a conversation's
    turns. A null label never repeats. Rows alike in order and label are taken in any order.
    """
    rest = [c for c in df.columns if c not in partition]
    rows = df.select(*partition, F.struct(*order, F.col(label).cast("string").alias("_label"), F.struct(*rest).alias("_row")).alias("_r"))
    lists = rows.groupBy(*partition).agg(F.array_sort(F.collect_list("_r"), lambda a, b: _by(a, b, [*order, "_label"])).alias("_rows"))
    start = F.struct(F.array().cast("array<string>").alias("has"), F.lit(0).alias("id"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, row: Column) -> Column:
        closes = F.coalesce(F.array_contains(acc["has"], row["_label"]), F.lit(False))
        has, now = F.when(closes, F.array(row["_label"])).otherwise(F.array_append(acc["has"], row["_label"])), acc["id"] + closes.cast("int")
        return F.struct(has.alias("has"), now.alias("id"), F.array_append(acc["ids"], now).alias("ids"))

    ids = F.aggregate("_rows", start, step)["ids"]
    out = lists.select(*partition, F.explode(F.arrays_zip(F.col("_rows"), ids.alias("_ids"))).alias("_z"))
    return out.select(*partition, "_z._rows._row.*", F.col("_z._ids").alias("group_id"))


def _by(a: Column, b: Column, names: list[str]) -> Column:
    """Comparison of two structs by some of their fields, nulls first."""
    out = F.lit(0)
    for n in reversed(names):
        x, y = a[n], b[n]
        out = F.when(x.eqNullSafe(y), out).when(x.isNull() | (x < y), -1).otherwise(1)
    return out


def downsample(df: DataFrame, order: str, n: int, mean: list[str], total: list[str]) -> DataFrame:
    """At most n points of one ordered series: contiguous buckets, means and sums, the middle row's order value.

    One series is one object's track, whose rows fit in a task; many series go by Window.partitionBy in downsample_by.
    """
    return downsample_by(df.withColumn("_one", F.lit(0)), "_one", order, n, mean, total).drop("_one")


def downsample_by(df: DataFrame, key: str, order: str, n: int, mean: list[str], total: list[str]) -> DataFrame:
    w = Window.partitionBy(key)
    r, size = F.row_number().over(w.orderBy(order)) - 1, F.count(F.lit(1)).over(w)
    points = F.least(F.col("_n"), F.lit(n))
    rows = df.withColumn("_r", r).withColumn("_n", size).withColumn("bucket", F.floor(((F.col("_r") + 1) * points - 1) / F.col("_n")).cast("long"))
    days = F.sort_array(F.collect_list(order))
    return rows.groupBy(key, "bucket").agg(F.element_at(days, (F.floor(F.size(days) / 2) + 1).cast("int")).alias(order), *(F.avg(c).alias(c) for c in mean), *(F.sum(c).alias(c) for c in total))


# ------------------------------------------------------------------ rules and lookups
def first_rule_wins(rules: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first rule that has a key; the rules' rows carry their name in rule."""
    out = None
    for r in rules:
        out = r if out is None else out.unionByName(r.join(out.select(*keys), keys, "left_anti"))
    return out


def unique_matches(left: DataFrame, right: DataFrame, key: str, right_id: str) -> DataFrame:
    """left joined to the one right row of its key; keys that several right rows share match nothing."""
    one = right.groupBy(key).agg(F.min(right_id).alias(right_id), F.count(F.lit(1)).alias("_c")).where("_c = 1").drop("_c")
    return left.join(one, key)


def only_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, *kept: Column) -> DataFrame:
    """left_id, right_id and aggregates of left, for those of left that meet one right_id alone by all their keys. The ends of each key's
    right ids say whether they are one, so a key that many rows of both sides share costs a row of each, not their product."""
    ends = right.groupBy(key).agg(F.min(right_id).alias(right_id), F.max(right_id).alias("_last"))
    met = left.join(ends, key).groupBy(left_id).agg(F.min(right_id).alias(right_id), F.max("_last").alias("_last"), *kept)
    return met.where(F.col(right_id) == F.col("_last")).drop("_last")


def pattern_join(df: DataFrame, patterns: DataFrame, condition: Column, most: int = 10_000) -> DataFrame:
    """df with the patterns that a condition ties to each row: no key, so the patterns go to every task. They are a curated list:
    more than `most` raise."""
    if patterns.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} patterns")
    return df.join(F.broadcast(patterns), condition)  # `most` rows at most


def by_precedence(claims: DataFrame, keys: list[str], source: str, order: list[str]) -> DataFrame:
    """One claim per key, by the order of its sources; sources not listed never win."""
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col(source))
    return latest_per_key(claims.withColumn("_rank", rank).where("_rank > 0"), keys, [F.col("_rank").asc(), F.col("observed_at").desc_nulls_last() if "observed_at" in claims.columns else F.col(source).asc()]).drop("_rank")


def walk_up(edges: DataFrame, through: DataFrame, depth: int = 10) -> DataFrame:
    """edges(code, parent_code) → leaf, root, path, depth: the chain of parents, only through codes in `through`, no cycles.

    A level is the frontier joined with the steps, written down before the next: the walk ends with the first empty one, after `depth`
    levels at most.
    """
    step = written(edges.join(through.withColumnRenamed("code", "parent_code"), "parent_code", "left_semi").select(F.col("code").alias("root"), "parent_code"))
    level = edges.select(F.col("code").alias("leaf"), F.col("code").alias("root"), F.array("code").alias("path"), F.lit(0).alias("depth"))
    levels = [level]
    for d in range(1, depth + 1):
        level = written(level.join(step, "root").where(~F.array_contains("path", F.col("parent_code"))).select("leaf", F.col("parent_code").alias("root"), F.concat("path", F.array("parent_code")).alias("path"), F.lit(d).alias("depth")))
        if not level.limit(1).count():
            break
        levels.append(level)
    return latest_per_key(reduce(DataFrame.unionByName, levels), ["leaf"], [F.col("depth").desc()])


# ------------------------------------------------------------------ shape
def unpivot(df: DataFrame, ids: list[str], attributes: dict[str, str]) -> DataFrame:
    """Long rows (ids, attribute, value) of the columns named by attributes (name → column); null values are no claims."""
    pairs = ", ".join(f"'{a}', cast(`{c}` as string)" for a, c in attributes.items())
    return df.select(*ids, F.expr(f"stack({len(attributes)}, {pairs}) as (attribute, value)")).where("value is not null")


def claims(raw: DataFrame, crosswalk: DataFrame, key: str, source: str, attributes: dict[str, str]) -> DataFrame:
    """Assertions of raw rows, with the entity that their key names where there is one; an ambiguous key gives one each."""
    long = unpivot(raw.withColumn("source_key", F.col(key).cast("string")), ["source_key", "observed_at", "ingest_run_id"], attributes)
    x = crosswalk.select(F.col("id_value").alias("source_key"), "satellite_id")
    return long.join(x, "source_key", "left").select("satellite_id", "source_key", "attribute", "value", F.lit(source).alias("source"), "observed_at", "ingest_run_id")


# ------------------------------------------------------------------ query layer
def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """One page under a total order, the limit held between 1 and `most`."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def page_and_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """A page, and the rows there are in all: counted apart, so that it is right beyond the last page."""
    return page(df, order, limit, offset), df.count()


def after(df: DataFrame, keys: list[str], last: tuple, limit: int) -> DataFrame:
    """Keyset paging: the rows whose keys, compared as a row, come after `last`."""
    kinds = dict(df.dtypes)
    bound = F.struct(*(F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, last, strict=True)))
    return df.where(F.struct(*keys) > bound).orderBy(*keys).limit(limit)


def choose(name: str, allowed: dict[str, Callable[[], list[Column]]]) -> list[Column]:
    """Ordering or filter by a name from a closed list."""
    if name not in allowed:
        raise ValueError(f"{name!r} is not one of {sorted(allowed)}")
    return allowed[name]()


def search(df: DataFrame, text: str, id_col: str, name_col: str, designator_col: str | None = None, limit: int = 20) -> DataFrame:
    """By the shape of the text: digits are an id, a designator is exact, else a part of the name, prefixes first."""
    import re

    from ..functions.names import like_literal

    t = text.strip()
    if t.isdigit():
        return df.where(F.col(id_col) == int(t)).limit(limit)
    if designator_col and re.fullmatch(r"\d{4}-\d{3}[A-Za-z]{1,3}", t):
        return df.where(F.col(designator_col) == t.upper()).limit(limit)
    starts = F.lower(F.col(name_col)).startswith(t.lower())
    return df.where(F.col(name_col).ilike(like_literal(t))).orderBy(starts.desc(), name_col, id_col).limit(limit)
