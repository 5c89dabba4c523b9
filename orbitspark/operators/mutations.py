"""Upserts, merges and expiries as pure functions: old rows and new rows to the rows that replace them."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_per_key
from .written import written


def _once(new: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    return latest_per_key(new, keys, order or [F.col(c).asc_nulls_last() for c in new.columns if c not in keys] or [F.lit(0)])


def rows_to_insert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Of new, one row per key that old lacks."""
    return _once(new, keys, order).join(old.select(*keys), keys, "left_anti").select(*new.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    return old.unionByName(rows_to_insert(old, new, keys, order))


def insert_with_log(old: DataFrame, new: DataFrame, keys: list[str], log: list[Column]) -> tuple[DataFrame, DataFrame]:
    """insert_ignore, and a log of exactly the rows that it inserts."""
    add = rows_to_insert(old, new, keys)
    return old.unionByName(add), add.select(*log)


def insert_or_touch(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Old rows keep their attributes; those that new names again take its stamp; new keys are added."""
    seen = _once(new, keys, None).select(*keys, F.col(stamp).alias("_s"))
    touched = old.join(seen, keys, "left").withColumn(stamp, F.coalesce("_s", stamp)).select(*old.columns)
    return touched.unionByName(rows_to_insert(old, new, keys))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], take: dict[str, str]) -> DataFrame:
    """take says for each other column what a key in both gets: 'new', 'old', 'new_or_old' (new unless null) or 'old_or_new'."""
    n = _once(new, keys, None).withColumn("_new", F.lit(True))
    o = old.withColumn("_old", F.lit(True))
    j = o.alias("o").join(n.alias("n"), keys, "full")

    def pick(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        both = {"new": b, "old": a, "new_or_old": F.coalesce(b, a), "old_or_new": F.coalesce(a, b)}[take.get(c, "new")]
        return F.when(F.col("_old").isNull(), b).when(F.col("_new").isNull(), a).otherwise(both).alias(c)

    return j.select(*keys, *(pick(c) for c in old.columns if c not in keys)).select(*old.columns)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """target with columns taken from source's row of the same keys; rows without one are as they were."""
    s = _once(source, keys, None).select(*keys, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = target.join(s, keys, "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


def chain_ends(pairs: DataFrame) -> DataFrame:
    """pairs(merged_id, surviving_id) → merged_id, surviving_id, cyclic: every survivor followed to the end of its chain, however long.

    Pointers jump: each round doubles the links that a row has followed, and its result is written before the next one reads it, so
    a chain of n takes about log2(n) short rounds. A chain without an end runs into a cycle: its entities survive as the smallest
    of the cycle, which is not merged itself, and are marked. Of several survivors of one entity the smallest counts; an entity merged
    into itself is left out.
    """
    at = pairs.where("merged_id <> surviving_id").groupBy("merged_id").agg(F.min("surviving_id").alias("to"))
    at = written(at.select("merged_id", "to", F.least("merged_id", "to").alias("low"), F.lit(True).alias("open")))
    longest = at.count()
    for _ in range(longest.bit_length() + 1):
        following = at.select(F.col("merged_id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        jumped = at.join(following, "to", "left")
        at = written(jumped.select("merged_id", F.coalesce("_to", "to").alias("to"), F.least("low", F.coalesce("_low", "low")).alias("low"), F.col("_to").isNotNull().alias("open")))
        if not at.where("open").limit(1).count():
            break
    # what is still open after as many links as there are rows lies on a cycle, or leads to one that its pointer has reached
    cycle = at.where("open").select(F.col("merged_id").alias("to"), F.col("low").alias("_low"))
    ends = at.join(cycle, "to", "left").select("merged_id", F.coalesce("_low", "to").alias("surviving_id"), F.col("open").alias("cyclic"))
    return ends.where("merged_id <> surviving_id")


def resolve_chains(pairs: DataFrame) -> DataFrame:
    """chain_ends without the mark."""
    return chain_ends(pairs).drop("cyclic")


def merge_all(children: dict[str, tuple[DataFrame, list[str] | None]], pairs: DataFrame, id_col: str = "satellite_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables that refer to entities, repointed along the whole chains of pairs; and the log: merged_id, surviving_id, rule (`merge`, or
    `cycle` where the chain had no end), child, moved (rows that were repointed). Chains are resolved once and written.

    children: name → (rows, natural key); with a key, of rows that collide the survivor's own stays, without one every row moves."""
    ends = written(chain_ends(pairs))
    out, log = {}, []
    for name, (rows, key) in children.items():
        if key:
            out[name] = merge_entities(rows, ends, key, id_col)
        else:
            to = ends.select(F.col("merged_id").alias(id_col), "surviving_id")
            out[name] = rows.join(to, id_col, "left").withColumn(id_col, F.coalesce("surviving_id", id_col)).select(*rows.columns)
        moved = rows.groupBy(F.col(id_col).alias("merged_id")).agg(F.count(F.lit(1)).alias("moved"))
        rule = F.when(F.col("cyclic"), "cycle").otherwise("merge").alias("rule")
        log.append(ends.join(moved, "merged_id", "left").select("merged_id", "surviving_id", rule, F.lit(name).alias("child"), F.coalesce("moved", F.lit(0)).alias("moved")))
    return out, reduce(DataFrame.unionByName, log)


def merge_entities(child: DataFrame, pairs: DataFrame, natural_key: list[str], id_col: str = "satellite_id") -> DataFrame:
    """child rows of merged entities repointed to their survivors; where both have a natural key, the survivor's row stays."""
    p = pairs.select(F.col("merged_id").alias(id_col), "surviving_id")
    moved = child.join(p, id_col, "left").withColumn("_moved", F.col("surviving_id").isNotNull()).withColumn(id_col, F.coalesce("surviving_id", id_col)).drop("surviving_id")
    rest = [F.col(c).asc_nulls_last() for c in child.columns if c not in natural_key]
    return latest_per_key(moved, natural_key, [F.col("_moved").asc(), *rest]).select(*child.columns)


def drop_merged(entities: DataFrame, pairs: DataFrame, id_col: str = "satellite_id") -> DataFrame:
    return entities.join(pairs.select(F.col("merged_id").alias(id_col)), id_col, "left_anti")


def expire(rows: DataFrame, present: DataFrame, keys: list[str], as_of: dt.date, event: str = "expired") -> tuple[DataFrame, DataFrame]:
    """Open rows whose keys `present` lacks close on as_of, closed ones that it has open again; and an event for each."""
    j = rows.join(present.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "left")
    close, revive = F.col("_in").isNull() & F.col("valid_to").isNull(), F.col("_in").isNotNull() & F.col("valid_to").isNotNull()
    out = j.withColumn("_event", F.when(close, event).when(revive, "revived")).withColumn("valid_to", F.when(close, F.lit(as_of)).when(revive, None).otherwise(F.col("valid_to")))
    return out.select(*rows.columns), out.where("_event is not null").select(*keys, F.col("_event").alias("event"), F.lit(as_of).alias("observed_at"))


def freeze_month(frozen: DataFrame, live: DataFrame, month: str, kind: str) -> DataFrame:
    """frozen plus live's rows under (month, kind), or frozen itself if that pair is there already."""
    there = frozen.where((F.col("month") == month) & (F.col("kind") == kind)).limit(1)
    add = live.select(F.lit(month).alias("month"), F.lit(kind).alias("kind"), "slug", F.to_json(F.struct("*")).alias("payload"))
    return frozen.unionByName(add.join(F.broadcast(there.select(F.col("month"))), "month", "left_anti"))  # one row at most


def split_ownership(owners: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """owners(satellite_id, operator_id, launch_date) and acquisitions(child_id, parent_id, valid_from) → half-open versions.

    Launched before the earliest deal: the child until then, its parent after. On or after it: the child alone. Without a
    launch date there is no version.
    """
    deal = latest_per_key(acquisitions, ["child_id"], [F.col("valid_from").asc(), F.col("parent_id").asc()])
    j = owners.where("launch_date is not null").join(deal, owners["operator_id"] == deal["child_id"], "left")
    split = F.coalesce(F.col("launch_date") < F.col("valid_from"), F.lit(False))
    first = j.select("satellite_id", "operator_id", F.col("launch_date").alias("valid_from"), F.when(split, F.col("valid_from")).alias("valid_to"))
    second = j.where(split).select("satellite_id", F.col("parent_id").alias("operator_id"), "valid_from", F.lit(None).cast("date").alias("valid_to"))
    return first.unionByName(second)


def with_ids(existing: DataFrame, new_keys: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """new_keys with ids that follow the largest there is, in a total order: the same keys get the same ids in every run.

    The order is global, so numbers are given in two steps: counts per range partition, then offsets. The ranges are written first:
    both steps must see the same ones.
    """
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    ranged = written(new_keys.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    ranged = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.groupBy("_p").agg(F.max("_i").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return ranged.join(offset, "_p").withColumn(id_col, (F.col("_i") + F.col("_o") + F.lit(top)).cast("long")).drop("_p", "_i", "_o")


def rebuild_resolved(owners: DataFrame, versions: DataFrame, source: str = "resolve") -> DataFrame:
    """owners with the rows that `source` wrote replaced by versions; what others wrote stays, and its keys are not doubled."""
    keep = owners.where(F.col("source") != source)
    new = versions.select("satellite_id", "operator_id", F.lit("owner").alias("role"), "valid_from", "valid_to", F.lit(source).alias("source"), F.lit(1).cast("decimal(3,2)").alias("confidence"))
    return insert_ignore(keep, new.select(*owners.columns), ["satellite_id", "operator_id", "role", "valid_from"])


def refresh_anchors(satellites: DataFrame) -> DataFrame:
    """An entity with a catalogue id is anchored."""
    return satellites.withColumn("anchor_state", F.when(F.col("norad_id").isNotNull(), "anchored").otherwise(F.col("anchor_state")))


def restore_verdicts(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """cases with exported verdicts put back by natural key; one that has a verdict keeps it, keys that are gone are passed over."""
    v = _once(verdicts.select("case_type", "subject_ref", "verdict"), ["case_type", "subject_ref"], None).withColumnRenamed("verdict", "_v")
    return cases.join(v, ["case_type", "subject_ref"], "left").withColumn("verdict", F.coalesce("verdict", "_v")).select(*cases.columns)


def refresh_window(materialised: DataFrame, facts: DataFrame, rollup, ts: str, now: dt.datetime, start: dt.timedelta = dt.timedelta(days=7), end: dt.timedelta = dt.timedelta(hours=1), day: str = "day") -> DataFrame:
    """The days between now - start and now - end computed anew from facts; older and newer days are as they were."""
    low, high = (now - start).date(), (now - end).date()
    new = rollup(facts.where((F.to_date(ts) >= F.lit(low)) & (F.to_date(ts) < F.lit(high))))
    return materialised.where((F.col(day) < F.lit(low)) | (F.col(day) >= F.lit(high))).unionByName(new.select(*materialised.columns))
