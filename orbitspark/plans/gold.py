"""Hard identity cases for people to judge, in eight strata, each chosen in a total order: the same graph gives the same cases.

A case is case_type, satellite_id, subject_ref and facts (JSON). t holds satellite (satellite_id, norad_id, canonical_name,
object_type, launch_date), satellite_identifier, source_assertion, operator (operator_id, canonical_name, operator_class),
operator_alias, operator_relationship (child_id, parent_id, relationship, valid_from), satellite_operator, status_mapping and
size (norad_id, rcs). Two sources are compared, a and b.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names
from ..operators import fuzzy, relational

#: Cases of a stratum, at most; strata that are not named here take every case. Fixed values.
TARGETS = {"owner_dispute": 30, "missed_join_candidate": 30, "decay_conflict": 20, "type_conflict": 25, "stale_owner": 15}
#: Names this similar within the launch window may be a missed join. Fixed value.
LIKELY = 0.75


def newest_claim(claims: DataFrame, source: str, attribute: str, out: str) -> DataFrame:
    """(satellite_id, out): what the source said last of the attribute."""
    mine = claims.where((F.col("source") == source) & (F.col("attribute") == attribute) & F.col("satellite_id").isNotNull())
    order = [F.col("observed_at").desc_nulls_last(), F.col("ingest_run_id").desc_nulls_last(), F.col("source_key").asc_nulls_last()]
    return relational.latest_per_key(mine, ["satellite_id"], order).select("satellite_id", F.col("value").alias(out))


def _both(t: dict[str, DataFrame], a: str, b: str, attribute: str) -> DataFrame:
    """Entities of which both sources say something: the satellite's columns, va and vb."""
    claims = t["source_assertion"]
    return newest_claim(claims, a, attribute, "va").join(newest_claim(claims, b, attribute, "vb"), "satellite_id").join(t["satellite"], "satellite_id")


def _cases(t: dict[str, DataFrame], kind: str, rows: DataFrame, **facts: Column) -> DataFrame:
    keys = t["satellite_identifier"].where("id_type = 'jcat'").groupBy("satellite_id").agg(F.min("id_value").alias("_jcat"))
    ref = names.subject_ref(F.col("norad_id"), F.col("_jcat"), F.col("satellite_id"))
    return rows.join(keys, "satellite_id", "left").select(F.lit(kind).alias("case_type"), "satellite_id", ref.alias("subject_ref"), F.to_json(F.struct(*(c.alias(n) for n, c in facts.items()))).alias("facts"))


def ambiguous_designators(t: dict[str, DataFrame]) -> DataFrame:
    many = t["satellite_identifier"].where("id_type = 'cospar'").groupBy("id_value").agg(F.array_sort(F.collect_set("satellite_id")).alias("ids")).where(F.size("ids") > 1)
    return many.select(F.lit("ambiguous_cospar").alias("case_type"), F.lit(None).cast("long").alias("satellite_id"), F.concat(F.lit("cospar:"), "id_value").alias("subject_ref"), F.to_json(F.struct("ids")).alias("facts"))


def orphans(t: dict[str, DataFrame], a: str) -> DataFrame:
    """Payloads without a catalogue id of which the first source says nothing."""
    known = t["source_assertion"].where(F.col("source") == a).select("satellite_id").distinct()
    return _cases(t, "rideshare_orphan", t["satellite"].where("norad_id is null and object_type = 'PAYLOAD'").join(known, "satellite_id", "left_anti"), name=F.col("canonical_name"))


def missed_joins(t: dict[str, DataFrame], measure: str = "gestalt") -> DataFrame:
    """Each dated entity without a catalogue id, and the catalogued one of its launch window whose name is most like its own."""
    s = t["satellite"].where("launch_date is not null")
    side = lambda df, key: df.select(F.col("satellite_id").alias(key), F.col("canonical_name").alias("name"), "launch_date", F.lit("UNKNOWN").alias("regime"), F.lit(None).cast("string").alias("country"))
    probes = side(s.where("norad_id is null"), "probe_key").where(names.norm_name(F.col("name")) != "")
    best = fuzzy.link(probes, side(s.where("norad_id is not null"), "satellite_id"), {"name": 1.0, "launch": 0.0, "regime": 0.0}, low=LIKELY, measure=measure, places=4)
    best = best.where("satellite_id is not null").withColumn("sim", F.round("score", 4)).orderBy(F.desc("sim"), "probe_key").limit(TARGETS["missed_join_candidate"])
    rows = best.select(F.col("probe_key").alias("satellite_id"), F.lit(None).cast("long").alias("norad_id"), F.col("satellite_id").alias("candidate"), "sim")
    return _cases(t, "missed_join_candidate", rows, candidate=F.col("candidate"), similarity=F.col("sim"))


def owner_disputes(t: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """Owner codes that name two commercial operators, neither of which is the other's parent."""
    ops, fold = t["operator"], lambda c: F.lower(F.trim(c))
    known = ops.select(F.lower("canonical_name").alias("k"), "operator_id").union(t["operator_alias"].select(F.lower("alias"), "operator_id")).groupBy("k").agg(F.min("operator_id").alias("op"))
    side = lambda x: known.join(ops.where("operator_class = 'commercial'"), F.col("op") == F.col("operator_id")).select(F.col("k").alias(f"k{x}"), F.col("op").alias(f"o{x}"), F.col("canonical_name").alias(f"n{x}"))
    rows = _both(t, a, b, "owner").withColumn("ka", fold("va")).withColumn("kb", fold("vb")).join(side("a"), "ka").join(side("b"), "kb").where("oa <> ob")
    rel = t["operator_relationship"].select(F.col("child_id").alias("oa"), F.col("parent_id").alias("ob"))
    rows = rows.join(rel.union(rel.select("ob", "oa")).distinct(), ["oa", "ob"], "left_anti").join(t["size"], "norad_id", "left")
    return _cases(t, "owner_dispute", rows.orderBy(F.col("rcs").desc_nulls_last(), F.col("norad_id").asc_nulls_last(), "satellite_id").limit(TARGETS["owner_dispute"]), a=F.col("na"), b=F.col("nb"))


def status_conflicts(t: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    word = lambda s, v, c: t["status_mapping"].where((F.col("source") == s) & (F.col("canonical_status") != "UNKNOWN")).select(F.col("value").alias(v), F.col("canonical_status").alias(c))
    rows = _both(t, a, b, "status").join(word(a, "va", "sa"), "va").join(word(b, "vb", "sb"), "vb").where("sa <> sb")
    return _cases(t, "status_conflict", rows, a=F.col("sa"), b=F.col("sb"))


def decay_conflicts(t: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """The largest disagreements between dates that both parse."""
    rows = _both(t, a, b, "decay_date").withColumn("days", F.abs(F.datediff(dates.parse_date_loose(F.col("va")), dates.parse_date_loose(F.col("vb"))))).where("days > 0")
    return _cases(t, "decay_conflict", rows.orderBy(F.desc("days"), "satellite_id").limit(TARGETS["decay_conflict"]), days=F.col("days"))


def type_conflicts(t: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """Debris to the one source and a payload to the other, from each launch decade in turn."""
    rows = _both(t, a, b, "object_type").where((names.object_type(F.col("va")) == "DEBRIS") & (names.object_type(F.col("vb")) == "PAYLOAD")).withColumn("decade", dates.decade(F.col("launch_date")))
    return _cases(t, "type_conflict", relational.round_robin(rows, "decade", [F.col("norad_id").asc_nulls_last(), F.col("satellite_id").asc()], TARGETS["type_conflict"]), decade=F.col("decade"))


def stale_owners(t: dict[str, DataFrame]) -> DataFrame:
    """Entities whose ownership was split at a deal, from each deal in turn."""
    deals = t["operator_relationship"].where("relationship in ('acquired_by', 'merged_into')").select("child_id", "parent_id")
    own = t["satellite_operator"].where("role = 'owner'")
    child = own.where("valid_to is not null").select(F.col("operator_id").alias("child_id"), "satellite_id", F.col("valid_to").alias("until"))
    parent = own.where("valid_to is null").select(F.col("operator_id").alias("parent_id"), "satellite_id")
    rows = deals.join(child, "child_id").join(parent, ["parent_id", "satellite_id"]).join(t["satellite"], "satellite_id").withColumn("deal", F.struct("child_id", "parent_id"))
    return _cases(t, "stale_owner", relational.round_robin(rows, "deal", [F.col("norad_id").asc_nulls_last(), F.col("satellite_id").asc()], TARGETS["stale_owner"]), child=F.col("child_id"), until=F.col("until"))


def gold_cases(t: dict[str, DataFrame], a: str = "satcat", b: str = "gcat", measure: str = "gestalt") -> DataFrame:
    """All eight strata; names are compared by a measure of fuzzy.link."""
    strata = [ambiguous_designators(t), orphans(t, a), missed_joins(t, measure), owner_disputes(t, a, b), status_conflicts(t, a, b), decay_conflicts(t, a, b), type_conflicts(t, a, b), stale_owners(t)]
    return reduce(DataFrame.unionByName, strata)
