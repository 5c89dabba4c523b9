"""The identity programs as frames in, frames out: deterministic matching, promotion, churn, resolution, attribution.

Entities, identifiers, claims and logs have the shapes of schemas.py. A stage returns the tables it changes; the caller
writes all of them, then swaps versions, so a failed run leaves the old graph.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, names
from ..operators import mutations, relational


def match_by_catalogue_id(satellites: DataFrame, identifiers: DataFrame, rows: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(norad_id, name, cospar, object_type, launch_date) → satellites with the new ids' entities, identifiers and a log of the
    links made. Rows of one id make one entity, the smallest name's."""
    fresh = relational.latest_per_key(rows.where("norad_id is not null"), ["norad_id"], [F.col("name").asc_nulls_last()])
    new = fresh.join(satellites.select("norad_id"), "norad_id", "left_anti")
    made = mutations.with_ids(satellites, new, "satellite_id", [F.col("norad_id").asc()]).select("satellite_id", "norad_id", names.norm_cospar(F.col("cospar")).alias("cospar"), F.col("name").alias("canonical_name"), names.object_type(F.col("object_type")).alias("object_type"), "launch_date", F.lit(None).cast("date").alias("decay_date"), F.lit("anchored").alias("anchor_state"))
    satellites = satellites.unionByName(made)
    ids, log = _link(satellites, identifiers, fresh.select("norad_id", F.lit("norad").alias("id_type"), F.col("norad_id").cast("string").alias("id_value")), ["norad_id"], source, "norad")
    return satellites, ids, log


def match_by_designator(satellites: DataFrame, identifiers: DataFrame, rows: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows(source_key, cospar, name, object_type, launch_date) without a catalogue id: linked to the entity of their designator (the
    smallest id where there are several), else made, one entity per designator. Also returns the designators that were ambiguous."""
    r = rows.withColumn("cospar", names.norm_cospar(F.col("cospar"))).where("cospar is not null")
    known = satellites.where("cospar is not null").groupBy("cospar").agg(F.min("satellite_id").alias("satellite_id"), F.count(F.lit(1)).alias("n"))
    ambiguous = known.where("n > 1").join(r.select("cospar").distinct(), "cospar", "left_semi").select("cospar", "n")
    new = relational.latest_per_key(r.join(known, "cospar", "left_anti"), ["cospar"], [F.col("source_key").asc()])
    made = mutations.with_ids(satellites, new, "satellite_id", [F.col("cospar").asc()]).select("satellite_id", F.lit(None).cast("long").alias("norad_id"), "cospar", F.col("name").alias("canonical_name"), names.object_type(F.col("object_type")).alias("object_type"), "launch_date", F.lit(None).cast("date").alias("decay_date"), F.lit("provisional").alias("anchor_state"))
    satellites = satellites.unionByName(made)
    whole = known.select("cospar", "satellite_id").unionByName(made.select("cospar", "satellite_id"))
    links = r.join(whole, "cospar").select("satellite_id", F.lit("source_key").alias("id_type"), F.col("source_key").alias("id_value"))
    ids, log = _link(None, identifiers, links, None, source, "cospar")
    return satellites, ids, log, ambiguous


def _link(satellites, identifiers, links, on, source, rule):
    if on:
        links = links.join(satellites.select(*on, "satellite_id"), on).drop(*on)
    new = links.select("satellite_id", "id_type", "id_value", F.lit(source).alias("source"), F.lit(1.0).cast("decimal(3,2)").alias("confidence"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    keys = ["satellite_id", "id_type", "id_value", "source"]
    out, log = mutations.insert_with_log(identifiers, new, keys, [*map(F.col, keys), F.lit(rule).alias("rule"), F.lit(1.0).cast("decimal(4,3)").alias("score"), F.to_json(F.struct("id_type", "id_value")).alias("details")])
    return out, log


def promotion_pairs(satellites: DataFrame) -> DataFrame:
    """Provisional entities whose designator and launch date are those of exactly one anchored one, and the name gate's verdict."""
    p = satellites.where("norad_id is null and cospar is not null").select("cospar", F.col("satellite_id").alias("merged_id"), F.col("canonical_name").alias("pn"), F.col("launch_date").alias("pl"))
    a = satellites.where("norad_id is not null and cospar is not null").select("cospar", F.col("satellite_id").alias("aid"), F.col("canonical_name").alias("an"), F.col("launch_date").alias("al"))
    j = p.join(a, "cospar").where(F.col("pl").eqNullSafe(F.col("al")))
    one = j.groupBy("merged_id").agg(F.min("aid").alias("surviving_id"), F.count_distinct("aid").alias("n"), F.max("pn").alias("provisional_name"), F.max("an").alias("anchored_name"), F.min("cospar").alias("cospar")).where("n = 1").drop("n")
    return one.withColumn("decision", F.when(names.name_gate(F.col("provisional_name"), F.col("anchored_name")), "merged").otherwise("declined"))


def promote(satellites: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Fold the merged pairs' provisional entities into the anchored ones. children: name → (table, natural key)."""
    pairs = promotion_pairs(satellites)
    merged = pairs.where("decision = 'merged'").select("merged_id", "surviving_id")
    out = {k: mutations.merge_entities(t, merged, key) for k, (t, key) in children.items()}
    return mutations.drop_merged(satellites, merged), out, pairs


def detect_churn(previous: DataFrame, current: DataFrame, identifiers: DataFrame, key: str, referent: str, id_type: str, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """Identifiers with those whose referent changed, or that left the source, closed; and the events."""
    same = current.join(previous, [key, referent], "left_semi").select(F.col(key).cast("string").alias("id_value"))
    arrived = current.join(previous.select(key), key, "left_anti").select(F.col(key).cast("string").alias("id_value"))
    mine, rest = identifiers.where(F.col("id_type") == id_type), identifiers.where(F.col("id_type") != id_type)
    kept, events = mutations.expire(mine, same.unionByName(arrived), ["id_value"], as_of)
    return rest.unionByName(kept.select(*identifiers.columns)), events


def resolve(satellites: DataFrame, claims: DataFrame, precedence: dict[str, list[str]]) -> DataFrame:
    """satellites with name, type and decay date by their claims' precedence; what no claim says stays."""
    def win(attribute: str) -> DataFrame:
        c = relational.latest_per_key(claims.where((F.col("attribute") == attribute) & F.col("satellite_id").isNotNull()), ["satellite_id", "source"], [F.col("observed_at").desc_nulls_last(), F.col("source_key").asc()])
        return relational.by_precedence(c, ["satellite_id"], "source", precedence[attribute]).select("satellite_id", F.col("value").alias(f"_{attribute}"))

    out = satellites
    for a in ("name", "object_type", "decay_date"):
        out = out.join(win(a), "satellite_id", "left")
    return out.withColumns({"canonical_name": F.coalesce("_name", "canonical_name"), "object_type": F.coalesce(F.nullif(names.object_type(F.col("_object_type")), F.lit("UNKNOWN")), "object_type"), "decay_date": F.coalesce(dates.parse_date_loose(F.col("_decay_date")), "decay_date")}).select(*satellites.columns)


def resolve_status(claims: DataFrame, taxonomy: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(satellite_id, status, source), a source whose value maps to UNKNOWN or to nothing falling through; and unmapped values with counts."""
    c = claims.where("attribute = 'status'").join(taxonomy.select("source", F.col("value"), "canonical_status"), ["source", "value"], "left")
    unmapped = c.where("canonical_status is null").groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))
    known = c.where("canonical_status is not null and canonical_status <> 'UNKNOWN'")
    return relational.by_precedence(known, ["satellite_id"], "source", order).select("satellite_id", F.col("canonical_status").alias("status"), "source"), unmapped


def resolve_owners(satellites: DataFrame, claims: DataFrame, aliases: DataFrame, acquisitions: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Half-open ownership from owner claims: the first source, by order, whose value an alias knows; and the values none knew."""
    c = claims.where("attribute = 'owner' and satellite_id is not null").withColumn("alias", F.lower(F.trim("value")))
    j = c.join(aliases.select(F.lower("alias").alias("alias"), "operator_id").distinct(), "alias", "left")
    won = relational.by_precedence(j.where("operator_id is not null"), ["satellite_id"], "source", order).select("satellite_id", "operator_id")
    lost = relational.by_precedence(j, ["satellite_id"], "source", order).join(won, "satellite_id", "left_anti").select("value").distinct()
    return mutations.split_ownership(won.join(satellites.select("satellite_id", "launch_date"), "satellite_id"), acquisitions), lost


def attribute_products(rows: DataFrame, crosswalk: DataFrame, orgs: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """rows(source_key, norad_id, piece, bus, manufacturer) → one product row per entity: first of catalogue id, designator, source key.

    crosswalk(satellite_id, norad_id, cospar, source_key); orgs(code, parent_code, org_class, display_name). Makers roll up through
    business-class parents only.
    """
    r = rows.select("*", names.is_uncertain(F.col("bus")).alias("bus_uncertain"), names.certain(F.col("bus")).alias("bus_clean"), names.codes(F.col("manufacturer")).alias("manufacturer_codes"), F.coalesce(F.contains("manufacturer", F.lit("?")), F.lit(False)).alias("manufacturer_uncertain"))
    r = r.withColumn("bus_slug", names.slugify(F.col("bus_clean"), plus=True)).withColumn("primary_code", F.get("manufacturer_codes", F.lit(0))).withColumn("cospar", names.norm_cospar(F.col("piece")))
    tier = lambda key, rule: r.join(crosswalk.where(F.col(key).isNotNull()).select(key, "satellite_id"), key).withColumn("join_rule", F.lit(rule)).select("satellite_id", "join_rule", *r.columns)
    rules = [tier("norad_id", "anchored_norad"), tier("cospar", "anchored_cospar"), tier("source_key", "provisional")]
    rules = [relational.latest_per_key(t, ["satellite_id"], [F.col("bus_slug").asc_nulls_last(), F.col("source_key").asc()]) for t in rules]
    won = relational.first_rule_wins(rules, ["satellite_id"])
    shown = r.where("bus_slug is not null").groupBy("bus_slug").agg(F.expr("mode() within group (order by bus_clean)").alias("bus_model"))
    patch = F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)) if overrides else None
    edges = orgs.select("code", F.coalesce(F.try_element_at(patch, F.col("code")), "parent_code").alias("parent_code") if patch is not None else F.col("parent_code"))
    up = relational.walk_up(edges, orgs.where("org_class = 'B'").select("code")).select(F.col("leaf").alias("primary_code"), F.col("root").alias("group_code"), F.col("path").alias("rollup_path"))
    shownorg = orgs.select(F.col("code").alias("group_code"), F.col("display_name").alias("manufacturer_name"))
    j = won.join(shown, "bus_slug", "left").join(up, "primary_code", "left").withColumn("group_code", F.coalesce("group_code", "primary_code")).join(shownorg, "group_code", "left")
    source = F.when(F.col("primary_code").isNull(), None).when(F.col("rollup_path").isNull(), "unresolved").when(F.size("rollup_path") == 1, "leaf").otherwise("gcat_orgs")
    return j.select("satellite_id", "bus_slug", "bus_model", "bus_uncertain", names.slugify(F.col("group_code")).alias("manufacturer_slug"), F.coalesce("manufacturer_name", "group_code").alias("manufacturer_name"), F.col("manufacturer").alias("manufacturer_raw"), "manufacturer_codes", "manufacturer_uncertain", "rollup_path", source.alias("rollup_source"), "join_rule")


def credits(products: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """satellite_id, manufacturer_slug, position, arity, uncertain: a credit per maker named, at its first place; guesses (marked '?')
    count in the first place only."""
    t = products.where("manufacturer_raw is not null").select("satellite_id", F.split("manufacturer_raw", "/").alias("t"))
    x = t.select("satellite_id", F.size("t").cast("smallint").alias("arity"), F.posexplode("t").alias("p", "token"))
    x = x.select("satellite_id", (F.col("p") + 1).cast("smallint").alias("position"), "arity", F.contains("token", F.lit("?")).alias("uncertain"), F.nullif(F.trim(F.regexp_replace(F.trim("token"), r"\?+$", "")), F.lit("")).alias("code"))
    x = x.where("code is not null and (position = 1 or not uncertain)")
    if up is not None:
        x = x.join(up.select(F.col("leaf").alias("code"), F.col("root").alias("_g")), "code", "left").withColumn("code", F.coalesce("_g", "code"))
    x = x.withColumn("manufacturer_slug", names.slugify(F.col("code"))).where("manufacturer_slug is not null")
    return relational.latest_per_key(x, ["satellite_id", "manufacturer_slug"], [F.col("position").asc()]).select("satellite_id", "manufacturer_slug", "position", "arity", "uncertain")


def authorisations(grants: DataFrame, entities: DataFrame, patterns: DataFrame, strict: bool = False, most: int = 10_000) -> DataFrame:
    """grants(call_sign, name, frequency_range) to entities(satellite_id, name): by pattern (grant_like, entity_prefix), then by a
    normalised name that one entity has; strict asks that one grant has it too.

    Patterns are a curated list: more than `most` raise. An entity meets a pattern by equality of its name's head, for each length that
    a prefix has, so entities are joined by hash whatever their number.
    """
    p = patterns.select(F.lower("grant_like").alias("gl"), F.lower("entity_prefix").alias("ep")).where("gl is not null and ep is not null").distinct()
    likely = relational.pattern_join(grants, p, F.contains(F.lower("name"), F.col("gl")), most).select("call_sign", "frequency_range", "ep")
    lengths = sorted(r[0] for r in p.select(F.length("ep")).distinct().collect())  # `most` rows at most
    heads = F.array(*(F.substring("_en", 1, n) for n in lengths)).cast("array<string>")
    named = entities.select("satellite_id", F.lower("name").alias("_en")).select("satellite_id", F.explode(F.array_distinct(heads)).alias("ep"))
    tier1 = likely.join(named, "ep").select("satellite_id", "call_sign", "frequency_range", F.lit("pattern").alias("match_tier"))
    e = entities.select("satellite_id", names.name_key(F.col("name")).alias("_k")).where("_k is not null")
    g = grants.withColumn("_k", names.name_key(F.col("name"))).where("_k is not null")
    if strict:
        g = g.join(g.groupBy("_k").agg(F.count_distinct("call_sign").alias("_n")).where("_n = 1").select("_k"), "_k", "left_semi")
    tier2 = relational.unique_matches(g, e, "_k", "satellite_id").select("satellite_id", "call_sign", "frequency_range", F.lit("name").alias("match_tier"))
    return relational.first_rule_wins([tier1.distinct(), tier2.distinct()], ["call_sign", "frequency_range"])


def enrich_operators(seeds: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """seeds(name, code) and orgs(code, name, parent_code) → operators(name, made), aliases(code, name), edges(child, parent).

    A code that a seed has is the seed's. Of the other codes the smallest one takes its organisation's name, unless a seed bears it;
    a code whose name is taken, in whatever case, gets the name with the code behind it. An edge joins two operators whose
    codes are parent and child.
    """
    fold = lambda c: F.lower(F.trim(c))
    new = orgs.where("code is not null and name is not null").join(seeds.select("code").where("code is not null").distinct(), "code", "left_anti")
    new = relational.latest_per_key(new, ["code"], [F.col("name").asc(), F.col("parent_code").asc_nulls_last()]).withColumn("_f", fold(F.col("name")))
    behind = F.concat("name", F.lit(" ("), "code", F.lit(")"))
    ranked = new.withColumn("_r", F.row_number().over(Window.partitionBy("_f").orderBy("code")))
    ranked = ranked.join(seeds.select(fold(F.col("name")).alias("_f"), F.lit(True).alias("_seed")).distinct(), "_f", "left")
    ranked = ranked.withColumn("_own", (F.col("_r") == 1) & F.col("_seed").isNull())
    # a name that an earlier code was given in its long form is taken too
    given = ranked.where(~F.col("_own")).select(fold(behind).alias("_f"), F.col("code").alias("_by"))
    ranked = ranked.join(given.groupBy("_f").agg(F.min("_by").alias("_by")), "_f", "left")
    made = ranked.select("code", F.when(F.col("_own") & ~F.coalesce(F.col("_by") < F.col("code"), F.lit(False)), F.col("name")).otherwise(behind).alias("name"))
    operators = seeds.select("name", F.lit(False).alias("made")).distinct().unionByName(made.select("name", F.lit(True).alias("made")))
    aliases = seeds.where("code is not null").select("code", "name").unionByName(made)
    up = orgs.where("parent_code is not null").select("code", "parent_code").distinct()
    side = lambda code, name: aliases.select(F.col("code").alias(code), F.col("name").alias(name))
    edges = up.join(side("code", "child"), "code").join(side("parent_code", "parent"), "parent_code").where("child <> parent").select("child", "parent").distinct()
    return operators, aliases, edges
