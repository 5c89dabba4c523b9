import datetime as dt

import pytest
from pyspark.sql import functions as F

from orbitspark.operators import compare, fuzzy, mutations, relational
from orbitspark.plans import identity, metrics
from orbitspark.schemas import CheckFailed, assert_domain, assert_unique

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_ownership_boundary(spark):
    days = spark.createDataFrame([(1, D(2024, 1, i), 1.0) for i in (1, 2, 3)], "user_id long, day date, value_avg double")
    own = spark.createDataFrame([(1, "a", D(2024, 1, 1), D(2024, 1, 3)), (1, "b", D(2024, 1, 3), None)], "user_id long, owner string, valid_from date, valid_to date")
    assert [r[3] for r in rows(relational.scd2_join(days, own, "user_id"), "day")] == ["a", "a", "b"]
    none = relational.scd2_join(days, own.where("owner = 'b'"), "user_id")
    assert [r[3] for r in rows(none, "day")] == [None, None, "b"]


def test_rolling_by_value_range(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1), 1.0), (1, D(2024, 1, 31), 3.0), (1, D(2024, 2, 1), 5.0)], "k int, day date, v double")
    got = [r[3] for r in rows(relational.rolling_stddev(df, "k", "day", "v", 30, "s"), "day")]
    assert got[0] is None and got[1] == pytest.approx(2**0.5) and got[2] == pytest.approx(2**0.5)


def test_islands_and_time_to_operational(spark):
    day = [D(2024, 1, i) for i in range(1, 12)]
    owned = spark.createDataFrame([(1, d, 100.0 if i < 3 else 500.0, "x") for i, d in enumerate(day)], "k int, day date, value_avg double, owner string")
    launch = spark.createDataFrame([(1, day[0])], "k int, launch_day date")
    got = metrics.time_to_operational(owned, "k", "owner", launch, F.lit(day[3]), 15.0, 7).first()
    assert got["days"] == 3 and got["shell_n"] == 1
    assert rows(relational.islands(owned.where("value_avg = 500"), "k", "day"))[0][3] == 8


def test_compliance_is_three_valued(spark):
    act = spark.createDataFrame([(1, D(2015, 1, 1)), (2, D(2015, 1, 1)), (3, D(2023, 1, 1))], "k int, last_active date")
    dec = spark.createDataFrame([(1, D(2021, 1, 1)), (2, D(2019, 1, 1))], "k int, decay_date date")
    assert [r["compliant"] for r in metrics.compliance(act, dec, "k", F.lit(D(2024, 1, 1))).orderBy("k").collect()] == [False, True, None]


def test_fuzzy_bands_and_gates(spark):
    p = spark.createDataFrame([("a", "STARLINK-30042", D(2023, 1, 1), "LEO", None), ("b", "ONEWEB-0012", D(2023, 6, 1), "LEO", None), ("c", "GSAT 7", D(2022, 1, 1), "GEO", None)], "probe_key string, name string, launch_date date, regime string, country string")
    e = spark.createDataFrame([(1, "Starlink 30042", D(2023, 1, 3), "LEO", None), (2, "OneWeb 0099", D(2023, 6, 10), "LEO", None), (3, "GSAT 7", D(2022, 1, 1), "LEO", None)], "satellite_id long, name string, launch_date date, regime string, country string")
    got = {r["probe_key"]: r for r in fuzzy.best_match(fuzzy.score(fuzzy.candidate_pairs(p, e))).collect()}
    assert got["a"]["decision"] == "auto" and 0.92 <= got["a"]["score"] <= 1
    assert got["b"]["decision"] == "review" and 0.75 <= got["b"]["score"] < 0.92
    assert "c" not in got


def test_split_ownership_edges(spark):
    o = spark.createDataFrame([(1, 10, D(2020, 1, 1)), (2, 10, D(2019, 12, 31)), (3, 10, None)], "satellite_id long, operator_id long, launch_date date")
    q = spark.createDataFrame([(10, 20, D(2020, 1, 1))], "child_id long, parent_id long, valid_from date")
    assert rows(mutations.split_ownership(o, q)) == [(1, 10, D(2020, 1, 1), None), (2, 10, D(2019, 12, 31), D(2020, 1, 1)), (2, 20, D(2020, 1, 1), None)]


def test_mutations_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "z", 2), (3, "c", 2), (3, "d", 2)], "k int, v string, t int")
    once = mutations.insert_ignore(old, new, ["k"])
    assert rows(once) == rows(mutations.insert_ignore(once, new, ["k"])) == [(1, "a", 1), (2, "b", 1), (3, "c", 2)]
    assert rows(mutations.insert_or_touch(old, new, ["k"], "t")) == [(1, "a", 1), (2, "b", 2), (3, "c", 2)]
    assert rows(mutations.upsert(old, new, ["k"], {"v": "old", "t": "new"}))[1] == (2, "b", 2)
    pairs = mutations.resolve_chains(spark.createDataFrame([(3, 2), (2, 1)], "merged_id long, surviving_id long"))
    assert rows(pairs) == [(2, 1), (3, 1)]
    child = spark.createDataFrame([(1, "x", "keep"), (3, "x", "lose"), (3, "y", "move")], "satellite_id long, t string, v string")
    assert rows(mutations.merge_entities(child, pairs, ["satellite_id", "t"])) == [(1, "x", "keep"), (1, "y", "move")]
    ids = spark.createDataFrame([("a", None), ("b", D(2020, 1, 1)), ("c", None)], "id_value string, valid_to date")
    out, events = mutations.expire(ids, spark.createDataFrame([("a",), ("b",)], "id_value string"), ["id_value"], D(2024, 1, 1))
    assert rows(out) == [("a", None), ("b", None), ("c", D(2024, 1, 1))] and rows(events.select("id_value", "event")) == [("b", "revived"), ("c", "expired")]
    frozen = mutations.freeze_month(spark.createDataFrame([], "month string, kind string, slug string, payload string"), spark.createDataFrame([("s", 1)], "slug string, n int"), "2024-01", "bus")
    assert mutations.freeze_month(frozen, spark.createDataFrame([("t", 2)], "slug string, n int"), "2024-01", "bus").count() == 1


def test_groups_close_when_a_label_repeats(spark):
    got = {}
    for case, labels in enumerate(["AABB", "ABAB", "ABCA", "AAAA", "", "ABBA"]):
        df = spark.createDataFrame([(case, i, c, i * 2) for i, c in enumerate(labels)], "k int, i int, label string, more int")
        got[labels] = [r["group_id"] for r in relational.group_ids(df, ["k"], ["i"], "label").orderBy("i").collect()]
    assert got == {"AABB": [0, 1, 1, 2], "ABAB": [0, 0, 1, 1], "ABCA": [0, 0, 0, 1], "AAAA": [0, 1, 2, 3], "": [], "ABBA": [0, 0, 1, 1]}


def test_parent_walk(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "m"), ("m", None)], "code string, parent_code string")
    b = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    got = {r["leaf"]: (r["root"], r["path"]) for r in relational.walk_up(e, b).collect()}
    assert got["a"] == ("c", ["a", "b", "c"]) and got["d"] == ("d", ["d"])


def test_checks_and_comparisons(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2)], "slug string, n int")
    with pytest.raises(CheckFailed):
        assert_unique(df, ["slug"])
    with pytest.raises(CheckFailed):
        assert_domain(df, "slug", ["y"])
    kinds = {r["change"] for r in compare.diff(spark.createDataFrame([("a", 1), ("b", 1)], "slug string, n int"), spark.createDataFrame([("b", 2), ("c", 1)], "slug string, n int"), "slug", ["n"]).collect()}
    assert kinds == {"vanished", "appeared", "changed"}
    with pytest.raises(ValueError):
        relational.choose("nope", {})


def test_identity_graph_on_five_objects(spark):
    sat = spark.createDataFrame([], "satellite_id long, norad_id long, cospar string, canonical_name string, object_type string, launch_date date, decay_date date, anchor_state string")
    ids = spark.createDataFrame([], "satellite_id long, id_type string, id_value string, source string, confidence decimal(3,2), valid_from date, valid_to date")
    day = D(2020, 1, 1)
    cat = spark.createDataFrame([(5, "ALPHA 1", "2020-001A", "PAY", day), (7, "OBJECT B", "2020-001B", "PAY", day), (9, "GAMMA", "2020-002A", "DEB", day)], "norad_id long, name string, cospar string, object_type string, launch_date date")
    sat, ids, log = identity.match_by_catalogue_id(sat, ids, cat, "satcat")
    assert rows(sat.select("satellite_id", "norad_id")) == [(1, 5), (2, 7), (3, 9)] and log.count() == 3
    other = spark.createDataFrame([("S1", "2020-1A", "Alpha-1", "P", day), ("S2", "2021-5A", "New", "P", day)], "source_key string, cospar string, name string, object_type string, launch_date date")
    sat2, ids2, _, ambiguous = identity.match_by_designator(sat, ids, other, "gcat")
    assert sat2.count() == 4 and ids2.count() == 5 and ambiguous.count() == 0
    twin = sat2.unionByName(spark.createDataFrame([(50, None, "2020-001B", "Beta", "PAYLOAD", day, None, "provisional"), (51, None, "2020-002A", "Delta", "PAYLOAD", day, None, "provisional")], sat2.schema))
    left, children, pairs = identity.promote(twin, {"ids": (ids2, ["satellite_id", "id_type", "id_value"])})
    assert {r["merged_id"]: r["decision"] for r in pairs.collect()} == {50: "merged", 51: "declined"} and left.count() == 5
    claims = spark.createDataFrame([(1, "S1", "name", "Alpha One", "ucs", None), (1, "5", "name", "ALPHA 1", "satcat", None), (1, "5", "status", "+", "satcat", None), (1, "S1", "status", "?", "gcat", None), (1, "S1", "owner", "ACME", "gcat", None)], "satellite_id long, source_key string, attribute string, value string, source string, observed_at timestamp")
    assert identity.resolve(sat, claims, {"name": ["ucs", "gcat", "satcat"], "object_type": ["gcat"], "decay_date": ["satcat"]}).where("satellite_id = 1").first()["canonical_name"] == "Alpha One"
    tax = spark.createDataFrame([("satcat", "+", "ACTIVE"), ("gcat", "?", "UNKNOWN")], "source string, value string, canonical_status string")
    status, unmapped = identity.resolve_status(claims, tax, ["gcat", "satcat"])
    assert rows(status) == [(1, "ACTIVE", "satcat")] and unmapped.count() == 0
    own, lost = identity.resolve_owners(sat, claims, spark.createDataFrame([("acme", 77)], "alias string, operator_id long"), spark.createDataFrame([], "child_id long, parent_id long, valid_from date"), ["gcat"])
    assert rows(own) == [(1, 77, day, None)] and lost.count() == 0


def test_products_credits_and_operators(spark):
    r = spark.createDataFrame([("S1", 5, "2020-001A", "BSS-702MP+", "RAYM?/GSFC/ACME?"), ("S2", None, "2021-005A", "unk", "SPXS")], "source_key string, norad_id long, piece string, bus string, manufacturer string")
    x = spark.createDataFrame([(1, 5, "2020-001A", None), (4, None, "2021-005A", "S2")], "satellite_id long, norad_id long, cospar string, source_key string")
    o = spark.createDataFrame([("RAYM", "RTX", "B", "Raytheon"), ("RTX", None, "B", "RTX Corp"), ("SPXS", None, "B", "Arm"), ("SPX", None, "B", "Space")], "code string, parent_code string, org_class string, display_name string")
    got = {r["satellite_id"]: r for r in identity.attribute_products(r, x, o, {"SPXS": "SPX"}).collect()}
    assert got[1]["bus_slug"] == "bss-702mp-plus" and got[1]["manufacturer_name"] == "RTX Corp" and got[1]["join_rule"] == "anchored_norad"
    assert got[4]["bus_slug"] is None and got[4]["manufacturer_name"] == "Space" and got[4]["join_rule"] == "anchored_cospar"
    c = rows(identity.credits(spark.createDataFrame([(1, "RAYM?/GSFC/ACME?/RAYM")], "satellite_id long, manufacturer_raw string")), "position")
    assert [(x[1], x[2]) for x in c] == [("raym", 1), ("gsfc", 2)]
    seeds = spark.createDataFrame([("Acme", "AC")], "name string, code string")
    orgs = spark.createDataFrame([("ZZ", "acme", "AC"), ("AC", "x", None), ("B1", "Bee", "AC"), ("B2", "BEE", "B1"), ("C1", "Bee (b2)", "XX")], "code string, name string, parent_code string")
    ops, aliases, edges = identity.enrich_operators(seeds, orgs)
    assert {r["name"] for r in ops.collect()} == {"Acme", "acme (ZZ)", "Bee", "BEE (B2)", "Bee (b2) (C1)"}
    assert {r["code"]: r["name"] for r in aliases.collect()}["AC"] == "Acme"
    assert rows(edges) == [("BEE (B2)", "Bee"), ("Bee", "Acme"), ("acme (ZZ)", "Acme")]


def test_authorisations(spark):
    g = spark.createDataFrame([("S1", "Space Exploration Holdings", "10.7-12.7"), ("S2", "LoneSat", "1-2"), ("S3", "Twin", "1-2")], "call_sign string, name string, frequency_range string")
    e = spark.createDataFrame([(1, "STARLINK-1"), (2, "LONESAT"), (3, "Twin"), (4, "TWIN")], "satellite_id long, name string")
    p = spark.createDataFrame([("space exploration", "starlink")], "grant_like string, entity_prefix string")
    assert rows(identity.authorisations(g, e, p).select("satellite_id", "call_sign", "match_tier")) == [(1, "S1", "pattern"), (2, "S2", "name")]


def test_anchors_and_verdicts(spark):
    s = spark.createDataFrame([(1, 5, "provisional"), (2, None, "provisional")], "satellite_id long, norad_id long, anchor_state string")
    assert [r[2] for r in rows(mutations.refresh_anchors(s))] == ["anchored", "provisional"]
    c = spark.createDataFrame([("a", "x", None), ("a", "y", "incorrect")], "case_type string, subject_ref string, verdict string")
    v = spark.createDataFrame([("a", "x", "correct"), ("a", "y", "correct"), ("a", "z", "correct")], "case_type string, subject_ref string, verdict string")
    assert rows(mutations.restore_verdicts(c, v)) == [("a", "x", "correct"), ("a", "y", "incorrect")]


def test_sql_functions(spark):
    from orbitspark.functions import sql

    sql.register(spark)
    r = spark.sql("select name_key('STARLINK-30042 (v2)') a, name_key('--') b, launch_key('2023-54A') c, launch_key('junk') d").first()
    assert tuple(r) == ("starlink 30042", None, "2023-054", None)


def test_only_match_joins_no_products(spark):
    """j13_shared_designator: a key that many rows of both sides share costs a row of each, not their product."""
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "d"), (5, None), (6, "e"), (7, "f")], "l long, k string")
    right = spark.createDataFrame([(10, "a"), (10, "a"), (10, "b"), (20, "c"), (21, "c"), (None, "d"), (30, None), (40, "e"), (None, "e")], "r long, k string")
    got = relational.only_match(left, right, "k", "l", "r", F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == [(1, 10, 2), (2, 10, 1), (6, 40, 1)]
    many = spark.range(200_000)
    assert relational.only_match(many.select(F.lit(1).alias("k"), F.col("id").alias("l")), many.select(F.lit(1).alias("k"), F.col("id").alias("r")), "k", "l", "r").count() == 0
