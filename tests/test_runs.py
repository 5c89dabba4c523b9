"""Runs that are seen whole or not at all; merges to the end of their chains."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orbitspark.operators import mutations
from orbitspark.sources.runs import Runs

T = dt.datetime
ROWS = "k long, v string"


class Clock:
    def __init__(self):
        self.now = T(2024, 5, 1)

    def __call__(self):
        return self.now


@pytest.fixture
def runs(spark, tmp_path):
    return Runs(spark, f"file://{tmp_path}", Clock())


def keys(df):
    return sorted(r["k"] for r in df.collect())


def test_a_failed_run_leaves_nothing(spark, runs, tmp_path):
    good = lambda a, b: lambda: spark.range(a, b).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert runs.committed("t", ROWS).count() == runs.runs().count() == 0
    first = runs.land("s", "e", "t", good(0, 5))
    # one partition writes its rows, the other dies
    broken = lambda: spark.range(5, 9, 1, 2).select(F.when(F.col("id") == 8, F.raise_error(F.lit("lost line"))).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    with pytest.raises(Exception, match="lost line"):
        runs.land("s", "e", "t", broken)
    with pytest.raises(OSError, match="no answer"):
        runs.land("s", "e", "t", lambda: (_ for _ in ()).throw(OSError("no answer")))
    last = runs.land("s", "e", "t", good(9, 11))
    assert last > first and keys(runs.committed("t", ROWS)) == [0, 1, 2, 3, 4, 9, 10] and keys(runs.newest("t", ROWS)) == [9, 10]
    ledger = runs.runs().orderBy("ingest_run_id").collect()
    assert [r["status"] for r in ledger] == ["ok", "error", "error", "ok"] and [r["rows_ingested"] for r in ledger] == [5, 0, 0, 2]
    assert "lost line" in ledger[1]["notes"] and ledger[2]["notes"] == "no answer"
    assert not list((tmp_path / "attempts").iterdir()) and len(list((tmp_path / "tables" / "t").glob("ingest*"))) == 2


@pytest.mark.parametrize("moved", [False, True])
def test_a_killed_run_is_never_seen(spark, runs, tmp_path, monkeypatch, moved):
    """Killed before its folder is moved, or after that and before it is closed: then not even the error is written."""
    rows = lambda: spark.createDataFrame([(1, "a"), (2, "b")], ROWS)
    with monkeypatch.context() as m:
        event, rename = runs._event, runs._rename
        m.setattr(runs, "_event", lambda *v: event(*v) if v[4] == "running" else (_ for _ in ()).throw(KeyboardInterrupt))
        m.setattr(runs, "_delete", lambda path: None)
        if not moved:
            m.setattr(runs, "_rename", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            runs.land("s", "e", "t", rows)
    assert rename and runs.committed("t", ROWS).count() == 0 and runs.runs().first()["status"] == "running"
    assert runs.close_lost() == []  # it may still be at work
    runs.clock.now += dt.timedelta(days=2)
    (lost,) = runs.close_lost()
    assert runs.runs().first()["status"] == "error" and runs.close_lost() == []
    assert not list(tmp_path.glob(f"*/*{lost}")) and not list(tmp_path.glob(f"tables/t/*{lost}"))
    runs.land("s", "e", "t", rows)
    assert keys(runs.committed("t", ROWS)) == [1, 2]


def test_fresh_pulls_are_skipped(spark, runs):
    calls = []

    def rows():
        calls.append(1)
        return spark.createDataFrame([(1, None)], ROWS)

    hour = dt.timedelta(hours=1)
    assert runs.land("s", "e", "t", rows, hour) and runs.land("s", "e", "t", rows, hour) is None
    assert runs.land("s", "other", "t", rows, hour)
    runs.clock.now += 2 * hour
    assert runs.land("s", "e", "t", rows, hour) and len(calls) == 3
    assert [r["status"] for r in runs.runs().orderBy("ingest_run_id").collect()] == ["ok", "skipped_fresh", "ok", "ok"]
    assert runs.committed("t", ROWS).count() == 3


# ------------------------------------------------------------------ merges
def closed(spark, pairs):
    df = spark.createDataFrame(pairs, "merged_id long, surviving_id long")
    return sorted((r["merged_id"], r["surviving_id"], r["cyclic"]) for r in mutations.chain_ends(df).collect())


def test_chains_and_cycles(spark):
    chain = [(i, i - 1) for i in range(1, 1001)]
    ring = [(2000, 2001), (2001, 2002), (2002, 2000), (2010, 2011), (2011, 2002)]  # three in a ring, two that lead there
    odd = [(3000, 3000), (3001, 3005), (3001, 3003), (None, 1), (1, None)]
    got = closed(spark, chain + ring + odd)
    assert got[:1000] == [(i, 0, False) for i in range(1, 1001)]
    assert got[1000:] == [(2001, 2000, True), (2002, 2000, True), (2010, 2000, True), (2011, 2000, True), (3001, 3003, False)]
    assert closed(spark, []) == []


def test_children_follow_and_are_logged(spark):
    pairs = spark.createDataFrame([(3, 2), (2, 1), (8, 9), (9, 8)], "merged_id long, surviving_id long")
    named = spark.createDataFrame([(1, "x", "keep"), (3, "x", "lose"), (2, "y", "move"), (9, "z", "to 8")], "satellite_id long, t string, v string")
    facts = spark.createDataFrame([(3, 1), (3, 2), (7, 3)], "satellite_id long, n int")
    out, log = mutations.merge_all({"named": (named, ["satellite_id", "t"]), "facts": (facts, None)}, pairs)
    assert sorted(map(tuple, out["named"].collect())) == [(1, "x", "keep"), (1, "y", "move"), (8, "z", "to 8")]
    assert sorted(map(tuple, out["facts"].collect())) == [(1, 1), (1, 2), (7, 3)]
    assert sorted(map(tuple, log.where("child = 'facts'").collect())) == [(2, 1, "merge", "facts", 0), (3, 1, "merge", "facts", 2), (9, 8, "cycle", "facts", 0)]
