"""Incremental rollups, and latest state that ends."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from orbitspark.streaming import rollup, state
from orbitspark.streaming.materialise import Materialised

T = dt.datetime
FACTS = "k long, ts timestamp, v double"


def daily(facts):
    return facts.groupBy("k", F.to_date("ts").alias("day")).agg(F.avg("v").alias("avg"), F.count(F.lit(1)).alias("n"))


def facts_of(spark, days, k=3, v=1.0):
    return spark.createDataFrame([(i, T(2024, 1, d, 5 + i), v * d) for d in days for i in range(k)], FACTS)


def versions(path):
    return sorted((d.name, v.name) for d in (path / "rollup").iterdir() if d.is_dir() for v in d.iterdir() if v.is_dir())


def same(a, b):
    key = lambda df: sorted(map(tuple, df.select("k", "day", "avg", "n").collect()))
    assert key(a) == key(b)


def test_only_touched_days_are_made_again(spark, tmp_path):
    m = Materialised(spark, f"file://{tmp_path}", FACTS, "ts", daily)
    assert m.refresh() == [] and m.current().count() == 0
    parts = [facts_of(spark, range(1, 11)), facts_of(spark, (3, 7), v=5.0), facts_of(spark, (20,))]
    m.land(parts[0], 0)
    assert len(m.refresh()) == 10 and m.refresh() == []
    m.land(parts[1].union(spark.createDataFrame([(9, None, 1.0)], FACTS)), 1)
    same(m.current(), daily(parts[0].union(parts[1])))  # not refreshed, yet there
    same(m.materialised(), daily(parts[0]))
    assert m.refresh() == [dt.date(2024, 1, 3), dt.date(2024, 1, 7)]
    assert [d for d, v in versions(tmp_path) if v == "version=2"] == ["day=2024-01-03", "day=2024-01-07"]
    same(m.materialised(), daily(parts[0].union(parts[1])))
    m.land(parts[1], 1)  # the same batch again
    m.land(parts[2], 2)
    assert m.refresh() == [dt.date(2024, 1, 20)]
    same(m.current(), daily(parts[0].union(parts[1]).union(parts[2])))
    held = versions(tmp_path)
    m.land(facts_of(spark, (21,)), 3)
    m.refresh()
    assert ("day=2024-01-03", "version=1") not in versions(tmp_path) and len(versions(tmp_path)) <= len(held) + 1


def test_a_refresh_that_dies_changes_nothing(spark, tmp_path):
    m = Materialised(spark, f"file://{tmp_path}", FACTS, "ts", daily)
    m.land(facts_of(spark, (1, 2)), 0)
    m.refresh()
    m.land(facts_of(spark, (2,), v=9.0), 1)
    write = m._write
    m._write = lambda df, path: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        m.refresh()
    m._write = write
    same(m.materialised(), daily(facts_of(spark, (1, 2))))
    assert m.refresh() == [dt.date(2024, 1, 2)]
    same(m.materialised(), daily(facts_of(spark, (1, 2)).union(facts_of(spark, (2,), v=9.0))))


def test_policy_leaves_the_filling_day(spark, tmp_path):
    m = Materialised(spark, f"file://{tmp_path}", FACTS, "ts", daily)
    m.land(facts_of(spark, (1, 10, 14, 15)), 0)
    assert m.policy(T(2024, 1, 15, 12)) == [dt.date(2024, 1, 10), dt.date(2024, 1, 14)]
    assert {r[0].day for r in m.pending().collect()} == {1, 15}
    same(m.current(), daily(facts_of(spark, (1, 10, 14, 15))))


def test_stream_refreshes_by_trigger(spark, tmp_path):
    for i, days in enumerate([(1, 2, 3), (4,), (2,)]):  # the last file is late
        facts_of(spark, days, v=i + 1.0).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
        time.sleep(0.05)
    stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    m = Materialised(spark, f"file://{tmp_path}/m", FACTS, "ts", daily)
    m.follow(stream)
    made = {}
    for day, version in versions(tmp_path / "m"):
        made.setdefault(version, []).append(day[-2:])
    assert made == {"version=1": ["01", "02", "03"], "version=2": ["04"], "version=3": ["02"]}
    same(m.materialised(), daily(spark.read.schema(FACTS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")))
    m.follow(stream)  # nothing new
    assert len(versions(tmp_path / "m")) == 5


def test_latest_state_ends(spark, tmp_path):
    schema = "k long, ts timestamp, id long, v double"
    for i in range(6):
        if i == 0:
            rows = [(k, T(2024, 1, 1, k % 24), k, 1.0) for k in range(60)] + [(5, T(2024, 1, 1, 5), 2, 7.0), (None, None, 3, 1.0)]
        else:
            rows = [(k, T(2024, 1, 1) + dt.timedelta(days=20 * i), 1000 * i + k, float(i)) for k in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    found = state.latest(rollup.timed(stream, "ts", "1 days"), "k", "ts", "id", ["v"], "30 days")
    changes, held = state.run_into_log(found, f"file://{tmp_path}/log")
    assert max(held) >= 60 and held[-1] <= 20  # a key costs its row and its timer
    first = {r["k"]: r for r in changes.where("batch = 0").collect()}
    assert len(first) == 60 and (first[5]["id"], first[5]["v"]) == (2, 7.0)
    assert sorted((r["k"], r["v"]) for r in changes.where("batch = 5").collect()) == [(k, 5.0) for k in range(5)]
