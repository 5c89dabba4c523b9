"""Every registered query against its SQL in DuckDB, and batch against stream."""

import datetime as dt
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from orbitspark.plans import registry, standins
from orbitspark.plans.api import Engine, Kept
from orbitspark.streaming import rollup

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float, decimal.Decimal)) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf, duck):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql:
        r = duck.sql(sql)
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    else:
        assert got


def test_stream_equals_batch(spark, sf, tmp_path):
    e = standins.table(spark, sf, "events")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = rollup.timed(rollup.source(spark, str(tmp_path / "in"), e.schema), "ts", "60 days")
    days = rollup.daily(rollup.deduplicated(stream, ["event_id"]), "user_id", "ts", "value")
    q = days.writeStream.outputMode("update").foreachBatch(rollup.keep_table(str(tmp_path / "out"), ["user_id", "day"], {})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    got = {(r["user_id"], r["day"]): (r["n"], round(r["value_avg"], 9)) for r in spark.read.parquet(str(tmp_path / "out" / f"batch={last}")).collect()}
    want = {(r["user_id"], r["day"]): (r["n"], round(r["value_avg"], 9)) for r in standins.events_daily(spark, sf).collect()}
    assert got == want


def test_serve_prefers_the_tail(spark):
    old = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1), (1, dt.date(2024, 1, 2), 1)], "k int, day date, n int")
    tail = spark.createDataFrame([(1, dt.date(2024, 1, 2)), (1, dt.date(2024, 1, 2))], "k int, day date")
    out = rollup.serve(old, tail, lambda t: t.groupBy("k", "day").agg(F.count(F.lit(1)).cast("int").alias("n")))
    assert sorted(r["n"] for r in out.collect()) == [1, 2]


def test_engine(spark, sf):
    e = Engine({"product": standins._products(spark, sf), "slug_alias": spark.createDataFrame([("bus", "old", "Brand#1")], "kind string, old_slug string, new_slug string")})
    top = e.query("leaderboard", sort="fleet", limit=3).collect()
    assert len(top) == 3 and top[0]["fleet_total"] >= top[1]["fleet_total"]
    for metric in ("fleet_total", "fleet_active", "decayed_count", "disposal_n", "sk_n"):
        assert e.query("receipts", slug=top[0]["slug"], metric=metric).count() == top[0][metric]
    assert e.resolve_slug("bus", "old") == "Brand#1" and e.resolve_slug("bus", "gone") is None
    with pytest.raises(ValueError):
        e.query("leaderboard", sort="; drop")
    with pytest.raises(ValueError):
        e.query("nothing")


def test_kept_reads_anew_after_its_time(spark):
    t, n = [0.0], []
    k = Kept(lambda: (n.append(1), spark.range(1))[1], 10, lambda: t[0])
    k.get(), k.get()
    t[0] = 11
    k.get()
    assert len(n) == 2
