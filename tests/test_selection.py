"""Percentiles by selection against those by aggregation."""

import numpy as np
from pyspark.sql import functions as F

from orbitspark.operators import selection

WANTED = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p999": 0.999, "top": 1.0}


def test_selection_equals_aggregation(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.normal(size=5_000)] + [("b", 1.0)] * 3_000 + [("b", float(v)) for v in range(1_500)] + [(None, float(v)) for v in rng.integers(0, 5, 2_001)]
    rows += [("a", None), ("c", None), ("d", 4.0), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    get = lambda large: {r["k"]: tuple(r) for r in selection.percentiles(df, ["k"], "v", WANTED, large).collect()}
    want = get(10**9)
    for large in (1_000, 1):
        got = get(large)
        assert got.keys() == want.keys() and len(got) == 6
        for k, r in want.items():
            assert got[k][:2] == r[:2]
            assert np.allclose(np.array(got[k][2:], float), np.array(r[2:], float), equal_nan=True, rtol=1e-12)
    assert want["c"][1:] == (0, *[None] * 6)
    both = df.withColumn("j", F.lit(1))
    assert selection.percentiles(both, ["k", "j"], "v", {"m": 0.5}, 100).count() == 6
    assert selection.percentiles(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0


def test_no_task_holds_a_group(spark):
    """One group of distinct values and one value that half of all rows have: the ranges stay even."""
    df = spark.range(60_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    r = selection.percentiles(df, ["k"], "v", {"m": 0.75}, 1_000).first()
    assert r["n"] == 60_000 and r["m"] == df.selectExpr("percentile(v, 0.75)").first()[0]
    dealt = df.repartitionByRange(4, "k", "v", F.rand(7)).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(x["count"] for x in dealt) < 30_000
