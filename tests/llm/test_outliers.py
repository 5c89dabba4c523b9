"""Vector search where queries are unlike the rest and where many vectors are equal."""

import numpy as np
from pyspark.sql import functions as F

from orbitspark.llm import ann


def searched(spark, x, asked):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(rows, F.col("vec_id").isin(asked)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def truth(x, asked):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sims = u[asked] @ u.T
    sims[np.arange(len(asked)), asked] = -np.inf
    return sims


def recall(got, x, asked, k=5):
    """Share of found scores that reach the k-th best one: ties may go either way by a rounding."""
    sims = truth(x, asked)
    least = -np.sort(-sims, 1)[:, k - 1]
    return np.mean([sum(s >= m - 1e-9 for _, _, s in got.get(q, [])) / k for q, m in zip(asked, least, strict=True)])


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.normal(size=(200, 32)), 10, axis=0), rng.normal(size=(40, 32))])
    asked = list(range(2000, 2040))
    got = searched(spark, x, asked)
    assert all([r for r, *_ in sorted(got[q])] == [1, 2, 3, 4, 5] for q in asked)
    assert recall(got, x, asked) >= 0.9
    copies = searched(spark, x, list(range(0, 2000, 50)))
    assert all(len(v) == 5 and all(s > 1 - 1e-9 for *_, s in v) for v in copies.values()) and len(copies) == 40


def test_queries_unlike_the_rest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(100, 32))
    x = np.concatenate([np.repeat(centres, 50, axis=0) + 0.01 * rng.normal(size=(5000, 32)), rng.normal(size=(50, 32))])
    asked = list(range(5000, 5050))
    got = searched(spark, x, asked)
    assert all([r for r, *_ in sorted(got[q])] == [1, 2, 3, 4, 5] for q in asked)
    assert recall(got, x, asked) >= 0.95


def test_fewer_candidates_than_asked(spark):
    x = np.random.default_rng(3).normal(size=(4, 8))
    assert [len(v) for v in searched(spark, x, [0, 3]).values()] == [3, 3]


def found(spark, x, asked, **more):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(rows, F.col("vec_id").isin(asked), **more).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_rows_unlike_the_books(spark):
    """Vectors that differ far less than the codebooks tell apart, beside loose ones, and more rows than the sample has."""
    rng = np.random.default_rng(4)
    loose, crowds = rng.normal(size=(2000, 32)), np.repeat(rng.normal(size=(5, 32)), 400, axis=0)
    tables = {
        "crowds": np.concatenate([loose, crowds + 0.01 * rng.normal(size=(2000, 32))]),
        "parallel": 100 + rng.normal(size=(4000, 32)),
        "scales": crowds[rng.integers(0, 2000, 4000)] + 10.0 ** rng.uniform(-4, 0, 4000)[:, None] * rng.normal(size=(4000, 32)),
    }
    asked = list(range(0, 4000, 40))
    for name, x in tables.items():
        x = x.astype(np.float32).astype(np.float64)
        for sample in (1000, 4000):
            got = found(spark, x, asked, sample=sample)
            assert all([r for r, *_ in got[q]] == [1, 2, 3, 4, 5] for q in asked), name
            sims = truth(x, asked)
            least = -np.sort(-sims, 1)[:, 4]
            assert np.mean([sum(s >= m - 1e-13 for *_, s in got[q]) / 5 for q, m in zip(asked, least, strict=True)]) >= (0.97 if sample < 4000 else 1), (name, sample)


def test_equal_scores_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32).astype(np.float64)
    crowd = np.sort(rng.permutation(3000)[:900])
    x[crowd] = x[crowd[0]]
    asked = crowd[::30].tolist()
    got = found(spark, x, asked)
    assert all([v for _, v, _ in got[q]] == [c for c in crowd[:6].tolist() if c != q][:5] for q in asked)
    whole = found(spark, np.sign(x), list(range(0, 3000, 100)), target=1.0, sample=500)  # many different vectors are equally near
    sims = np.round(truth(np.sign(x), list(whole)), 12)
    assert all([v for _, v, _ in whole[q]] == np.lexsort((np.arange(3000), -s))[:5].tolist() for q, s in zip(whole, sims, strict=True))


def test_ids_of_any_type_and_huge_components(spark):
    x = np.random.default_rng(6).integers(1, 3, size=(60, 4)).astype(np.float64)  # few different vectors: many equal scores
    sims = np.round(truth(x, [0, 30]), 12)
    rows = spark.createDataFrame([(i, (v * 2.0**900).tolist()) for i, v in enumerate(x)], "n long, embedding array<double>").repartition(4)
    for kind in ("lpad(n, 3, '0')", "cast(n as decimal(20, 1))", "named_struct('a', 1, 'b', n)", "array(n)"):
        ids = rows.selectExpr(f"{kind} as vec_id", "embedding", "n")
        got = ann.search(ids, F.col("n") % 30 == 0).join(ids.selectExpr("vec_id", "n"), "vec_id").join(ids.selectExpr("vec_id as query_id", "n as q"), "query_id").orderBy("q", "rank").collect()
        assert [r["n"] for r in got] == [i for s in sims for i in np.lexsort((np.arange(60), -s))[:5].tolist()], kind
        assert all(abs(r["score"] - sims[r["q"] // 30, r["n"]]) < 1e-11 for r in got)
