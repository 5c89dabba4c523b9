"""Alignment against whole texts cut by both tokenizers, in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orbitspark.llm import alignment as al


def plain(rows, pair):
    per, links = [], Counter()
    for i, t in rows:
        a = pair.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        whole = (" " + (t or "")).encode()
        if not t or b"".join(pair.a_bytes[x] for x in a) != whole or b"".join(pair.b_bytes[x] for x in b) != whole:
            per.append((i, [], [], [], []))
            continue
        ends, end = {}, 0
        for k, x in enumerate(a):
            end += len(pair.a_bytes[x])
            ends[end] = k
        end = p = q = 0
        groups, mine = [], []
        for k, x in enumerate(b):
            end += len(pair.b_bytes[x])
            if end in ends:
                j = ends[end]
                groups.append(",".join(map(str, a[p : j + 1])) + "|" + ",".join(map(str, b[q : k + 1])))
                mine.append((a[j], x))
                p, q = j + 1, k + 1
        assert p == len(a) and q == len(b)
        links.update(mine)
        per.append((i, a, b, groups, mine))
    best = defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    key = lambda r: (r[0] is not None, r)
    return sorted(((i, len(a), len(b), len(g), len(m), sum(links[x] == best[x[1]] for x in m), sum(links[x] for x in m), ";".join(g)) for i, a, b, g, m in per), key=key), key


@pytest.fixture(scope="module")
def pair():
    return al.Pair()


def texts():
    rng = random.Random(1)
    parts = ["a", "the", "Ünï", "\n", "\t", " ", " ", " ", "  ", "漢字", "x" * 20, "!!", "1234", "'s", " ", "　", "<s>", "<|endoftext|>", "é", "\x1c", "\r\n", "🙂", " ", "\x85", "hello", "ﬁ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(500)] + ["▁x y", "x ▁ y hello", "hello world ", " ", "   ", "word " * 900]


def test_units_put_a_text_together():
    for t in texts():
        if t:
            assert "".join(" " + u for u in al.units_of(t)) == " " + t


@pytest.mark.parametrize("block", [12 << 20, 900])
def test_groups_links_and_counts(spark, pair, monkeypatch, block):
    monkeypatch.setattr(al, "BLOCK_BYTES", block)
    rows = [(i % 300, t) for i, t in enumerate(texts())] + [(9, None), (9, ""), (None, "no id"), (7, "hello world"), (7, "hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("unit", "block", "n", "number")}).repartition(2)
    want, key = plain(rows, pair)
    assert sorted(map(tuple, al.align(df).collect()), key=key) == want
    assert al.align(df.where("false")).count() == al.align(df.where("text is null")).where("n_a = 0 and groups = ''").count() - 1 == 0


def test_query(spark, sf, pair):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, key = plain(rows, pair)
    want = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want]
    assert sorted(map(tuple, al.op13_alignment(spark, sf).collect()), key=key) == want


def test_pairs_are_bounded_by_the_vocabularies(spark, sf, pair):
    """Of two tokens that end together one is a suffix of the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    units = al.numbered(docs).where("unit is not null").groupBy("unit").agg(F.sum("n").alias("n"))
    for r in al.pair_counts(al.cuts(al.unit_tokens(units)).select("n", F.inline("at"))).select("a_id", "b_id").distinct().collect():
        a, b = pair.a_bytes[r["a_id"]], pair.b_bytes[r["b_id"]]
        assert a.endswith(b) or b.endswith(a)
    assert sum(map(len, pair.a_bytes)) + sum(map(len, pair.b_bytes)) < 600_000
