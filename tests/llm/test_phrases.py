"""Collocations: the automaton against plain counts, the operator against a plain version, odd cases."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from orbitspark.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def counts(docs, depth=3):
    f = defaultdict(Counter)
    for text, lang in docs:
        for w in pieces(text):
            for k in range(1, depth + 1):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def plain(docs, least=10, best=2000):
    out = []
    for lang, f in counts(docs).items():
        n = sum(x for p, x in f.items() if len(p) == 1)
        good = {p: x for p, x in f.items() if len(p) > 1 and x >= least}
        rows = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * x >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, x in good.items()):
                continue
            s, k = min((int(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best])]
    return sorted(out)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = ["la", "LA", "the", "of", "é", "漢字", "x-y", "new", "york", "city", "a"] + [f"w{i}" for i in range(30)]
    make = lambda: "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\x0b", "!? "]) for _ in range(rng.randrange(60)))
    docs = [(make() + rng.choice(["", " New York City "]), rng.choice(["en", "fr", None, ""])) for _ in range(n)]
    return [*docs, (None, "en"), ("", None), ("la " * 500, "en"), ("la la, " * 30, "fr")] + docs[:20]


@pytest.mark.parametrize("shard", [1_000_000, 37, 2])
def test_shards_count_every_phrase(monkeypatch, shard):
    """Also where a piece is longer than an automaton."""
    monkeypatch.setattr(c, "SHARD_WORDS", shard)
    docs = [(t or "") for t, _ in corpus(2, 60)]
    raw = [t.encode() for t in docs]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for depth in (1, 3, 5):
        got, words = Counter(), 0
        for phrases, _, n, w in c.shard_counts(buf, offs, depth):
            words += w
            for p, x in zip(phrases.to_pylist(), n.tolist(), strict=True):
                got[tuple(p.split(" "))] += x
        want = counts([(t, "en") for t in docs], depth)["en"]
        assert got == want and words == sum(x for p, x in want.items() if len(p) == 1)


def test_states_are_sets_of_places():
    """Two phrases share a state only where they end at the same places, and a link leads to a suffix with more of them."""
    rng = np.random.default_rng(4)
    words, place = rng.integers(0, 3, 60), np.concatenate([np.arange(20), np.arange(40)])
    a = c.Automaton(words, place, np.ones(60, bool), 3)
    ends = defaultdict(set)
    for k in (1, 2, 3):
        for i in range(60):
            if place[i] >= k - 1:
                ends[tuple(words[i - k + 1 : i + 1])].add(i)
    reached = defaultdict(set)
    for p, where in ends.items():
        s = 0
        for w in p:
            (at,) = np.flatnonzero((a.source == s) & (a.item == w))
            s = a.target[at]
        assert a.count[s] == len(where)
        reached[s].add(frozenset(where))
        longest = max((q for q in ends if ends[q] == where), key=len)
        shorter = [longest[i:] for i in range(1, len(longest)) if ends[longest[i:]] != where]
        assert a.count[a.link[s]] == (len(ends[shorter[0]]) if shorter else 0)
    assert all(len(x) == 1 for x in reached.values())


def test_operator(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "text string, lang string").selectExpr("*", "1 as phrase", "2 as f", "3 as rank").repartition(3)
    got = c.collocations(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(docs)
    assert sorted(map(tuple, got.collect())) == want and len({r[0] for r in want}) == 4
    assert sorted(map(tuple, c.collocations(df, best=7).collect())) == plain(docs, best=7)
    assert c.collocations(df.where("false")).count() == 0
    assert c.collocations(df.limit(1), least=1_000).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of 10^9 give products of 10^24."""
    monkeypatch.setattr(c, "phrase_counts", lambda *_: spark.createDataFrame([("en", "", 10**10), ("en", "a", 3 * 10**9), ("en", "b", 2 * 10**9 + 1), ("en", "a b", 10**9 + 7)], "lang string, phrase string, f long"))
    r = c.collocations(spark.range(0)).first()
    assert (r["a"], r["l"], r["r"], r["n"]) == (10**9 + 7, 3 * 10**9, 2 * 10**9 + 1, 10**10)
    assert r["score"] == 1_000_000 * (10**9 + 7) ** 2 // (3 * 10**9 * (2 * 10**9 + 1))
