"""Line labelling against a plain version, and its defined results in odd cases."""

import itertools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orbitspark.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    g = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), copies, len(repeated)


def texts():
    rng = random.Random(2)
    alphabet = ["a", "the", "Ünï", "漢字", "x*", "|", "##", "\n", "\n", " ", "\t", "\x0b", "\r\n", "1234", "END.", "🙂"]
    out = ["".join(rng.choice(alphabet) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(80))) for _ in range(150)]
    return [*out, None, "", " \n ", "one", "same line\n" * 40, "w " * 3000, "\n".join(f"line {i} of a long text." for i in range(2500))]


def test_base_counts(spark):
    rows = [(i % 40, t) for i, t in enumerate(texts())]  # repeated ids
    got = lines.judge(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(5)), lines.Chain(), ["doc_id", "text"])
    got = [tuple(r) for r in got.select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()]
    assert len(got) == len(rows)
    for text, *figures in got:
        want = plain_counts(text)
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert tuple(figures) == (*want, failed, not failed)  # a field that knows nothing marks every line as content


def test_viterbi_is_the_best_marking():
    rng = np.random.default_rng(1)
    chain = lines.Chain()
    for _ in range(20):
        chain.weight, chain.step, chain.first = rng.normal(size=(len(lines.FEATURES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
        per_doc = np.array([3, 0, 7, 1])
        x = rng.normal(size=(11, len(lines.FEATURES))).astype(np.float32)
        marks = chain.decode(x, per_doc)
        emit, at = x @ chain.weight, 0
        for n in per_doc:
            score = lambda y, at=at, n=n: chain.first[y[0]] + sum(emit[at + i, y[i]] for i in range(n)) + sum(chain.step[a, b] for a, b in itertools.pairwise(y))
            if n:
                best = max(itertools.product((0, 1), repeat=int(n)), key=score)
                assert tuple(marks[at : at + n]) == best
            at += n


def test_gradient():
    rng = np.random.default_rng(3)
    chain = lines.Chain()
    chain.weight, chain.step, chain.first = rng.normal(size=(len(lines.FEATURES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    x, per_doc, y = rng.normal(size=(6, len(lines.FEATURES))), np.array([4, 2]), np.array([0, 1, 1, 0, 1, 1])

    def likelihood():
        total, at = 0.0, 0
        for n in per_doc:
            emit = x[at : at + n] @ chain.weight
            score = lambda z, emit=emit, n=n: chain.first[z[0]] + sum(emit[i, z[i]] for i in range(n)) + sum(chain.step[a, b] for a, b in itertools.pairwise(z))
            total += score(tuple(y[at : at + n])) - np.logaddexp.reduce([score(z) for z in itertools.product((0, 1), repeat=int(n))])
            at += n
        return total / len(x)

    for p, g in zip([chain.weight, chain.step, chain.first], chain._gradient(x, per_doc, y), strict=True):
        for i in np.ndindex(p.shape):
            p[i] += 1e-5
            up = likelihood()
            p[i] -= 2e-5
            down = likelihood()
            p[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = lines.op11_lines(spark, sf)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where(lines.held_out("doc_id") & ~F.col("base_failed"))
    good, bad = held.where("quality = 1"), held.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count() and bad.where("kept").count() <= 0.2 * max(5, bad.count())


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30), (None, None), (2, "x\n" * 500)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert lines.fit(docs, none).share == 0.5
    one_kind = spark.createDataFrame([(1, 1), (1, None), (None, 0), (7, 1)], "doc_id long, quality int")
    assert (lines.fit(docs, one_kind).weight == 0).all()
    assert lines.judge(docs.where("false"), lines.Chain(), ["doc_id"]).count() == 0
    assert lines.judge(docs, lines.Chain(), ["doc_id"]).count() == 3
