"""The training-data operators against plain versions, and their defined results in odd cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitspark.llm import ann, chat, components, decontaminate, gsaca, neardup, packing, quality, queries, sharding, substring, suffix, tokens
from orbitspark.llm.common import chunks, word_spans

from . import plain

DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=400):
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Random texts with copies, near copies, shared passages, runs of one word, and odd characters."""
    rng = random.Random(3)
    base = [words(rng, rng.choice([3, 20, 60, 150])) for _ in range(60)]
    passage = words(rng, 50)
    out = base + base[:6] + [base[0]] * 5
    for t in [x for x in base if x.count(" ") > 100][:4]:
        for _ in range(14):
            w = t.split(" ")
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
            out.append(" ".join(w))
    out += [f"{words(rng, 9)} {passage} {words(rng, 9)}" for _ in range(4)] + ["la " * 90, "ÉÄ\tx\x0b" * 30, "", "  \n ", "one", "ONE", words(rng, 4000)]
    return list(enumerate(out))


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd(spark):
    """Nulls, blanks, repeated rows and ids, and columns whose names the operators use inside."""
    rows = [(1, None, 1), (2, "", 1), (3, "a b c d e f", 1), (3, "a b c d e f", 1), (None, "null id " * 40, None), (None, "null id " * 40, None), (4, "other words here now", 2)]
    return spark.createDataFrame(rows, DOCS + ", n int").withColumns({c: F.lit(9) for c in ("row", "z", "ranges", "bucket", "position", "score", "g", "kept", "n_words", "root", "rep", "at", "record", "shard")})


# ------------------------------------------------------------------ parts
def test_word_spans_stop_at_documents():
    buf = np.frombuffer(b"ab cdef", np.uint8)
    s, e, wo = word_spans(buf, np.array([0, 4, 7]))
    assert list(zip(s, e)) == [(0, 2), (3, 4), (4, 7)] and list(wo) == [0, 2, 3]
    assert list(chunks(np.array([0, 5, 5, 30]), 10)) == [(0, 2), (2, 3)]


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(60):
        strings = [np.append(rng.integers(1, 4, rng.integers(0, 30)), 0) for _ in range(4)] + [np.append(np.tile([1, 2], 9), 0)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        sa = gsaca.suffix_arrays(np.concatenate(strings), bounds)
        for i, s in enumerate(strings):
            assert (sa[bounds[i] : bounds[i + 1]] - bounds[i]).tolist() == sorted(range(len(s)), key=lambda j, s=s.tolist(): s[j:])


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(120)] + [(5000, k) for k in range(5001, 5060)]
    got = {r["u"]: r["v"] for r in components.components(frame(spark, links, "u long, v long").repartition(7)).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(400):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    assert {x: got.get(x, x) for x in root} == root


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    stored = rng.integers(0, 256, (80, decontaminate.BLOCKS), dtype=np.uint8)
    asked = np.concatenate([stored[:40] ^ np.packbits(rng.random((40, decontaminate.BITS)) < 0.2, axis=1), rng.integers(0, 256, (20, decontaminate.BLOCKS), dtype=np.uint8)])
    d = np.unpackbits(asked[:, None] ^ stored[None], axis=2).sum(2)
    q, s, _ = decontaminate.MultiIndex(stored).within(asked)
    assert set(zip(q.tolist(), s.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= decontaminate.RADIUS))))


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        free += [100] * (b == len(free))
        assert (bins[i], offsets[i]) == (b, 100 - free[b])
        free[b] -= sizes[i]


# ------------------------------------------------------------------ operators
def test_near_duplicates(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, texts).repartition(5), 4, 80).collect()}
    assert got == plain.components(texts, 4)


def test_near_duplicates_of_a_large_cluster(spark):
    """Near copies of one text, some too far from all others: links are neither lost nor made up."""
    rng = random.Random(8)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 8])):
            w[rng.randrange(120)] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), 4, 80).collect()}
    assert got == plain.components(rows, 4)


def test_substrings(spark, texts):
    got = sorted(tuple(r) for r in substring.remove_repeats(frame(spark, texts).repartition(5), 35).collect())
    assert got == sorted(plain.without_repeats(texts, 35))


def test_hot_seeds(spark, texts, monkeypatch):
    """A seed that very many windows share is dealt out by finer keys; results are the same."""
    from orbitspark.llm import repeats

    rows = texts[-45:]
    settle = repeats.repeated

    def eager(elements, **how):  # the threshold as workers see it
        out = settle(elements, **how)
        return out.withColumn("hot", F.lit(True))

    monkeypatch.setattr(substring, "repeated", eager)
    monkeypatch.setattr(suffix, "repeated", eager)
    assert sorted(tuple(r) for r in substring.remove_repeats(frame(spark, rows).repartition(5), 35).collect()) == sorted(plain.without_repeats(rows, 35))
    assert sorted(tuple(r) for r in suffix.remove_seen(frame(spark, rows).repartition(5), 50).collect()) == plain.without_seen(rows, 50)


def test_doubling_goes_to_the_end(spark, texts):
    """The longest repeat of each document, by doubling until no candidates survive, against plain counts."""
    from collections import Counter

    rng = random.Random(2)
    shared = words(rng, 100, 10**6)
    rows = [*texts[-50:], (900, f"x {shared}"), (901, f"y {shared} z"), (902, words(rng, 90)), (903, None)]
    split = [(i, plain.WORDS.findall(t or "")) for i, t in rows]
    want, length = dict.fromkeys((i for i, _ in rows), 0), 10
    while True:
        count = Counter(tuple(w[p : p + length]) for _, w in split for p in range(len(w) - length + 1))
        hit = [i for i, w in split if any(count[tuple(w[p : p + length])] > 1 for p in range(len(w) - length + 1))]
        if not hit:
            break
        want |= dict.fromkeys(hit, length)
        length *= 2
    got = {r["doc_id"]: r["longest"] for r in substring.longest_repeats(frame(spark, rows), 10).collect()}
    assert got == want and want[900] == 80 and substring.longest_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("window", [50, 7])
def test_suffixes(spark, texts, window):
    got = sorted(tuple(r) for r in suffix.remove_seen(frame(spark, texts[-40:]).repartition(5), window).collect())
    assert got == plain.without_seen(texts[-40:], window)


def test_suffix_order_decides(monkeypatch):
    """Equal windows of different runs are found through the suffix arrays alone: without the sorting they are missed."""
    import pandas as pd

    from orbitspark.llm.repeats import deflate

    rng = np.random.default_rng(3)
    core = rng.integers(97, 123, 80)
    spans = [(0, 60), (5, 65), (8, 70), (2, 58)]  # stretches of one passage, each between bytes of its own, no two the same
    runs = [np.concatenate([np.full(2, 40 + k), core[a:b], np.full(3, 60 + k)]).astype(np.uint8) for k, (a, b) in enumerate(spans)]
    n = np.array([len(r) - 49 for r in runs])
    pdf = pd.DataFrame([(0, np.full(4, 7, np.uint32).tobytes(), deflate(np.arange(4, dtype="<i8")), deflate(np.zeros(4, "<i4")), deflate(n.astype("<i4")), deflate(np.concatenate(runs)), None)], columns=["bucket", "seed", "row", "start", "n", "bytes", "gone"])
    want = [(1, 2, 6), (2, 2, 8), (3, 2, 7)]
    got = lambda: sorted(suffix._settle_strings(50)(pdf)[["row", "start", "n"]].itertuples(index=False, name=None))
    assert got() == want
    monkeypatch.setattr(suffix, "suffix_arrays", lambda text, bounds: np.arange(len(text)))
    assert got() != want


def test_long_groups_of_one_seed(monkeypatch):
    """A seed with so many runs that they are sorted in several strings: equal windows meet across them."""
    import pandas as pd

    from orbitspark.llm.repeats import deflate

    monkeypatch.setattr(suffix, "LONG", 300)
    rng = np.random.default_rng(4)
    core = rng.integers(97, 123, 50)
    runs = [np.concatenate([np.full(3, k), core, np.full(3, 40 + k)]).astype(np.uint8) for k in range(40)]
    pdf = pd.DataFrame([(0, np.full(40, 7, np.uint32).tobytes(), deflate(np.arange(40, dtype="<i8")), deflate(np.zeros(40, "<i4")), deflate(np.full(40, 7, "<i4")), deflate(np.concatenate(runs)), None)], columns=["bucket", "seed", "row", "start", "n", "bytes", "gone"])
    got = sorted(suffix._settle_strings(50)(pdf)[["row", "start", "n"]].itertuples(index=False, name=None))
    assert got == [(r, 3, 1) for r in range(1, 40)]
    again = pd.concat([pdf, pdf.assign(start=deflate(np.full(40, 100, "<i4")))])  # each run twice in its row
    got = sorted(suffix._settle_strings(50)(again)[["row", "start", "n"]].itertuples(index=False, name=None))
    assert got == [(r, k, 1) for r in range(1, 40) for k in (3, 103)]


def test_hashes_of_structured_text(spark):
    """Thue-Morse words, which collide under any polynomial modulo a power of two, are told apart."""
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: "b", 98: "a"})
    b = a.translate({97: "b", 98: "a"})
    rows = [(1, a), (2, b)]
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), 4, 80).collect()} == {(1, 1), (2, 2)}
    common = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*common, a])), (2, " ".join([*common, b]))]
    assert sorted(tuple(r) for r in substring.remove_repeats(frame(spark, rows), 35).collect()) == plain.without_repeats(rows, 35)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, words(rng, n, 10**5)) for i, n in enumerate([16, 30, 59, 40, 3])] + [(9, ""), (None, "no id at all here it is")]
    one = items[1][1].split(" ")
    edited = " ".join([*one[:15], "changed", *one[16:]])
    docs = [(0, f"{words(rng, 50)} {items[0][1].upper()}, {words(rng, 50)}"), (1, f"a {edited} b"), (2, " ".join(one[:15])), (3, words(rng, 300)), (4, None), (5, ""), (6, items[4][1]), (7, f"{items[2][1]}. {items[3][1]}!")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    assert set(got) == {(0, 0), (1, 1), (6, 4), (7, 2), (7, 3)} and got[(0, 0)]["start_word"] == 50 and 0.8 <= got[(1, 1)]["similarity"] < 1
    left = decontaminate.drop_contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminated(frame(spark, docs), frame(spark, [], "item_id long, text string")).count() == 0


def similarities(items, docs):
    """Brute force: the greatest similarity of each document and item over all windows of the item's size, where the document
    as a whole holds enough of the item."""
    from collections import Counter

    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    held = {i: grams(t.split()) for i, t in items}
    df = Counter(g for x in held.values() for g in x)
    out = {}
    for d, t in docs:
        w = t.split()
        whole = grams(w)
        for i, x in held.items():
            n, weight = sum(x.values()) + 4, {g: np.log1p(len(items) / df[g]) for g in x}
            share = lambda y: sum(weight[g] * min(c, y[g]) for g, c in x.items() if g in y) / sum(weight[g] * c for g, c in x.items())  # noqa: B023, E731
            if share(whole) >= 0.8:
                out[d, i] = max(share(grams(w[a : a + n])) for a in range(max(1, len(w) - n + 1)))
    return out


def boilerplate(rng, n, shared, own):
    """Items of which half share boilerplate before a few words of their own, and documents that hold one with a word changed."""
    common = words(rng, shared + 4, 10**5)
    items = [(i, f"{common} {words(rng, own, 10**6)}" if i % 2 else words(rng, 30, 10**6)) for i in range(n)]
    docs = []
    for d in range(30):
        w = items[2 * rng.randrange(n // 2) + 1][1].split()
        w[rng.choice([rng.randrange(shared - 40, shared), shared + 2, len(w) - 1])] = f"changed{d}"
        for k in rng.sample(range(0, shared - 60, 6), rng.randrange(0, 3)):
            w[k] = f"also{d}"
        docs.append((d, f"{words(rng, 3, 10**6)} {' '.join(w)} {'la ' * rng.choice([0, 40])}".strip()))
    return items, docs


@pytest.mark.parametrize(("n", "shared", "own"), [(1000, 100, 12), (200, 120, 6)])
def test_decontamination_with_shared_boilerplate(n, shared, own):
    """Every pair of similarity 0.8 is found, however little the shared part weighs."""
    import pyarrow as pa

    items, docs = boilerplate(random.Random(n), n, shared, own)
    bench = decontaminate.Benchmark(np.arange(n), pa.array([t for _, t in items]), 0.8)
    got = {(docs[d][0], i): s for d, i, s, *_ in decontaminate.found(bench, pa.array([t for _, t in docs]))}
    want = {k: s for k, s in similarities(items, docs).items() if s >= 0.8}
    assert len(want) > 10 and set(got) == set(want) and all(abs(got[k] - s) < 1e-9 for k, s in want.items())


def test_decontamination_does_not_depend_on_slices(spark, monkeypatch):
    """The same items with the same similarities, fingerprints and places in one slice and in several."""
    items, docs = boilerplate(random.Random(5), 40, 120, 6)
    tables = frame(spark, docs), frame(spark, [*items, (99, ""), items[3]], "item_id long, text string")
    one = sorted(tuple(r) for r in decontaminate.contaminated(*tables).collect())
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 4_000)
    many = sorted(tuple(r) for r in decontaminate.contaminated(*tables).collect())
    assert len(one) > 10 and [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in many]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(one, many))


def test_quality_learns(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(quality.held_out("doc_id")).select("score", "quality").toPandas()
    rank, good = got["score"].rank(), got["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97 and got["score"].between(0, 1).all()
    again = quality.score(frame(spark, [(1, ""), (2, None), (3, "x" * 10**6)]), model, ["doc_id"]).orderBy("doc_id").collect()
    assert again[0]["score"] == again[1]["score"]


def test_quality_equals_a_plain_network():
    """Scores by table look-up, blocks and chunks against a network written out byte by byte."""
    rng = np.random.default_rng(9)
    n = quality.Network(3)
    n.bias[:] = rng.normal(0, 0.2, quality.FILTERS)
    for t in (b"", b"a", b"abc" * 40, bytes(rng.integers(32, 127, 64)), bytes(rng.integers(0, 256, 1000)), b"x" * 257):
        padded = np.frombuffer((t or b"\0") + bytes(quality.WIDTH - 1), np.uint8)
        size = max(1, len(t))
        z = np.array([sum(n.table[j, padded[p + j]] for j in range(quality.WIDTH)) for p in range(size)])
        chunks_, at = [], 0
        while True:
            chunks_.append(np.maximum(z[at : at + 4 * quality.BLOCK].max(0) + n.bias, 0))
            at += 3 * quality.BLOCK
            if at + quality.BLOCK >= size:
                break
        u = np.array(chunks_)
        want = 1 / (1 + np.exp(-(np.concatenate([u.mean(0), u.max(0)]) @ n.out + n.shift[0])))
        assert np.isclose(n.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], want, atol=1e-5)


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None), (3, "b" * 500)]).withColumn("score", F.lit("mine"))
    for labels in ([], [(7, 1)], [(1, None), (None, 1)]):
        model = quality.fit(docs, frame(spark, labels, "doc_id long, quality int"))
        out = quality.score(docs, model, ["doc_id", "score"])
        assert out.columns == ["doc_id", "score"] and [r["score"] for r in out.collect()] == [0.5] * 3
    assert quality.score(docs.where("false"), model, ["doc_id"]).count() == 0


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    """Bounds hold back whole documents, never parts of one."""
    seen = []
    monkeypatch.setattr(quality.Network, "fit", lambda self, texts, labels: seen.append(texts) or self)
    docs = frame(spark, [(i, "w" * (100 * i)) for i in range(1, 40)])
    labels = frame(spark, [(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    quality.fit(docs, labels, rows=10, size=9_000)
    assert 0 < len(seen[0]) <= 10 and sum(map(len, seen[0])) <= 9_000 and all(len(t) % 100 == 0 for t in seen[0])
    quality.fit(docs, labels)
    assert len(seen[1]) == labels.where(~quality.held_out("doc_id")).count()


def test_quality_score_does_not_depend_on_company(spark):
    """A document's score is its own, whatever lies beside it, and covers its end."""
    n = quality.Network()
    t = [b"abc " * 300, b"", b"z" * 64, b"q" * 65, b"abc " * 300 + b"\xff\xfe\xfd"]
    one = [n.score(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in t]
    both = n.score(np.frombuffer(b"".join(t), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in t])]))
    assert np.allclose(one, both)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] <|end|>\n & &lt; [x]"), (1, 1, "assistant", "<|next|>"), (1, 2, "assistant", ""), (1, 3, "assistant", None), (1, 4, None, "né"), (1, 4, None, "né"), (2, None, "a|b>\n", "x"), (None, 0, "user", "y")]
    f = chat.format_conversations(frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("a", F.lit(1)))
    got = {r["conv_id"]: r for r in f.withColumn("t", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(x) for x in got[1]["t"]] == [(r or "", t or "") for _, _, r, t in rows[:6]]
    assert (got[1]["n_turns"], got[1]["n_blocks"]) == (6, 3) and [tuple(x) for x in got[2]["t"]] == [("a|b>\n", "x")] and got[None]["n_turns"] == 1
    d = {r["conv_id"]: r for r in chat.digests(f).collect()}
    assert d[1]["loss_chars"] == len("<|next|>")


def test_shards(spark):
    docs = frame(spark, [(i, "x" * (i % 50)) for i in range(1000)] + [(None, None), (5, "xxxxx")])
    out = sharding.assign_shards(docs, ["doc_id", "text"], bucket_bytes=900)
    rows = [tuple(r) for r in out.select("shard", "slot", "doc_id").collect()]
    sizes = [sum(1 for s, *_ in rows if s == k) for k in range(16)]
    assert len(rows) == 1002 and max(sizes) - min(sizes) <= 1 and all(sorted(t for s, t, _ in rows if s == k) == list(range(sizes[k])) for k in range(16))
    assert rows == [tuple(r) for r in out.select("shard", "slot", "doc_id").collect()]
    assert out.select("bucket").distinct().count() > 5


def test_shards_are_written(spark, tmp_path):
    docs = frame(spark, [(i, f"t{i}") for i in range(100)])
    sharding.write_shards(docs, str(tmp_path / "s"), ["doc_id"], 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and sorted(p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("shard=")) == [f"shard={i}" for i in range(4)]


def test_shard_query_shuffles_whole_records(spark, sf, monkeypatch):
    """The buckets that op5 writes hold the documents as they are, and its digests are those of the texts."""
    written = []
    monkeypatch.setattr(sharding, "materialize", lambda df, write=sharding.materialize: written.append(write(df)) or written[-1])
    out = sharding.op5_shards(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (buckets, _), want = written[0], sorted(map(repr, docs.collect()))
    assert sorted(map(repr, buckets.select("record.*").select(*docs.columns).collect())) == want
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == len(want) and all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in rows)


def test_packing(spark):
    rng = random.Random(6)
    docs = [(i, words(rng, rng.choice([0, 5, 400, 3000]))) for i in range(40)] + [(90, None), (90, None), (None, "İs. ΣΑΣ don't, 3.5 <|endoftext|> é́")]
    rows = packing.pack(frame(spark, docs), 512, group_rows=16).collect()
    enc = packing.encoder(None)
    want = {i: np.asarray([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs}
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in rows) == sum(len(want[i]) for i, _ in docs)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 512


def test_packed_sequences_hold_every_token(spark):
    """The pieces carry their ids, and sequences() puts them end to end; ids beyond 16 bits stay whole."""
    rng = random.Random(8)
    docs = [(i, words(rng, rng.choice([0, 5, 400, 3000]))) for i in range(20)] + [(None, None)]
    tokenizer = packing.encoder(None).tokenizer
    for eos in (2, 1 << 20):
        want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, eos] for i, t in docs}
        packed = packing.pack(frame(spark, docs), 512, eos, group_rows=8)
        rows = packed.collect()
        ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in rows]
        assert all(x == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["ids_crc32"] == zlib.crc32(r["ids"]) for r, x in zip(rows, ids))
        assert sum(map(len, ids)) == sum(map(len, want.values()))
        whole = {s["sequence_id"]: np.frombuffer(s["ids"], "<u4").tolist() for s in packing.sequences(packed).collect()}
        assert max(map(len, whole.values())) <= 512 and sum(map(len, whole.values())) == sum(map(len, ids))
        assert all(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == x for r, x in zip(rows, ids))


def test_token_cache_overflows(spark, monkeypatch):
    """A worker that cannot keep all pieces of its rows gives the same tokens."""
    rng = random.Random(12)
    enc = tokens.SpanEncoder()
    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    for _ in range(3):
        texts = [words(rng, 40).encode() for _ in range(5)]
        assert all(a.tolist() == enc.sizes(t.decode()).tolist() for a, t in zip(enc.encode(texts), texts))
        assert len(enc.kept) <= 250


def test_token_counts(spark, texts):
    rows = texts[-30:] + [(900, "a\n\nb  c\n"), (901, " lead"), (902, "tab\there é\n'll"), (903, "<|endoftext|> x"), (904, None), (905, "x y")]
    enc = tokens.SpanEncoder()
    for r in tokens.token_counts(frame(spark, rows)).collect():
        t = dict(rows)[r["doc_id"]] or ""
        e = enc.tokenizer.encode(t, add_special_tokens=False)
        ends = [k + 1 for k, c in enumerate(t) if c == "\n"]
        ends += [len(t)] * (not ends or ends[-1] < len(t))
        want = [0] * len(ends)
        for s, _ in e.offsets:
            want[int(np.searchsorted(ends, s, "right"))] += 1
        assert (r["n_tokens"], list(r["section_tokens"])) == (len(e.ids), want)
    got = tokens.token_counts(spark.createDataFrame([(1, "one two", None, "three")], "doc_id long, a string, b string, c string"), ["a", "b", "c"]).first()
    assert got["n_sections"] == 3 and sum(got["section_tokens"]) == got["n_tokens"]
    assert [list(x) for x, _ in (tokens.attribute(np.array([2, 4, 1]), np.array([3, 7]), r) for r in ("start", "overlap"))] == [[2, 1], [1, 2]]


def nearest(x, queries, k=5):
    """Brute force: of each query its k nearest rows, ties to the smaller number, and their cosines."""
    u = x / np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for q in queries:
        s = np.round(u @ u[q], 12)
        s[q] = -2
        out[q] = np.lexsort((np.arange(len(s)), -s))[:k]
    return out


def test_search(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x[100:400] = x[7]  # a crowd of equal vectors, and one of another length
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] + [1.0] * 15), (9004, (2 * x[7]).tolist()), (9005, [1.0])]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SHELF_ROWS", (100, 100))
    monkeypatch.setattr(ann, "QUERY_ROWS", 25)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = nearest(x, [q for q in got if q < 3000])
    hit = sum(len(set(want[q].tolist()) & {v for _, v, _ in rs}) for q, rs in got.items())
    assert hit / (5 * len(got)) >= 0.9 and len(got) == 60 and all([r for r, _, _ in sorted(rs)] == [1, 2, 3, 4, 5] for rs in got.values())
    assert all(abs(s - x[q] @ x[v] / np.sqrt((x[q] @ x[q]) * (x[v] @ x[v]))) < 1e-12 for q, rs in got.items() for _, v, s in rs if v < 3000)
    assert [v for _, v, _ in sorted(got[300])][0] in (7, *range(100, 400)) and all(s > 1 - 1e-9 for _, _, s in got[300])
    assert ann.search(df.where("false"), F.col("vec_id") == 0).count() == 0
    foreign = ann.search(df, frame(spark, [(1, x[500].tolist()), (2, None)], "vec_id long, embedding array<double>"), 1).collect()
    assert [(r["query_id"], r["vec_id"]) for r in foreign] == [(1, 500)]


def test_search_takes_repeated_ids_by_row(spark):
    x = np.random.default_rng(1).normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (10, x[3].tolist())]
    got = ann.search(frame(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 2).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(r for r, _ in by[0]) == sorted(r for r, _ in by[10]) == [1, 1, 2, 2] and len(by[20]) == 2
    assert by[0].count((1, 0)) == 2 and (1, 3) in by[10]


def test_search_prunes(spark):
    """A cloud with structure: most of the nearest are found in a small share of the rows."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(300, 32))[rng.integers(0, 300, 20_000)] + 0.4 * rng.normal(size=(20_000, 32))).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 200 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = nearest(x, list(got))
    u = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
    model = ann.Model(u, len(u), 5, 0.95)
    size = np.bincount(ann._near(u, model.cells), minlength=len(model.cells))
    assert sum(len(got[q] & set(w.tolist())) for q, w in want.items()) / (5 * len(want)) >= 0.95
    assert np.mean(size[model.probed(u[::200])].sum(1)) < len(u) / 3


def test_odd_cases(spark):
    d = odd(spark)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(d, 4).collect())
    assert [g for g in got if g[0] == 3] == [(3, 3, 3, True)] * 2 and [g for g in got if g[0] == 1] == [(1, 0, 1, True)] and len(got) == 7
    kept = neardup.keep_one(d, 4)
    assert kept.columns == d.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id is null").count() == 1
    s = substring.remove_repeats(d, 35, texts=True, keep=d.columns)
    assert s.where("doc_id is null and n_removed = 80").count() == 2 and s.where("doc_id = 3").first()["kept_text"] == "a b c d e f"
    assert suffix.remove_seen(d, 5).where("doc_id = 3").agg(F.sum("n_removed")).first()[0] == 0  # neither has the smaller id
    assert sharding.assign_shards(d, ["doc_id", "text"]).count() == packing.pack(d).count() == 7
    assert decontaminate.drop_contaminated(d, frame(spark, [(1, "other words here now")], "item_id long, text string")).count() == 6
    assert tokens.token_counts(d).count() == 7
    empty = d.where("false")
    assert neardup.near_duplicates(empty).count() == neardup.keep_one(empty).count() == substring.remove_repeats(empty).count() == suffix.remove_seen(empty).count() == 0
    assert sharding.assign_shards(empty, ["doc_id"]).count() == packing.pack(empty).count() == tokens.token_counts(empty).count() == 0
    assert chat.format_conversations(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(7) for c in ("row", "score", "kept", "whole", "n_words")})
    at = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in at.collect()}
        at = stage(spark, at, sf)
        assert at.dtypes == docs.dtypes, name
        after = {r["doc_id"]: r for r in at.collect()}
        if name == "near_duplicates":
            want = plain.components(sorted(before.items()), 5)
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        elif name == "repeated_passages":
            for i, n, gone, _ in plain.without_repeats(sorted(before.items()), 35):
                assert len(plain.WORDS.findall(after[i]["text"])) == n - gone and after[i]["n_chars"] == len(after[i]["text"])
                assert gone or after[i]["text"] == before[i]
        else:
            assert set(after) <= set(before) and len(after) > 0.7 * len(before) and all(after[i]["text"] == before[i] for i in after)
        at = spark.createDataFrame(at.collect(), at.schema)
    packed = cp.STAGES[-1][1](spark, at, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in at.collect()}


def test_pipeline_in_odd_cases(spark, sf, tmp_path):
    """No labels, null and blank texts, repeated rows, and no documents at all."""
    import corpus_pipeline as cp

    base = spark.read.parquet(f"{sf}/documents.parquet")
    odd_rows = spark.createDataFrame([(900001, None, "en", "s", None), (900002, "", "en", "s", 0), (900003, "  ", None, None, 2), (900004, "one word", "en", "s", 8), (900004, "one word", "en", "s", 8), (None, "no id here", "en", "s", 10)], base.schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd_rows.unionByName(base.limit(20)).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in got.collect()}
    assert {900001, 900002, 900003, 900004, None} <= kept and got.where("doc_id = 900004").count() == 1
    empty = tmp_path / "empty"
    base.where("false").write.parquet(str(empty / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(empty / f"{t}.parquet"))
    assert cp.run(spark, str(empty)).count() == 0


def test_ids_of_other_types(spark):
    """Text ids: operators keep them as they are."""
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", None)], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs, 4).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == {"a", "b", "c"}
    bench = frame(spark, [(1, "one two three four five six")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()) == ["a", "b"]
    assert {r["doc_id"]: r["n_removed"] for r in suffix.remove_seen(docs, 10).collect()} == {"a": 0, "b": 27, "c": 0}


def test_all_ten_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = c.sql(queries.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*want.columns).collect()) == sorted(want.fetchall())
