"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of n words is looked for in every window of n words of a document. A window's fingerprint has BITS bits, to
which every shingle counts the same; the items' fingerprints lie in a multi-index of BLOCKS blocks. Two fingerprints within
RADIUS differ by at most RADIUS // BLOCKS bits in some block, so looking up every value that close in each block finds all of
them. Candidates are then compared exactly: the share of the item's shingle weight that the window holds, counting repeats,
must reach 0.8.

How far apart the fingerprints of such a pair may lie follows from the item's own weights: it can lack as many shingles as its
lightest ones make up a fifth of its weight, which bounds the cosine of the two count vectors from below. The radius of a pair
is the distance expected at that cosine plus MARGIN standard deviations (a miss of 3e-5 at the bound itself). A window for
which this is beyond the index's reach is compared with the fingerprints of all items of its size.

Only windows that share a shingle with an item are fingerprinted: any other has similarity 0, so this loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import buffers, chunks, materialize, mix, ngram_hash, tidy, word_hash, word_spans
from .repeats import WHOLE

SHINGLE, BITS, BLOCKS, RADIUS, MARGIN = 5, 128, 16, 40, 4
#: Bytes of benchmark text that go to the executors at once; a larger benchmark is taken in slices, a pass for each.
SLICE_BYTES = 16 << 20

#: Blanks and ASCII punctuation part words.
BREAK = np.zeros(256, bool)
BREAK[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

HITS = "similarity double, distance int, start_word int, n_words int"


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts, and each text's offsets."""
    buf, offs = buffers(col)
    s, e, wo = word_spans(buf, offs, BREAK)
    return word_hash(buf, s, e, seed=3), wo


def shingles_of(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each item and the hashes of its shingles."""
    h, wo = words_of(pc.utf8_lower(col))
    return np.diff(wo), [ngram_hash(h[a:b], min(SHINGLE, b - a)) for a, b in zip(wo[:-1], wo[1:], strict=True)]


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """(n, BITS) int32: 1 or -1 by the bits of each shingle's hash."""
    h = np.stack([mix(shingles), mix(shingles ^ np.uint64(0x5851F42D4C957F2D))], 1)
    sign = np.unpackbits(h.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return 2 * sign.astype(np.int32) - 1


def radius_at(cosine: np.ndarray) -> np.ndarray:
    """Bits by which fingerprints of vectors of at least that cosine differ at most, but for MARGIN standard deviations."""
    p = np.arccos(np.clip(cosine, 0, 1)) / np.pi
    return np.floor(BITS * p + MARGIN * np.sqrt(BITS * p * (1 - p))).astype(np.int64)


def norms(g: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Length of the vector of shingle counts of each window g[s:s + size]; starts increase."""
    names, number = np.unique(g, return_inverse=True)
    if len(names) == len(g):
        return np.full(len(starts), np.sqrt(size))
    number, count, squares, out = number.tolist(), [0] * len(names), 0, np.zeros(len(g) - size + 1)
    for i, k in enumerate(number):
        squares += 2 * count[k] + 1
        count[k] += 1
        if i >= size:
            k = number[i - size]
            count[k] -= 1
            squares -= 2 * count[k] + 1
        if i >= size - 1:
            out[i - size + 1] = squares
    return np.sqrt(out[starts])


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_CLOSE = np.array([v for v in range(256) if _COUNT[v] <= RADIUS // BLOCKS], np.uint8)


class MultiIndex:
    """Finds all stored fingerprints within RADIUS of given ones, or within a radius for each of these."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.order = [np.argsort(prints[:, b], kind="stable") for b in range(BLOCKS)]
        self.edges = [np.searchsorted(prints[o, b], np.arange(257)) for b, o in enumerate(self.order)]

    def within(self, asked: np.ndarray, radius: np.ndarray | int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (asked, stored) and their distances, by increasing asked."""
        radius = np.broadcast_to(radius, len(asked))
        near = radius // BLOCKS <= RADIUS // BLOCKS
        looked, wide, stored = np.flatnonzero(near), np.flatnonzero(~near), len(self.prints)
        pairs = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            value = (asked[looked, b][:, None] ^ _CLOSE[None, :]).astype(np.int64)
            lo, n = self.edges[b][value], self.edges[b][value + 1] - self.edges[b][value]
            q = np.repeat(np.repeat(looked, value.shape[1]), n.ravel())
            n, lo = n.ravel(), lo.ravel()
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            pairs.append(np.unique(q * stored + self.order[b][at]))
        step = max(1, (1 << 18) // max(1, stored))
        for lo in range(0, len(wide), step):
            part = wide[lo : lo + step]
            q, at = np.nonzero(_COUNT[asked[part][:, None] ^ self.prints[None]].sum(2) <= radius[part][:, None])
            pairs.append(part[q] * stored + at)
        pair = np.unique(np.concatenate(pairs))
        q, s = np.divmod(pair, max(1, stored))
        d = _COUNT[asked[q] ^ self.prints[s]].sum(1) if len(q) else np.zeros(0, np.int64)
        near = d <= radius[q]
        return q[near], s[near], d[near]


class Benchmark:
    """The items of one slice: shingles with weights and the items that hold them, and an index of fingerprints per size.
    least: the similarity from which an item is found. whole: of a benchmark in slices the number of items, and the shingles
    that more than one item holds, sorted, with the number of these; weights are those of the whole benchmark."""

    def __init__(self, ids: list, col: pa.Array, least: float, whole: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.size, per = shingles_of(col)
        self.ids, self.least = ids, least
        self.shingles, df = np.unique(np.concatenate([np.unique(p) for p in per if len(p)] or [np.zeros(0, np.uint64)]), return_counts=True)
        n_items = len(ids)
        if whole:
            n_items, often, counts = whole
            at = np.searchsorted(self.shingles, often)
            here = at < len(self.shingles)
            here[here] = self.shingles[at[here]] == often[here]
            df[at[here]] = counts[here]
        self.weights = np.log1p(n_items / df)
        self.lengths = sorted({int(min(SHINGLE, n)) for n in self.size if n})
        held = [np.unique(np.searchsorted(self.shingles, p), return_counts=True) if len(p) else (np.zeros(0, int), np.zeros(0, int)) for p in per]
        self.counts = [dict(zip(k.tolist(), c.tolist(), strict=True)) for k, c in held]
        self.total = np.array([float((self.weights[k] * c).sum()) for k, c in held])
        # the cosine of an item's counts with those of a window that holds enough of it is at least this by the length of the latter
        self.share = np.zeros(len(ids))
        for i, (k, c) in enumerate(held):
            if len(k):
                lightest = np.cumsum(np.sort(np.repeat(self.weights[k], c)))
                self.share[i] = np.sum(lightest > (1 - least + 1e-9) * self.total[i]) / np.sqrt((c.astype(float) ** 2).sum())
        k, item = (np.concatenate([k for k, _ in held] or [np.zeros(0, int)]), np.repeat(np.arange(len(ids)), [len(k) for k, _ in held]))
        o = np.argsort(k, kind="stable")
        self.items, self.edges = item[o], np.searchsorted(k[o], np.arange(len(self.shingles) + 1))
        # most hashes of a document are told apart by a table of their top bits; the rest are searched for
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        prints = np.stack([fingerprint(bits_of(p).sum(0, keepdims=True))[0] for p in per]) if len(ids) else np.zeros((0, BLOCKS), np.uint8)
        self.by_size = {int(n): np.flatnonzero(self.size == n) for n in np.unique(self.size) if n}
        self.index = {n: MultiIndex(prints[i]) for n, i in self.by_size.items()}

    def vocabulary(self, g: np.ndarray) -> np.ndarray:
        """Number of each hash among the shingles, or -1."""
        out = np.full(len(g), -1, np.int64)
        maybe = np.flatnonzero(self.gate[(g >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.shingles, g[maybe]), len(self.shingles) - 1)
        hit = self.shingles[at] == g[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def hits(self, h: np.ndarray) -> list[tuple]:
        """(item, similarity, distance, first word, words) of each item found in a document's words: its most similar window."""
        out = []
        for length in self.lengths:
            g = ngram_hash(h, length)
            v = self.vocabulary(g)
            at = np.flatnonzero(v >= 0)
            if not len(at):
                continue
            reach: dict[int, list[np.ndarray]] = {}
            for p in at.tolist():
                for n in {int(self.size[i]) for i in self.items[self.edges[v[p]] : self.edges[v[p] + 1]]}:
                    if min(SHINGLE, n) == length:
                        reach.setdefault(n, []).append(p)
            for n, ps in reach.items():
                # all windows of n words that hold one of the shingles; a shorter document is one window
                top = max(0, len(h) - n)
                mask = np.zeros(top + 2, np.int64)
                ps = np.array(ps)
                np.add.at(mask, np.clip(ps - (n - length), 0, top), 1)
                np.add.at(mask, np.minimum(ps, top) + 1, -1)
                starts = np.flatnonzero(np.cumsum(mask[:-1]) > 0)
                size = min(n, len(h)) - length + 1
                a, b = int(starts[0]), int(starts[-1]) + size
                # a window whose shingles together weigh too little for an item does not hold it
                known = np.concatenate([[0], np.cumsum(np.where(v[a:b] >= 0, self.weights[v[a:b]], 0))])
                known = known[starts - a + size] - known[starts - a]
                items = self.by_size[n]
                heavy = known >= (self.least - 1e-9) * self.total[items].min() - 1e-9
                starts, known = starts[heavy], known[heavy]
                if not len(starts):
                    continue
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits_of(g[a:b]), 0, dtype=np.int32)])
                prints = fingerprint(sums[starts - a + size] - sums[starts - a])
                long = norms(g[a:b], starts - a, size)
                q, s, d = self.index[n].within(prints, radius_at(self.share[items].min() / long))
                enough = (d <= radius_at(self.share[items[s]] / long[q])) & (known[q] >= (self.least - 1e-9) * self.total[items[s]] - 1e-9)
                q, s, d = q[enough], s[enough], d[enough]
                best: dict[int, tuple] = {}
                for w, item, dist in zip(starts[q].tolist(), items[s].tolist(), d.tolist(), strict=True):
                    found = v[w : w + size]
                    k, c = np.unique(found[found >= 0], return_counts=True)
                    mine = self.counts[item]
                    sim = min(1.0, sum(self.weights[x] * min(y, mine[x]) for x, y in zip(k.tolist(), c.tolist(), strict=True) if x in mine) / self.total[item])
                    if sim >= self.least and (item not in best or (sim, -dist) > (best[item][0], -best[item][1])):
                        best[item] = (sim, dist, w)
                out += [(self.ids[i], float(s), int(x), w, int(min(n, len(h)))) for i, (s, x, w) in best.items()]
        return out


def shared_shingles(items: DataFrame) -> DataFrame:
    """Of items(k, t): each shingle that more than one item holds, how many hold it, and their slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per = [np.unique(p) for p in shingles_of(batch.column(1))[1]]
            held = np.concatenate([*per, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(p) for p in per])), pa.array(held)], ["k", "h"])

    return items.select("k", "t").mapInArrow(tidy(run), "k long, h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.collect_set("k").alias("ks")).where("n > 1")


def slices(benchmark: DataFrame, item: str, text: str, least: float) -> Iterator:
    """The benchmark as broadcasts of about SLICE_BYTES of text each; weights are those of the whole benchmark."""
    whole_numbers = dict(benchmark.dtypes)[item] in WHOLE
    items = benchmark.select((F.col(item).cast("long") if whole_numbers else F.col(item)).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.col("i").isNotNull())
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // SLICE_BYTES)
    items = items.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, n))).cast("long")).distinct()
    if n > 1:
        total, (often, _) = items.count(), materialize(shared_shingles(items))
    for k in range(n):
        got, whole = items.where(F.col("k") == k).orderBy("i", "t").toArrow(), None
        if n > 1:
            counts = often.where(F.array_contains("ks", F.lit(k).cast("long"))).select("h", "n").toArrow()
            h, c = counts.column("h").to_numpy().view(np.uint64), counts.column("n").to_numpy()
            order = np.argsort(h)
            whole = total, h[order], c[order]
        if got.num_rows:
            yield benchmark.sparkSession.sparkContext.broadcast(Benchmark(got.column("i").to_pylist(), got.column("t").combine_chunks(), least, whole))


def found(bench: Benchmark, texts: pa.Array) -> Iterator[tuple]:
    """(index of the text, item, similarity, distance, first word, words) of all items found."""
    low = pc.utf8_lower(texts)
    _, offs = buffers(low)
    for a, b in chunks(offs):
        h, wo = words_of(low.slice(a, b - a))
        # documents without any shingle of an item are passed over together
        near = np.zeros(b - a, bool)
        for length in bench.lengths:
            at = np.flatnonzero(bench.vocabulary(ngram_hash(h, length)) >= 0)
            near[np.searchsorted(wo, at, "right") - 1] = True
        for i in np.flatnonzero(near).tolist():
            for x in bench.hits(h[wo[i] : wo[i + 1]]):
                yield (a + i, *x)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, item: str = "item_id", text: str = "text") -> DataFrame:
    """A row per document and benchmark item found in it: doc_id, item_id, similarity, distance, start_word, n_words.

    Words are lower-cased runs without blanks or ASCII punctuation. An item of fewer than five words is one shingle; one
    without words, or without an id, is never found. Ids may be of any type; whole numbers come back as longs. Null and empty texts hold nothing. Repeated rows each count; an empty
    table on either side gives an empty result. Other columns are not read.
    """
    of = dict(benchmark.dtypes)[item]
    of = "bigint" if of in WHOLE else of
    passes, kind = [], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {of}, "
    item_type = pa.int64() if of == "bigint" else to_arrow_type(benchmark.schema[item].dataType)
    for shared in slices(benchmark, item, text, least):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, *cols = list(zip(*found(shared.value, batch.column(1)), strict=True)) or [()] * 6
                kinds = [item_type, pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "item_id", *(x.split()[0] for x in HITS.split(", "))])

        passes.append(docs.select("doc_id", text).mapInArrow(tidy(run), kind + HITS))
    return reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], kind + HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no item is found; nothing is shuffled."""
    at = docs.columns.index(text)
    for shared in slices(benchmark, item, text, least):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, *_ in found(shared.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, and which."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
