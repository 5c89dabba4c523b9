"""Phrase collocations from generalised suffix automata.

Each shard of the corpus, some megabytes of one language, becomes one generalised suffix automaton over its pieces' words. A state
stands for phrases that end at the same places; how many places there are is summed along the suffix links, and the phrases of
bounded depth are the paths from the root. Shards' counts are summed by Spark, so that no shard, word or language is a bottleneck.

A longer candidate subsumes those that its suffix link, and its link in the automaton of the reversed texts, lead to: its longest
proper suffix and prefix. As depths fall one by one along these links, so are all phrases inside it reached.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, chunks, materialize, mix, tidy, word_hash, word_spans

#: Words of one automaton, and the most bytes of text that wait for one; both bound a worker's memory, not the result.
SHARD_WORDS, SHARD_BYTES = 450_000, 3 << 20
#: Contract.
LONGEST, LEAST, COVER, BEST = 3, 10, 50, 2_000
#: Parts of a language that are ranked side by side before its best are put together.
SPREAD = 64

BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK[[0x20, 0x09]] = True


class Automaton:
    """The generalised suffix automaton of the pieces of a shard, as deep as `depth` words.

    Phrases that end at the same places are one state. A state's link leads to the phrases that are its proper suffixes and end at
    more places; from the root, a path of words leads to the state of its phrase. Built level by level, a whole level at once:
    a phrase of d words is known by its first d - 1 words and its last one, and its longest suffix ends where it ends.
    """

    def __init__(self, words: np.ndarray, place: np.ndarray, counted: np.ndarray, depth: int):
        """words: numbers from 0, piece after piece; place: of each word in its piece; counted: whether what ends there counts."""
        size = int(words.max()) + 1 if len(words) else 1
        node, source, link, item, own, ends = [], [], [], [], [], []
        base, before = 1, np.zeros(len(words), np.int64)  # node 0 is the root
        for d in range(1, depth + 1):
            at = np.flatnonzero(place >= d - 1)
            if not len(at):
                break
            prefix = before[at - 1] if d > 1 else np.zeros(len(at), np.int64)
            _, first, new = np.unique(prefix * size + words[at], return_index=True, return_inverse=True)
            n, head = len(first), at[first]
            node.append((base, base + n))
            source.append(prefix[first])
            item.append(words[head])
            link.append(before[head] if d > 1 else np.zeros(n, np.int64))
            longest = (place[at] == d - 1) | (d == depth)
            ends.append(np.bincount(new[longest], minlength=n))
            own.append(np.bincount(new[longest & counted[at]], minlength=n))
            before = np.zeros(len(words), np.int64)
            before[at] = new + base
            base += n
        self.count, ends = (np.concatenate([[0], *x]).astype(np.int64) for x in (own, ends))
        state = np.arange(base)
        for (a, b), to in zip(reversed(node[1:]), reversed(link[1:]), strict=True):
            np.add.at(self.count, to, self.count[a:b])
            np.add.at(ends, to, ends[a:b])
        for (a, b), to in zip(reversed(node[1:]), reversed(link[1:]), strict=True):
            same = ends[a:b] == ends[to]  # all places, those of context as well, decide what is one state
            state[to[same]] = state[a:b][same]
        self.link = np.zeros(base, np.int64)  # of states; the deepest of a state's phrases comes last and so decides nothing
        source, item, link = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (source, item, link))
        out = state[1:] != state[link]
        self.link[state[1:][out]] = state[link[out]]
        key, first = np.unique(state[source] * size + item, return_index=True)
        self.source, self.item, self.target = key // size, item[first], state[1:][first]

    def phrases(self, depth: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """For each size up to depth: the phrases' words, an array for each place, and how often each phrase occurs."""
        state, items = np.zeros(1, np.int64), []
        for _ in range(depth):
            lo, hi = np.searchsorted(self.source, state), np.searchsorted(self.source, state, "right")
            n = hi - lo
            edge = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            items = [*(np.repeat(x, n) for x in items), self.item[edge]]
            state = self.target[edge]
            f = self.count[state]
            yield [x[f > 0] for x in items], f[f > 0]


def _lower(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def shard_counts(buf: np.ndarray, offs: np.ndarray, depth: int = LONGEST) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """Phrases, hashes of their words and counts, and how many words were counted, automaton by automaton, over texts of one language."""
    buf = _lower(buf)
    starts, ends, wo = word_spans(buf, offs, BREAK | BLANK)
    if not len(starts):
        return
    hashes, some, ids = np.unique(word_hash(buf, starts, ends), return_index=True, return_inverse=True)
    raw = buf.tobytes()
    names = pa.array([raw[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], pa.binary()).cast(pa.string())
    breaks = np.concatenate([[0], np.cumsum(BREAK[buf])])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = breaks[1:] != breaks[:-1]
    new[wo[:-1][wo[:-1] < len(starts)]] = True
    at = np.arange(len(starts))
    first = np.flatnonzero(new)
    place = at - first[np.cumsum(new) - 1]
    lo = 0
    while lo < len(at):  # pieces end to end; one that is cut goes on with its last words as context, which are not counted again
        hi = min(len(at), lo + SHARD_WORDS)
        head = lo - min(int(place[lo]), depth - 1)
        where = np.minimum(place[head:hi], at[head:hi] - head)
        found = Automaton(ids[head:hi], where, at[head:hi] >= lo, depth)
        parts = []
        for items, n in found.phrases(depth):
            words = [names.take(pa.array(x)) for x in items]
            h = hashes[items[0]]
            for x in items[1:]:
                h = mix(h) + hashes[x]
            parts.append((pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0], mix(h), n))
        phrases, keys, counts = zip(*parts, strict=True)
        yield pa.concat_arrays(phrases), np.concatenate(keys), np.concatenate(counts), hi - lo
        lo = hi


def phrase_counts(docs: DataFrame, depth: int = LONGEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, f: how often each phrase of at most `depth` words occurs within pieces, for each language; all words of a language
    stand under an empty phrase.

    A-Z are lower-cased. A null text is empty, a null language `und`; other columns are not read. Repeated rows count as often as
    they are there. An empty table, or one without words, gives no row.

    A shard's phrases travel together, a row for each partition that the hash of their words deals them to, so that the exchange
    carries text and counts and no row for each phrase. Most phrases of a shard are rare and none is there twice: combining rows
    before the exchange would save nothing. The most frequent phrase has one count a shard.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(of: str, phrase: pa.Array, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")  # within a bucket phrases stay by their first words, which helps compression
        found, first = np.unique(bucket[order], return_index=True)
        ends = pa.array(np.append(first, len(order)), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(ends, phrase.take(pa.array(order))), "\n")
        counts = pa.ListArray.from_arrays(ends, pa.array(n[order]))
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array([of] * len(found), pa.string()), joined, counts], ["bucket", "lang", "phrases", "fs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waits: Counter[str] = Counter()

        def flush(of: str) -> Iterator[pa.RecordBatch]:
            buf, offs = buffers(pa.concat_arrays(held.pop(of)))
            waits.pop(of)
            total = 0
            for a, b in chunks(offs, SHARD_BYTES):
                for phrase, h, n, words in shard_counts(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], depth):
                    total += words
                    yield rows(of, phrase, h, n)
            if total:
                yield rows(of, pa.array([""]), np.zeros(1, np.uint64), np.array([total]))

        for batch in batches:
            langs = batch.column(1).to_numpy(zero_copy_only=False)
            column = batch.column(0).cast(pa.large_string())
            for of in sorted(set(langs)):
                some = column.filter(pa.array(langs == of))
                held.setdefault(of, []).append(some)
                waits[of] += some.nbytes
                if waits[of] >= SHARD_BYTES:
                    yield from flush(of)
            while sum(waits.values()) > 4 * SHARD_BYTES:  # many languages
                yield from flush(waits.most_common(1)[0][0])
        for of in sorted(held):
            yield from flush(of)

    of = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    found = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), of.alias("l"))
    found = found.mapInArrow(tidy(run), "bucket int, lang string, phrases string, fs array<long>")
    found = found.repartitionById(buckets, F.col("bucket"))
    found = found.select("bucket", "lang", F.inline(F.arrays_zip(F.split("phrases", "\n").alias("phrase"), F.col("fs").alias("f"))))
    return found.groupBy("bucket", "lang", "phrase").agg(F.sum("f").alias("f")).drop("bucket")


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, best: int = BEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two or three words.

    a, l and r count the phrase and its two parts at the cut of lowest score, n all words of the language. The score is
    floor(1000000 * a * a / (l * r)), in decimals of 38 digits: exact for counts below 10^15. A phrase inside a longer candidate that
    has `cover` percent of its count or more gives way to it. No phrase is left out before it is ranked. Parts of candidates are as
    frequent as these, so a table of the frequent phrases, written once, holds all that is asked for. Odd rows: see phrase_counts.
    """
    counts = phrase_counts(docs, LONGEST, text, lang)
    counts, _ = materialize(counts.where((F.col("f") >= least) | (F.col("phrase") == "")).withColumn("size", F.size(F.split("phrase", " "))))
    total = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    f = counts.where("phrase <> ''")

    ways = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cut = f.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", ways)
    words = F.split("phrase", " ")
    cut = cut.withColumns({"left": F.concat_ws(" ", F.slice(words, F.lit(1), F.col("k"))), "right": F.concat_ws(" ", F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")))})
    cut = cut.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    lowest = F.min(F.struct(exact.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("m")
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("size").alias("size"), lowest)

    links = F.explode(F.array(F.concat_ws(" ", F.slice(words, F.lit(2), F.col("size") - 1)), F.concat_ws(" ", F.slice(words, F.lit(1), F.col("size") - 1))))
    longer = f.where("size > 2").select("lang", "f", "size", "phrase").select("lang", "f", links.alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a")))

    order = [F.col("m.score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)).alias("part")
    ranked = kept.select("lang", "phrase", "a", "m", part)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    out = ranked.join(total, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of every language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
