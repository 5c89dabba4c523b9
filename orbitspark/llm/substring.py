"""Substring deduplication by level-wise doubling.

Level one looks at windows of half the length that counts (only each window's seed, see repeats.py). Where those repeat
anywhere, the windows of twice the length are hashed and compared: a window that repeats at one length alone is extended to
twice that length. remove_repeats() stops at its window, for which the result is exact. longest_repeats() goes on doubling,
asking each time only about windows both of whose halves repeat, until no candidates survive.

Windows are compared by keys of 128 bits that are built by mixing halves, so no pattern of words makes two of them collide;
among 10**13 windows the chance of any collision is below 10**-12.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, materialize, ngram_hash, parts_of, tidy, totals, word_hash, word_spans
from .repeats import ELEMENTS, bucket_count, element_batch, hot_items, packed_text, range_arrays, repeated, row_ids, runs, spread, unpack_text, with_ranges

#: Seeds per byte of text, for the number of buckets: about 2 in 19 words start a run, and a word has 6 bytes.
SEEDS_PER_BYTE = 0.018


def _word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, wo = word_spans(buf, offs)
    return word_hash(buf, s, e), wo


def seed_elements(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """docs(row, text) → ELEMENTS of the seed of every window."""
    half = -(-window // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column("row").to_numpy(zero_copy_only=False), []
            buf, offs = buffers(batch.column("text"))
            for a, b in chunks(offs):
                h, wo = _word_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                doc, first, n, key = runs(ngram_hash(h, half), wo, half, window)
                parts.append((key, key, ids[a + doc], first - wo[doc], n))
            yield from element_batch(parts, buckets, brief=True)

    return docs.select("row", "text").mapInArrow(tidy(run), ELEMENTS)


def window_elements(docs: DataFrame, window: int, shift: int, buckets: int) -> DataFrame:
    """docs(row, z, ranges) → ELEMENTS of the windows at p where p, and p + shift unless that is 0, lie in the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts_of(whole, "z")):
            ids, parts = batch.column("row").to_numpy(zero_copy_only=False), []
            count, start, n = range_arrays(batch.column("ranges"))
            bounds = np.concatenate([[0], np.cumsum(count)])
            buf, offs = buffers(unpack_text(batch.column("z")))
            for a, b in chunks(offs):
                h, wo = _word_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if len(h) < window:
                    continue
                r = slice(bounds[a], bounds[b])
                base = np.repeat(wo[:-1], count[a:b])
                mask = spread(len(h), base + start[r], n[r])
                cand = np.zeros(len(h), bool)
                cand[: len(h) - shift] = mask[: len(h) - shift] & mask[shift:]
                doc = np.repeat(np.arange(b - a), np.diff(wo))
                p = np.flatnonzero(cand)
                p = p[p + window <= wo[doc[p] + 1]]
                if not len(p):
                    continue
                key = np.stack([ngram_hash(h, window)[p], ngram_hash(h, window, other=True)[p]], 1)
                # windows in a row travel together, so that their addresses stay ranges: the seed is their route unless it is hot
                half = -(-window // 2)
                rd, rf, rn, rk = runs(ngram_hash(h, half), wo, half, window)
                route = np.where(hot_items(batch.column("ranges"), len(h), base, r)[p], key[:, 0], rk[np.searchsorted(rf, p, "right") - 1])
                parts.append((key, route, ids[a + doc[p]], p - wo[doc[p]], np.ones(len(p), np.int64)))
            yield from element_batch(parts, buckets)

    # whatever else docs holds is read too: the shuffle of the join is then the one that the texts' last reader asks for
    return docs.where(F.col("ranges").isNotNull()).mapInArrow(tidy(run), ELEMENTS)


def repeated_windows(docs: DataFrame, packed: DataFrame, window: int, total_bytes: int) -> DataFrame:
    """RANGES of the starts of all windows whose word sequence also starts anywhere else. docs(row, text), packed(row, z, ...)."""
    seeds = repeated(seed_elements(docs, window, bucket_count(total_bytes * SEEDS_PER_BYTE)), brief=True)
    return repeated(window_elements(with_ranges(packed, seeds), window, 0, bucket_count(total_bytes / 24)), wide=True)


def longer_windows(packed: DataFrame, ranges: DataFrame, window: int, total_bytes: int) -> DataFrame:
    """From the ranges at `window` words to those at twice as many."""
    return repeated(window_elements(with_ranges(packed, ranges), 2 * window, window, bucket_count(total_bytes / 48)), wide=True)


def longest_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id and longest for each row of docs(doc_id, text, ...): the largest of window, 2 * window, 4 * window, ... words of which a
    window of the document occurs anywhere else, 0 where not even the first does. Odd cases are those of remove_repeats."""
    _, total = totals(docs)
    base = row_ids(docs.select("doc_id", "text"))
    packed = packed_text(base, ["row"])
    ranges, length, found = materialize(repeated_windows(base, packed, window, total))[0], window, []
    while ranges.limit(1).count():
        found.append(ranges.select("row", F.lit(length).cast("long").alias("length")))
        packed, _ = materialize(packed.join(ranges.select("row").distinct(), "row"))  # others hold no longer one
        ranges, _ = materialize(longer_windows(packed, ranges, length, total))
        length *= 2
    none = docs.sparkSession.createDataFrame([], "row long, length long")
    best = reduce(DataFrame.union, found, none).groupBy("row").agg(F.max("length").alias("longest"))
    return base.select("row", "doc_id").join(best, "row", "left").select("doc_id", F.coalesce("longest", F.lit(0)).alias("longest"))


def remove_repeats(docs: DataFrame, window: int = 35, texts: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Each row of docs(doc_id, text, ...) with its repeated words removed: keep (doc_id by default), n_words, n_removed,
    kept_sha256 and, with texts, kept_text: the text itself where nothing went, else the kept words joined by one space.

    A word goes if some window over it occurs anywhere else, in another document or the same one. A null or empty text has
    no words; a text shorter than the window keeps all. Repeated rows are rows like others, so they remove each other.
    Columns beyond `keep` are not read; columns of `keep` that bear a result's name give way to it. An empty table gives an
    empty one.
    """
    names = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])]
    out = removed(docs, window, texts, keep or ["doc_id"])
    return out.select(*(F.col(f"kept.`{c}`") for c in keep or ["doc_id"] if c not in names), *names)


def removed(docs: DataFrame, window: int, texts: bool, keep: list[str]) -> DataFrame:
    """remove_repeats with the columns of keep as one struct, `kept`, so that their names are free."""
    _, total = totals(docs)
    base = row_ids(docs.select(F.struct(*keep).alias("kept"), "doc_id", "text"))
    packed = packed_text(base, ["row", "kept"]).where("row is not null")  # alike for both joins, which then share one shuffle
    ranges = repeated_windows(base, packed, window, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts_of(whole, "z")):
            count, start, n = range_arrays(batch.column("ranges"))
            bounds = np.concatenate([[0], np.cumsum(count)])
            buf, offs = buffers(unpack_text(batch.column("z")))
            words, removed, sha, kept_texts = [], [], [], []
            for a, b in chunks(offs):
                part, po = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                s, e, wo = word_spans(part, po)
                r = slice(bounds[a], bounds[b])
                gone = spread(len(s), np.repeat(wo[:-1], count[a:b]) + start[r], n[r] + window - 1)
                # each kept word and one blank after it, copied as one gather
                size = np.where(gone, 0, e - s + 1)
                to = np.concatenate([[0], np.cumsum(size)])
                src = np.repeat(s - to[:-1], size) + np.arange(to[-1])
                text = np.where(np.arange(to[-1]) == np.repeat(to[1:] - 1, size), 32, part[np.minimum(src, max(0, len(part) - 1))]).astype(np.uint8).tobytes() if len(part) else b""
                lost = np.concatenate([[0], np.cumsum(gone)])
                for i in range(b - a):
                    mine = text[to[wo[i]] : max(to[wo[i]], to[wo[i + 1]] - 1)]
                    words.append(int(wo[i + 1] - wo[i]))
                    removed.append(int(lost[wo[i + 1]] - lost[wo[i]]))
                    sha.append(hashlib.sha256(mine).hexdigest())
                    if texts:
                        kept_texts.append((mine if removed[-1] else part[po[i] : po[i + 1]].tobytes()).decode("utf-8", "replace"))
            cols = [batch.column("kept"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), *([pa.array(kept_texts)] if texts else [])]
            yield pa.RecordBatch.from_arrays(cols, ["kept", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])])

    kinds = dict(packed.dtypes)
    schema = f"kept {kinds['kept']}" + ", n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return with_ranges(packed, ranges).mapInArrow(tidy(run), schema)


def op9_substring(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of its repeated 35-word windows."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35)
