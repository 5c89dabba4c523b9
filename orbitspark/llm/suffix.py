"""Suffix-array deduplication of bytes: what a document shares with one of a smaller id goes.

1. The seed of every window (repeats.py) is looked up across all documents; windows whose seed is unique are done.
2. The bytes of the runs that are left go to the buckets of their seeds, those of windows with a hot seed one by one, dealt out by
   their own hash. Copies are put together on the way, first in a batch, then in the bucket: of runs that are the same byte for
   byte only the smallest row's goes on.
3. Windows whose hash is unique in the bucket have no equal. The parts of runs that are left are put end to end, seed by seed, and
   sorted by suffix arrays (gsaca.py). Equal windows are neighbours there: neighbours are compared byte by byte, and every
   window but those of the smallest row is removed. A seed's parts that make a very long string are sorted in several, whose
   sorted windows are merged.

Hashes only say where to look; what is removed follows from the order of the suffixes and from bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, byte_ngram_hash, chunks, materialize, mix, parts_of, tidy, tidy_group, totals
from .gsaca import _spans, suffix_arrays
from .repeats import ELEMENTS, RANGES, bucket_count, by_bucket, deflate, element_batch, has_own_ids, hot_items, inflate, merge_ranges, packed_text, range_arrays, repeated, row_ids, runs, spread, unpack_text, with_ranges

#: Bytes hashed or marked at once: a byte takes some dozens of bytes of working memory.
CHUNK = 384 << 10
#: Bytes of one string that is suffix-sorted, about, and at most for the runs of one seed.
STRING, LONG = 1_536, 6_144
#: Bytes whose strings are sorted together; bounds a worker's memory.
TOGETHER = 512 << 10
#: Bytes of text a bucket, about.
BUCKET_BYTES = 6 << 20


def seed_of(window: int) -> int:
    return max(1, min(22, window // 2))


def seeds(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts_of(whole, "text")):
            ids, parts = batch.column("row").to_numpy(zero_copy_only=False), []
            buf, offs = buffers(batch.column("text"))
            for a, b in chunks(offs, CHUNK):
                o = offs[a : b + 1] - offs[a]
                doc, first, n, key = runs(byte_ngram_hash(buf[offs[a] : offs[b]], seed_of(window)), o, seed_of(window), window)
                parts.append((key, key, ids[a + doc], first - o[doc], n))
            yield from element_batch(parts, buckets, brief=True)

    return docs.select("row", "text").mapInArrow(tidy(run), ELEMENTS)


STRINGS = "bucket int, seed binary, row binary, start binary, n binary, bytes binary, gone binary"


def eights(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number from the first and last eight bytes of each stretch buf[at:at + size]; equal stretches have equal ones."""
    view = np.ndarray(len(buf), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    some = ~np.uint64(0) >> ((8 - np.minimum(size, 8)) * 8).astype(np.uint64)
    return mix(view[at] & some) + (view[at + np.maximum(size - 8, 0)] & some)


def first_copies(buf: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each stretch the number of the one with the same key and, byte for byte, the same content that has the smallest row: itself,
    if it is the first or none is the same."""
    guess = mix(key ^ eights(buf, at, size)) + size.astype(np.uint64)
    order = np.lexsort((row, guess))
    new = np.ones(len(order), bool)
    new[1:] = guess[order][1:] != guess[order][:-1]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    ask = np.flatnonzero(~new)
    ask, lead = order[ask], lead[ask]
    same = (key[ask] == key[lead]) & (size[ask] == size[lead])
    ask, lead = ask[same], lead[same]
    out = np.arange(len(at))
    step = 65_536
    for lo in range(0, len(ask), step):
        x, y = ask[lo : lo + step], lead[lo : lo + step]
        differ = buf[_spans(at[x], size[x])] != buf[_spans(at[y], size[y])]
        equal = ~np.logical_or.reduceat(differ, np.cumsum(size[x]) - size[x])
        out[x[equal]] = y[equal]
    return out


def candidate_strings(docs: DataFrame, window: int, buckets: int, bits: int = 0) -> DataFrame:
    """docs(row, z, ranges) → STRINGS: the bytes of each run of windows in the ranges, in the bucket of its seed, or of each window
    by itself where the seed is hot. Runs that equal one of a smaller row in their batch are settled (gone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts_of(whole, "z", 2 << 20)):
            ids, parts = batch.column("row").to_numpy(zero_copy_only=False), []
            count, start, n = range_arrays(batch.column("ranges"))
            bounds = np.concatenate([[0], np.cumsum(count)])
            buf, offs = buffers(unpack_text(batch.column("z")))
            for a, b in chunks(offs, CHUNK):
                x, o = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                hashes = byte_ngram_hash(x, seed_of(window))
                doc, first, m, key = runs(hashes, o, seed_of(window), window)
                if not len(first):
                    continue
                r = slice(bounds[a], bounds[b])
                base = np.repeat(o[:-1], count[a:b]) + start[r]
                mine = spread(len(x), base, n[r])[first]
                doc, first, m, key = doc[mine], first[mine], m[mine], key[mine]
                hot = hot_items(batch.column("ranges"), len(x), np.repeat(o[:-1], count[a:b]), r)[first]
                if hot.any():
                    each = np.where(hot, m, 1)
                    inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    doc, key, hot = np.repeat(doc, each), np.repeat(key, each), np.repeat(hot, each)
                    first, m = np.repeat(first, each) + inner, np.where(hot, 1, np.repeat(m, each))
                    own = byte_ngram_hash(x, window)
                    key = np.where(hot, mix(own[first] + np.uint64(1)), key)
                parts.append((key, ids[a + doc], first - o[doc], m, first + offs[a]))
            if not parts:
                continue
            key, row, start, n, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            size = n + window - 1
            lost = row >> bits > row[first_copies(buf, at, size, key, row)] >> bits
            out, go = [], np.flatnonzero(~lost)
            for k, i in by_bucket((key[go] % np.uint64(buckets)).astype(np.int64)):
                i = go[i]
                out.append((k, (key[i] >> np.uint64(32)).astype(np.uint32).tobytes(), deflate(row[i].astype("<i8")), deflate(start[i].astype("<i4")), deflate(n[i].astype("<i4")), deflate(buf[_spans(at[i], size[i])]), None))
            if lost.any():
                i = np.flatnonzero(lost)
                i = i[np.lexsort((start[i], row[i]))]
                gone = row[i].astype("<i8").tobytes() + start[i].astype("<i4").tobytes() + n[i].astype("<i4").tobytes()
                out.append((int(mix(ids[:1].astype(np.uint64))[0] % np.uint64(buckets)), b"", *[deflate(b"")] * 4, deflate(gone)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], [c.split()[0] for c in STRINGS.split(", ")])

    return docs.where(F.col("ranges").isNotNull()).select("row", "z", "ranges").mapInArrow(tidy(run), STRINGS)


def sorted_windows(text: np.ndarray, size: np.ndarray, string: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """text: contexts of `size` bytes end to end; string: the number of the string that each belongs to, in order. Returns the starts
    of all windows in suffix order, string by string, and whether each equals the one before it."""
    at = np.cumsum(size) - size
    # each context is followed by a 1, each string's last symbol is the only 0
    new_at = at + np.arange(len(size))
    sym = np.ones(len(text) + len(size), np.int64)
    where = _spans(new_at, size)
    sym[where] = text.astype(np.int64) + 2
    last = np.flatnonzero(np.append(string[1:] != string[:-1], True))
    ends = new_at[last] + size[last] + 1
    sym[ends - 1] = 0
    bounds = np.concatenate([[0], ends])
    sa = suffix_arrays(sym, bounds)
    origin = np.full(len(sym), -1, np.int64)
    ok = np.arange(len(where)) - np.repeat(at, size) <= np.repeat(size - window, size)
    origin[where[ok]] = np.flatnonzero(ok)
    starts = origin[sa]
    owner = np.repeat(np.arange(len(ends)), np.diff(bounds))[starts >= 0]
    starts = starts[starts >= 0]
    same = np.zeros(len(starts), bool)
    view = np.lib.stride_tricks.sliding_window_view(text, window)
    step = max(1, (8 << 20) // window)
    for lo in range(1, len(starts), step):
        hi = min(len(starts), lo + step)
        same[lo:hi] = (owner[lo:hi] == owner[lo - 1 : hi - 1]) & (view[starts[lo:hi]] == view[starts[lo - 1 : hi - 1]]).all(1)
    return starts, same


def repeated_parts(text: np.ndarray, at: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (place `at`, n of them) cut down to the parts whose windows' hashes occur at least twice here: number of the
    run, first window in it, number of windows. A window whose hash is unique has no equal, so it needs no sorting."""
    hashes, size, lo = [np.zeros(0, np.uint64)], n + window - 1, 0
    ends = np.cumsum(size)
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + CHUNK, "right")))
        part = text[_spans(at[lo:hi], size[lo:hi])]
        hashes.append(byte_ngram_hash(part, window)[_spans(np.cumsum(size[lo:hi]) - size[lo:hi], n[lo:hi])])
        lo = hi
    _, inv, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    again = count[inv] > 1
    run = np.repeat(np.arange(len(n)), n)
    new = again.copy()
    new[1:] &= ~again[:-1] | (run[1:] != run[:-1])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(again & ~np.append(again[1:] & (run[1:] == run[:-1]), False)) + 1
    return run[first], first - (np.cumsum(n) - n)[run[first]], stop - first


def strings_of(seed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the runs, the string that each lies in, by that order, and whether that is one of several of its seed. Seeds whose
    runs are shorter together come first, so that strings sorted together are about as long."""
    _, inv = np.unique(seed, return_inverse=True)
    total = np.bincount(inv, weights=size).astype(np.int64)
    order = np.lexsort((inv, total[inv]))
    inv, size = inv[order], size[order]
    start = np.cumsum(size) - size
    new = np.ones(len(inv), bool)
    new[1:] = inv[1:] != inv[:-1]
    long = total[inv] > LONG
    group = start[np.flatnonzero(new)][np.cumsum(new) - 1]  # where the seed's first run starts
    return order, np.where(long, (1 << 50) + start // LONG, group // STRING), long


def _settle_strings(window: int, bits: int = 0):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in pdf["gone"].dropna():
            x = inflate(b, np.uint8)
            k = len(x) // 16
            out.append(merge_ranges(*(np.frombuffer(x[i * k : j * k].tobytes(), t) for i, j, t in ((0, 8, "<i8"), (8, 12, "<i4"), (12, 16, "<i4")))))
        seed = np.frombuffer(b"".join(pdf["seed"]), np.uint32)
        row = np.concatenate([inflate(b, "<i8") for b in pdf["row"]])
        start, n = (np.concatenate([inflate(b, "<i4") for b in pdf[c]]).astype(np.int64) for c in ("start", "n"))
        text = np.concatenate([inflate(b, np.uint8) for b in pdf["bytes"]])
        at = np.cumsum(n + window - 1) - (n + window - 1)
        first = first_copies(text, at, n + window - 1, seed.astype(np.uint64), row)
        alone = first == np.arange(len(first))
        rank = row >> bits
        i = np.flatnonzero(rank > rank[first])
        i = i[np.lexsort((start[i], row[i]))]
        out.append(merge_ranges(row[i], start[i], n[i]))
        # copies in the first one's own row, or in one of the same id, share its fate
        twins = np.flatnonzero(~alone & (rank == rank[first]))
        twins = twins[np.argsort(first[twins], kind="stable")]
        different = np.flatnonzero(alone)
        part, inner, n = repeated_parts(text, at[different], n[different], window)
        who, inside = lost_windows(text, at[different[part]] + inner, n + window - 1, seed[different[part]], rank[different[part]], window)
        run, inside = different[part[who]], inner[who] + inside
        a, b = (np.searchsorted(first[twins], run, side) for side in ("left", "right"))
        run, inside = np.concatenate([run, twins[_spans(a, b - a)]]), np.concatenate([inside, np.repeat(inside, b - a)])
        o = np.lexsort((start[run] + inside, row[run]))
        out.append(merge_ranges(row[run][o], (start[run] + inside)[o], np.ones(len(o), np.int64)))
        return pd.concat(out, ignore_index=True)

    return settle


def lost_windows(text: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the parts text[at:at + size], all windows that equal one of a smaller row with the same seed: numbers of the parts, and the
    windows' places in them. Seed by seed the parts are sorted by their suffix array, whose neighbours are compared."""
    order, string, long = strings_of(seed, size)
    ends = np.cumsum(size[order])
    edge = np.flatnonzero(np.append(string[1:] != string[:-1], True)) + 1 if len(order) else order  # where strings end
    none = np.zeros(0, np.int64)
    classes, owners, places, many, lo, made = [none], [none], [none], [], 0, 0
    while lo < len(order):
        hi = edge[min(len(edge) - 1, max(np.searchsorted(edge, lo, "right"), np.searchsorted(ends[edge - 1], (ends[lo - 1] if lo else 0) + TOGETHER, "right") - 1))]
        i = order[lo:hi]
        part, to = text[_spans(at[i], size[i])], np.cumsum(size[i])
        w, same = sorted_windows(part, size[i], string[lo:hi], window)
        mine, c = np.searchsorted(to, w, "right"), made + np.cumsum(~same) - 1
        made = c[-1] + 1
        lead = np.flatnonzero(~same & long[lo:hi][mine])  # to be merged with the other strings of their seed
        if len(lead):
            view = np.lib.stride_tricks.sliding_window_view(part, window)
            many.append((c[lead], np.ascontiguousarray(view[w[lead]])))
        classes.append(c)
        owners.append(i[mine])
        places.append(w - (to - size[i])[mine])
        lo = hi
    classes, owners, places = map(np.concatenate, (classes, owners, places))
    if many:
        c, raw = (np.concatenate(x) for x in zip(*many, strict=True))
        raw = raw.view(f"V{window}").ravel()
        by = np.argsort(raw, kind="stable")  # a merge of sorted runs
        new = np.ones(len(by), bool)
        new[1:] = raw[by][1:] != raw[by][:-1]
        same_as = np.arange(made)
        same_as[c[by]] = c[by[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        classes = same_as[classes]
    least = np.full(made, np.iinfo(np.int64).max)
    np.minimum.at(least, classes, row[owners])
    lost = row[owners] > least[classes]
    return owners[lost], places[lost]


def ranked_rows(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs plus `row`, a number of its own for each row, and how many of its low bits tell rows of one id apart: without them it is the
    id's rank. Null ids come last, each with a rank of its own. Numbers are given range by range and then offset, so that no
    id, however often it is there, meets in one task."""
    placed = docs.repartitionByRange(F.col("doc_id").asc_nulls_last(), "text").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    placed, _ = materialize(placed.withColumns({"p": F.spark_partition_id(), "i": F.monotonically_increasing_id()}))
    runs = placed.groupBy("p", "doc_id").agg(F.min("i").alias("i0"), F.count(F.lit(1)).alias("m"))  # an id's rows of a range lie together
    before = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("k0", F.coalesce(F.sum("m").over(before), F.lit(0)))
    ids = runs.where("doc_id is not null").groupBy("doc_id").agg(F.min("p").alias("p"), F.sum("m").alias("m"))
    local = ids.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("doc_id")) - 1)
    first = local.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("r0", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = local.join(first, "p").select("doc_id", (F.col("r") + F.col("r0")).alias("rank"))
    n, most = ids.agg(F.count(F.lit(1)), F.max("m")).first()
    bits = max(0, int(most or 1) - 1).bit_length()
    if int(n).bit_length() + bits > 62:
        raise ValueError("too many ids that are repeated too often")
    runs, _ = materialize(runs.join(ranks, "doc_id", "left"))
    rows = placed.alias("x").join(runs.alias("y"), (F.col("x.p") == F.col("y.p")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")))
    k = F.col("x.i") - F.col("y.i0") + F.col("y.k0")
    row = F.when(F.col("y.rank").isNull(), F.shiftleft(F.lit(n) + k, bits)).otherwise(F.shiftleft("y.rank", bits) + k)
    return materialize(rows.select("x.doc_id", "x.text", row.alias("row")))[0], bits


def remove_seen(docs: DataFrame, window: int = 50, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept (binary) for each row of docs(doc_id, text, ...).

    A byte goes if a `window`-byte string over it also starts in a document with a smaller id. A null text is empty; one
    shorter than the window keeps all. Rows that share an id are documents of
    their own, and as none has the smaller id, none of them loses a byte to another. Rows with a null id come after all others, each
    with a larger id than those of smaller text. Other columns are not read; an empty table gives an empty one.
    """
    _, total = totals(docs)
    own = has_own_ids(docs)
    base, bits = (row_ids(docs.select("doc_id", "text"), own=True), 0) if own else ranked_rows(docs.select("doc_id", "text"))
    packed = packed_text(base, ["row"]).where("row is not null")  # alike for both joins, which then share one shuffle
    found, _ = materialize(repeated(seeds(base, window, bucket_count(total * 0.06)), brief=True))
    strings = candidate_strings(with_ranges(packed, found), window, max(48, total // BUCKET_BYTES), bits)
    ranges = strings.groupBy("bucket").applyInPandas(tidy_group(_settle_strings(window, bits)), RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts_of(whole, "z", 4 << 20)):
            count, start, n = range_arrays(batch.column("ranges"))
            buf, offs = buffers(unpack_text(batch.column("z")))
            bounds = np.concatenate([[0], np.cumsum(count)])
            figures, parts, sha = [], [], []
            for a, b in chunks(offs, CHUNK):
                x, o, r = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], slice(bounds[a], bounds[b])
                gone = spread(len(x), np.repeat(o[:-1], count[a:b]) + start[r], n[r] + window - 1)
                lost = np.concatenate([[0], np.cumsum(gone)])
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                inner = o[:-1][o[:-1] < len(x)]
                head[inner] |= gone[inner]
                spans = np.concatenate([[0], np.cumsum(head)])
                kept, to = x[~gone].tobytes(), o - lost[o]
                mine = [kept[i:j] for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
                sha += [hashlib.sha256(p).hexdigest() for p in mine]
                parts += mine if texts else []
                figures.append(np.stack([np.diff(o), np.diff(lost[o]), np.diff(spans[o])]))
            three = np.concatenate(figures, 1) if figures else np.zeros((3, 0), np.int64)
            cols = [batch.column("row"), *(pa.array(f.astype(np.int64)) for f in three), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(parts, pa.binary())] if texts else [])], ["row", *figures_of])

    kind, figures_of = dict(docs.dtypes)["doc_id"], ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    done = with_ranges(packed, ranges).mapInArrow(tidy(run), "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
    if not own:
        return done.join(base.select("row", "doc_id"), "row").select("doc_id", *figures_of)
    return done.select(F.col("row").cast(kind).alias("doc_id"), *figures_of)


def op10_suffix(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its 50-byte strings that a document with a smaller id holds too."""
    return remove_seen(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)
