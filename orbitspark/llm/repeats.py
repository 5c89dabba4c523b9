"""Finding equal windows across all documents without shuffling every window.

A window of `length` items has one seed: the sub-window of `seed_length` items with the smallest hash (leftmost on ties).
Equal windows have equal seeds, so a window can repeat only if its seed does; consecutive windows that share a seed
occurrence form a run, which travels as one element. Elements go to hash buckets as packed arrays with a return address.
A batch writes one record for each bucket that it has elements for, so the work grows with the input, whatever the number of
buckets. An element seen twice in one batch is settled there and sends its key once, with its count and the places; one seen
DENSE times keeps its places at home and sends key and count alone, so a key that a third of the documents hold costs its
bucket some bytes a batch. What comes back is ranges of window starts by document, and whether their key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, tidy, tidy_group

#: Elements that a bucket holds, about, and the fewest buckets.
BUCKET_ELEMENTS, BUCKETS = 256_000, 48
#: A seed that occurs more often is hot: what shares it is dealt out by finer keys at the next level. Up to here its windows, some
#: dozens of bytes each, fit in a task.
HOT = 65_536
#: A key that one batch holds so often is hot as well, and its places in that batch do not travel to its bucket.
DENSE = 64

ELEMENTS = "bucket int, solo binary, known binary, times binary, address binary, settled binary, home binary"
NAMES = [c.split()[0] for c in ELEMENTS.split(", ")]
#: Types of ids that are whole numbers.
WHOLE = ("bigint", "int", "smallint", "tinyint")
RANGES = "row long, start int, n int, hot boolean"
_ADDRESS = np.dtype([("row", "<i8"), ("start", "<u4"), ("n", "<u4")])


def bucket_count(elements: float) -> int:
    return max(BUCKETS, int(elements // BUCKET_ELEMENTS) + 1)


def has_own_ids(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether the key is a unique whole number and never null."""
    return dict(docs.dtypes)[key] in WHOLE and not docs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count()


def row_ids(docs: DataFrame, key: str = "doc_id", ordered: bool = False, own: bool | None = None) -> DataFrame:
    """docs plus `row`, a long that tells rows apart and is the same whenever docs is read: the key where it is a unique whole
    number and never null (own, asked here unless it is given), else a running number that is written down with the rows. ordered: it
    grows with the key, then the text, and null keys come last."""
    if not (has_own_ids(docs, key) if own is None else own):
        if ordered:
            docs = docs.orderBy(F.col(key).asc_nulls_last(), "text")
        return materialize(docs.withColumn("row", F.monotonically_increasing_id()))[0]
    return docs.withColumn("row", F.col(key).cast("long"))


def deflate(a: np.ndarray | bytes) -> bytes:
    return zstandard.compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes(), 1)


def inflate(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def packed_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep plus `z`, the text compressed: it is shuffled at every level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [squeeze(t or b"") for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(z, pa.binary())], [*keep, "z"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(tidy(run), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", z binary")


def unpack_text(z: pa.Array) -> pa.Array:
    out = zstandard.ZstdDecompressor().decompress
    return pa.array([out(x) for x in z.to_pylist()], pa.large_binary())


# ------------------------------------------------------------------ windows of one chunk
def runs(hashes: np.ndarray, offs: np.ndarray, seed_length: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes: of the seed windows at each item; offs: documents' items. Per run: document, first window (in the chunk),
    number of windows, and the seed's hash."""
    n, w = int(offs[-1]), length - seed_length + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    bits = np.uint64(max(28, n.bit_length()))  # the same for all chunks: equal windows must choose equal seeds
    low = (np.uint64(1) << bits) - np.uint64(1)
    m = hashes & ~low
    m |= np.arange(len(hashes), dtype=np.uint64)
    cover = 1
    while cover < w:
        step = min(cover, w - cover)
        m = np.minimum(m[:-step], m[step:])
        cover += step
    # windows that end within their document
    size = np.diff(offs)
    edge = np.zeros(len(m) + 1, np.int8)
    full = size >= length
    np.add.at(edge, offs[:-1][full], 1)
    np.add.at(edge, (offs[1:] - length + 1)[full], -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    at = (m[first] & low).astype(np.int64)
    # a run ends where the next begins or where windows stop being valid
    stop = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
    nxt = np.append(first[1:], len(m))
    last = stop[np.searchsorted(stop, first, "right")] if len(first) else none
    return np.searchsorted(offs, first, "right") - 1, first, np.minimum(nxt, last) - first, hashes[at]


# ------------------------------------------------------------------ the exchange
def short(keys: np.ndarray) -> bytes:
    """The upper 40 bits of each key. Buckets take the lower bits, so two keys of one bucket seldom look alike: enough for a
    filter, whose answer the next level checks."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def unshort(b: bytes) -> np.ndarray:
    x = np.zeros((len(b) // 5, 8), np.uint8)
    x[:, 3:] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return x.view(np.uint64).ravel()


def classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 64-bit keys (n,) or 128-bit ones (n, 2): the number of each one's class, the classes' sizes, their first members."""
    one = keys if keys.ndim == 1 else keys[:, 0]
    order = np.argsort(one, kind="stable")
    new = np.ones(len(one), bool)
    new[1:] = one[order][1:] != one[order][:-1]
    if keys.ndim == 2:
        two = keys[:, 1][order]
        if (~new[1:] & (two[1:] != two[:-1])).any():
            order = np.lexsort((keys[:, 1], one))
            two = keys[:, 1][order]
            new[1:] = one[order][1:] != one[order][:-1]
            new[1:] |= two[1:] != two[:-1]
    first = np.flatnonzero(new)
    number = np.empty(len(one), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.diff(np.append(first, len(one))), order[first]


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and where."""
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else order
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def element_rows(keys: np.ndarray, route: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, buckets: int, brief: bool = False) -> Iterator[tuple]:
    """One batch's elements as rows of ELEMENTS. route decides the bucket: equal keys have equal routes. brief: see short()."""
    put = short if brief else (lambda k: np.ascontiguousarray(k).tobytes())
    if not len(keys):
        return
    inv, count, first = classes(keys)
    dense, twice = count[inv] >= DENSE, count[inv] > 1
    bucket = (route % np.uint64(buckets)).astype(np.int64)
    address = np.empty(len(keys), _ADDRESS)
    address["row"], address["start"], address["n"] = row, start, n
    lead = np.zeros(len(keys), bool)
    lead[first] = True
    go = np.flatnonzero(~dense | lead)
    for b, i in by_bucket(bucket[go]):
        i = go[i]
        solo, known, done = i[~twice[i]], i[twice[i] & lead[i]], i[twice[i] & ~dense[i]]
        known, done = known[np.argsort(inv[known])], done[np.argsort(inv[done], kind="stable")]  # places by key, as known lists them
        times = count[inv[known]].astype("<u4") | (dense[known].astype("<u4") << np.uint32(31))
        yield b, put(keys[solo]), put(keys[known]), times.tobytes(), deflate(_columns(address[solo])), deflate(_columns(address[done])), None
    if dense.any():
        home = np.flatnonzero(dense)
        home = home[np.lexsort((start[home], row[home]))]
        yield int(mix(np.array([row[0] + len(row)], np.uint64))[0] % np.uint64(buckets)), b"", b"", b"", _NOWHERE, _NOWHERE, deflate(_columns(address[home]))


def _columns(a: np.ndarray) -> bytes:
    """Column by column: row numbers and positions each compress better alone."""
    return b"".join(np.ascontiguousarray(a[c]).tobytes() for c in a.dtype.names)


def _uncolumn(b: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.decompress(b)
    n = len(raw) // _ADDRESS.itemsize
    return {"row": np.frombuffer(raw, "<i8", n), "start": np.frombuffer(raw, "<u4", n, 8 * n), "n": np.frombuffer(raw, "<u4", n, 12 * n)}


_NOWHERE = deflate(b"")


def element_batch(parts: list[tuple], buckets: int, brief: bool = False) -> Iterator[pa.RecordBatch]:
    """The elements (keys, route, row, start, n) of one batch's chunks as a batch of ELEMENTS."""
    rows = list(element_rows(*(np.concatenate(c) for c in zip(*parts, strict=True)), buckets, brief)) if parts else []
    if rows:
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], NAMES)


def merge_ranges(row: np.ndarray, start: np.ndarray, n: np.ndarray, hot: np.ndarray | None = None) -> pd.DataFrame:
    """Ranges that follow one another in the order given, and are as hot, become one. RANGES."""
    row, start, n = row.astype(np.int64), start.astype(np.int64), n.astype(np.int64)
    hot = np.zeros(len(row), bool) if hot is None else hot
    end = start + n
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != end[:-1]) | (hot[1:] != hot[:-1])
    i = np.flatnonzero(new)
    last = end[np.append(i[1:], len(row)) - 1] if len(row) else end
    return pd.DataFrame({"row": row[i], "start": start[i].astype(np.int32), "n": (last - start[i]).astype(np.int32), "hot": hot[i]})


def repeated(elements: DataFrame, brief: bool = False, wide: bool = False) -> DataFrame:
    """RANGES of the elements whose key occurs at least twice anywhere. brief: see short(); wide: keys have 128 bits."""

    def take(b: bytes) -> np.ndarray:
        return unshort(b) if brief else np.frombuffer(b, np.uint64).reshape(-1, 2) if wide else np.frombuffer(b, np.uint64)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        solo, known = ([take(x) for x in pdf[c]] for c in ("solo", "known"))
        times = [np.frombuffer(x, "<u4") for x in pdf["times"]]
        inv, size, _ = classes(np.concatenate([*solo, *known]))
        alone, each = sum(map(len, solo)), np.concatenate(times)
        held, dense = each & np.uint32((1 << 31) - 1), each >> np.uint32(31)
        count = np.bincount(inv, weights=np.concatenate([np.ones(alone), held]), minlength=len(size))[inv]
        hot = (np.bincount(inv, weights=np.concatenate([np.zeros(alone), dense]), minlength=len(size))[inv] > 0) | (count > HOT)
        out, at, behind = [], 0, alone
        for mine, theirs, address, settled, home in zip(solo, times, pdf["address"], pdf["settled"], pdf["home"], strict=True):
            if home is not None:
                h = _uncolumn(home)
                out.append(merge_ranges(h["row"], h["start"], h["n"], np.ones(len(h["row"]), bool)))
                continue
            i, k = slice(at, at + len(mine)), slice(behind, behind + len(theirs))
            at, behind = i.stop, k.stop
            hit, stay = count[i] > 1, np.where(theirs >> np.uint32(31), 0, theirs)
            a, s = _uncolumn(address), _uncolumn(settled)
            row, start, n = (np.concatenate([a[x][hit], s[x]]) for x in _ADDRESS.names)
            warm = np.concatenate([hot[i][hit], np.repeat(hot[k], stay)])
            o = np.lexsort((start, row))
            out.append(merge_ranges(row[o], start[o], n[o], warm[o]))
        return pd.concat(out, ignore_index=True)

    return elements.groupBy("bucket").applyInPandas(tidy_group(settle), RANGES)


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs (with row) plus `ranges`, array<struct<start, n, hot>>, null where there are none."""
    lists = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "n", "hot")).alias("ranges"))
    return docs.join(lists, "row", "left")


def range_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's `ranges`: number per document, starts, lengths."""
    if col.null_count == len(col):
        return np.zeros(len(col), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    import pyarrow.compute as pc

    count = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(col)
    return count, flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)


def spread(size: int, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Boolean mask of `size` with [start, start + n) set for every range."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, np.minimum(starts, size), 1)
    np.add.at(d, np.minimum(starts + n, size), -1)
    return np.cumsum(d[:-1]) > 0


def hot_items(col: pa.Array, size: int, base: np.ndarray, part: slice) -> np.ndarray:
    """Mask over a chunk's items: starts of windows in hot ranges. base: where the documents of these ranges begin."""
    import pyarrow.compute as pc

    if col.null_count == len(col):
        return np.zeros(size, bool)
    flat = pc.list_flatten(col)
    hot = flat.field("hot").to_numpy(zero_copy_only=False)[part]
    start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64)[part] for c in ("start", "n"))
    return spread(size, (base + start)[hot], n[hot]) if hot.any() else np.zeros(size, bool)
