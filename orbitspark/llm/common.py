"""What the training-data operators share: written intermediate tables, text buffers, hashes and size estimates."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at once; bounds a worker's memory whatever the Arrow batch holds. One longer document goes alone.
CHUNK_BYTES = 512 << 10

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ------------------------------------------------------------------ written tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets a folder of its
    own; a cluster gets an error, as its executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orbitspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Rows of one Arrow batch. Texts of thousands of bytes make Spark's default of 10,000 rows tens of megabytes, held by the
#: executor, the worker and the result at once.
ARROW_ROWS = 1_024


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ARROW_ROWS, unless they have been set lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage: write df as Parquet in the shared folder and read it back; also returns the path, for drop()."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/orbitspark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Tables that materialize() has written and nothing has dropped yet, oldest first.
_WRITTEN: list[str] = []


def note_written(path: str) -> None:
    """Let drop_since() know of a table that was written otherwise."""
    _WRITTEN.append(path)


def written() -> int:
    """A mark for drop_since()."""
    return len(_WRITTEN)


def drop_since(spark: SparkSession, mark: int, *but: str) -> None:
    """Delete what materialize() has written since the mark, for a caller that has written its result down. Not for threads
    that share a session."""
    gone = [p for p in _WRITTEN[mark:] if p not in but]
    _WRITTEN[mark:] = [p for p in _WRITTEN[mark:] if p in but]
    drop(spark, *gone)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        if p in _WRITTEN:
            _WRITTEN.remove(p)
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text of all documents, in one native pass."""
    bound_batches(docs.sparkSession)
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


# ------------------------------------------------------------------ workers' memory
def trim() -> None:
    """Give freed memory back to the system: idle workers of other stages stay alive beside the busy ones."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


_KEPT: dict[str, dict] = {}


def keep(name: str, store: dict) -> dict:
    """Register what an operator keeps in a worker from task to task."""
    _KEPT[name] = store
    return store


def release(but: str | None) -> None:
    """Drop what other operators have kept in this worker."""
    for name, store in _KEPT.items():
        if name != but:
            store.clear()


def tidy(run, keeps: str | None = None):
    """A batch function that trims at the end of its partition, and of what is kept leaves only its own."""

    def tidied(batches):
        release(keeps)
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def tidy_group(settle):
    """The same for a function of one group."""

    def tidied(pdf):
        try:
            return settle(pdf)
        finally:
            trim()

    return tidied


# ------------------------------------------------------------------ text buffers
def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets. A null is an empty text. No Python string is made."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) else pa.large_binary()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges [a, b) of documents of about `limit` bytes together, one document at least."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def parts_of(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """The batch in slices whose texts have about `limit` bytes together: what is gathered from a slice is sent before the next."""
    offs = buffers(batch.column(column))[1]
    for a, b in chunks(offs, limit):
        yield batch.slice(a, b - a)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no space) and, for n documents, n + 1 offsets into them."""
    inner = ~space[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True  # a word never runs over a document's start
    prev = np.empty(len(buf) + 1, bool)
    prev[0] = False
    prev[1:] = inner
    starts = np.flatnonzero(inner & (~prev[:-1] | first[:-1]))
    cur = np.empty(len(buf) + 1, bool)
    cur[:-1] = inner
    cur[-1] = False
    ends = np.flatnonzero(prev & (~cur | first))
    return starts, ends, np.searchsorted(starts, offs)


# ------------------------------------------------------------------ hashes
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (splitmix finalizer)."""
    t = x >> np.uint64(30)
    x = x ^ t
    x *= _MIX1
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= _MIX2
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


_LENGTH = np.uint64(0x9E3779B97F4A7C15)
#: What tells the two halves of a 128-bit key apart.
_OTHER = np.uint64(0xA5A5A5A55A5A5A5A)
#: Words of more bytes are hashed one by one: a loop over eights must not be as long as the longest word.
LONG_WORD = 64


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the words buf[s:e]: eight bytes at a time, each step a bijection of what came before, so that words of at
    most eight bytes and one length never collide and no pattern of letters makes longer ones collide."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * _LENGTH + np.uint64(seed * 0x1000193 + 0x2545F4914F6CDD1D))
    if not len(h):
        return h
    eights = np.ndarray(len(buf), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    todo = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(todo):
        part = eights[starts[todo] + at]
        left = size[todo] - at
        part &= ~np.uint64(0) >> ((8 - np.clip(left, 1, 8)) * 8).astype(np.uint64)
        h[todo] = mix(h[todo] ^ part)
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed))
    return mix(h)


def _window_parts(values: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of windows of a power of two of items that together cover each n-item window."""
    k = len(values) - n + 1
    if k <= 0:
        return [np.zeros(0, np.uint64)]
    cover, g = 1, values
    while 2 * cover <= n:
        x = mix(g)
        g = x[:-cover] * _MIX1 + g[cover:]
        cover *= 2
    return [g[:k]] if cover == n else [g[:k], g[n - cover : n - cover + k]]


def ngram_hash(values: np.ndarray, n: int, other: bool = False) -> np.ndarray:
    """64-bit hashes of all n-item windows of 64-bit items, by doubling: a window's hash mixes those of its halves. other: a second
    hash that is independent of the first; the two make a 128-bit key."""
    parts = _window_parts(values, int(n))
    h = mix(parts[0] ^ _OTHER if other else parts[0])
    for p in parts[1:]:
        h = mix(h + mix(p ^ _OTHER if other else p) * _MIX2)
    return mix(h + np.uint64(int(n) * int(_LENGTH) % 2**64))


def byte_ngram_hash(buf: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-byte windows: a filter whose answer is checked on the bytes."""
    n = int(n)
    if len(buf) < n:
        return np.zeros(0, np.uint64)
    if n < 8:
        return short_byte_hash(buf, n)
    k = len(buf) - n + 1
    eights = np.ndarray(len(buf) - 7, "<u8", np.ascontiguousarray(buf), strides=(1,)).copy()
    places = [*range(0, n - 8, 8), n - 8]
    h = eights[places[0] : places[0] + k] * _MIX1
    t = np.empty_like(h)
    for p in places[1:]:
        np.right_shift(h, np.uint64(29), out=t)
        h ^= t
        h += eights[p : p + k]
        h *= _MIX2
    return mix(h)


def short_byte_hash(buf: np.ndarray, n: int) -> np.ndarray:
    """The same for windows shorter than eight bytes, which are hashed without loss."""
    k = len(buf) - n + 1
    h = np.zeros(k, np.uint64)
    for j in range(n):
        h = h << np.uint64(8) | buf[j : j + k].astype(np.uint64)
    return mix(h)
