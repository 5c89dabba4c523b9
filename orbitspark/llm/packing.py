"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document is cut where it is encoded, at every `capacity` tokens from its start, and the pieces are dealt out with their
ids, two bytes an id where all of a piece's ids fit. Each group of about GROUP_ROWS pieces, chosen by a seeded hash, is packed
on its own; its open last bins are the only padding that grouping adds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, keep, parts_of, tidy

GROUP_ROWS = 2048
#: Words whose ids a worker keeps in each of two generations: a word not met for a whole generation goes.
CACHE_WORDS = 900_000

#: Bytes of text encoded at once: their ids are sent before the next are made.
PART_BYTES = 2 << 20

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
PACKED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


class WordEncoder:
    """Ids of whole texts by a word-end BPE, which never joins characters across ASCII blanks: words are encoded once and kept.

    ASCII letters are lowered first, as the vocabulary's own normalizer does, unless a text may hold a special token.
    """

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.kept, self.old = Tokenizer.from_file(path), {}, {}
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def fill(self, words: set[bytes]) -> None:
        """Encode words not kept yet. Words of letters alone go as lines of many: each is one pre-token, whose last id ends a
        word. A final full stop or comma behind a letter is a pre-token of its own."""
        ended = [w for w in words if w[-1:] in (b".", b",") and b"a" <= w[-2:-1] <= b"z" and w[:1] != b"<"]
        bare = words.difference(ended) | {w[:-1] for w in ended} | {b".", b","}
        plain, other = [], []
        for w in bare.difference(self.kept):
            try:
                t = w.decode()
                (plain if t.lower().isalpha() else other).append((w, t))
            except UnicodeDecodeError:
                other.append((w, w.decode("utf-8", "replace")))
        encode = self.tokenizer.encode_batch_fast
        for i in range(0, len(plain), 400):
            part = plain[i : i + 400]
            ids = np.asarray(encode([" ".join(t for _, t in part)], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != len(part):
                other += part
                continue
            raw, at = ids.tobytes(), 0
            for (w, _), e in zip(part, ends.tolist(), strict=True):
                self.kept[w] = raw[at:e]
                at = e
        for i in range(0, len(other), 5_000):
            part = other[i : i + 5_000]
            for (w, _), e in zip(part, encode([t for _, t in part], add_special_tokens=False), strict=True):
                self.kept[w] = np.asarray(e.ids, "<u4").tobytes()
        for w in ended:
            self.kept[w] = self.kept[w[:-1]] + self.kept[w[-1:]]

    def encode(self, texts: list[bytes], keep_words: int = CACHE_WORDS) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [(t if b"<|" in t else t.lower()).replace(b"\n", b" ").split(b" ") for t in texts]
        if len(self.kept) > keep_words:
            self.kept, self.old = {}, self.kept
        if new := {w for words in split for w in words}.difference(self.kept):
            again = new.intersection(self.old)
            self.kept.update((w, self.old[w]) for w in again)
            self.fill(new - again)
        get = self.kept.__getitem__
        return [b"".join(map(get, words)) for words in split]


_ENCODERS: dict[str | None, WordEncoder] = keep("words", {})


def encoder(path: str | None) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def narrow(ids: bytes) -> bytes:
    """The ids in two bytes each, if all fit."""
    x = np.frombuffer(ids, "<u4")
    return x.astype("<u2").tobytes() if len(x) and x.max() < 1 << 16 else ids


def widened(ids: bytes, length: int) -> bytes:
    """narrow() undone: `length` ids of four bytes."""
    return ids if len(ids) == 4 * length else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int, int, bytes]]:
    """(start, length, crc32 of the ids, tokens of the document, narrowed ids) of the pieces; an empty document has none."""
    step, parts = 4 * capacity, []
    for i in range(0, len(ids), step):
        piece = ids[i : i + step]
        parts.append((i // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, narrow(piece)))
    return parts


def cut(docs: DataFrame, capacity: int, eos: int | None, path: str | None, keep_words: int = CACHE_WORDS) -> DataFrame:
    """A row per piece (doc_id and PIECES). A null text is empty; a null doc_id stays null; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = b"" if eos is None else int(eos).to_bytes(4, "little")
        for batch in batches:
            for part in parts_of(batch, "text", PART_BYTES):
                ids = enc.encode([t or b"" for t in part.column(1).cast(pa.large_binary()).to_pylist()], keep_words)
                at, *cols = list(zip(*((i, *p) for i, x in enumerate(ids) for p in pieces_of(x + end, capacity)), strict=True)) or [()] * 6
                columns = [part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run, "words"), f"doc_id {dict(docs.dtypes)['doc_id']}, {PIECES}")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size. A tournament tree holds at each node the largest free space below it, so the first bin
    that fits is found by one walk from the root; equal sizes keep their order."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - width, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            top = a if a >= b else b
            if tree[node] == top:
                break
            tree[node] = top
    return bins, offsets


def pack(docs: DataFrame, capacity: int = 4096, eos: int | None = 2, path: str | None = None, seed: int = 7, group_rows: int = GROUP_ROWS, keep_words: int = CACHE_WORDS) -> DataFrame:
    """docs(doc_id, text) as PACKED: each piece's sequence and its offset there, gapless from 0, and its ids as little-endian
    unsigned 32-bit integers; ids_crc32 is taken of these.

    path: the tokenizer's file on the executors (the public word-level vocabulary by default). keep_words: words of which a worker
    keeps the ids, in each of two generations. Repeated rows are packed
    once each. An empty text is its end token alone; with eos None it gives no row. An empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_rows))

    def pack_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        length = table.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(length, capacity)
        ids = [widened(x, n) for x, n in zip(table.column("ids").to_pylist(), length.tolist(), strict=True)]
        columns = [*(table.column(c) for c in ("doc_id", "start", "length", "doc_tokens")), pa.array(bins + (key[0].as_py() << 32)), pa.array(offsets), pa.array(ids, pa.binary())]
        return pa.table(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    dealt = cut(docs, capacity, eos, path, keep_words).withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(pack_group, f"doc_id {dict(docs.dtypes)['doc_id']}, {PLACED}").withColumn("ids_crc32", F.crc32("ids")).select(*PACKED)


def sequences(packed: DataFrame) -> DataFrame:
    """What pack() returns as whole sequences: sequence_id, n_tokens and the ids of all its pieces end to end."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return parts.select("sequence_id", ids.alias("ids")).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def op7_pack(spark, sf_dir: str) -> DataFrame:
    """All documents, each followed by id 2, in sequences of at most 4096 tokens; of the ids, their digest."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
