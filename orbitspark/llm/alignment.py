"""Cross-tokenizer alignment in relations.

Two tokenizers cut one text; where tokens of both end at the same byte, a group ends. Tokens are exploded with their positions,
cumulative lengths come from a window, an equi-join on unit and end finds the cuts, the running count of cuts numbers the groups,
and a group's tokens are those between its cut and the one before.

A unit is a word with the blank before it: both tokenizers always part a text before a blank that follows a visible character (the
one by its pattern, the other as no entry of its vocabulary runs over such a place, which is checked). So a text's groups are its
units' groups end to end, and each different unit of the corpus is cut and aligned once, however often it occurs. Texts that end
in a blank are one unit as a whole. Documents are written as lists of their units' numbers within blocks of some megabytes, and
every block gets its units' groups back.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, keep, materialize, note_written, shared_dir, tidy, tidy_group
from .repeats import deflate, inflate

#: Bytes of text of one block: what a task holds of documents, and of their units' groups, at once. A longer text is a block alone.
BLOCK_BYTES = 12 << 20
#: A token is one number: its bytes, shifted by so many bits, and its id in the bits below.
SHIFT = 16
MASK = (1 << SHIFT) - 1

_AFTER_VISIBLE, _BLANK_BEFORE = re.compile(r"(?<=\S) "), re.compile(r"\s ")


def units_of(text: str) -> list[str]:
    """The units of a text, each without the blank before it: a blank and each unit, end to end, are a blank and the text."""
    if text.startswith(" ") or _BLANK_BEFORE.search(text):
        out = _AFTER_VISIBLE.split(text)
    else:
        out = text.split(" ")
    return out if out[-1].strip() else [text]


class Pair:
    """A byte-level BPE (A) and a sentence-piece model with byte fallback (B)."""

    def __init__(self, a: str | None = None, b: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        if a is None or b is None:
            import public_tokenizers

            a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # special tokens' names in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        signs = sorted(pre_tokenizers.ByteLevel.alphabet())  # a sign for each byte: visible bytes stand for themselves
        own = {c: ord(c) for c in signs if ord(c) < 256}
        rest = dict(zip((c for c in signs if ord(c) >= 256), (i for i in range(256) if chr(i) not in own), strict=True))
        byte = own | rest
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of the vocabulary runs over the start of a word")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_codes, self.b_codes = (np.array([len(x) << SHIFT | i for i, x in enumerate(of)], np.int64) for of in (self.a_bytes, self.b_bytes))

    def whole(self, text: str) -> bool:
        """Whether B's pieces give back a blank and the text; A's always do."""
        return "▁" not in text and self.b.normalize(text).replace("▁", " ") == " " + text

    def cut(self, units: list[str]) -> tuple[pa.Array, pa.Array]:
        """Tokens of each unit with the blank before it, by A and by B: lists of numbers that hold a token's bytes and its id."""
        texts = [(" " + u).encode() for u in units]
        size = np.array([len(t) for t in texts], np.int64)
        left = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        out = []
        for lists, of, codes in ((left, self.a_bytes, self.a_codes), (self.b.encode(units, num_threads=1), self.b_bytes, self.b_codes)):
            ends = np.cumsum([0, *map(len, lists)])
            flat = list(chain.from_iterable(lists))
            tokens = codes[np.array(flat, np.int64)]
            to = np.concatenate([[0], np.cumsum(tokens >> SHIFT)])[ends]
            if not np.array_equal(np.diff(to), size) or b"".join([of[i] for i in flat]) != b"".join(texts):
                raise ValueError("the tokens of a unit do not give it back")
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32())))
        return out[0], out[1]


_PAIRS: dict[tuple, Pair] = keep("pairs", {})


def _pair(a: str | None, b: str | None) -> Pair:
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def numbered(docs: DataFrame, a: str | None = None, b: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each block: a row for each document (doc_id, units: the numbers of its units in order, compressed), and a row for each different unit
    (number, unit, n: how often). A document without tokens has no units."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, names = _pair(a, b), ["block", "number", "unit", "n", "doc_id", "units"]
        block = TaskContext.get().partitionId() << 32
        seen: dict[str, int] = {}
        count = np.zeros(0, np.int64)
        held = 0

        def end() -> Iterator[pa.RecordBatch]:
            units = list(seen)
            for lo in range(0, len(units), 1 << 15):
                part = units[lo : lo + (1 << 15)]
                k = len(part)
                cols = [pa.array(np.full(k, block)), pa.array(np.arange(lo, lo + k), pa.int32()), pa.array(part, pa.string()), pa.array(count[lo : lo + k])]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(k, ids), pa.nulls(k, pa.binary())], names)

        for batch in batches:
            ids = batch.column(0).type
            for lo in range(0, batch.num_rows, 64):
                rows = batch.slice(lo, 64)
                found = []
                for t in rows.column(1).to_pylist():
                    held += 4 * len(t or "") // 3
                    words = units_of(t) if t and pair.whole(t) else []
                    found.append(np.array([seen.setdefault(u, len(seen)) for u in words], np.int32))
                if len(seen) > len(count):
                    count = np.concatenate([count, np.zeros(max(len(seen) - len(count), len(count)), np.int64)])
                count += np.bincount(np.concatenate(found), minlength=len(count))
                k = rows.num_rows
                none = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), *none, rows.column(0), pa.array([deflate(u) for u in found], pa.binary())], names)
                if held >= BLOCK_BYTES:
                    yield from end()
                    block, held, count = block + 1, 0, np.zeros(0, np.int64)
                    seen.clear()
        if seen:
            yield from end()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(tidy(run, "pairs"), f"block long, number int, unit string, n long, doc_id {kind}, units binary")


def unit_tokens(units: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """unit, n → unit, n, a, b: the tokens of both tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a, b)
        for batch in batches:
            left, right = pair.cut(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), left, right], ["unit", "n", "a", "b"])

    return units.select("unit", "n").mapInArrow(tidy(run, "pairs"), "unit string, n long, a array<int>, b array<int>")


@contextmanager
def in_place(spark):
    """Let joins on more columns than both sides are dealt out by stay where they are: sound for any keys, and even where each key of
    the dealing has few rows."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the shared folder, in buckets by the key: what groups or joins by it later needs no exchange."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"orbitspark_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    bound_batches(spark)
    df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    note_written(path)
    return spark.table(name)


def cuts(tokens: DataFrame) -> DataFrame:
    """unit, n, a, b (token arrays) → unit, n, a, b and at: for each place where tokens of both end, in order, g (cuts before it), a_at and
    b_at (tokens before the two that end there), a_id, b_id. Token arrays are dealt out by unit once; windows, join and groups follow
    in place."""
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = tokens.repartition(n, "unit")
    side = {}
    for c in "ab":
        rows = tokens.select("unit", F.posexplode(c).alias(f"{c}_at", "t"))
        so_far = Window.partitionBy("unit").orderBy(f"{c}_at").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.shiftright("t", SHIFT)).over(so_far).alias("end")
        side[c] = rows.select("unit", f"{c}_at", F.col("t").bitwiseAND(MASK).alias(f"{c}_id"), end)
    both = side["a"].join(side["b"], ["unit", "end"])
    both = both.withColumn("g", F.row_number().over(Window.partitionBy("unit").orderBy("end")) - 1)
    at = both.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("g", "a_at", "b_at", "a_id", "b_id"))).alias("at"))
    return tokens.join(at, "unit")


def pair_counts(links: DataFrame) -> DataFrame:
    """a_id, b_id, c: how many links corpus-wide hold the pair, and best: whether no pair of this B id has more.

    Of two tokens that end together one is a suffix of the other, so there are no more pairs than the two vocabularies have bytes
    together, about half a million: that bounds the broadcast of this table, whatever the corpus."""
    c = links.groupBy("a_id", "b_id").agg(F.sum("n").alias("c"))
    top = F.max("c").over(Window.partitionBy("b_id"))
    return c.withColumn("best", (F.col("c") == top).cast("long"))


def _groups() -> F.Column:
    """Text of all groups of a unit from its cuts, in order, and its token arrays."""
    before = "if(i = 0, 0, at[i - 1].%s_at + 1)"
    part = f"array_join(transform(slice(%s, {before} + 1, x.%s_at - {before} + 1), t -> cast(t & {MASK} as string)), ',')"
    return F.expr(f"array_join(transform(at, (x, i) -> concat({part % (('a',) * 4)}, '|', {part % (('b',) * 4)})), ';')")


#: Figures of a unit, and of a document.
LONGS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")
PACK = "block long, numbers binary, longs binary, groups binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units' figures and groups on their way to their blocks, compressed together: a row for each block among some 10,000s of rows."""

    def out(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(part).sort_by("block")
        block = t.column("block").to_numpy()
        found, first = np.unique(block, return_index=True)
        numbers = t.column("number").to_numpy().astype("<i4")
        longs = np.stack([t.column(c).to_numpy() for c in LONGS]).astype("<i8")
        groups = t.column("groups").to_pylist()
        ends = [*first[1:].tolist(), len(block)]
        rows = [(deflate(numbers[a:b]), deflate(longs[:, a:b]), deflate("\n".join(groups[a:b]).encode())) for a, b in zip(first.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], ["block", "numbers", "longs", "groups"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= 1 << 17 or sum(b.nbytes for b in held) >= 16 << 20:
            yield out(held)
            held = []
    if held:
        yield out(held)


def align(docs: DataFrame, a: str | None = None, b: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (`a1,a2|b1;a3|b2,b3`) for each row.

    Rows whose text is null or empty, or changed by B (it holds U+2581), have no tokens: zeros and ''. Repeated rows are counted and
    returned as often as they are there, whatever their ids; an empty table gives an empty one; other columns are not read. a, b: the
    tokenizers' files on the executors.
    """
    table, _ = materialize(numbered(docs, a, b, doc_id, text))
    units = bucketed(table.where("unit is not null").select("block", "number", "unit", "n"), "unit")
    tokens, _ = materialize(unit_tokens(units.groupBy("unit").agg(F.sum("n").alias("n")), a, b))
    links = F.transform("at", lambda x: F.struct(x["a_id"].alias("a_id"), x["b_id"].alias("b_id"))).alias("links")
    figures = [F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size("at").alias("n_groups"), _groups().alias("groups")]
    with in_place(docs.sparkSession):
        aligned = bucketed(cuts(tokens).select("unit", "n", *figures, links), "unit")
    pairs = F.broadcast(pair_counts(aligned.select("n", F.inline("links"))))
    sums = aligned.select("unit", F.inline("links")).join(pairs, ["a_id", "b_id"]).groupBy("unit").agg(F.sum("c").alias("count_sum"), F.sum("best").alias("n_best"))
    found = aligned.drop("n", "links").join(sums, "unit")
    back = units.drop("n").join(found, "unit").select("block", "number", *LONGS, "groups").mapInArrow(tidy(_packed), PACK)

    kind = dict(docs.dtypes)[doc_id]
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def settle(docs: pa.Table, packs: pa.Table) -> pa.Table:
        numbers, figures, groups = [np.zeros(0, np.int32)], [np.zeros((len(LONGS), 0), np.int64)], []
        for n, v, g in zip(*(packs.column(c).to_pylist() for c in ("numbers", "longs", "groups")), strict=True):
            numbers.append(inflate(n, "<i4"))
            figures.append(inflate(v, "<i8").reshape(len(LONGS), -1))
            groups += zstandard.decompress(g).decode().split("\n")
        order = np.argsort(np.concatenate(numbers), kind="stable")
        value = dict(zip(LONGS, np.concatenate(figures, 1)[:, order], strict=True))
        value["n_links"] = value["n_groups"]  # each cut is one pair of tokens, as none is empty
        groups = [groups[i] for i in order.tolist()]
        ids = docs.column("doc_id").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        lists = [inflate(z, "<i4") for z in docs.column("units").to_pylist()]
        out = []
        for lo in range(0, len(ids), 64):  # a batch for some documents: their groups are several times as long as their texts
            part = lists[lo : lo + 64]
            cols = [pa.array([int(value[c][u].sum()) for u in part], pa.int64()) for c in longs]
            texts = pa.array([";".join([groups[i] for i in u.tolist()]) for u in part], pa.string())
            out.append(pa.RecordBatch.from_arrays([ids.slice(lo, len(part)), *cols, texts], ["doc_id", *longs, "groups"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", ids.type), *((c, pa.int64()) for c in longs), ("groups", pa.string())]))

    rows = table.where("unit is null").select(F.col("block").alias("block"), "doc_id", "units").groupBy("block")
    return rows.cogroup(back.groupBy("block")).applyInArrow(tidy_pair(settle), f"doc_id {kind}, " + "".join(f"{c} long, " for c in longs) + "groups string")


def tidy_pair(settle):
    """tidy_group for two tables."""
    one = tidy_group(lambda pair: settle(*pair))

    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        return one((left, right))

    return tidied


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's alignment, with its groups as a digest."""
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups").withColumn("doc_id", F.col("doc_id").cast("long"))
