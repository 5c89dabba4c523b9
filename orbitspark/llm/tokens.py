"""Token counts by offset-mapped attribution.

A document is its fields end to end, each but the last followed by a newline, encoded once as a whole. Its sections are the
fields, or the lines of the text. Every token's span is joined to the sections' spans; a token that crosses a boundary goes
by an explicit rule: `start` (the section of its first character) or `overlap` (the one that holds most of it, the earlier
on ties). So the sections' counts add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, tidy

#: Pieces whose tokens a worker keeps.
CACHE_PIECES = 1_000_000


class SpanEncoder:
    """Byte spans of a byte-level BPE's tokens over whole texts.

    The vocabulary's pattern always parts a text before a single blank that stands between two visible characters, so the
    pieces between such blanks are encoded once and kept; a text with other blanks beside a blank is encoded whole.
    """

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # special tokens' names in a text are text
        vocab = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # a character of a vocabulary entry stands for a byte
        for t, i in vocab.items():
            self.size[i] = len(t)
        self.kept: dict[bytes, bytes | None] = {}

    def sizes(self, text: str) -> np.ndarray:
        return self.size[np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)]

    def fill(self, pieces: set[bytes]) -> None:
        """Encode the pieces that are not kept; where there is no room for them, only these pieces stay."""
        new = pieces.difference(self.kept)
        if len(self.kept) + len(new) > CACHE_PIECES:
            self.kept = {p: self.kept[p] for p in pieces.intersection(self.kept)}
        todo = []
        for p in new:
            t = p.decode("utf-8", "replace")
            if len(t) < 2 or t[1].isspace() or t[-1].isspace() or "�" in t:
                self.kept[p] = None
            else:
                todo.append((p, t))
        for i in range(0, len(todo), 5_000):
            part = todo[i : i + 5_000]
            for (p, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                self.kept[p] = self.size[np.asarray(e.ids, np.int64)].astype("<u2").tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Byte lengths of each text's tokens, in order. A blank is put before each text for the look-up and taken off again."""
        split = [[b" " + p for p in t.split(b" ")] for t in texts]
        self.fill({p for ps in split for p in ps[1:]})
        out = []
        for t, ps in zip(texts, split, strict=True):
            rest = [self.kept[p] for p in ps[1:]]
            head = ps[0][1:].decode("utf-8", "replace")
            if None in rest or not head or head[-1].isspace() or "�" in head:
                out.append(self.sizes(t.decode("utf-8", "replace")) if t else np.zeros(0, np.int64))
            else:
                out.append(np.concatenate([self.sizes(head), np.frombuffer(b"".join(rest), "<u2").astype(np.int64)]))
        return out


_ENCODERS: dict[str | None, SpanEncoder] = keep("spans", {})


def attribute(sizes: np.ndarray, ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """Tokens of each section, given token lengths and the sections' ends (increasing, the last is the text's), and how many
    tokens cross a boundary. All lengths are in the same unit."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    a = np.searchsorted(ends, start, "right")
    b = np.searchsorted(ends, stop - 1, "right")
    a, b = np.minimum(a, len(ends) - 1), np.minimum(b, len(ends) - 1)
    to = a.copy()
    if rule == "overlap":
        first = np.concatenate([[0], ends[:-1]])
        for i in np.flatnonzero(a != b):
            k = np.arange(a[i], b[i] + 1)
            to[i] = k[np.argmax(np.minimum(ends[k], stop[i]) - np.maximum(first[k], start[i]))]
    elif rule != "start":
        raise ValueError(f"unknown rule {rule}")
    return np.bincount(to, minlength=len(ends)), int((a != b).sum())


def token_counts(docs: DataFrame, fields: list[str] | None = None, rule: str = "start", path: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_sections, section_tokens array<int>, crossing for each row.

    fields: the columns that make up a document, each a section; None: the lines of `text`, each with its newline. A null
    field is empty; an empty text has one empty section and no token. Repeated rows give repeated results, an empty table an
    empty one; other columns are not read. path: the tokenizer's file on the executors.
    """
    names = fields or ["text"]
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = SpanEncoder(path)
        enc = _ENCODERS[path]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cols = [[t or b"" for t in part.column(i + 1).cast(pa.large_binary()).to_pylist()] for i in range(len(names))]
                rows = list(zip(*cols, strict=True))
                texts = [b"\n".join(r) for r in rows]
                total, sections, counts, crossing = [], [], [], []
                for r, t, sizes in zip(rows, texts, enc.encode(texts), strict=True):
                    if fields:
                        ends = np.cumsum([len(x) + 1 for x in r]) - np.array([0] * (len(r) - 1) + [1])
                    else:
                        ends = np.flatnonzero(np.frombuffer(t, np.uint8) == 10) + 1
                        ends = np.append(ends, len(t)) if not len(ends) or ends[-1] < len(t) else ends
                    n, over = attribute(sizes, ends, rule)
                    total.append(len(sizes))
                    sections.append(len(n))
                    counts.append(n)
                    crossing.append(over)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sections)]), pa.int32()), pa.array(np.concatenate(counts or [np.zeros(0)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(sections, pa.int64()), lists, pa.array(crossing, pa.int64())], ["doc_id", "n_tokens", "n_sections", "section_tokens", "crossing"])

    return docs.select(doc_id, *names).mapInArrow(tidy(run, "spans"), f"doc_id {kind}, n_tokens long, n_sections long, section_tokens array<int>, crossing long")


def op1_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document and of each of its lines."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
