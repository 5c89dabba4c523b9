"""Quality rules by line sequence labelling.

A linear-chain conditional random field over the lines of a document marks each as content or boilerplate; Viterbi decoding
finds the best marking of the whole document, and the share of words in content lines decides whether it is kept. A line's
features are shares that need nothing but its document, so every document is decided alone, in one pass without a shuffle.

The field is fitted on documents labelled as wholes: at first each line has its document's label; then the lines of bad
documents are marked anew by the field itself, as a bad document may hold good lines, and the field is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, buffers, chunks, mix, ngram_hash, tidy, word_hash, word_spans
from .quality import held_out

#: Labelled documents that the field is fitted on, at most, and the lines that one of them may have: longer ones are not learnt
#: from. Both bound what the driver holds: TRAIN_ROWS * TRAIN_LINES * len(FEATURES) numbers of four bytes.
TRAIN_ROWS, TRAIN_LINES = 2_000, 120
ROUNDS, STEPS, RATE, DECAY = 2, 80, 0.15, 1e-3
#: Contract: fewer words fail, as do documents of which more words than this percentage lie in repeated windows.
LEAST_WORDS, MOST_REPEATS = 50, 50
FEATURES = ("constant", "symbols", "exclamations", "capitals", "digits", "repeats", "stutter", "copy", "short", "long", "sentence", "word_size")


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


SYMBOL, CAPITAL, DIGIT = _mask(b"#*$%&|<>"), _mask(bytes(range(65, 91))), _mask(b"0123456789")
LETTER = CAPITAL | _mask(bytes(range(97, 123)))
STOP, EXCLAMATION = _mask(b".!?:;"), _mask(b"!")


class Lines:
    """The lines with a word of the documents in buf, their features, and the documents' base counts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        docs = len(offs) - 1
        starts, ends, wo = word_spans(buf, offs)
        self.n_words = np.diff(wo)
        word_doc = np.repeat(np.arange(docs), self.n_words)
        point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before a byte
        size = point[ends] - point[starts]
        self.word_chars = np.bincount(word_doc, size, docs).astype(np.int64)
        self.n_symbols = _between(SYMBOL[buf], offs[:-1], offs[1:])
        words = word_hash(buf, starts, ends)
        repeated = self._repeated(words, word_doc)
        self.n_repeat_words = np.bincount(word_doc, repeated, docs).astype(np.int64)

        # lines: cut behind each newline and at each document's end
        cut = np.unique(np.concatenate([offs, np.flatnonzero(buf == 10) + 1]))
        first, last = cut[:-1], cut[1:]
        lo, hi = np.searchsorted(starts, first), np.searchsorted(starts, last)
        full = hi > lo
        first, last, lo, hi = first[full], last[full], lo[full], hi[full]
        doc = np.searchsorted(offs, first, "right") - 1
        self.per_doc = np.bincount(doc, minlength=docs)
        self.words = n = hi - lo
        body = last - (buf[last - 1] == 10) if len(last) else last
        copy = _seen_before(word_hash(buf, first, body), doc)
        self.n_dup_lines = np.bincount(doc, copy, docs).astype(np.int64)

        same = np.zeros(len(words), bool)  # the word before, of the same document, over again
        same[1:] = (words[1:] == words[:-1]) & (word_doc[1:] == word_doc[:-1])
        f = np.zeros((len(n), len(FEATURES)), np.float32)
        if len(n):
            chars, letters = np.maximum(1, point[ends[hi - 1]] - point[starts[lo]]), np.maximum(1, _between(LETTER[buf], first, last))
            f[:, 0] = 1
            f[:, 1] = np.minimum(1, _between(SYMBOL[buf], first, last) / n)
            f[:, 2] = np.minimum(1, _between(EXCLAMATION[buf], first, last) / n)
            f[:, 3] = _between(CAPITAL[buf], first, last) / letters
            f[:, 4] = _between(DIGIT[buf], first, last) / chars
            f[:, 5] = _between(repeated, lo, hi) / n
            f[:, 6] = _between(same, lo, hi) / n
            f[:, 7] = copy
            f[:, 8] = n < 5
            f[:, 9] = n > 60
            f[:, 10] = STOP[buf[ends[hi - 1] - 1]]
            f[:, 11] = np.minimum(2, np.add.reduceat(size, lo) / n / 10)
        self.features = f

    @staticmethod
    def _repeated(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Words that lie in a 3-word window whose sequence is found twice or more in its document."""
        out = np.zeros(len(words), bool)
        if len(words) < 3:
            return out
        h = mix(ngram_hash(words, 3) + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(doc[:-2] == doc[2:])
        _, group, count = np.unique(h[at], return_inverse=True, return_counts=True)
        at = at[count[group] > 1]
        for k in range(3):
            out[at + k] = True
        return out


def _between(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flags set in each range [a, b)."""
    c = np.concatenate([[0], np.cumsum(flags)])
    return c[b] - c[a]


def _seen_before(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose hash an earlier row of the same document has."""
    out = np.ones(len(h), bool)
    out[np.unique(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]] = False
    return out


class Chain:
    """A linear-chain conditional random field with the states boilerplate (0) and content (1)."""

    def __init__(self):
        self.weight = np.zeros((len(FEATURES), 2))
        self.step = np.zeros((2, 2))
        self.first = np.zeros(2)
        self.share = 0.5

    @staticmethod
    def _order(per_doc: np.ndarray):
        """Documents by falling number of lines, where their lines begin, and how many documents have a line at each place."""
        order = np.argsort(-per_doc, kind="stable")
        begin = (np.cumsum(per_doc) - per_doc)[order]
        n = per_doc[order]
        return begin, [int(k) for k in np.searchsorted(-n, -np.arange(1, n.max() + 1 if len(n) else 0), "right")]

    def decode(self, features: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """The best marking of each document, by Viterbi's recursion over places, all documents at once. Ties go to content."""
        emit = features @ self.weight
        begin, active = self._order(per_doc)
        back, best = np.zeros((len(emit), 2), np.int8), np.zeros((len(begin), 2))
        for t, k in enumerate(active):
            at = begin[:k] + t
            if t:
                via = best[:k, :, None] + self.step  # from, to
                pick = via[:, 1] >= via[:, 0]
                back[at] = pick
                best[:k] = np.where(pick, via[:, 1], via[:, 0]) + emit[at]
            else:
                best[:k] = self.first + emit[at]
        out, state = np.zeros(len(emit), np.int8), (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            at = begin[:k] + t
            out[at] = state[:k]
            state[:k] = back[at, state[:k]]
        return out

    def _gradient(self, features, per_doc, y):
        """Gradient of the mean log-likelihood of the marking y, by the forward-backward recursions."""
        emit = features @ self.weight
        begin, active = self._order(per_doc)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        for t, k in enumerate(active):
            at = begin[:k] + t
            forward[at] = emit[at] + (np.logaddexp.reduce(forward[at - 1][:, :, None] + self.step, axis=1) if t else self.first)
        step, whole = np.zeros((2, 2)), np.zeros(len(emit))
        for t in range(len(active) - 1, -1, -1):
            k, following = active[t], active[t + 1] if t + 1 < len(active) else 0
            at = begin[:following] + t
            if following:
                reach = self.step + (emit[at + 1] + backward[at + 1])[:, None, :]
                backward[at] = np.logaddexp.reduce(reach, axis=2)
                joint = forward[at][:, :, None] + reach
                joint -= np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None]
                step -= np.exp(joint).sum(0)
                np.add.at(step, (y[at], y[at + 1]), 1)
            at = begin[:k] + t
            whole[at] = np.logaddexp.reduce(forward[at] + backward[at], axis=1)
        gap = np.eye(2)[y] - np.exp(forward + backward - whole[:, None])
        head = begin[: active[0]] if active else begin[:0]
        n = max(1, len(emit))
        return [features.T @ gap / n, step / n, gap[head].sum(0) / n]

    def fit(self, features: np.ndarray, per_doc: np.ndarray, words: np.ndarray, good: np.ndarray) -> Chain:
        """Fit on documents with labels; words: of each line. The kept share is the one that parts these documents best."""
        line_doc = np.repeat(np.arange(len(per_doc)), per_doc)
        y = good[line_doc].astype(np.int8)
        if not len(y) or good.all() or not good.any():
            return self
        features = features.astype(np.float64)
        for _ in range(ROUNDS):
            params = [self.weight, self.step, self.first]
            m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
            for i in range(1, STEPS + 1):
                for j, (p, g) in enumerate(zip(params, self._gradient(features, per_doc, y), strict=True)):
                    g = g - DECAY * p
                    m[j] += 0.1 * (g - m[j])
                    v[j] += 0.02 * (g * g - v[j])
                    p += RATE * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.98**i)) + 1e-8)
            marks = self.decode(features, per_doc)
            some = np.bincount(line_doc, marks == 0, len(per_doc)) > 0  # of a bad document something is bad
            y = np.where(good[line_doc], 1, np.where(some[line_doc], marks, 0)).astype(np.int8)
        share = self.content(marks, words, per_doc)
        marks_at = np.arange(1, 20) / 20
        right = [np.mean((share >= c)[good]) + np.mean((share < c)[~good]) for c in marks_at]
        self.share = float(np.mean(marks_at[np.flatnonzero(np.array(right) == max(right))]))
        return self

    @staticmethod
    def content(marks: np.ndarray, words: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Share of a document's words in content lines; 0 without words."""
        line_doc = np.repeat(np.arange(len(per_doc)), per_doc)
        n = np.bincount(line_doc, words, len(per_doc))
        return np.bincount(line_doc, words * marks, len(per_doc)) / np.maximum(1, n)


def _pieces(batch: pa.RecordBatch, at: int):
    buf, offs = buffers(batch.column(at))
    for a, b in chunks(offs):
        yield a, b, Lines(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Chain:
    """A field fitted on labelled documents outside the held-out third, at most `rows` by a hash of the id.

    Rows with a null id or label are left out; of repeated ids the largest label counts, and each row's text is learnt from.
    Documents of more than TRAIN_LINES lines are passed over, one by one. Where labels of either kind are missing every line is
    content and the base rules alone decide.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    picked = picked.groupBy(doc_id).agg(F.max(label).alias("y")).orderBy(F.xxhash64(doc_id), doc_id).limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, x in _pieces(batch, 0):
                to = np.cumsum(x.per_doc)
                some = [i for i in range(b - a) if 0 < x.per_doc[i] <= TRAIN_LINES]
                part = [(to[i] - x.per_doc[i], to[i]) for i in some]
                cols = [pa.array([x.features[s:e].tobytes() for s, e in part], pa.binary()), pa.array([x.words[s:e].astype("<i8").tobytes() for s, e in part], pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([bool(y[a + i]) for i in some], pa.bool_())], ["f", "w", "y"])

    got = docs.select(doc_id, text).join(F.broadcast(picked), doc_id)  # a broadcast of `rows` pairs of numbers at most
    got = got.select(text, F.col("y").cast("int").alias("y")).mapInArrow(tidy(run), "f binary, w binary, y boolean")
    t = got.orderBy(F.xxhash64("f", "w"), "y").limit(2 * rows).toArrow()
    if not t.num_rows:
        return Chain()
    f, w = (t.column(c).to_pylist() for c in "fw")
    features = np.frombuffer(b"".join(f), np.float32).reshape(-1, len(FEATURES))
    words = np.frombuffer(b"".join(w), "<i8")
    return Chain().fit(features, np.array([len(x) // 8 for x in w]), words, np.array(t.column("y").to_pylist(), bool))


def judge(docs: DataFrame, model: Chain, keep: list[str], text: str = "text") -> DataFrame:
    """keep plus the base counts, base_failed, kept, content_share, and lines: for each line with a word, in order, whether it is content.

    A null text has no words; without words a document fails. Every row is judged by itself, repeated rows alike; columns of keep
    with a name given here give way to it, other columns are not read.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kinds = dict(docs.dtypes)
    keep = [c for c in keep if c not in {*longs, "base_failed", "kept", "content_share", "lines"}]
    at = keep.index(text) if text in keep else len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thirty numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for a, b, x in _pieces(batch, at):
                marks = chain.decode(x.features, x.per_doc)
                share = chain.content(marks, x.words, x.per_doc)
                failed = (x.n_words < LEAST_WORDS) | (100 * x.n_repeat_words > MOST_REPEATS * x.n_words)
                ends = pa.array(np.concatenate([[0], np.cumsum(x.per_doc)]), pa.int32())
                cols = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                cols += [pa.array(getattr(x, c), pa.int64()) for c in longs]
                cols += [pa.array(failed), pa.array(~failed & (share >= chain.share)), pa.array(share), pa.ListArray.from_arrays(ends, pa.array(marks == 1))]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *longs, "base_failed", "kept", "content_share", "lines"])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "".join(f"{c} long, " for c in longs)
    schema += "base_failed boolean, kept boolean, content_share double, lines array<boolean>"
    return docs.select(*(F.col(f"`{c}`") for c in keep), *([] if text in keep else [text])).mapInArrow(tidy(run), schema)


def op11_lines(spark, sf_dir: str) -> DataFrame:
    """Every document judged by its lines, by a field that has not seen the labels of the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"]).drop("lines")
