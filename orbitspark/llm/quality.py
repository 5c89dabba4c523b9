"""Quality: a byte-level convolutional network in numpy.

FILTERS filters of WIDTH bytes slide over the whole text. Outputs are max-pooled in overlapping chunks of four blocks of
BLOCK bytes (one block shared with the next chunk), and a document's probability is a logistic function of the mean and the
maximum of its chunks' vectors. As a filter sees one of 256 values at each place, a convolution is WIDTH table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, chunks, tidy

WIDTH, FILTERS, BLOCK = 5, 16, 64
#: Labelled documents that the network is fitted on, at most, and bytes of text that they have together. Each is learnt from whole.
TRAIN_ROWS, TRAIN_BYTES = 3_000, 16 << 20
#: Bytes of a text that is learnt from, at most, as a share of these: a longer one is passed over, and no other for its sake.
LONGEST_SHARE = 64
EPOCHS, BATCH, RATE = 8, 48, 0.02


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(positions, FILTERS) for padded bytes: positions = len(x) - WIDTH + 1."""
        n = len(x) - WIDTH + 1
        z = self.table[0][x[:n]]
        tmp = np.empty_like(z)
        for j in range(1, WIDTH):
            z += np.take(self.table[j], x[j : j + n], axis=0, out=tmp, mode="clip")
        return z

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of each document that lies in buf."""
        n = np.diff(offs)
        width = np.maximum(n, 1) + WIDTH - 1  # zeros behind each text, so that every byte starts a window
        po = np.concatenate([[0], np.cumsum(width)])
        x = np.zeros(po[-1], np.uint8)
        x[np.repeat(po[:-1] - offs[:-1], n) + np.arange(offs[-1])] = buf
        blocks = -(-np.maximum(n, 1) // BLOCK)
        bo = np.concatenate([[0], np.cumsum(blocks)])
        first = np.repeat(po[:-1], blocks) + (np.arange(bo[-1]) - np.repeat(bo[:-1], blocks)) * BLOCK
        ends = np.minimum(first + BLOCK, np.repeat(po[:-1] + np.maximum(n, 1), blocks))
        z = self.responses(x)
        cut = np.stack([first, ends], 1).ravel()
        top = np.maximum.reduceat(np.concatenate([z, z[-1:]]), cut, axis=0)[::2]
        chunk = np.maximum(1, -(-(blocks - 1) // 3))
        co = np.concatenate([[0], np.cumsum(chunk)])
        lead = np.repeat(bo[:-1], chunk) + 3 * (np.arange(co[-1]) - np.repeat(co[:-1], chunk))
        last = np.repeat(bo[1:], chunk) - 1
        u = top[lead]
        for k in (1, 2, 3):
            np.maximum(u, top[np.minimum(lead + k, last)], out=u)
        u = np.maximum(u + self.bias, 0)
        doc = np.concatenate([np.add.reduceat(u, co[:-1], axis=0) / chunk[:, None], np.maximum.reduceat(u, co[:-1], axis=0)], 1)
        return 1 / (1 + np.exp(-(doc.astype(np.float64) @ self.out + self.shift[0])))

    def silent(self) -> Network:
        """The network that knows nothing: every score is 0.5."""
        self.out[:] = 0
        self.shift[:] = 0
        return self

    # -------------------------------------------------------------- training
    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 6) -> Network:
        rng = np.random.default_rng(seed)
        span, stride = 4 * BLOCK, 3 * BLOCK
        mats, valid = [], []
        for t in texts:
            x = np.frombuffer(t or b"\0", np.uint8)
            k = max(1, -(-(-(-len(x) // BLOCK) - 1) // 3))
            padded = np.concatenate([x, np.zeros(span + WIDTH, np.uint8)])
            mats.append(np.lib.stride_tricks.sliding_window_view(padded, span + WIDTH - 1)[: k * stride : stride])
            valid.append(np.minimum(span, len(x) - np.arange(k) * stride))
        params = [self.table, self.bias, self.out, self.shift]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        rate = labels.mean() if len(labels) else 0.5
        self.shift[0] = np.log(max(rate, 1e-3) / max(1 - rate, 1e-3))
        for epoch in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(texts), BATCH):
                i = order[at : at + BATCH]
                size = np.array([len(mats[k]) for k in i])
                co = np.concatenate([[0], np.cumsum(size)])
                x, n = np.concatenate([mats[k] for k in i]), np.concatenate([valid[k] for k in i])
                p, best = np.zeros((len(x), FILTERS), np.int64), np.zeros((len(x), FILTERS), np.float32)
                for lo in range(0, len(x), 256):  # chunks at once: bounds memory where documents are very long
                    y = x[lo : lo + 256]
                    z = self.table[0][y[:, :span]]
                    for j in range(1, WIDTH):
                        z += self.table[j][y[:, j : j + span]]
                    z[np.arange(span)[None, :] >= n[lo : lo + 256, None]] = -np.inf
                    p[lo : lo + 256] = z.argmax(1)
                    best[lo : lo + 256] = np.take_along_axis(z, p[lo : lo + 256, None], 1)[:, 0]
                u = np.maximum(best + self.bias, 0)
                mean, high = np.add.reduceat(u, co[:-1], axis=0) / size[:, None], np.maximum.reduceat(u, co[:-1], axis=0)
                d = np.concatenate([mean, high], 1)
                g = (1 / (1 + np.exp(-(d @ self.out + self.shift[0]))) - labels[i]).astype(np.float32) / len(i)
                gd = g[:, None] * self.out
                back = np.repeat(gd[:, :FILTERS] / size[:, None], size, 0)
                back += (u == np.repeat(high, size, 0)) * np.repeat(gd[:, FILTERS:], size, 0)
                back *= u > 0
                gt = np.zeros_like(self.table)
                f = np.broadcast_to(np.arange(FILTERS), p.shape)
                for j in range(WIDTH):
                    np.add.at(gt[j], (np.take_along_axis(x, p + j, 1), f), back)
                grads = [gt, back.sum(0), d.T @ g + 1e-4 * self.out, g.sum(keepdims=True)]
                step += 1
                lr = RATE * (1 - epoch / EPOCHS)
                for q, (a, b) in enumerate(zip(params, grads, strict=True)):
                    m[q] += 0.1 * (b - m[q])
                    v[q] += 0.01 * (b * b - v[q])
                    a -= lr * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-7)
        return self


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """A network fitted on labelled documents outside the held-out third: by a hash of the id, at most `rows` of them, and of these as
    many as have `size` bytes of text together. A document that is learnt from is learnt from whole; one longer than
    size / LONGEST_SHARE bytes is passed over.

    Rows with a null id or label are left out; of repeated ids the smallest text and the largest label count. Without any labelled
    document every score is 0.5, so nothing is rejected.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(doc_id).agg(F.max(label).alias("y")).orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    got = docs.select(doc_id, text).join(F.broadcast(picked), doc_id)  # a broadcast of `rows` pairs of numbers at most
    got = got.groupBy(doc_id).agg(F.min(text).alias("t"), F.max("y").alias("y"))
    before = Window.orderBy(F.xxhash64(doc_id), doc_id).rowsBetween(Window.unboundedPreceding, 0)  # over `rows` rows at most
    ids = got.select(doc_id, F.coalesce(F.octet_length("t"), F.lit(0)).alias("b")).where(F.col("b") <= max(1, size // LONGEST_SHARE)).withColumn("b", F.sum("b").over(before)).where(F.col("b") <= size)
    t = got.join(F.broadcast(ids), doc_id).orderBy(doc_id).select("t", "y").toArrow()
    y = t.column("y").to_numpy().astype(np.float32)
    texts = [x or b"" for x in t.column("t").cast(pa.large_binary()).to_pylist()]
    return Network().fit(texts, y) if len(y) else Network().silent()


def score(docs: DataFrame, model: Network, keep: list[str], text: str = "text") -> DataFrame:
    """keep plus `score`, the probability that the whole text is of good quality; a null text counts as empty. A column of keep that is
    called score gives way to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 80 kB
    kinds, keep = dict(docs.dtypes), [c for c in keep if c != "score"]
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffers(batch.column(at))
            s = [shared.value.score(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in chunks(offs, 1 << 18)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.concatenate(s or [np.zeros(0)]))], [*keep, "score"])

    return docs.select(*(F.col(f"`{c}`") for c in keep), *([] if text in keep else [text])).mapInArrow(tidy(run), "".join(f"`{c}` {kinds[c]}, " for c in keep) + "score double")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score, by a network that has not seen the labels of the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
