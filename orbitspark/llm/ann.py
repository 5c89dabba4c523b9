"""Nearest neighbours by cosine: an inverted file of coarse centroids with product-quantised residuals.

The codebooks are fitted on one half of a bounded sample (SAMPLE vectors by hash order) on the driver; every row is indexed, once,
and the index is written down. The sample's other half, which no centroid was made of, says for each query by itself in which
cells to look: those that hold the query's own nearest there, and all that are as near as these. Cells lie on shelves of bounded
size, and a query goes once to each shelf with cells that it probes. There an asymmetric distance table bounds the score of each
code in these cells: a row's code misses its vector by a length that the index keeps, so a row whose score by code falls short of
the k-th best of the sample by more than that is no neighbour. All others are ranked by their original vectors in double
precision; no count cuts them short. A large cell has a shelf of several blocks, and queries come in slices, so a cell that holds
a third of all vectors is searched by many tasks and nothing in it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, tidy

#: Vectors that the codebooks are fitted on, at most, and coarse cells, at most: 8 for each square root of the rows up to there.
SAMPLE, CELLS = 16_384, 4_096
#: Rows of a shelf: a sixteenth of all within these bounds. Queries that meet a shelf in one task, at most.
SHELF_ROWS, QUERY_ROWS = (2_048, 8_192), 16_384
#: By so much a score that codes bound may be off, as it is summed in single precision, and one in double precision.
ROUGH, FINE = 1e-5, 1e-9


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest row of c for each row of x, in slices of bounded size."""
    half = (c * c).sum(1) / 2
    step = max(1, (8 << 20) // max(1, len(c)))
    return np.concatenate([np.argmax(x[i : i + step] @ c.T - half, 1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids (fewer if x has fewer rows), by Lloyd's rounds; an empty cell takes a random row."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _near(x, c)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        s = np.zeros_like(c)
        full = n > 0
        s[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        c = np.where(full[:, None], s / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


class Model:
    """Coarse centroids, codebooks of residuals per subspace, and the sample that says in which cells a query looks."""

    def __init__(self, x: np.ndarray, rows: int, k: int, target: float, seed: int = 11, row: np.ndarray | None = None):
        x = np.asarray(x, np.float64)
        d = x.shape[1]
        self.dim, self.k = d, k
        # a centroid is near the rows that it was made of, more than to others: the half that judges cells takes no part in making them
        judge = np.zeros(len(x), bool)
        judge[1::2] = len(x) >= 64
        fit = x[~judge]
        # equal centroids, as many copies make them, are one cell
        self.cells = np.unique(kmeans(fit, int(np.clip(round(8 * rows**0.5), 1, min(CELLS, max(1, len(fit) // 4)))), 6, seed), axis=0)
        self.parts = np.array_split(np.arange(d), min(d, max(1, d // 4)))
        residual = (fit - self.cells[_near(fit, self.cells)]).astype(np.float32)
        self.books = [kmeans(residual[:, p], min(256, max(1, len(fit))), 6, seed + 1 + i) for i, p in enumerate(self.parts)]
        self.seen, self.near, self.judges = x, _near(x, self.cells), np.flatnonzero(judge)
        self.row = np.full(len(x), -1) if row is None else row
        # of so many and one more that could be the farthest, one is with a chance of 1 - target; a sample of all rows has the nearest itself
        self.most = 0 if len(x) >= rows else len(x) if target >= 1 else max(k, int(np.ceil(target / (1 - target) - 1e-9)))
        # the neighbours of some judges among the others say in how many cells a query must look at least
        at = self.judges[:: max(1, len(self.judges) // 512)] if judge.any() else np.arange(len(x))
        among = self.judges if judge.any() else np.arange(len(x))
        sims = np.where(among == at[:, None], -np.inf, x[at] @ x[among].T)
        best = among[np.argsort(-sims, 1)[:, : min(k, len(among) - 1)]]
        need = np.sort(np.take_along_axis(self.ranks(x[at])[0], self.near[best], 1).ravel())
        self.probes = int(need[min(len(need) - 1, int(np.ceil(target * len(need))))]) + 1 if len(need) else len(self.cells)

    def closeness(self, x: np.ndarray) -> np.ndarray:
        return x @ self.cells.T - (self.cells**2).sum(1) / 2

    def ranks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the place of every cell, nearest first, and its distance."""
        close = self.closeness(x)
        order = np.argsort(-close, 1, kind="stable").astype(np.int32)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=np.int32)[None], 1)
        return rank, np.sqrt(np.maximum(0, 1 - 2 * close))

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Cells that each row looks in at least, nearest first: as many as most queries need."""
        return np.argsort(-self.closeness(x), 1, kind="stable")[:, : self.probes]

    def reached(self, x: np.ndarray, row: np.ndarray, sizes: np.ndarray, radius: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Cells that each query looks in, and the score that its k nearest reach: that of the k-th best of the sample, whose cells are
        looked in, so no query is left with fewer rows. Cells go as far as those of probed() and the query's own nearest of the sample's
        judges; among these, one that is empty or too far away for its radius is left out. sizes, radius: rows of each cell, and how far
        from its centroid they lie."""
        sims = x @ self.seen.T
        sims[row[:, None] == self.row] = -np.inf
        rank, far = self.ranks(x)
        at = rank[:, self.near]
        floor = np.full(len(x), -np.inf) if sims.shape[1] < self.k else -np.partition(-sims, self.k - 1, 1)[:, self.k - 1] - FINE
        last = np.maximum(self.probes - 1, np.where(sims >= floor[:, None], at, 0).max(1))
        if self.most > len(self.judges):
            last[:] = len(self.cells)
        elif self.most:
            own = np.argpartition(-sims[:, self.judges], self.most - 1, 1)[:, : self.most]
            last = np.maximum(last, np.take_along_axis(at, self.judges[own], 1).max(1))
        last[~np.isfinite(floor)] = len(self.cells)
        reach = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(floor, -1))) + ROUGH
        looks = (rank <= last[:, None]) & (sizes > 0) & (far - radius <= reach[:, None])
        return [np.flatnonzero(c) for c in looks], floor

    def shelves(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By cell its shelf, by shelf its blocks: cells that lie together share a shelf (see SHELF_ROWS), and one that is larger has a
        shelf of several blocks to itself. Both are as short as the list of cells."""
        room = int(np.clip(sizes.sum() // 16, *SHELF_ROWS))
        groups = kmeans(self.cells, max(1, min(len(self.cells), int(sizes.sum()) // room + 1)), 4, 3)
        shelf, blocks, held = np.zeros(len(sizes), np.int64), [1], 0
        for c in np.argsort(_near(self.cells, groups), kind="stable").tolist():
            if held and held + sizes[c] > room:
                blocks.append(1)
                held = 0
            shelf[c] = len(blocks) - 1
            held += int(sizes[c])
            blocks[-1] = -(-max(1, held) // room)
        return shelf, np.array(blocks)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        r = (x - self.cells[cell]).astype(np.float32)
        return np.stack([_near(r[:, p], b).astype(np.uint8) for p, b in zip(self.parts, self.books, strict=True)], 1)

    def decoded(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = self.cells[cell].copy()
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out[:, p] += b[code[:, i]]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(parts, 256, queries): inner products of each query with every entry of every codebook."""
        out = np.zeros((len(self.parts), 256, len(q)), np.float32)
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out[i, : len(b)] = b @ q[:, p].T
        return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that squares neither overflow nor vanish; no digit of a cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), dim)


def _raw(x: np.ndarray, width: str) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(width)], pa.binary())


def _given(col: pa.ChunkedArray, dim: int, width: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), width).reshape(-1, dim)


def _first_copies(x: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each vector in each cell: the others come after these for every query."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((cell, same))
    same, cell = same[order], cell[order]
    start = np.concatenate([[True], (same[1:] != same[:-1]) | (cell[1:] != cell[:-1])])
    at = np.arange(len(x))
    return np.sort(order[at - np.maximum.accumulate(np.where(start, at, 0)) < n])


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of row and row, in double precision: equal rows give equal scores, which a matrix product does not promise."""
    a, b = _scaled(a.astype(np.float64)), _scaled(b.astype(np.float64))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def valid(vectors: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """id and v (array<double>), plus more, of the vectors that take part: not null, no null or non-finite component, not zero."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    zero = F.forall(v, lambda a: a == 0)
    # coalesce keeps the null test ahead: exists() is null where only some element is
    return vectors.select(F.col(id_col).alias("id"), v.alias("v"), *more).where(F.col("v").isNotNull() & F.col("id").isNotNull()).where(~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)))


def _nested(rows: DataFrame) -> bool:
    """Whether ids are of a type that Arrow does not sort; rows then are numbered in their order."""
    return dict(rows.dtypes)["id"].startswith(("array", "struct"))


def build(rows: DataFrame, k: int, target: float, sample: int) -> tuple[Model | None, DataFrame]:
    """A model fitted on a bounded sample of rows(id, v, ...), and all rows with their cell, their distance from its centroid (far), code
    and the distance from what the code stands for (off): written, each with a number (row) that tells repeated ids apart."""
    spark = rows.sparkSession
    if _nested(rows):
        rows = rows.orderBy("id")
    rows, _ = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    got = rows.orderBy(F.xxhash64("id"), "id", "row").limit(sample).select("row", "v").toArrow()
    number, got = got.column("row").to_numpy(), got.column("v").combine_chunks()
    if not len(got):
        return None, rows
    length = pc.list_value_length(got).to_numpy(zero_copy_only=False)
    often = np.bincount(length)
    dim = len(often) - 1 - int(np.argmax(often[::-1]))  # the most common length, the greater of two
    model = Model(_unit(_matrix(got.filter(pa.array(length == dim)), dim)), n, k, target, row=number[length == dim])
    shared = spark.sparkContext.broadcast(model)  # the sample, at most CELLS centroids and 256 entries a subspace, whatever the input

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            u = _unit(_matrix(batch.column("v"), m.dim))
            cell = _near(u, m.cells)
            code = m.encode(u, cell)
            far, off = (np.sqrt(((u - c) ** 2).sum(1)) for c in (m.cells[cell], m.decoded(cell, code)))
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far), codes, pa.array(off)], [*batch.schema.names, "cell", "far", "code", "off"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    indexed = rows.where(F.size("v") == dim).mapInArrow(tidy(assign), f"{kinds}, cell int, far double, code binary, off double")
    return model, materialize(indexed)[0]


def search(vectors: DataFrame, queries: DataFrame | Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", target: float = 0.97, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows of `vectors`, ties to the smaller id.

    queries: a condition on vectors, whose rows then are the queries and do not find themselves; or a frame of others with the same
    two columns, to which every row is a candidate. Vectors that are null, zero, or hold a null or non-finite component take no
    part; of several lengths only the most common in the sample takes part. Rows that repeat an id are rows of their own: as a
    query each has its own ranks, as a candidate each its own place. Repeated vectors tie exactly. Fewer than k candidates
    give fewer rows; an empty table gives none. target: the
    share of the nearest that the probed cells hold, by the sample; 1 looks in every cell that can hold one, where no row is missed.
    """
    spark = vectors.sparkSession
    own = isinstance(queries, Column)
    asks = F.coalesce(queries, F.lit(False)) if own else F.lit(False)
    model, index = build(valid(vectors, id_col, vec_col, asks.alias("asks")), k, target, sample)
    kind = dict(index.dtypes)["id"]
    asker = kind if own else dict(queries.dtypes)[id_col]
    if model is None:
        return spark.createDataFrame([], f"query_id {asker}, rank int, vec_id {kind}, score double")
    if own:
        asked = index.where("asks").select("row", "id", "v")
    else:
        asked, _ = materialize(valid(queries, id_col, vec_col).where(F.size("v") == model.dim).withColumn("row", -1 - F.monotonically_increasing_id()).select("row", "id", "v"))
    # vectors travel as they are given
    width = "<f4" if all(dict(f.dtypes)[vec_col] == "array<float>" for f in ([vectors] if own else [vectors, queries])) else "<f8"
    shared = spark.sparkContext.broadcast(model)
    counts = {r["cell"]: r for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # a row per centroid
    sizes, radius = (np.array([counts[c][of] if c in counts else 0 for c in range(len(model.cells))]) for of in ("n", "far"))
    shelf, blocks = model.shelves(sizes)
    by = ["row"] if _nested(index) else ["id", "row"]
    slices = max(1, -(-asked.count() // QUERY_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "cell"))
            on = shelf[cell]
            block = mix(row.astype(np.uint64)) % blocks[on].astype(np.uint64)
            v = _raw(_matrix(batch.column("v"), shared.value.dim), width)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "cell", "code", "off")), v, pa.array(on, pa.int32()), pa.array(block.astype(np.int32))], ["row", "id", "cell", "code", "off", "v", "shelf", "block"])

    listed = index.select("row", "id", "cell", "code", "off", "v").mapInArrow(tidy(place), f"row long, id {kind}, cell int, code binary, off double, v binary, shelf int, block int")
    listed = listed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                x = _matrix(part.column("v"), m.dim)
                probed, floor = m.reached(_unit(x), part.column("row").to_numpy(), sizes, radius)
                cell, q = np.concatenate(probed).astype("<i4"), np.repeat(np.arange(len(x)), [len(c) for c in probed])
                order = np.lexsort((shelf[cell], q))
                cell, q, on = cell[order], q[order], shelf[cell[order]]
                cut = np.flatnonzero(np.concatenate([[len(q) > 0], (q[1:] != q[:-1]) | (on[1:] != on[:-1])]))
                lists = [c.tobytes() for c in np.split(cell, cut[1:])]
                each = blocks[on[cut]]
                at = np.repeat(np.arange(len(cut)), each)
                block = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
                to = pa.array(q[cut][at])
                cols = [part.column("row").take(to), part.column("id").take(to), pa.array(floor).take(to), _raw(x, width).take(to), pa.array([lists[i] for i in at.tolist()], pa.binary()), pa.array(on[cut][at], pa.int32()), pa.array(block, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["q", "query_id", "floor", "v", "cells", "shelf", "block"])

    ways = asked.select("row", "id", "v").mapInArrow(tidy(probe), f"q long, query_id {asker}, floor double, v binary, cells binary, shelf int, block int").withColumn("slice", F.pmod(F.xxhash64("q"), F.lit(slices)).cast("int"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        m, out = shared.value, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            by_id = pc.sort_indices(left.select(by), [(c, "ascending") for c in by]).to_numpy().astype(np.int64)
            turn = np.argsort(left.column("cell").to_numpy()[by_id], kind="stable")  # by cell; within equal scores the smaller id is first
            order = by_id[turn]
            vectors = _given(left.column("v"), m.dim, width)
            few = _first_copies(vectors[order], left.column("cell").to_numpy()[order], k + 1)  # one of them may be the query
            turn, order = turn[few], order[few]
            row, cell, off = (left.column(c).to_numpy()[order] for c in ("row", "cell", "off"))
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)[order].astype(np.int64)
            vectors = vectors[order]
            units = _unit(vectors.astype(np.float64))
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            q, floor = (right.column(c).to_numpy() for c in ("q", "floor"))
            asking, lists = _given(right.column("v"), m.dim, width), right.column("cells").to_pylist()
            step = max(1, (1 << 22) // max(len(row), len(m.parts) * 256))
            for lo in range(0, len(q), step):
                mine, least = _unit(asking[lo : lo + step].astype(np.float64)), floor[lo : lo + step]
                tables = m.tables(mine)
                asks = np.zeros((len(mine), len(m.cells)), bool)
                for i, x in enumerate(lists[lo : lo + step]):
                    asks[i, np.frombuffer(x, "<i4")] = True
                score = np.full((len(mine), len(row)), -np.inf)
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(row)], strict=True):
                    w = np.flatnonzero(asks[:, cell[a]])
                    if len(w):
                        most = 4 * len(w) >= len(mine)  # then whole lines of a table are read, which is faster than to pick some
                        near = np.zeros((b - a, len(mine) if most else len(w)), np.float32)
                        for p in range(code.shape[1]):
                            near += tables[p, code[a:b, p]] if most else tables[p, code[a:b, p, None], w]
                        some = (near[:, w] if most else near) + off[a:b, None] >= least[w] - mine[w] @ m.cells[cell[a]] - ROUGH
                        w, at = w[some.any(0)], a + np.flatnonzero(some.any(1))
                        score[np.ix_(w, at)] = mine[w] @ units[at].T
                score[q[lo : lo + step, None] == row] = -np.inf
                n = min(k, len(row))
                kth = np.partition(score, len(row) - n, 1)[:, len(row) - n]
                i, j = np.nonzero((score >= np.maximum(least, kth - FINE)[:, None]) & (score > -np.inf))
                exact = np.concatenate([_cosine(asking[lo + i[c : c + 65536]], vectors[j[c : c + 65536]]) for c in range(0, len(i), 65536)] or [np.zeros(0)])
                best = np.lexsort((turn[j], -exact, i))
                i = i[best]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((lo + i[top], order[j[best][top]], exact[best][top]))
        i, j, exact = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([right.column("q").take(pa.array(i)), left.column("row").take(pa.array(j)), right.column("query_id").take(pa.array(i)), left.column("id").take(pa.array(j)), pa.array(exact)], ["q", "row", "query_id", "vec_id", "score"])

    keys = ["shelf", "block", "slice"]
    found = listed.groupBy(*keys).cogroup(ways.groupBy(*keys)).applyInArrow(scan, f"q long, row long, query_id {asker}, vec_id {kind}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each whose id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
