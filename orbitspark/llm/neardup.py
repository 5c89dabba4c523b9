"""Near duplicates by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one class first, so exact copies cost nothing later. Each of TREES trees orders the
classes by the signature read from another place on; those that share a prefix of DEPTH values form a region. In a region the
neighbours in the tree's order, which have the longest common prefixes, are candidates: a small region's all, a large one's
next few, however deep their prefix must be to tell them apart. Candidates whose signatures agree enough are verified on full
shingle sets: the two best of each document first, then all whose components still differ. In a large region each member is
also verified against the one with the fewest scarce shingles; pairs that share a scarce shingle are listed by it, and other
pairs of different components are compared in blocks where counts of scarce shingles do not rule a link out exactly. So no
link is lost to a region's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, buffers, chunks, materialize, mix, ngram_hash, tidy, word_hash, word_spans
from .components import components
from .repeats import WHOLE, packed_text, row_ids, unpack_text

#: A pair of similarity 0.8 shares no region with probability (1 - 0.8**4)**20 = 3e-5, and has AGREE values in common but for 1e-5.
TREES, DEPTH = 20, 4
VALUES, AGREE = TREES * DEPTH, 48
#: Members of a small region, next neighbours taken in a larger one, and rows of a block where regions are compared whole.
SMALL, NEXT, BLOCK = 8, 3, 256
#: A shingle that at most so many members of large regions have is scarce.
SCARCE = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(17)
_FACTORS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "row long, n long, s1 long, s2 long, sig binary"


def shingle_sets(buf: np.ndarray, offs: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document: A-Z lowered, words between blanks; a text of fewer words is one shingle."""
    buf = _LOWER[buf]
    s, e, wo = word_spans(buf, offs, SPACE)
    h = word_hash(buf, s, e, seed=4)
    g = ngram_hash(h, shingle)
    out = []
    for a, b in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(g[a : b - shingle + 1]))
        else:
            out.append(ngram_hash(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(row, text) → SIGNED: set size, two sums that name the set, and VALUES minima of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffers(batch.column("text"))
            n, s1, s2, sig = [], [], [], []
            for a, b in chunks(offs):
                sets = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle)
                size = np.array([len(x) for x in sets])
                full = np.flatnonzero(size)
                k1, k2, m = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.zeros((len(sets), VALUES), np.uint16)
                if len(full):
                    x = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    k1[full] = np.add.reduceat(mix(x), at)
                    k2[full] = np.add.reduceat(mix(x ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
                    for j in range(VALUES):
                        # the minimum's low half names it; its high half decides
                        least = np.minimum.reduceat((x * _FACTORS[j]) >> np.uint64(32), at)
                        m[full, j] = mix(least).astype(np.uint16)
                n.append(size)
                s1.append(k1.view(np.int64))
                s2.append(k2.view(np.int64))
                sig += [r.tobytes() for r in m]
            cat = lambda x: pa.array(np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), cat(n), cat(s1), cat(s2), pa.array(sig, pa.binary())], ["row", "n", "s1", "s2", "sig"])

    return docs.select("row", "text").mapInArrow(tidy(run), SIGNED)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), VALUES)


def regions(classes: DataFrame) -> DataFrame:
    """classes(rep, sig) → (key, rep): in each tree, a hash of the tree and the first DEPTH values of its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.ascontiguousarray(_matrix(batch.column("sig"))).view(np.uint64)  # DEPTH values of 16 bits are 64 bits
            key = mix(m ^ (np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
            key = (key & ~np.uint64(31)) | np.arange(TREES, dtype=np.uint64)[None, :]  # the tree can be read from its key
            rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rep)], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(tidy(run), "key long, rep long")


def neighbours(members: DataFrame) -> DataFrame:
    """members(key, n, rep, sig), sorted by key and the tree's order within partitions → candidate pairs (a < b, agree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            key, n, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "rep"))
            sig = _matrix(batch.column("sig"))
            if tail is not None:
                key, n, rep, sig = (np.concatenate(x) for x in zip(tail, (key, n, rep, sig), strict=True))
            old = 0 if tail is None else len(tail[0])
            found = []
            for d in range(1, SMALL):
                if d >= len(key):
                    break
                i = np.arange(max(0, old - d), len(key) - d)
                i = i[(key[i] == key[i + d]) & ((n[i] <= SMALL) | (d <= NEXT))]
                agree = (sig[i] == sig[i + d]).sum(1)
                i, agree = i[agree >= AGREE], agree[agree >= AGREE]
                found.append((np.minimum(rep[i], rep[i + d]), np.maximum(rep[i], rep[i + d]), agree))
            tail = tuple(x[-SMALL:] for x in (key, n, rep, sig))
            if found:
                a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], ["a", "b", "agree"])

    return members.select("key", "n", "rep", "sig").mapInArrow(tidy(run), "a long, b long, agree int")


def tree_order(key, sig):
    """The signature as its tree reads it: from the tree's place to the end, then from the start."""
    at = (key.bitwiseAND(F.lit(31)) * (2 * DEPTH)).cast("int")
    return F.concat(F.substring(sig, at + 1, F.lit(2 * VALUES)), F.substring(sig, F.lit(1), at))


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b, agree), and (key, n, rep) of the members of regions too large for neighbours alone."""
    keys = regions(classes)
    # written, so that adaptive execution may split the other side of the join where one region holds most rows
    sizes, _ = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members, _ = materialize(keys.join(sizes, "key"))
    signed = members.join(classes.select("rep", "sig"), "rep").withColumn("o", tree_order(F.col("key"), F.col("sig")))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = signed.where(F.col("n") <= SMALL).repartition("key").sortWithinPartitions("key", "o", "rep")
    # by range of the whole order: a region that holds a third of all rows is dealt to many tasks
    large = signed.where(F.col("n") > SMALL).repartitionByRange(parts, "key", "o", "rep").sortWithinPartitions("key", "o", "rep")
    pairs = neighbours(small).union(neighbours(large)).groupBy("a", "b").agg(F.max("agree").alias("agree"))
    return materialize(pairs)[0], members.where(F.col("n") > SMALL)


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(row, set) of the documents named in ids: the hashes of all their shingles. Written, as several joins read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                buf, offs = buffers(unpack_text(part.column("z")))
                sets = [x.tobytes() for x in shingle_sets(buf, offs, shingle)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.binary())], ["row", "set"])

    return materialize(packed_text(docs, ["row"]).join(ids, "row").mapInArrow(tidy(run), "row long, set binary"))[0]


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach percent of their union."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = (batch.column(i) for i in range(4))
            good = []
            for i in range(batch.num_rows):
                p, q = unpack(a[i].as_py()), unpack(b[i].as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    joined = pairs.select("a", "b").join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
    return joined.select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y").mapInArrow(tidy(hold), "u long, v long")


def scarce_shingles(large: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """large(key, rep) → (key, rep, size, own, centre) and (a, b).

    A shingle is scarce if at most SCARCE members of large regions have it; own counts a member's. centre is the region's member
    with the fewest. Two members without a scarce shingle in common share at most the smaller of their size - own. Those that have
    one in common are listed, at most SCARCE**2 / 2 a shingle, and returned where the same bound plus their number allows a link.
    """
    members = large.select("rep").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [unpack(x.as_py()) for x in batch.column("set")]
            rows = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), [len(x) for x in sets_])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets_ or [np.zeros(0, np.uint64)]).view(np.int64)), pa.array(rows)], ["shingle", "rep"])

    held = members.join(sets.withColumnRenamed("row", "rep"), "rep")
    rows = held.select("set", "rep").mapInArrow(tidy(run), "shingle long, rep long")
    few = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= SCARCE)
    scarce, _ = materialize(rows.join(few, "shingle"))
    own = scarce.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    sizes, _ = materialize(held.select("rep", (F.octet_length("set") / 8).cast("long").alias("size")).join(own, "rep", "left").select("rep", "size", F.coalesce("own", F.lit(0)).alias("own")))
    lists = scarce.where("c > 1").groupBy("shingle").agg(F.sort_array(F.collect_list("rep")).alias("l"))
    pair = F.explode(F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    pairs = lists.select(pair.alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("k"))
    side = lambda x: sizes.select(F.col("rep").alias(x), F.col("size").alias(f"s{x}"), (F.col("size") - F.col("own")).alias(f"c{x}"))
    both = F.least("ca", "cb") + F.col("k")
    linked = pairs.join(side("a"), "a").join(side("b"), "b").where(F.lit(100) * both >= F.lit(percent) * (F.col("sa") + F.col("sb") - both)).select("a", "b")
    placed = large.select("key", "rep").join(sizes, "rep")
    centres, _ = materialize(placed.groupBy("key").agg(F.min(F.struct("own", "rep")).alias("centre")))
    return materialize(placed.join(centres, "key"))[0], linked


def possible(size: str, own: str, other: str, percent: int):
    return F.lit(100) * (F.col(size) - F.col(own)) >= F.lit(percent) * (F.col(size) + F.col(other))


def remaining(placed: DataFrame, comps: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """Candidate pairs (a, b) between different components of one large region, or None if there can be none.

    Only pairs without a scarce shingle in common are asked for (see scarce_shingles). Members whose own scarce shingles rule out
    a link with the region's most ordinary member have none there. Of the others, the largest component's are compared with the
    rest only; both sides go in blocks, and a pair leaves a block if its signatures agree, the bound allows a link, and no
    earlier tree has the pair in a region."""
    open_ = placed.where(possible("size", "own", "centre.own", percent))
    open_ = open_.join(comps.withColumnRenamed("u", "rep"), "rep", "left").select("key", "rep", "size", "own", F.coalesce("v", "rep").alias("comp"))
    per = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("top")).where("all > top")
    mixed, _ = materialize(mixed)
    rows = open_.join(mixed, "key").join(classes.select("rep", "sig"), "rep").withColumn("mb", F.ceil(F.col("all") / BLOCK)).withColumn("qb", F.ceil((F.col("all") - F.col("top")) / BLOCK))
    rows, _ = materialize(rows)
    if not rows.limit(1).count():
        return None
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["key", "rep", "comp", "sig", "size", "own"]
    member = rows.select(*cols, at("mb").alias("m"), every("qb").alias("q"))
    asked = rows.where("comp <> main").select(*cols, at("qb").alias("q"), every("mb").alias("m"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(p["sig"]), np.uint16).reshape(len(p), VALUES) for p in (left, right))
            tree = int(left["key"].iloc[0]) & 31
            px, py = x.view(np.uint64)[:, :tree], y.view(np.uint64)[:, :tree]
            (cx, rx, sx, ox), (cy, ry, sy, oy) = ([p[c].to_numpy() for c in ("comp", "rep", "size", "own")] for p in (left, right))
            for i in range(len(x)):
                both = np.minimum(sx[i] - ox[i], sy - oy)
                j = np.flatnonzero((cy != cx[i]) & (100 * both >= percent * (sx[i] + sy - both)))
                j = j[((y[j] == x[i]).sum(1) >= AGREE) & ~(py[j] == px[i]).any(1)]
                out.append(np.stack([np.minimum(rx[i], ry[j]), np.maximum(rx[i], ry[j])], 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return asked.groupBy("key", "q", "m").cogroup(member.groupBy("key", "q", "m")).applyInPandas(compare, "a long, b long").distinct()


def groups(base: DataFrame, shingle: int, percent: int) -> DataFrame:
    """base(row, text) → (row, n, root): set size, and the smallest row of the component."""
    signed, _ = materialize(signatures(base, shingle))
    classes, _ = materialize(signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("rep"), F.first("sig").alias("sig")))
    pairs, large = candidates(classes)
    ids = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).union(large.select("rep")).distinct()
    sets = full_sets(base, ids, shingle)
    placed, scarce = scarce_shingles(large, sets, percent)
    # first each document's two best neighbours, and the most ordinary member of its large regions
    ways = pairs.union(pairs.select("b", "a", "agree"))
    best = ways.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b"))).where("k <= 2").select("a", "b")
    centre = placed.where("rep <> centre.rep").where(possible("size", "own", "centre.own", percent)).groupBy("rep").agg(F.min("centre").alias("c")).select(F.col("rep").alias("a"), F.col("c.rep").alias("b"))
    tried, _ = materialize(best.union(centre).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first, _ = materialize(verify(tried, sets, percent))
    comps = components(first)
    c = lambda x: comps.select(F.col("u").alias(x), F.col("v").alias(f"c{x}"))
    open_pairs = pairs.select("a", "b").union(scarce).distinct().join(c("a"), "a", "left").join(c("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rest = remaining(placed, comps, classes, percent)
    open_pairs = (open_pairs.union(rest).distinct() if rest is not None else open_pairs).join(tried, ["a", "b"], "left_anti")
    open_pairs, _ = materialize(open_pairs)
    if open_pairs.limit(1).count():
        comps = components(first.union(materialize(verify(open_pairs, sets, percent))[0]))
    roots = classes.select("s1", "s2", "n", "rep").join(comps.withColumnRenamed("u", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("v", "rep").alias("root"))
    return signed.where("n > 0").select("row", "n", "s1", "s2").join(roots, ["s1", "s2", "n"]).select("row", "n", "root").union(signed.where("n = 0").select("row", "n", F.col("row").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text, ...).

    Two documents are linked if their distinct `shingle`-word shingles reach `percent` of their union; component_id is the
    smallest doc_id reachable by links, and kept marks the rows that bear it. Null, empty and blank texts have no shingles
    and no links. Repeated rows are copies of each other: rows that share the smallest id are all kept. A null id takes the
    place of the largest; ids may be of any type that has an order. Columns beyond these two are not read; an empty table gives
    an empty one.
    """
    base = row_ids(docs.select("doc_id", "text"), ordered=True)
    named = groups(base, shingle, percent)
    whole = dict(docs.dtypes)["doc_id"] in WHOLE
    if whole and not base.where(~F.col("row").eqNullSafe(F.col("doc_id"))).limit(1).count():
        return named.select(F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), (F.col("row") == F.col("root")).alias("kept"))
    named, _ = materialize(named.join(base.select("row", "doc_id"), "row"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those whose component has a row of a smaller id (or text, where ids are equal).
    Documents without words have no links and stay."""
    base = row_ids(docs.select(F.struct("*").alias("whole"), "doc_id", "text"), ordered=True)
    first = groups(base, shingle, percent).where("row = root").select("row")
    return base.join(first, "row", "left_semi").select("whole.*")


def op4_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component on 4-word shingles at 80 per cent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 80)
