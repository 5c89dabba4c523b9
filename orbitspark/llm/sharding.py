"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records by a seeded hash into buckets that fit in memory; pass two shuffles each bucket with
Fisher-Yates (Spark's `shuffle`) and writes it. The order of the buckets, then of the records in them, is a global random
order; dealing it out in turn gives shards whose row counts differ by at most one (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, totals

#: A bucket's bytes: 1/4096 of the input within these bounds, so that neither a bucket nor the list of buckets grows large.
BUCKET_BYTES = (4 << 20, 64 << 20)


def global_shuffle(df: DataFrame, key: list[str], text: str = "text", columns: list[str] | None = None, seed: int = 20240601, bucket_bytes: int | None = None) -> DataFrame:
    """`columns` of df (all by default) plus bucket and position (gapless from 0 over everything, in random order).

    key: columns that tell records apart; they alone decide the bucket. Nulls are values like others. Rows alike in
    every column share a bucket. An empty table gives an empty one. Columns named bucket or position are replaced. A map, which has no
    order, travels as its entries.
    The shuffled buckets are written before they are used, so a lost executor cannot change an order that was handed out.
    """
    columns = [c for c in (columns or df.columns) if c not in ("bucket", "position")]
    maps = [c for c, kind in df.dtypes if kind.startswith("map<") and c in columns]
    df = df.withColumns({c: F.map_entries(f"`{c}`") for c in maps})
    _, total = totals(df, text)
    size = bucket_bytes or min(max(total // 4096, BUCKET_BYTES[0]), BUCKET_BYTES[1])
    buckets = max(1, -(-total // size))
    scattered = df.select(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).alias("bucket"), F.struct(*(F.col(c) for c in columns)).alias("record"))
    # sorted first, and the buckets in order: the same seed then gives the same permutation when a task runs again
    lists = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records")).sortWithinPartitions("bucket")
    shuffled, _ = materialize(lists.select("bucket", F.shuffle("records", F.lit(seed)).alias("records")).select("bucket", F.posexplode("records").alias("at", "record")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    out = shuffled.join(offsets, "bucket").select("record.*", "bucket", (F.col("first") + F.col("at")).alias("position"))
    return out.withColumns({c: F.map_from_entries(f"`{c}`") for c in maps})


def assign_shards(df: DataFrame, key: list[str], shards: int = 16, **kw) -> DataFrame:
    """global_shuffle plus shard and slot: the record at position p lies in shard p mod `shards`, slot p div `shards`. Columns of these
    names are replaced."""
    out = global_shuffle(df, key, **kw)
    return out.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / shards).cast("long")}).drop("position")


def write_shards(df: DataFrame, path: str, key: list[str], shards: int = 16, **kw) -> None:
    """The shards as folders shard=N of Parquet files, their rows in slot order within each file."""
    assign_shards(df, key, shards, **kw).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_shards(spark, sf_dir: str) -> DataFrame:
    """Every document's place in 16 shards under the law `rows`; size is the text's UTF-8 bytes (null: none) plus 1. Whole
    records are shuffled and written; size and checksum are those of the text read back from the shuffled buckets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    out = assign_shards(docs.withColumn("text_crc32", crc), ["doc_id", "text_crc32"], columns=docs.columns)
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
