"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, benchmark leaks, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitspark.llm import decontaminate, neardup, packing, quality, substring
from orbitspark.llm.common import drop_since, materialize, written

#: Documents below this score go.
LEAST_SCORE = 0.5


def _others(docs: DataFrame) -> Column:
    """All columns but the text as one struct, whose names then clash with none."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality network rejects; all stay where no document is labelled."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.select(_others(docs), "text"), model, ["others", "text"])
    return scored.where(F.col("score") >= LEAST_SCORE).select(*(F.col("text" if c == "text" else f"others.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, by 5-word shingles at 80 per cent."""
    return neardup.keep_one(docs, 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated 35-word windows; n_chars follows. A document of which nothing is left keeps
    its row; a null text becomes empty."""
    out = substring.removed(docs, 35, True, [c for c in docs.columns if c != "text"])
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text")}
    return out.select(*((new[c].cast(t) if c in new else F.col(f"kept.`{c}`")).alias(c) for c, t in docs.dtypes))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 4096 tokens. Workers that have run the other stages keep fewer words."""
    return packing.pack(docs, keep_words=60_000)


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("no_benchmark", no_benchmark), ("packed", packed)]

#: A network, signatures and a tokenizer are not SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage has written on its way is deleted once its own rows are written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = materialize(docs)
            drop_since(spark, mark, path)
    return docs
