"""Streaming counterparts of the batch programs: the same expressions over a stream.

Late rows within the watermark change their day; older ones are dropped here and taken in by recomputing the days they touch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutations import upsert
from ..operators.written import shared_folder


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(stream: DataFrame, ts: str, late: str = "7 days") -> DataFrame:
    """The stream with a timestamp that carries the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def daily(stream: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The daily rollup. In update mode each trigger gives the days it changed."""
    w = stream.groupBy(key, F.window(ts, "1 day")).agg(F.avg(value).alias("value_avg"), F.stddev_samp(value).alias("value_stddev"), F.min(value).alias("value_min"), F.max(value).alias("value_max"), F.count(F.lit(1)).alias("n"))
    return w.select(key, F.to_date("window.start").alias("day"), "value_avg", "value_stddev", "value_min", "value_max", "n")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def latest(stream: DataFrame, key: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """Latest row per key, ties to the smaller `tie`: one state row per key, for update mode."""
    best = F.max_by(F.struct(ts, tie, *columns), F.struct(F.col(ts), -F.col(tie)))
    return stream.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def sessions(stream: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    return stream.groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))


def keep_table(path: str, keys: list[str], take: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each micro-batch is upserted into the version that the one before wrote. A repeated batch gives the same
    version again, as its number names it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{path}/batch={number - 1}")
        except Exception as e:  # the first batch, or the first after a cleared folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = spark.createDataFrame([], batch.schema)
        upsert(old, batch, keys, take).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_into_table(stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Run the stream to the end of what is there, in update mode, upserting each micro-batch into a table; returns its last version.
    Nothing of the result passes through the driver. path: a folder that driver and executors share; by default a new one below
    spark.checkpoint.dir."""
    spark = stream.sparkSession
    path = path or shared_folder(spark, "stream")
    last: list[int] = []
    sink = keep_table(f"{path}/table", keys, {})

    def write(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        last[:] = [number]

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/table/batch={last[0]}") if last else spark.createDataFrame([], stream.schema)


def run_into_files(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run the stream to the end of what is there, appending its rows to Parquet files; returns them. For streams whose rows are final
    once they are given."""
    spark = stream.sparkSession
    path = path or shared_folder(spark, "stream")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def serve(materialised: DataFrame, tail: DataFrame, rollup: Callable[[DataFrame], DataFrame], day: str = "day") -> DataFrame:
    """Days that are written, and those of the live tail computed now: the tail's days win."""
    live = rollup(tail)
    return materialised.join(live.select(day).distinct(), day, "left_anti").select(*live.columns).unionByName(live)
