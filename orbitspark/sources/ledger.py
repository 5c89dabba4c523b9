"""The ledger of pulls, seeds, checkpoints of backfills, and sinks: everything that lands or leaves."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest_per_key

#: Vocabularies. Fixed values.
RUN_STATUS = ("running", "ok", "skipped_fresh", "error")
STATUSES = ("ACTIVE", "INACTIVE", "DECAYED", "PARTIAL", "STANDBY", "EXTENDED", "UNKNOWN")


# ------------------------------------------------------------------ ledger
def collapse(events: DataFrame) -> DataFrame:
    """One row per run from its appended events (opened, then closed): the latest wins, a closed one before an open one."""
    return latest_per_key(events, ["ingest_run_id"], [F.col("finished_at").desc_nulls_last(), F.col("started_at").desc(), (F.col("status") == "running").asc()])


def is_fresh(runs: DataFrame, source: str, endpoint: str, now: dt.datetime, interval: dt.timedelta) -> bool:
    """Whether an ok pull of this endpoint finished within the interval: then the next one is skipped."""
    since = now - interval
    return bool(runs.where((F.col("source") == source) & (F.col("endpoint") == endpoint) & (F.col("status") == "ok") & (F.col("finished_at") >= F.lit(since))).limit(1).count())


def recent_activity(runs: DataFrame, now: dt.datetime, n: int = 20) -> DataFrame:
    """The newest run of each source, endpoint label and status, of the n most recently active: source, endpoint, status, finished_at,
    rows_ingested.

    A run without a status is running if it started in the last 24 hours, else stale. An endpoint with a class in its path goes by
    that class's name.
    """
    label = F.coalesce(F.nullif(F.regexp_extract("endpoint", "class/([a-z_]+)", 1), F.lit("")), F.col("endpoint"))
    started = F.col("started_at") >= F.lit(now - dt.timedelta(hours=24))
    status = F.coalesce("status", F.when(started, "running").otherwise("stale"))
    rows = runs.select("source", label.alias("endpoint"), status.alias("status"), "started_at", "finished_at", "rows_ingested")
    last = latest_per_key(rows, ["source", "endpoint", "status"], [F.col("started_at").desc_nulls_last(), F.col("finished_at").desc_nulls_last(), F.col("rows_ingested").desc_nulls_last()])
    recent = last.withColumn("_at", F.coalesce("finished_at", "started_at")).orderBy(F.col("_at").desc_nulls_last(), "source", "endpoint", "status").limit(n)
    return recent.select("source", "endpoint", "status", "finished_at", "rows_ingested").orderBy("source", "endpoint", "status")


# ------------------------------------------------------------------ seeds
def read_seed(spark: SparkSession, path: str, schema: str, root: str | None = None) -> DataFrame:
    """A YAML list (or the list under root) as a small dimension; keys beyond the schema are dropped, absent ones null."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f) or []
    rows = got.get(root, []) if root else got
    if isinstance(rows, dict):
        rows = [{"key": k, "value": v} for k, v in rows.items()]
    names = [c.strip().split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


# ------------------------------------------------------------------ backfill
def pending_units(windows: DataFrame, ids: DataFrame, done: DataFrame, id_col: str, per_batch: int = 100) -> DataFrame:
    """(window_start, window_end, batch_no, ids) still to be fetched: each window by batches of about per_batch ids, less the
    finished units. Batches are hash groups, so a new id changes one batch and no numbering."""
    n = max(1, -(-ids.select(id_col).distinct().count() // per_batch))
    batches = ids.select(id_col).distinct().groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("batch_no")).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    numbered = windows.withColumn("batch_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return numbered.join(batches, "batch_no").join(done, ["window_start", "batch_no"], "left_anti")


# ------------------------------------------------------------------ sinks
def append_run(df: DataFrame, path: str, run_id: int, loaded_at: Column | None = None) -> None:
    """Rows stamped with their run, in a partition of their own: the newest run is one directory to read."""
    df.withColumn("ingest_run_id", F.lit(run_id).cast("long")).withColumn("loaded_at", F.current_timestamp() if loaded_at is None else loaded_at).write.mode("append").partitionBy("ingest_run_id").parquet(path)


def publish(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones and swing the pointer file last, by one rename; readers keep the version they opened."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(conf)
    new = Path(f"{path}/current.pointer.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    # one rename over the old pointer: a reader finds the old or the new one, never none
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    rename = df.sparkSession.sparkContext._gateway.new_array(kind, 1)
    rename[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, Path(f"{path}/current.pointer"), rename)
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.text(f"{path}/current.pointer").first()[0]
    return spark.read.parquet(version)


def append_csv_queue(df: DataFrame, path: str) -> None:
    """A review queue people read: one file per call, each with its header."""
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def append_jsonl(rows: list[dict], path: str) -> None:
    """Verdicts, a line each, on the driver's disk."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(json.dumps(r, default=str, sort_keys=True) + "\n" for r in rows)


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """df, if it has at most so many rows: what follows brings them to the driver."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def baseline(board: DataFrame, key: str, most: int = 100_000) -> str:
    """A leaderboard as JSON text in the key's order, for a later diff: small by nature, rendered on the driver; more than `most` rows
    raise."""
    return "[" + ",\n ".join(r[0] for r in _bounded(board, most).orderBy(key).select(F.to_json(F.struct(*sorted(board.columns)), {"ignoreNullFields": "false"})).collect()) + "]\n"


def markdown_table(df: DataFrame, order: list[Column], limit: int = 200) -> str:
    """The first `limit` rows in a total order as a Markdown table; the same rows give the same bytes. If there are more, a last line
    says so."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), *([f"\nOnly the first {limit} rows are shown."] if more else [])]) + "\n"


def serialise(df: DataFrame, most: int = 10_000) -> list[str]:
    """A page's rows as JSON; decimals and dates as text. More than `most` rows raise."""
    return _bounded(df, most).toJSON().collect()
