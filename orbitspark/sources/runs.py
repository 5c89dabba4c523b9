"""Landing by runs that are seen whole or not at all.

A run opens in the ledger, writes its rows into an attempt folder of its own, moves that folder to its place by one rename, and is
closed as `ok` by a ledger event, which comes last. Whatever fails before closes it as `error`. Readers take rows of closed `ok` runs
alone, so neither half a write nor a moved folder whose run never closed is ever seen.

    base/ledger (events)      base/attempts/RUN      base/tables/NAME/ingest_run_id=RUN
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ledger import collapse, is_fresh

EVENTS = "ingest_run_id long, source string, endpoint string, table string, status string, started_at timestamp, finished_at timestamp, rows_ingested long, notes string"
#: Characters of an error that the ledger keeps.
NOTES = 2_000


class Runs:
    """A ledger and the tables that land under it. Times are UTC without a zone."""

    def __init__(self, spark: SparkSession, base: str, clock: Callable[[], dt.datetime] | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))

    # -------------------------------------------------------------- ledger
    def _event(self, *values) -> None:
        self.spark.createDataFrame([values], EVENTS).coalesce(1).write.mode("append").parquet(f"{self.base}/ledger")

    def runs(self) -> DataFrame:
        """One row a run, by its last event."""
        fs, path = self._fs(f"{self.base}/ledger")
        if not fs.exists(path):
            return self.spark.createDataFrame([], EVENTS)
        return collapse(self.spark.read.schema(EVENTS).parquet(f"{self.base}/ledger"))

    # -------------------------------------------------------------- landing
    def land(self, source: str, endpoint: str, table: str, produce: Callable[[], DataFrame], interval: dt.timedelta | None = None) -> int | None:
        """Pull, write and commit the rows of produce() as a run of the table; returns its id. With an interval, a pull whose last ok run
        is younger is skipped: the ledger says `skipped_fresh`, produce is not called, and None is returned. An error closes the
        run, leaves no row of it behind and is raised again."""
        started, run = self.clock(), self._next()
        if interval is not None and is_fresh(self.runs(), source, endpoint, started, interval):
            self._event(run, source, endpoint, table, "skipped_fresh", started, started, 0, None)
            return None
        self._event(run, source, endpoint, table, "running", started, None, None, None)
        attempt = f"{self.base}/attempts/{run}"
        try:
            seen = Observation()
            rows = produce().observe(seen, F.count(F.lit(1)).alias("rows"))  # counted as they are written
            rows.withColumn("loaded_at", F.lit(started)).write.parquet(attempt)
            self._rename(attempt, f"{self.base}/tables/{table}/ingest_run_id={run}")
            self._event(run, source, endpoint, table, "ok", started, self.clock(), int(seen.get["rows"]), None)
        except BaseException as e:
            self._delete(attempt)
            self._event(run, source, endpoint, table, "error", started, self.clock(), 0, str(e)[:NOTES])
            raise
        return run

    def _next(self) -> int:
        """Ids grow with time, also where two runs open within one tick of the clock."""
        return max(time.time_ns() // 1000, 1 + (self.runs().agg(F.max("ingest_run_id")).first()[0] or 0))

    # -------------------------------------------------------------- reading
    def committed(self, table: str, schema: str | StructType) -> DataFrame:
        """Rows of the table's ok runs, with ingest_run_id and loaded_at. Runs are partitions, so others are not read."""
        empty = self.spark.createDataFrame([], schema).schema
        full = StructType([*empty, *self.spark.createDataFrame([], "loaded_at timestamp, ingest_run_id long").schema])
        fs, path = self._fs(f"{self.base}/tables/{table}")
        if not fs.exists(path):
            return self.spark.createDataFrame([], full)
        ok = self.runs().where((F.col("status") == "ok") & (F.col("table") == table)).select("ingest_run_id")
        rows = self.spark.read.schema(full).option("basePath", f"{self.base}/tables/{table}").parquet(f"{self.base}/tables/{table}")
        return rows.join(ok, "ingest_run_id", "left_semi")

    def newest(self, table: str, schema: str | StructType) -> DataFrame:
        """Rows of the table's newest ok run."""
        ok = self.runs().where((F.col("status") == "ok") & (F.col("table") == table))
        last = ok.agg(F.max("ingest_run_id")).first()[0]
        return self.committed(table, schema).where(F.col("ingest_run_id") == F.lit(last))

    # -------------------------------------------------------------- recovery
    def close_lost(self, older: dt.timedelta = dt.timedelta(hours=24)) -> list[int]:
        """Close runs that opened longer ago and never closed, as `error`, and delete what they wrote, moved or not; returns their ids. For
        the next job to call: a killed one cannot."""
        now = self.clock()
        lost = self.runs().where((F.col("status") == "running") & (F.col("started_at") < F.lit(now - older))).orderBy("ingest_run_id").collect()  # a row a killed job
        for r in lost:
            self._delete(f"{self.base}/attempts/{r['ingest_run_id']}")
            self._delete(f"{self.base}/tables/{r['table']}/ingest_run_id={r['ingest_run_id']}")
            self._event(r["ingest_run_id"], r["source"], r["endpoint"], r["table"], "error", r["started_at"], now, 0, "lost")
        return [r["ingest_run_id"] for r in lost]

    # -------------------------------------------------------------- files
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _rename(self, old: str, new: str) -> None:
        fs, a = self._fs(old)
        _, b = self._fs(new)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"cannot move {old} to {new}")

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)
