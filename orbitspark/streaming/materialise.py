"""A rollup by day that is kept up to date by the days that change.

Landing a batch appends its facts and notes the days they touch in an invalidation log. A refresh computes the noted days anew, and
these alone: each becomes a new version of its partition, and the commit that names the versions is written last. Readers take the
committed version of each day; days that are noted and not yet refreshed they compute from the facts, so nothing that has landed is
missing. Superseded versions are deleted one refresh later, as a reader may still be on them.

    base/facts/day=D/batch=N      base/noted/batch=N (days)      base/rollup/day=D/version=V      base/commits/version=V (days, batch)

Late rows are facts like others: their day is noted again, however old it is. The tables of days are as long as the calendar, so
they are small whatever the facts are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest_per_key

DAYS = "day date"


class Materialised:
    """rollup: facts → rows with a column `day`, each day's rows computed from that day's facts alone. One writer at a time."""

    def __init__(self, spark: SparkSession, base: str, schema, ts: str, rollup: Callable[[DataFrame], DataFrame]):
        self.spark, self.base, self.ts, self.rollup = spark, base.rstrip("/"), ts, rollup
        self.schema = spark.createDataFrame([], schema).schema

    # -------------------------------------------------------------- landing
    def land(self, batch: DataFrame, number: int) -> None:
        """Append a batch. The same number again replaces what it wrote before; rows without a timestamp belong to no day and are left out.
        The days are noted first: a batch that dies in between costs a needless refresh and no missing one."""
        rows = batch.select(*self.schema.names).withColumns({"day": F.to_date(self.ts), "batch": F.lit(number).cast("long")}).where("day is not null")
        self._write(rows.select("day").distinct(), f"{self.base}/noted/batch={number}")
        rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.base}/facts")

    def follow(self, stream: DataFrame, refresh: bool = True) -> None:
        """Run a stream of facts to the end of what is there: each micro-batch lands and, with refresh, its days are made anew."""

        def take(batch: DataFrame, number: int) -> None:
            self.land(batch, number)
            if refresh:
                self.refresh()

        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    # -------------------------------------------------------------- state
    def facts(self) -> DataFrame:
        return self._table("facts", [*self.schema.fields], DAYS + ", batch long")

    def commits(self) -> DataFrame:
        """version, day, through: the newest commit of each day, and the last batch that it holds."""
        rows = self._table("commits", [], DAYS + ", through long, version long")
        return latest_per_key(rows, ["day"], [F.col("version").desc()])

    def pending(self) -> DataFrame:
        """Days that a batch has touched since they were last made."""
        noted = self._table("noted", [], DAYS + ", batch long").groupBy("day").agg(F.max("batch").alias("batch"))
        return noted.join(self.commits(), "day", "left").where("through is null or batch > through").select("day")

    # -------------------------------------------------------------- refresh
    def refresh(self, low: dt.date | None = None, high: dt.date | None = None) -> list[dt.date]:
        """Make the pending days in [low, high) anew; returns them. A refresh that dies before its commit leaves what readers see as it
        was."""
        last = self._table("noted", [], DAYS + ", batch long").agg(F.max("batch")).first()[0]
        due = self.pending().where(F.lit(True) if low is None else F.col("day") >= F.lit(low)).where(F.lit(True) if high is None else F.col("day") < F.lit(high))
        days = sorted(r[0] for r in due.collect())  # days of a calendar
        if not days:
            return []
        version = (self._table("commits", [], DAYS + ", through long, version long").agg(F.max("version")).first()[0] or 0) + 1
        made = self.rollup(self.facts().where(F.col("day").isin(days) & (F.col("batch") <= last)).drop("day", "batch"))
        made = made.where(F.col("day").isin(days)).withColumn("version", F.lit(version).cast("long"))
        self._drop_superseded()
        made.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(f"{self.base}/rollup")
        self._write(self.spark.createDataFrame([(d, last) for d in days], DAYS + ", through long"), f"{self.base}/commits/version={version}")
        return days

    def policy(self, now: dt.datetime, start: dt.timedelta = dt.timedelta(days=7), end: dt.timedelta = dt.timedelta(hours=1)) -> list[dt.date]:
        """refresh() of the days between now - start and now - end, as a schedule calls it: the day that still fills is left alone."""
        return self.refresh((now - start).date(), (now - end).date())

    def materialised(self) -> DataFrame:
        """The committed version of each day."""
        columns = [f for f in self.rollup(self.spark.createDataFrame([], self.schema)).schema if f.name != "day"]
        rows = self._table("rollup", columns, DAYS + ", version long")
        return rows.join(F.broadcast(self.commits().select("day", "version")), ["day", "version"]).drop("version")  # a row a day

    def current(self) -> DataFrame:
        """Committed days, and those pending computed now from their facts."""
        late = self.pending()
        done = self.materialised().join(late, "day", "left_anti")
        live = self.rollup(self.facts().join(F.broadcast(late), "day", "left_semi").drop("day", "batch"))  # a row a day
        return done.select(*live.columns).unionByName(live)

    # -------------------------------------------------------------- files
    def _drop_superseded(self) -> None:
        """Delete the versions of days that a commit before the last one has replaced, and those that no commit names."""
        commits = self._table("commits", [], DAYS + ", through long, version long")
        newest = commits.agg(F.max("version")).first()[0] or 0
        kept = {(r["day"], r["version"]) for r in commits.where(F.col("version") < newest).groupBy("day").agg(F.max("version").alias("version")).collect()}
        kept |= {(r["day"], r["version"]) for r in commits.where(F.col("version") == newest).collect()}
        fs, path = self._fs(f"{self.base}/rollup")
        for day in fs.listStatus(path) if fs.exists(path) else []:
            name = day.getPath().getName()
            if not name.startswith("day="):
                continue
            for v in fs.listStatus(day.getPath()):
                there = v.getPath().getName()
                if there.startswith("version=") and (dt.date.fromisoformat(name[4:]), int(there[8:])) not in kept:
                    fs.delete(v.getPath(), True)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _table(self, name: str, columns: list, more: str) -> DataFrame:
        empty = self.spark.createDataFrame([], more).schema
        schema = type(empty)([*columns, *empty])
        fs, path = self._fs(f"{self.base}/{name}")
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/{name}").parquet(f"{self.base}/{name}")

    @staticmethod
    def _write(df: DataFrame, path: str) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(path)  # a row a day
