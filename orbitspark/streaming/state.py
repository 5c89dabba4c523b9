"""Latest state that ends: a stateful processor with event-time timers on a RocksDB store.

A key's newest row is kept until the watermark passes its timestamp by `ttl`; then its state is cleared, and an idle key costs
nothing. A row that comes back later starts anew. So the store holds the keys that were active lately, not all there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.written import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """The row of a key with the largest timestamp, ties to the smaller `tie`; given out whenever it changes."""

    def __init__(self, schema: str, columns: list[str], ts: str, tie: str, ttl_ms: int):
        self.schema, self.columns, self.ts, self.tie, self.ttl_ms = schema, columns, ts, tie, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, tie = self.columns.index(self.ts), self.columns.index(self.tie)
        old = tuple(self.row.get()) if self.row.exists() else None
        best = old
        for part in rows:
            top = part.sort_values([self.ts, self.tie], ascending=[False, True], kind="stable").iloc[0]
            row = tuple(_plain(top[c]) for c in self.columns)
            if best is None or (row[at], _Falling(row[tie])) > (best[at], _Falling(best[tie])):
                best = row
        if best is not None and best != old:
            if old is not None:
                self.handle.deleteTimer(self._ends(old[at]))
            self.row.update(best)
            self.handle.registerTimer(self._ends(best[at]))
            yield pd.DataFrame([best], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.row.clear()
        return iter([])

    def close(self) -> None:
        pass

    def _ends(self, ts) -> int:
        return int(pd.Timestamp(ts).timestamp() * 1000) + self.ttl_ms


class _Falling:
    """Orders the other way round: of equal timestamps the smaller tie wins."""

    def __init__(self, of):
        self.of = of

    def __gt__(self, other) -> bool:
        return self.of < other.of

    def __eq__(self, other) -> bool:
        return self.of == other.of


def _plain(v):
    """A value of the state store: no pandas or numpy types, nulls as None."""
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v.item() if hasattr(v, "item") else v


def latest(stream: DataFrame, key: str, ts: str, tie: str, columns: list[str], ttl: str = "30 days") -> DataFrame:
    """The stream of each key's newest row (key, ts, tie, columns), for update mode: a row whenever it changes.

    stream carries a watermark on ts. A key whose newest row lies `ttl` behind the watermark is forgotten. Rows without a
    key or a timestamp count for nothing.
    """
    names = [key, ts, tie, *columns]
    rows = stream.select(*names).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    schema = StructType([rows.schema[c] for c in names])
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    made = Newest(schema, names, ts, tie, ttl_ms)
    return rows.groupBy(key).transformWithStateInPandas(made, schema, "Update", "EventTime")


def run_into_log(stream: DataFrame, path: str | None = None) -> tuple[DataFrame, list[int]]:
    """Run the stream to the end of what is there, writing each micro-batch's changes as a folder of its own; returns all changes with
    their `batch`, and the state rows after each trigger. A repeated batch overwrites its folder."""
    spark = stream.sparkSession
    path = path or shared_folder(spark, "stream")
    with rocksdb(spark):
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/changes/batch={n}")
        sink = stream.writeStream.outputMode("update").foreachBatch(write)
        query = sink.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(f"{path}/changes"), held


class rocksdb:  # noqa: N801
    """Within it, streams start on RocksDB stores, which timers and state variables need."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.KEY, None)
        self.conf.set(self.KEY, ROCKSDB)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.conf.unset(self.KEY)
        else:
            self.conf.set(self.KEY, self.before)
