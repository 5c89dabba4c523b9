"""SparkSession settings the engine relies on: UTC, ANSI errors on, adaptive execution with skew handling."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("orbitspark")
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
