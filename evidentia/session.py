"""Session factory and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with what the operators rely on: UTC, ANSI, adaptive plans with skew handling.

    On a cluster, master and sizes come from spark-submit; nothing here overrides them unless given.
    """
    b = SparkSession.builder.appName("evidentia")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; only the columns and row groups that the plan asks for are read."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet") if "://" not in folder else f"{folder}/{name}.parquet")
