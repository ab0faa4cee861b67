"""Windows over events, as Structured Streaming or over a finished table.

Each function takes a DataFrame, streaming or not, with a timestamp column; the
watermark bounds what state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, table: str = "events", files_per_trigger: int = 16) -> DataFrame:
    """A stream over the table's files; ``ts`` as a timestamp, which watermarks need."""
    one = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(one).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{table}.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", *keys: str) -> DataFrame:
    return _windows(events, F.window("ts", width), late, keys)


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "1 hour", *keys: str) -> DataFrame:
    return _windows(events, F.window("ts", width, step), late, keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", *keys: str) -> DataFrame:
    return _windows(events, F.session_window("ts", gap), late, keys)


def _windows(events: DataFrame, window, late: str, keys: tuple[str, ...]) -> DataFrame:
    base = events.withWatermark("ts", late) if events.isStreaming else events
    out = base.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def once_each(events: DataFrame, id_col: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once; ids are remembered for as long as the watermark lets them come again."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_col])
    return events.dropDuplicates([id_col])


def run_once(stream: DataFrame, spark: SparkSession, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, then stop: the result as a table in memory, for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
