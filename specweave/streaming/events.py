"""Query logs as streams: windows, late rows, duplicates and upserts. Batch and stream share the transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.merge import KeyedTable

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "1 hour"


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return timed(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def timed(events: DataFrame) -> DataFrame:
    """Event time with a zone (UTC), which watermarks ask for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    w = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


def without_repeats(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def upsert_into(table: KeyedTable, order: list[str] | None = None, stream: str = "upsert"):
    """A foreachBatch that merges each batch into a table: the newest row of a key (the last in ``order``) stays, untouched partitions keep their files.

    A batch done twice changes nothing: the table knows which ones of this stream it has.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, order, f"{stream}:{batch_id}")

    return run
