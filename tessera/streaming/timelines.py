"""Streaming forms of the timeline and of the latest event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and failures of each day by event time; works on streams and on tables. Rows later than the watermark are left out of streams."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    return days.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "events", "errors")


def once_per_key(events: DataFrame, key: str, within: str = "24 hours") -> DataFrame:
    """A stream without repeats of a key within that time."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def write_log(events: DataFrame, path: str, checkpoint: str):
    """Append a stream to a table in the given folder, in micro-batches, until what is there has been read."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
