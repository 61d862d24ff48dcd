"""Windowed event counts, as one plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n) of tumbling windows; on a stream, rows later than `delay` are dropped by the watermark."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events
    return source.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
