"""Streaming forms of two batch queries: an extension, since the batch model has no unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_tally(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type over a stream (or table) of events with a column ts; rows later than `late` are dropped by the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, parted by gaps of more than `gap`."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
