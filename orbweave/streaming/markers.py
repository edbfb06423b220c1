"""Counts over event streams (an extra: the batch operators on unbounded input)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, start, n, value: tumbling windows; rows later than the watermark are left out, state is dropped behind it."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select("event_type", F.col("window.start").alias("start"), "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of sessions that a gap ends."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
