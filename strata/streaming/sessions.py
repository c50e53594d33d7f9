"""Event streams: sessions by inactivity and change events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user, closed by a gap; on a stream, state ends once the watermark has passed."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.session_window("ts", gap).alias("w")
    return df.groupBy("user_id", w).agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events", "total")


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest events, ties by id."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)
