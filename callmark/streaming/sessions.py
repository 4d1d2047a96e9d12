"""Sessions: superloci of a stream, runs of a user's events with gaps below a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "10 minutes", late: str | None = None) -> DataFrame:
    """Per user and session: start, last event, events, sum of values.  late: the watermark, for a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start_ts"), "last_ts", "n", "total")
