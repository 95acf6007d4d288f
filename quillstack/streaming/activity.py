"""Activity of users as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream (append mode): a session is given out once the watermark is past its gap; later events are dropped."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    found = timed.groupBy(F.col(user), F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n_events"), F.min("_t").alias("started"), F.max("_t").alias("ended"))
    return found.select(user, "started", "ended", "n_events")


def activity_counts(events: DataFrame, ts: str = "ts", every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by type and hour of a stream."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", every).alias("w"), "event_type").agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("hour"), "event_type", "n_events")
