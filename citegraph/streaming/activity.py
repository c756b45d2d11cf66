"""Streaming forms: windows over an activity stream, first sight of an event, and sync of a landing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_windows(events: DataFrame, every: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and users by window and type; rows later than the watermark are dropped by the state store."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sync_stream(landing: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of a landing folder goes to apply(batch, number), which must be idempotent for a number."""
    return landing.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
