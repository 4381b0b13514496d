"""Structured Streaming without state by hand: rate limits, notification dedupe, stretches of presence. Counts and presence take a streaming DataFrame or a batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_counts(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Events (operation, subject, at) counted in fixed windows; rows later than `late` are dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", f"{seconds} seconds").alias("w"), "operation", "subject").agg(F.count("*").alias("n")).select("operation", "subject", F.col("w.start").alias("from"), "n")


def dedupe_notifications(notices: DataFrame, ttl: str = "30 seconds") -> DataFrame:
    """A job id once within ttl. Streams only: a table has no watermark."""
    return notices.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["job_id"])


def presence(beats: DataFrame, ttl: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches in which a worker was alive: it is gone when no beat came for ttl."""
    return beats.withWatermark("at", late).groupBy(F.session_window("at", ttl).alias("w"), "worker").agg(F.count("*").alias("n")).select("worker", F.col("w.start").alias("from"), F.col("w.end").alias("until"), "n")

