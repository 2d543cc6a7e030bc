"""Sessions and active users of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap_seconds: int = 1800, late_seconds: int = 3600) -> DataFrame:
    """user, started, ended and n_events of each session, given out once the watermark has passed its end.

    Works on streams and on tables. Times without a zone are taken in the session's zone, as watermarks need one. The state
    holds a row for each open session; events later than late_seconds are dropped.
    """
    timed = events.select(F.col(user).alias("user"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", f"{late_seconds} seconds")
    grouped = timed.groupBy("user", F.session_window("ts", f"{gap_seconds} seconds").alias("session"))
    return grouped.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_events")).drop("session")


def totals(events: DataFrame, kind: str = "event_type", ts: str = "ts", value: str = "value", every: str = "1 hour", late_seconds: int = 3600) -> DataFrame:
    """Events and the sum of their values in each window of time and kind."""
    timed = events.select(F.col(kind).alias("kind"), F.col(value).alias("value"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", f"{late_seconds} seconds")
    grouped = timed.groupBy(F.window("ts", every).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("began"), "kind", "n_events", "total")
