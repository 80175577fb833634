"""Signals as streams: windowed consensus with watermark and expiry of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL, LATENESS = "30 minutes", "1 hour"


def consensus(signals: DataFrame, window: str = TTL, lateness: str = LATENESS) -> DataFrame:
    """Windows of signals (memory_id, origin, vigor, created_at) with their backing, count and whether half agrees.

    Works on a batch or a stream; on a stream, windows close by the watermark.
    """
    df = signals.withWatermark("created_at", lateness) if signals.isStreaming else signals
    per = df.groupBy("memory_id", F.window("created_at", window)).agg(F.sum(F.when(F.col("origin") == "purchase", F.col("vigor")).otherwise(0)).alias("backing"), F.count("*").alias("live"))
    return per.select("memory_id", F.col("window.start").alias("opened"), "backing", "live", (2 * F.col("backing") >= F.col("live")).alias("resolved"))


def expired(signals: DataFrame, now, ttl_seconds: int = 1800) -> DataFrame:
    """Signals whose time to live has passed at ``now``."""
    return signals.where(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) <= F.lit(now))
