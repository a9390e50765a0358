"""Structured Streaming forms that need no state of their own: frames of points and rates in windows, and health at given ticks.
Those with deadlines, matching and filters are in timed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_frames(points: DataFrame, interval: str, lateness: str) -> DataFrame:
    """Points (ts, lidar_id, x, y, z) merged over all lidars into frames of an interval: start, number and mean position."""
    framed = points.withWatermark("ts", lateness).groupBy(F.window("ts", interval).alias("w"))
    return framed.agg(F.count("*").alias("n"), F.min("ts").alias("base_ts"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")).select(F.col("w.start").alias("frame_ts"), "n", "base_ts", "x", "y", "z")


def stream_metrics(messages: DataFrame, length: str, slide: str, lateness: str) -> DataFrame:
    """Rate of each topic in sliding windows: (n - 1) over the span between first and last, 0 without one."""
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    out = messages.withWatermark("ts", lateness).groupBy(F.window("ts", length, slide).alias("w"), "topic")
    return out.agg(F.count("*").alias("n"), F.when(span > 0, (F.count("*") - 1) * 1e6 / span).otherwise(0.0).alias("rate")).select(F.col("w.start").alias("start"), "topic", "n", "rate")


def health(ticks: DataFrame, last_seen: dict[str, str], timeouts: dict[str, float]) -> DataFrame:
    """ticks (t, and the last receive time of each topic) with the first unhealthy topic in order of timeouts, else healthy;
    a topic never seen is stale, timeout 0 never."""
    reason = None
    for topic, limit in timeouts.items():
        if limit <= 0:
            continue
        seen = F.col(last_seen[topic])
        stale = seen.isNull() | (F.col("t") - seen > limit)
        reason = F.when(stale, f"{topic}_timeout") if reason is None else reason.when(stale, f"{topic}_timeout")
    return ticks.withColumn("health", F.lit("healthy") if reason is None else reason.otherwise("healthy"))
