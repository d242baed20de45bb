"""Streaming twins of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """W3 with the threshold rule alone: sessions by inactivity."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def counters(stream: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A2, A3: tumbling counts."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def idempotent(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """K8: each key once."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def merge_into(stream: DataFrame, write, checkpoint: str, trigger: dict | None = None):
    """K5, K6: each micro-batch handed to a merge."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
