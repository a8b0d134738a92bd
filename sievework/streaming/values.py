"""Streaming checks: windowed completeness and range rates over events (beyond the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, low: float, high: float, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """For each window and event type: events, missing values and values out of range.  Works on streams and tables."""
    value = F.col("value")
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    out = counted.agg(F.count("*").alias("n"), F.count_if(value.isNull()).alias("n_missing"), F.count_if((value < low) | (value > high)).alias("n_outside"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "n_missing", "n_outside")
