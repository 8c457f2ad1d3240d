"""Counts over streams (F8, F13): Structured Streaming aggregations of token counts, in all, by condition, by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def freq_dist(stream: DataFrame, tokens: Column) -> DataFrame:
    """sample, count so far; for output mode update or complete. The state is one row a sample."""
    return stream.select(F.explode(tokens).alias("sample")).groupBy("sample").agg(F.count(F.lit(1)).alias("count"))


def conditional_freq_dist(stream: DataFrame, condition: Column, tokens: Column) -> DataFrame:
    return stream.select(condition.alias("condition"), F.explode(tokens).alias("sample")).groupBy("condition", "sample").agg(F.count(F.lit(1)).alias("count"))


def windowed_freq_dist(stream: DataFrame, time: str, tokens: Column, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, end, sample, count by event time; rows later than ``late`` are dropped by the watermark, windows behind it leave the
    state, so output mode append works."""
    rows = stream.withWatermark(time, late).select(F.window(time, window, slide).alias("w"), F.explode(tokens).alias("sample"))
    return rows.groupBy("w", "sample").agg(F.count(F.lit(1)).alias("count")).select("w.start", "w.end", "sample", "count")
