"""Counts of sentiments in windows of time over a stream of assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintleaf.functions.numbers import count_if
from mintleaf.operators.units import opinions
from mintleaf.schemas import SENTIMENTS


def windowed_counts(assertions: DataFrame, length: str = "30 days", late: str = "7 days") -> DataFrame:
    """(window start, Restaurant, aspect, counts); rows later than the watermark are dropped in a stream."""
    rows = opinions(assertions).withColumn("Review_Date", F.col("Review_Date").cast("timestamp")).withWatermark("Review_Date", late)
    grouped = rows.groupBy(F.window("Review_Date", length), "Restaurant", "aspect").agg(F.count(F.lit(1)).alias("mentions"), *[count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in SENTIMENTS])
    return grouped.select(F.col("window.start").alias("window_start"), "Restaurant", "aspect", "mentions", *[f"n_{s}" for s in SENTIMENTS])
