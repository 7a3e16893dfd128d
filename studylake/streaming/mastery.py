"""Incremental versions of batch operators on Structured Streaming (an extension: the batch operators are the standard)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.core import half_up, recency


def daily_activity(events: DataFrame, late: str = "2 days") -> DataFrame:
    """user_id, day, n: answers per user and day; a day is final once the watermark has passed it, and later rows are dropped."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").cast("date").alias("day"), "n")


def mastery_sums(attempts: DataFrame, as_of: Column, credit: Column) -> DataFrame:
    """user_id, chapter, wc, w: the two sums whose quotient is the mastery; they only grow, so state is two numbers a key."""
    w = F.when(credit.isNotNull(), recency(F.col("attempted_at"), as_of) * 0.5)
    return attempts.groupBy("user_id", "chapter").agg(F.sum(credit * w).alias("wc"), F.sum(w).alias("w"))


def mastery_of(sums: DataFrame) -> DataFrame:
    return sums.select("user_id", "chapter", half_up(F.when(F.col("w") > 0, F.col("wc") / F.col("w")).otherwise(0.0), 3).alias("mastery"))
