"""The driver's tables as the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.sources.files import bounded

#: The moment that all time-relative queries look back from.
AS_OF = "2024-02-01 00:00:00"


#: Tables of whole texts, which go to Python in batches of a bounded number of rows.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return bounded(rows) if name in TEXTS else rows


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as attempts: errors are wrong, purchases right, other types have a score out of 500."""
    e = table(spark, sf_dir, "events")
    judged = F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "purchase", True)
    return e.select("event_id", "user_id", F.col("event_type").alias("chapter"), F.col("ts").cast("timestamp").alias("attempted_at"), judged.alias("is_correct"), F.col("value").alias("score"), F.lit(500.0).alias("max_score"))
