"""Learning analytics: mastery, readiness, repetition and planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.core import DEFAULT_DIFFICULTY, LEAST_DIFFICULTY, clamp01, credit, half_up, recency


def mastery(attempts: DataFrame, as_of: Column, by: list[str], difficulty: str | None = None) -> DataFrame:
    """by, mastery (weighted mean credit, 3 digits, 0 without scored attempts), attempts (scored or not)."""
    c = credit(F.col("is_correct"), F.col("score"), F.col("max_score"))
    hard = F.coalesce(F.col(difficulty), F.lit(DEFAULT_DIFFICULTY)) if difficulty else F.lit(DEFAULT_DIFFICULTY)
    weight = F.when(c.isNotNull(), recency(F.col("attempted_at"), as_of) * F.greatest(hard, F.lit(LEAST_DIFFICULTY)))
    total = F.sum(weight)
    score = F.when(total > 0, clamp01(F.sum(c * weight) / total)).otherwise(F.lit(0.0))
    return attempts.groupBy(*by).agg(half_up(score, 3).alias("mastery"), F.count("*").alias("attempts"))


def readiness(now: DataFrame, before: DataFrame, user: str, chapter: str, chapters: int) -> DataFrame:
    """user, readiness (half mastery times coverage, three tenths chapters with five attempts, two tenths trend), trend, reportable."""
    old = before.select(user, chapter, F.col("mastery").alias("__old"))
    each = now.join(old, [user, chapter], "left").groupBy(user).agg(
        F.avg("mastery").alias("m"), (F.count("*") / chapters).alias("coverage"), (F.count(F.when(F.col("attempts") >= 5, 1)) / chapters).alias("deep"),
        half_up(F.coalesce(F.avg("mastery") - F.avg("__old"), F.lit(0.0)), 9).alias("delta"), F.sum("attempts").alias("attempts"),
    )
    score = 0.5 * F.col("m") * F.col("coverage") + 0.3 * F.col("deep") + 0.2 * clamp01(0.5 + F.col("delta") / 0.2 * 0.5)
    trend = F.when(F.col("delta") > 0.02, "up").when(F.col("delta") < -0.02, "down").otherwise("flat")
    # to 9 digits first, so that the order of a sum does not decide a half
    return each.select(user, half_up(half_up(score, 9), 3).alias("readiness"), trend.alias("trend"), (F.col("attempts") >= 10).alias("reportable"))
