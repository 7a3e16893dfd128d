"""Scalar rules shared by many operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed values of the scoring rules.
RECENCY_DAYS = 14.0
DEFAULT_DIFFICULTY = 0.5
LEAST_DIFFICULTY = 0.05


def half_up(x: Column, digits: int) -> Column:
    """Rounded with halves towards plus infinity, the rule of every reported figure."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def mean(x: Column) -> Column:
    """Mean of doubles from an exact sum of their decimals, so that the order in which rows meet doesn't decide its last bit, nor a half that is rounded later.

    A plain mean where a value has more than 18 digits before the point or isn't finite.
    """
    digits = x.try_cast("decimal(38, 20)")
    return F.coalesce(F.when(F.count(digits) == F.count(x), F.try_sum(digits).cast("double") / F.count(x)), F.avg(x))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def credit(is_correct: Column, score: Column, max_score: Column) -> Column:
    """1 or 0 for a judged attempt, else the share of marks; null if neither says."""
    return F.when(is_correct.isNotNull(), is_correct.cast("double")).when(max_score > 0, clamp01(score / max_score))


@F.pandas_udf(DoubleType())
def exp(x: pd.Series) -> pd.Series:
    """exp of the C library, which SQL engines call too; the JVM's own differs in the last bit, which decides halves that are rounded later."""
    return x.map(math.exp)


def recency(attempted_at: Column, as_of: Column) -> Column:
    """exp(-days / 14); attempts in the future count as now."""
    days = (F.unix_micros(as_of) - F.unix_micros(attempted_at)) / 1e6 / 86400.0  # whole microseconds: seconds as doubles lose some
    return exp(-F.greatest(days, F.lit(0.0)) / RECENCY_DAYS)
