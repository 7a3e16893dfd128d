"""Operators whose state runs along a sequence or a search; each group is one learner, paper or page, and small."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.core import half_up

#: Fixed values of the repetition rule.
START_EASE, LEAST_EASE = 2.5, 1.3


def review(state: Column, quality: Column) -> Column:
    """One step of spaced repetition; the interval comes from the ease before the answer, which a failure changes too."""
    passed = quality >= 3
    interval = F.when(~passed, 1).when(state["repetitions"] == 0, 1).when(state["repetitions"] == 1, 6).otherwise(F.floor(state["interval"] * state["ease"] + 0.5))
    miss = 5 - quality
    ease = F.greatest(F.lit(LEAST_EASE), half_up(state["ease"] + (0.1 - miss * (0.08 + miss * 0.02)), 2))
    return F.struct(ease.cast("double").alias("ease"), interval.cast("long").alias("interval"), F.when(passed, state["repetitions"] + 1).otherwise(0).cast("long").alias("repetitions"))


def repetition_state(answers: DataFrame, by: list[str], at: str, tie: str, quality: str) -> DataFrame:
    """by, ease, interval, repetitions after all answers, in order of time."""
    history = F.array_sort(F.collect_list(F.struct(at, tie, F.col(quality).cast("double").alias("q"))))
    start = F.struct(F.lit(START_EASE).alias("ease"), F.lit(0).cast("long").alias("interval"), F.lit(0).cast("long").alias("repetitions"))
    folded = answers.groupBy(*by).agg(history.alias("h")).withColumn("s", F.aggregate("h", start, lambda s, a: review(s, a["q"])))
    return folded.select(*by, "s.ease", "s.interval", "s.repetitions")


def assemble_paper(items: list[tuple[str, float, str]], target: float = 20.0, least: int = 3, most: int = 6, steps: int = 50_000, large: float = 5.0) -> list[str] | None:
    """Ids of least to most items (id, marks, chapter) whose marks sum exactly to the target, never two large ones of a chapter.

    The first found in the given order; None if there is none in the step bound.
    """
    goal = round(target * 100)
    usable = [(i, round(m * 100), c if m >= large else None) for i, m, c in items if m is not None and 0 < m <= target]
    stack: list[tuple[int, int, tuple[str, ...], frozenset[str]]] = [(0, 0, (), frozenset())]
    for _ in range(steps):
        if not stack:
            return None
        at, total, chosen, used = stack.pop()
        if total == goal and len(chosen) >= least:
            return list(chosen)
        if at == len(usable) or total >= goal or len(chosen) == most:
            continue
        item, marks, big = usable[at]
        stack.append((at + 1, total, chosen, used))
        if total + marks <= goal and big not in used:
            stack.append((at + 1, total + marks, (*chosen, item), used | {big} if big else used))
    return None


def papers(items: DataFrame, by: str, id_col: str, marks: str, chapter: str, target: float = 20.0) -> DataFrame:
    """by, items (comma-joined ids), total: one paper for each group that has one, large items tried first."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([marks, id_col], ascending=[False, True])
        found = assemble_paper(list(zip(rows[id_col].astype(str), rows[marks], rows[chapter], strict=True)), target)
        return pd.DataFrame([(pdf[by].iloc[0], ",".join(found), target)] if found else [], columns=[by, "items", "total"])

    return items.groupBy(by).applyInPandas(build, f"{by} {items.schema[by].dataType.simpleString()}, items string, total double")


def rescale_marks(points: list[float], target: float) -> list[float]:
    """Points in steps of a half that sum to the target, none below a half; the drift goes to the largest, half a mark at a time."""
    total = sum(points)
    if total <= 0:
        return points
    halves = [max(1, int(p * target / total * 2 + 0.5)) for p in points]
    drift = int((target - sum(halves) / 2) * 2)
    step = 1 if drift > 0 else -1
    for _ in range(abs(drift)):
        free = [i for i, h in enumerate(halves) if step > 0 or h > 1]
        if not free:
            break
        halves[max(free, key=lambda i: (halves[i], -i))] += step
    return [h / 2 for h in halves]


def increasing_places(values: list[int]) -> list[int]:
    """Places of the longest strictly increasing subsequence, the earliest ends first."""
    tops: list[int] = []
    last: list[int] = []
    before = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before.append(last[at - 1] if at else -1)
        tops[at : at + 1], last[at : at + 1] = [v], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]
