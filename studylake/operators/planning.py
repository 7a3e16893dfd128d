"""Study plans and papers: weights and shares are expressions, the laying out of one learner's days is a fold over a short list."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.functions.core import half_up

# Fixed values of the planner: minutes of an activity, ceilings and windows in days.
MINUTES = {"flashcards": 20, "quiz": 30, "exam_drill": 45, "review": 15}
DAILY_MINUTES, CHAPTERS_A_DAY, HORIZON, HORIZON_WITHOUT_EXAM = 120, 3, 60, 14
DRILL_DAYS, RAMP_DAYS, RAMP_MOST, REVIEW_GAP = 10, 14, 1.5, 3
FOCUS_DAYS, FOCUS_MOST, FOCUS_FLOOR = 14, 3, 0.15
KNOWN, EVIDENCE = 0.7, 5


def focus_ramp(days_out: Column) -> Column:
    """1 at the edge of the window before an exam, rising to 3 on its day."""
    near = FOCUS_DAYS - F.greatest(F.lit(0), F.least(days_out, F.lit(FOCUS_DAYS)))
    return 1 + near / FOCUS_DAYS * (FOCUS_MOST - 1)


def chapter_weight(mastery: Column, attempts: Column, days_out: Column | None = None) -> Column:
    """The gap to full mastery, halved with fewer than five attempts; 0 from 0.7 on. days_out: of the subject's exam, null if another subject is examined."""
    base = F.when(mastery < KNOWN, F.greatest(F.lit(0.0), 1 - mastery) * F.when(attempts >= EVIDENCE, 1.0).otherwise(0.5)).otherwise(0.0)
    if days_out is None:
        return base
    known = F.when(mastery >= KNOWN, FOCUS_FLOOR).otherwise(base)
    return F.when(days_out.isNotNull() & (days_out <= FOCUS_DAYS), known * focus_ramp(days_out)).otherwise(base)


def focus_pulls(days_out: Column) -> Column:
    """Chapters that a subject gives in a turn: up to three of the one under examination (days_out: to its exam, null for others)."""
    return F.coalesce(F.greatest(F.lit(1), F.floor(focus_ramp(days_out) + 0.5)), F.lit(1)).cast("int")


def daily_capacity(days_out: Column, base: Column) -> Column:
    """Minutes of a day: flat, then up to one and a half times in the last fortnight, in steps of five; no exam: flat."""
    ramped = F.floor(base * (1 + (RAMP_DAYS - days_out) / RAMP_DAYS * (RAMP_MOST - 1)) / 5 + 0.5) * 5
    return F.when((days_out > 0) & (days_out <= RAMP_DAYS), ramped).otherwise(base).cast("long")


def session_queue(chapters: DataFrame, by: list[str], weight: str, subject: str, chapter: str, minutes: Column, pulls: Column | None = None) -> DataFrame:
    """chapters with sessions (their share of the minutes in quizzes, one at least) and place: subjects take turns, heaviest chapters first.

    A chapter's place in its subject, over the chapters that the subject gives in a turn (pulls, one by default), is its turn; within a turn subjects go
    by their heaviest chapter. Ties end in the chapter's name.
    """
    live = chapters.where(F.col(weight) > 0)
    total = half_up(F.sum(weight).over(Window.partitionBy(*by)), 6)
    order = [F.desc(weight), F.col(chapter)]
    first = F.min(F.struct((-F.col(weight)).alias("w"), F.col(chapter).alias("c"))).over(Window.partitionBy(*by, subject))
    turns = live.withColumn("__n", F.row_number().over(Window.partitionBy(*by, subject).orderBy(*order))).withColumn("__first", first)
    turn = F.ceil(F.col("__n") / (F.lit(1) if pulls is None else pulls))
    placed = turns.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(turn, "__first", "__n", chapter)))
    share = F.col(weight) / total * minutes / MINUTES["quiz"]
    return placed.withColumn("sessions", F.greatest(F.lit(1), F.floor(share + 0.5)).cast("int")).drop("__n", "__first")


@dataclass
class Day:
    capacity: int
    out: int | None
    used: int = 0
    chapters: set[str] = field(default_factory=set)

    def activity(self, due: int, attempts: int) -> str:
        if due > 0:
            return "flashcards"
        drill = attempts >= EVIDENCE and self.out is not None and 0 < self.out <= DRILL_DAYS
        return "exam_drill" if drill else "quiz"

    def holds(self, chapter: str, minutes: int, reserve: int = 0) -> bool:
        crowded = chapter not in self.chapters and len(self.chapters) >= CHAPTERS_A_DAY
        return not crowded and self.used + minutes <= self.capacity - reserve

    def add(self, chapter: str, minutes: int) -> None:
        self.used += minutes
        self.chapters.add(chapter)


def lay_out(sessions: Iterable[tuple[str, int, int]], days: list[Day]) -> Iterator[tuple[int, str, str, int]]:
    """(day, chapter, activity, minutes) for sessions (chapter, due cards, attempts) in order; a day that is full closes for good.

    A day keeps room for the reviews that it owes to chapters first met three days before; a review is left out where it does not fit.
    """
    met: dict[str, int] = {}
    owed: Counter[int] = Counter()
    at = 0
    for chapter, due, attempts in sessions:
        if at >= len(days):
            break
        reserve = min(owed[at], CHAPTERS_A_DAY) * MINUTES["review"]
        if not days[at].holds(chapter, MINUTES[days[at].activity(due, attempts)], reserve):
            at += 1
            if at == len(days):
                break
        kind = days[at].activity(due, attempts)
        days[at].add(chapter, MINUTES[kind])
        yield at, chapter, kind, MINUTES[kind]
        if chapter not in met:
            met[chapter] = at
            owed[at + REVIEW_GAP] += 1
    for chapter, first in met.items():
        later = first + REVIEW_GAP
        if later < len(days) and days[later].holds(chapter, MINUTES["review"]):
            days[later].add(chapter, MINUTES["review"])
            yield later, chapter, "review", MINUTES["review"]


def plans(queue: DataFrame, user: str, chapter: str, open_days: list[tuple[int, int, int | None]]) -> DataFrame:
    """user, day, seq, chapter, activity, minutes. queue: session_queue plus due and attempts; open_days: (day of the horizon, minutes, days to the exam).

    One learner's queue is at most a few sessions for each chapter, so a group is small whatever the number of learners.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        slots = [(k, p, c, d, a) for p, c, n, d, a in zip(rows["place"], rows[chapter], rows["sessions"], rows["due"], rows["attempts"], strict=True) for k in range(n)]
        order = [(c, int(d), int(a)) for _, _, c, d, a in sorted(slots)]
        laid = sorted(lay_out(order, [Day(m, out) for _, m, out in open_days]), key=lambda x: x[0])
        return pd.DataFrame([(rows[user].iloc[0], open_days[d][0], i, c, k, m) for i, (d, c, k, m) in enumerate(laid)], columns=[user, "day", "seq", chapter, "activity", "minutes"])

    return queue.groupBy(user).applyInPandas(build, f"{user} {queue.schema[user].dataType.simpleString()}, day int, seq int, {chapter} string, activity string, minutes int")


def pick_spread(pool: DataFrame, by: list[str], chapter: str, marks: str, order: list[Column], count: int, large: float = 5.0) -> DataFrame:
    """pool rows with pick (1 to count): first one of each chapter in order, then others in order, but no second large one of a chapter."""
    ranked = pool.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    w = Window.partitionBy(*by, chapter).orderBy("__at")
    heads = ranked.withColumn("__second", (F.row_number().over(w) > 1).cast("int")).withColumn("__big", F.sum(F.when(F.col(marks) >= large, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fits = heads.where((F.col(marks) < large) | (F.coalesce("__big", F.lit(0)) == 0))
    picked = fits.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy("__second", "__at")))
    return picked.where(F.col("pick") <= count).drop("__at", "__second", "__big")


def usable_scheme(scheme: Column, text: Column, longest: int = 200, echo: int = 60) -> Column:
    """Several criteria, or a single one of at most 200 characters that does not repeat the question's first 60."""
    only = F.trim(F.element_at(scheme, 1)["criterion"])
    opening = F.lower(F.left(F.trim(F.coalesce(text, F.lit(""))), F.lit(echo)))
    repeats = (F.length(opening) >= echo) & (F.lower(F.left(only, F.lit(echo))) == opening)
    return F.coalesce(F.when(F.size(scheme) > 1, True).when(F.size(scheme) == 1, (F.length(only) <= longest) & ~repeats), F.lit(False))


def tally(entries: DataFrame, by: list[str], status: str, got: str, most: str, ceiling: float = 20.0) -> DataFrame:
    """by, score, out_of (both at most 20), unmarked: entries that wait for a reviewer count on neither side."""
    waits = F.col(status) == "needs_human_review"
    total = lambda x: F.least(F.lit(ceiling), half_up(F.coalesce(F.sum(F.when(~waits, F.col(x))), F.lit(0.0)), 2))
    return entries.groupBy(*by).agg(total(got).alias("score"), total(most).alias("out_of"), F.count(F.when(waits, 1)).alias("unmarked"))
