"""Queries of plans, papers, reports and what a learner does next."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.functions.core import half_up
from studylake.operators import planning as P
from studylake.operators import relational as R
from studylake.operators import sequential
from studylake.plans.learning import MASTERY, READINESS, i07_readiness, mastered
from studylake.registry import query
from studylake.sources.tables import table as t

c = F.col
SUBJECT_SQL = "CASE WHEN chapter IN ('click', 'view') THEN 'web' ELSE 'shop' END"
WEIGHTS = f"SELECT *, {SUBJECT_SQL} AS subject, CASE WHEN mastery >= 0.7 THEN 0.0 ELSE greatest(0.0, 1 - mastery) * CASE WHEN attempts >= 5 THEN 1.0 ELSE 0.5 END END AS weight FROM ({MASTERY})"
QUEUE = f"""SELECT user_id, chapter, row_number() OVER (PARTITION BY user_id ORDER BY turn, lead, first, chapter) AS place, greatest(1, floor(weight / total * 1440 / 30 + 0.5))::INT AS sessions FROM (
  SELECT *, floor(sum(weight) OVER (PARTITION BY user_id) * 1000000 + 0.5) / 1000000 AS total, row_number() OVER w AS turn, first_value(-weight) OVER w AS lead, first_value(chapter) OVER w AS first
  FROM ({WEIGHTS}) WHERE weight > 0 WINDOW w AS (PARTITION BY user_id, subject ORDER BY weight DESC, chapter))"""


def subject():
    return F.when(c("chapter").isin("click", "view"), "web").otherwise("shop")


def weighted(s, d):
    return mastered(s, d).withColumn("subject", subject()).withColumn("weight", P.chapter_weight(c("mastery"), c("attempts")))


def queue(s, d, minutes):
    return P.session_queue(weighted(s, d), ["user_id"], "weight", "subject", "chapter", F.lit(minutes))


@query("i05_ranking", f"SELECT user_id, chapter, row_number() OVER (PARTITION BY user_id ORDER BY mastery, chapter) AS weak, row_number() OVER (PARTITION BY user_id ORDER BY mastery DESC, chapter) AS strong FROM ({MASTERY})")
def i05_ranking(s, d):
    rank = lambda *o: F.row_number().over(Window.partitionBy("user_id").orderBy(*o)).cast("long")
    return mastered(s, d).select("user_id", "chapter", rank("mastery", "chapter").alias("weak"), rank(F.desc("mastery"), "chapter").alias("strong"))


EARLIER = MASTERY.replace("FROM events", "FROM events WHERE ts < TIMESTAMP '2024-01-04'").replace("2024-02-01", "2024-01-04")


def earlier(s, d):
    """Mastery as it was 28 days before."""
    from studylake.operators import learning
    from studylake.sources.tables import attempts

    then = F.lit("2024-01-04").cast("timestamp")
    return learning.mastery(attempts(s, d).where(c("attempted_at") < then), then, ["user_id", "chapter"])


@query("i08_trend", f"SELECT user_id, chapter, CASE WHEN o.mastery IS NULL THEN 'flat' WHEN floor((n.mastery - o.mastery) * 1000 + 0.5) > 20 THEN 'up' WHEN floor((n.mastery - o.mastery) * 1000 + 0.5) < -20 THEN 'down' ELSE 'flat' END AS trend FROM ({MASTERY}) n LEFT JOIN ({EARLIER}) o USING (user_id, chapter)")
def i08_trend(s, d):
    delta = F.floor((c("mastery") - c("old")) * 1000 + 0.5)
    both = mastered(s, d).join(earlier(s, d).select("user_id", "chapter", c("mastery").alias("old")), ["user_id", "chapter"], "left")
    return both.select("user_id", "chapter", F.when(delta > 20, "up").when(delta < -20, "down").otherwise("flat").alias("trend"))


@query("i09_subject_progress", f"SELECT user_id, {SUBJECT_SQL} AS subject, floor(avg(n.mastery) * 1000 + 0.5) / 1000 AS mastery, floor(avg(o.mastery) * 1000 + 0.5) / 1000 AS before, sum(n.attempts)::BIGINT AS attempts FROM ({MASTERY}) n LEFT JOIN ({EARLIER}) o USING (user_id, chapter) GROUP BY 1, 2")
def i09_subject_progress(s, d):
    both = mastered(s, d).join(earlier(s, d).select("user_id", "chapter", c("mastery").alias("old")), ["user_id", "chapter"], "left")
    return both.groupBy("user_id", subject().alias("subject")).agg(half_up(F.avg("mastery"), 3).alias("mastery"), half_up(F.avg("old"), 3).alias("before"), F.sum("attempts").alias("attempts"))


@query("i11_credit_chapter", """
SELECT l_orderkey, CASE WHEN bool_or(l_partkey = l_orderkey % 200 + 1) THEN l_orderkey % 200 + 1 WHEN bool_or(l_partkey = l_orderkey % 37 + 1) THEN l_orderkey % 37 + 1 ELSE min(l_partkey) END AS chapter FROM lineitem GROUP BY 1""")
def i11_credit_chapter(s, d):
    """The claimed chapter if the item is in it, else its home, else the first of those it is in."""
    claimed, home = c("l_orderkey") % 200 + 1, c("l_orderkey") % 37 + 1
    among = lambda x: F.bool_or(c("l_partkey") == x)
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.when(among(claimed), claimed).when(among(home), home).otherwise(F.min("l_partkey")).alias("chapter"))


STORED = "SELECT c_custkey AS user_id, DATE '2024-01-01' AS day, 0.5::DOUBLE AS readiness FROM customer WHERE c_custkey <= 40"


@query("i12_snapshot_batch", f"WITH fresh AS (SELECT user_id, DATE '2024-02-01' AS day, readiness FROM ({READINESS}) WHERE reportable) SELECT * FROM fresh UNION ALL SELECT * FROM ({STORED}) WHERE user_id NOT IN (SELECT user_id FROM fresh)")
def i12_snapshot_batch(s, d):
    """Readiness of all learners in one grouped job, over the stored snapshot: reportable ones replace theirs, others stay."""
    fresh = i07_readiness(s, d).where("reportable").select("user_id", F.lit("2024-02-01").cast("date").alias("day"), "readiness")
    stored = t(s, d, "customer").where("c_custkey <= 40").select(c("c_custkey").alias("user_id"), F.lit("2024-01-01").cast("date").alias("day"), F.lit(0.5).alias("readiness"))
    return R.latest_wins(stored, fresh, ["user_id"])


@query("i19_repeated_criteria", "SELECT user_id, event_type AS criterion, count(*) AS times FROM events WHERE value < 100 AND event_type IN ('click', 'error') GROUP BY 1, 2 HAVING count(*) >= 2")
def i19_repeated_criteria(s, d):
    wanted = s.createDataFrame([("click",), ("error",)], "criterion string")
    lost = t(s, d, "events").where("value < 100").groupBy("user_id", c("event_type").alias("criterion")).agg(F.count("*").alias("times")).where("times >= 2")
    return lost.join(wanted, "criterion", "left_semi").select("user_id", "criterion", "times")


@query("i27_next_up", f"""
WITH due AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2) WHERE last <= TIMESTAMP '2024-01-05' GROUP BY 1),
weak AS (SELECT user_id, min_by(chapter, mastery * 1000 + CASE chapter WHEN 'click' THEN 0.0 WHEN 'error' THEN 0.1 WHEN 'purchase' THEN 0.2 WHEN 'signup' THEN 0.3 ELSE 0.4 END) AS chapter FROM ({MASTERY}) WHERE attempts >= 5 GROUP BY 1),
sat AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT user_id, CASE WHEN n > 0 THEN 'flashcards' WHEN chapter IS NOT NULL THEN 'weakChapter' WHEN sat.user_id IS NULL THEN 'examSim' ELSE 'anything' END AS kind, CASE WHEN n > 0 THEN NULL ELSE chapter END AS chapter
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN due USING (user_id) LEFT JOIN weak USING (user_id) LEFT JOIN sat USING (user_id)""")
def i27_next_up(s, d):
    """Due cards, else the weakest chapter with evidence, else a paper if none was sat, else anything."""
    e = t(s, d, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    due = last.groupBy("user_id").agg(F.count(F.when(c("last") <= F.lit("2024-01-05").cast("timestamp_ntz"), 1)).alias("n"), F.bool_or(c("event_type") == "purchase").alias("sat"))
    weak = mastered(s, d).where("attempts >= 5").groupBy("user_id").agg(F.min(F.struct("mastery", "chapter"))["chapter"].alias("w"))
    kind = F.when(c("n") > 0, "flashcards").when(c("w").isNotNull(), "weakChapter").when(~c("sat"), "examSim").otherwise("anything")
    return due.join(weak, "user_id", "left").select("user_id", kind.alias("kind"), F.when(c("n") == 0, c("w")).alias("chapter"))


@query("i28_planner_weight", f"SELECT user_id, chapter, weight FROM ({WEIGHTS})")
def i28_planner_weight(s, d):
    return weighted(s, d).select("user_id", "chapter", "weight")


@query("i29_capacity", "SELECT o_orderkey, CASE WHEN x > 0 AND x <= 14 THEN floor(120 * (1 + (14 - x) / 14 * 0.5) / 5 + 0.5)::BIGINT * 5 ELSE 120 END AS minutes FROM (SELECT o_orderkey, (o_orderkey % 20)::DOUBLE AS x FROM orders)")
def i29_capacity(s, d):
    return t(s, d, "orders").select("o_orderkey", P.daily_capacity(c("o_orderkey") % 20, F.lit(120)).alias("minutes"))


@query("i30_session_queue", QUEUE)
def i30_session_queue(s, d):
    return queue(s, d, 1440).select("user_id", "chapter", c("place").cast("long").alias("place"), "sessions")


@query("i30_study_plan")
def i30_study_plan(s, d):
    """A plan of each learner to an exam on 16 February, Sundays off; a fold over days, tested by its rules."""
    days = s.range(15).select(c("id").cast("int").alias("day"), (15 - c("id")).cast("int").alias("out")).where("(day + 4) % 7 <> 0")  # 1 February is a Thursday
    open_days = [tuple(r) for r in days.select("day", P.daily_capacity(c("out"), F.lit(P.DAILY_MINUTES)).cast("int"), "out").orderBy("day").collect()]
    total = sum(m for _, m, _ in open_days)
    late = t(s, d, "events").groupBy("user_id", c("event_type").alias("chapter")).agg(F.when(F.max("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"), 1).otherwise(0).alias("due"))
    return P.plans(queue(s, d, total).join(late, ["user_id", "chapter"]), "user_id", "chapter", open_days)


# Fixed values of the older plan: days, sessions a day, last days that consolidate, minutes of new, consolidating and card sessions.
DAYS, A_DAY, TAIL = 14, 2, 3
MINUTES = {"weak": 60, "uncovered": 60, "consolidate": 45, "flashcards": 20}
#: Days with cards due and days with a session of the learner's own, by learner.
CARDS, BUSY = "(user_id + day) % 5 = 0", "(user_id * 3 + day) % 7 = 0"


@query("i31_older_plan", f"""
WITH c AS (SELECT u.user_id, e.chapter, coalesce(m.attempts, 0) AS attempts, CASE WHEN coalesce(m.attempts, 0) = 0 THEN 1.5 ELSE (1 - mastery) * (0.5 + 0.5 * least(1.0, attempts / 5.0)) END AS p
  FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type AS chapter FROM events) e LEFT JOIN ({MASTERY}) m ON m.user_id = u.user_id AND m.chapter = e.chapter),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, chapter) AS place, count(*) OVER (PARTITION BY user_id) AS size,
  greatest(1, floor(p / (floor(sum(p) OVER (PARTITION BY user_id) * 1000000 + 0.5) / 1000000) * {DAYS * A_DAY} + 0.5))::INT AS slots FROM c),
q AS (SELECT user_id, chapter, attempts, row_number() OVER (PARTITION BY user_id ORDER BY k, place) AS number FROM n, generate_series(1, {DAYS * A_DAY}) g(k) WHERE k <= slots),
d AS (SELECT user_id, size, day, {CARDS} AS cards, {A_DAY} - ({CARDS})::INT - ({BUSY})::INT AS free FROM (SELECT DISTINCT user_id, size FROM n), (SELECT unnest(range(0, {DAYS})) AS day)),
w AS (SELECT user_id, day, slot, row_number() OVER (PARTITION BY user_id ORDER BY day, slot) AS number FROM d, (SELECT unnest(range(0, {A_DAY})) AS slot) WHERE slot < free AND day < {DAYS - TAIL})
SELECT w.user_id, w.day, w.slot, q.chapter, CASE WHEN q.attempts = 0 THEN 'uncovered' ELSE 'weak' END AS rationale, {MINUTES['weak']} AS minutes FROM w JOIN q USING (user_id, number)
UNION ALL SELECT d.user_id, day, slot, chapter, 'consolidate', {MINUTES['consolidate']} FROM d, (SELECT unnest(range(0, {A_DAY})) AS slot), n WHERE slot < free AND day >= {DAYS - TAIL} AND n.user_id = d.user_id AND place = d.size - (day + slot) % d.size
UNION ALL SELECT user_id, day, -1, NULL, 'flashcards', {MINUTES['flashcards']} FROM d WHERE cards""")
def i31_older_plan(s, d):
    """Two sessions a day, fewer where cards are due or the learner has a session: chapters take turns, as often as their priority gives; the last days go
    back over the strongest."""
    events = t(s, d, "events")
    chapters = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # the few chapters
    every = events.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, chapters))).alias("chapter"))
    known = every.join(mastered(s, d), ["user_id", "chapter"], "left").select("user_id", "chapter", F.coalesce("attempts", F.lit(0)).alias("attempts"), "mastery")
    p = known.withColumn("p", F.when(c("attempts") == 0, 1.5).otherwise((1 - c("mastery")) * (0.5 + 0.5 * F.least(F.lit(1.0), c("attempts") / 5.0))))
    own = Window.partitionBy("user_id")
    slots = F.greatest(F.lit(1), F.floor(c("p") / half_up(F.sum("p").over(own), 6) * (DAYS * A_DAY) + 0.5)).cast("int")
    n = p.withColumn("slots", F.least(F.lit(DAYS * A_DAY), slots)).withColumn("place", F.row_number().over(own.orderBy(F.desc("p"), "chapter"))).withColumn("size", F.count("*").over(own))
    queue = n.withColumn("k", F.explode(F.sequence(F.lit(1), "slots"))).withColumn("number", F.row_number().over(own.orderBy("k", "place"))).select("user_id", "number", "chapter", "attempts")
    days = n.select("user_id", "size").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))))
    days = days.withColumn("cards", F.expr(CARDS)).withColumn("free", A_DAY - c("cards").cast("int") - F.expr(BUSY).cast("int"))
    free = days.where("free > 0").withColumn("slot", F.explode(F.sequence(F.lit(0), c("free") - 1)))
    work = free.where(c("day") < DAYS - TAIL).withColumn("number", F.row_number().over(own.orderBy("day", "slot"))).join(queue, ["user_id", "number"])
    tail = free.where(c("day") >= DAYS - TAIL).withColumn("place", (c("size") - (c("day") + c("slot")) % c("size")).cast("int")).join(n.select("user_id", "place", "chapter"), ["user_id", "place"])
    cards = days.where("cards").withColumn("slot", F.lit(-1)).withColumn("chapter", F.lit(None).cast("string"))
    row = lambda df, why: df.select("user_id", "day", "slot", "chapter", why.alias("rationale"))
    plan = row(work, F.when(c("attempts") == 0, "uncovered").otherwise("weak")).unionByName(row(tail, F.lit("consolidate"))).unionByName(row(cards, F.lit("flashcards")))
    minutes = F.create_map(*[F.lit(x) for pair in MINUTES.items() for x in pair])
    return plan.withColumn("minutes", minutes[c("rationale")])


@query("i32_reconciled", "SELECT s.event_id AS session_id, count(a.event_id) AS answers, count(a.event_id) > 0 AS done FROM events s LEFT JOIN events a ON s.user_id = a.user_id AND a.event_type = 'purchase' AND a.ts >= s.ts AND a.ts < s.ts + INTERVAL 48 HOUR WHERE s.event_type = 'signup' GROUP BY 1")
def i32_reconciled(s, d):
    e = t(s, d, "events")
    sessions = e.where("event_type = 'signup'").select("user_id", c("event_id").alias("session_id"), c("ts").alias("start"))
    n = R.within(sessions, e.where("event_type = 'purchase'").select("user_id", "ts"), ["user_id"], "start", "ts", 48).groupBy("session_id").agg(F.count("*").alias("k"))
    return sessions.join(n, "session_id", "left").select("session_id", F.coalesce("k", F.lit(0)).alias("answers"), c("k").isNotNull().alias("done"))


@query("i33_paper_assembly")
def i33_paper_assembly(s, d):
    """A paper of exactly 20 marks for each size of part; a search, so its test is the exact sum."""
    return sequential.papers(t(s, d, "part").select("p_size", "p_partkey", "p_brand", (c("p_partkey") % 13 * 0.5 + 1).alias("marks")), "p_size", "p_partkey", "marks", "p_brand")


@query("i34_spread", """
WITH RECURSIVE p AS (SELECT p_size, p_partkey, p_brand, p_partkey % 13 * 0.5 + 1 AS m FROM part),
x AS (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS k, count(*) FILTER (m >= 5) OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS big FROM p)
SELECT p_size, p_partkey, pick FROM (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY (k > 1)::INT, p_partkey)::INT AS pick FROM x WHERE m < 5 OR coalesce(big, 0) = 0) WHERE pick <= 5""")
def i34_spread(s, d):
    pool = t(s, d, "part").select("p_size", "p_partkey", "p_brand", (c("p_partkey") % 13 * 0.5 + 1).alias("marks"))
    return P.pick_spread(pool, ["p_size"], "p_brand", "marks", [c("p_partkey")], 5).select("p_size", "p_partkey", "pick")


@query("i35_tally", "SELECT l_orderkey, least(20.0, floor(coalesce(sum(l_quantity * (1 - l_discount)) FILTER (l_returnflag <> 'R'), 0) * 100 + 0.5) / 100) AS score, least(20.0, floor(coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) * 100 + 0.5) / 100) AS out_of, count(*) FILTER (l_returnflag = 'R') AS unmarked FROM lineitem GROUP BY 1")
def i35_tally(s, d):
    rows = t(s, d, "lineitem").select("l_orderkey", F.when(c("l_returnflag") == "R", "needs_human_review").otherwise("graded").alias("status"), (c("l_quantity") * (1 - c("l_discount"))).alias("got"), c("l_quantity").alias("most"))
    return P.tally(rows, ["l_orderkey"], "status", "got", "most")


@query("i36_rescaled_marks")
def i36_rescaled_marks(s, d):
    """Marks of each order's lines, rescaled to sum to 20 in steps of a half; a loop over one paper, tested by its sum."""
    lines = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))["l_quantity"].alias("marks"))
    scaled = F.pandas_udf(lambda x: x.map(lambda m: sequential.rescale_marks([float(v) for v in m], 20.0)), "array<double>")
    return lines.select("l_orderkey", scaled("marks").alias("marks"))


@query("i37_all_or_nothing", "SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS points FROM lineitem GROUP BY 1")
def i37_all_or_nothing(s, d):
    """A criterion's marks in full if it is met; one without a verdict is not."""
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(c("l_linestatus") == "F", c("l_quantity")).otherwise(0.0)).alias("points"))


@query("i41_real_paper", "SELECT y, p, count(*) AS items, least(20.0, floor(sum(o_totalprice) / 100000 * 100 + 0.5) / 100) AS max_score, min(o_orderkey) AS first_item FROM (SELECT year(o_orderdate) AS y, o_orderpriority AS p, * FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1, 2")
def i41_real_paper(s, d):
    """All live items of an edition, the total at most 20."""
    live = t(s, d, "orders").where("o_orderstatus <> 'P'").groupBy(F.year("o_orderdate").alias("y"), c("o_orderpriority").alias("p"))
    return live.agg(F.count("*").alias("items"), F.least(F.lit(20.0), half_up(F.sum("o_totalprice") / 100000, 2)).alias("max_score"), F.min("o_orderkey").alias("first_item"))


@query("i42_references", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS verified, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey) AS rn, max((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey) AS any_ FROM orders)
SELECT o_custkey, o_orderkey, verified FROM r WHERE (verified OR any_ = 0) AND rn <= 3""")
def i42_references(s, d):
    """The newest three verified ones; a chapter without any falls back to the newest three of the others."""
    r = t(s, d, "orders").withColumn("verified", c("o_orderstatus") == "F")
    best = R.top_per_group(r, ["o_custkey", "verified"], [F.desc("o_orderdate"), c("o_orderkey")], 3)
    return best.withColumn("any", F.max("verified").over(Window.partitionBy("o_custkey"))).where("verified or not any").select("o_custkey", "o_orderkey", "verified")


@query("i43_scheme_usable", "SELECT l_orderkey, count(*) AS criteria, count(*) > 1 OR max(l_quantity) <= 25 AS usable FROM lineitem GROUP BY 1")
def i43_scheme_usable(s, d):
    """Criteria as texts whose length is eight letters a mark: single ones of over 200 letters are not usable."""
    scheme = F.transform(F.array_sort(F.collect_list("l_quantity")), lambda q: F.struct(F.repeat(F.lit("abcdefgh"), q.cast("int")).alias("criterion")))
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(scheme.alias("x")).select("l_orderkey", F.size("x").cast("long").alias("criteria"), P.usable_scheme(c("x"), F.lit(None).cast("string")).alias("usable"))


@query("i47_listed_subjects", "SELECT p_brand, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag <> 'R')) AS live FROM part WHERE p_size > 10 GROUP BY 1")
def i47_listed_subjects(s, d):
    live = t(s, d, "lineitem").where("l_returnflag <> 'R'").select(c("l_partkey").alias("p_partkey")).distinct().withColumn("k", F.lit(1))
    return t(s, d, "part").where("p_size > 10").join(live, "p_partkey", "left").groupBy("p_brand").agg(F.count("k").alias("live"))
