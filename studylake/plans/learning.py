"""Queries of the learning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.functions.core import credit, half_up, recency
from studylake.operators import learning, relational, sequential
from studylake.registry import query
from studylake.sources.tables import as_of, attempts, table


@query("i03_mastery", """
WITH a AS (SELECT user_id, event_type AS chapter,
    CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'purchase' THEN 1.0 ELSE greatest(0.0, least(1.0, value / 500.0)) END AS c,
    exp(-greatest(0.0, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 1e6 / 86400.0) / 14.0) * 0.5 AS w
  FROM events)
SELECT user_id, chapter, floor(coalesce(sum(c * w) / sum(w), 0) * 1000.0 + 0.5) / 1000.0 AS mastery, count(*) AS attempts
FROM a GROUP BY user_id, chapter
""")
def i03_mastery(spark, sf_dir):
    return learning.mastery(attempts(spark, sf_dir), as_of(), ["user_id", "chapter"])


CREDIT = "CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'purchase' THEN 1.0 ELSE greatest(0.0, least(1.0, value / 500.0)) END"
WEIGHT = "exp(-greatest(0.0, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 1e6 / 86400.0) / 14.0)"
MASTERY = f"SELECT user_id, event_type AS chapter, floor(coalesce(sum({CREDIT} * {WEIGHT}) / sum({WEIGHT}), 0) * 1000.0 + 0.5) / 1000.0 AS mastery, count(*) AS attempts FROM events GROUP BY 1, 2"


def mastered(spark, sf_dir):
    return i03_mastery(spark, sf_dir)


@query("i01_credit", f"SELECT event_id, floor({CREDIT} * 1000000 + 0.5) / 1000000 AS credit FROM events")
def i01_credit(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", half_up(credit(F.col("is_correct"), F.col("score"), F.col("max_score")), 6).alias("credit"))


@query("i02_recency", f"SELECT event_id, floor({WEIGHT} * 1000000 + 0.5) / 1000000 AS weight FROM events")
def i02_recency(spark, sf_dir):
    return attempts(spark, sf_dir).select("event_id", half_up(recency(F.col("attempted_at"), as_of()), 6).alias("weight"))


@query("i04_weakest", f"SELECT user_id, chapter FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mastery, chapter) AS rn FROM ({MASTERY}) WHERE attempts >= 5) WHERE rn = 1")
def i04_weakest(spark, sf_dir):
    return relational.distinct_on(mastered(spark, sf_dir).where("attempts >= 5"), ["user_id"], [F.col("mastery"), F.col("chapter")]).select("user_id", "chapter")


@query("i06_weak_chapters", f"SELECT user_id, chapter, mastery FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mastery, chapter) AS rn FROM ({MASTERY}) WHERE attempts >= 5 AND mastery < 0.7) WHERE rn <= 5")
def i06_weak_chapters(spark, sf_dir):
    return relational.top_per_group(mastered(spark, sf_dir).where("attempts >= 5 and mastery < 0.7"), ["user_id"], [F.col("mastery"), F.col("chapter")], 5).select("user_id", "chapter", "mastery")


READINESS = f"""
WITH n AS ({MASTERY}), b AS ({MASTERY.replace('FROM events', "FROM events WHERE ts < TIMESTAMP '2024-01-04'").replace("2024-02-01", "2024-01-04")}),
x AS (SELECT n.user_id, avg(n.mastery) AS m, count(*) / 5.0 AS coverage, count(*) FILTER (n.attempts >= 5) / 5.0 AS deep, floor((avg(n.mastery) - avg(b.mastery)) * 1000000000 + 0.5) / 1000000000 AS delta, sum(n.attempts) AS attempts FROM n LEFT JOIN b USING (user_id, chapter) GROUP BY 1)
SELECT user_id, floor(floor((0.5 * m * coverage + 0.3 * deep + 0.2 * greatest(0.0, least(1.0, 0.5 + coalesce(delta, 0) / 0.2 * 0.5))) * 1000000000 + 0.5) / 1000000000 * 1000 + 0.5) / 1000 AS readiness,
  CASE WHEN coalesce(delta, 0) > 0.02 THEN 'up' WHEN coalesce(delta, 0) < -0.02 THEN 'down' ELSE 'flat' END AS trend, attempts >= 10 AS reportable FROM x"""


@query("i07_readiness", READINESS)
def i07_readiness(spark, sf_dir):
    before = F.lit("2024-01-04").cast("timestamp")
    old = learning.mastery(attempts(spark, sf_dir).where(F.col("attempted_at") < before), before, ["user_id", "chapter"])
    return learning.readiness(mastered(spark, sf_dir), old, "user_id", "chapter", 5)


@query("i13_marks", f"SELECT user_id, floor(avg(mastery) * 20 * 10 + 0.5) / 10 AS mark, CASE WHEN avg(mastery) >= 0.7 THEN 'good' WHEN avg(mastery) >= 0.5 THEN 'fair' ELSE 'weak' END AS band FROM ({MASTERY}) GROUP BY 1")
def i13_marks(spark, sf_dir):
    m = F.avg("mastery")
    return mastered(spark, sf_dir).groupBy("user_id").agg(half_up(m * 20, 1).alias("mark"), F.when(m >= 0.7, "good").when(m >= 0.5, "fair").otherwise("weak").alias("band"))


@query("i15_standing", f"SELECT chapter, floor(sum(mastery * attempts) / sum(attempts) * 1000 + 0.5) / 1000 AS standing FROM ({MASTERY}) GROUP BY 1")
def i15_standing(spark, sf_dir):
    return mastered(spark, sf_dir).groupBy("chapter").agg(half_up(F.sum(F.col("mastery") * F.col("attempts")) / F.sum("attempts"), 3).alias("standing"))


@query("i16_week", f"SELECT user_id, count(*) AS attempts, floor(avg({CREDIT}) * 1000 + 0.5) / 1000 AS accuracy FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1")
def i16_week(spark, sf_dir):
    recent = attempts(spark, sf_dir).where(F.col("attempted_at") >= F.date_sub(as_of(), 7).cast("timestamp"))
    return recent.groupBy("user_id").agg(F.count("*").alias("attempts"), half_up(F.avg(credit(F.col("is_correct"), F.col("score"), F.col("max_score"))), 3).alias("accuracy"))


@query("i18_recurring_losses", "SELECT l_suppkey AS criterion, count(*) AS times, floor(sum(l_quantity) * 100 + 0.5) / 100 AS points FROM lineitem WHERE l_quantity > 0 AND l_discount = 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY points DESC, times DESC, criterion LIMIT 5")
def i18_recurring_losses(spark, sf_dir):
    lost = table(spark, sf_dir, "lineitem").where("l_quantity > 0 and l_discount = 0").groupBy(F.col("l_suppkey").alias("criterion")).agg(F.count("*").alias("times"), half_up(F.sum("l_quantity"), 2).alias("points"))
    return lost.where("times >= 2").orderBy(F.desc("points"), F.desc("times"), "criterion").limit(5)


@query("i21_mark_gap", "SELECT c_custkey, CASE WHEN g IS NULL THEN NULL WHEN abs(g) < 2 THEN 'aligned' WHEN g < 0 THEN 'lower' ELSE 'higher' END AS verdict FROM (SELECT c_custkey, m / 10000 - c_acctbal / 500 AS g FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey)")
def i21_mark_gap(spark, sf_dir):
    mean = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    gap = table(spark, sf_dir, "customer").join(mean, "c_custkey", "left").withColumn("g", F.col("m") / 10000 - F.col("c_acctbal") / 500)
    return gap.select("c_custkey", F.when(F.col("g").isNull(), None).when(F.abs("g") < 2, "aligned").when(F.col("g") < 0, "lower").otherwise("higher").alias("verdict"))


@query("i24_repetition", """
WITH RECURSIVE a AS (SELECT user_id, event_type AS chapter, floor(value / 100)::DOUBLE AS q, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, chapter, 0::BIGINT AS i, 2.5::DOUBLE AS ease, 0::BIGINT AS interval_, 0::BIGINT AS repetitions FROM a WHERE i = 1
  UNION ALL SELECT r.user_id, r.chapter, a.i, greatest(1.3::DOUBLE, floor((r.ease + (0.1::DOUBLE - (5 - a.q) * (0.08::DOUBLE + (5 - a.q) * 0.02::DOUBLE))) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE),
    CASE WHEN a.q < 3 THEN 1 WHEN r.repetitions = 0 THEN 1 WHEN r.repetitions = 1 THEN 6 ELSE floor(r.interval_ * r.ease + 0.5)::BIGINT END, CASE WHEN a.q >= 3 THEN r.repetitions + 1 ELSE 0 END
  FROM r JOIN a ON a.user_id = r.user_id AND a.chapter = r.chapter AND a.i = r.i + 1)
SELECT user_id, chapter, ease, interval_ AS interval, repetitions FROM (SELECT *, row_number() OVER (PARTITION BY user_id, chapter ORDER BY i DESC) AS last FROM r) WHERE last = 1""")
def i24_repetition(spark, sf_dir):
    answers = attempts(spark, sf_dir).withColumn("quality", F.floor(F.col("score") / 100))
    return sequential.repetition_state(answers, ["user_id", "chapter"], "attempted_at", "event_id", "quality")


@query("i25_difficulty", "SELECT l_partkey, floor((1 - avg(l_discount * 10)) * 1000 + 0.5) / 1000 AS difficulty, least(1.0::DOUBLE, count(*) / 50::DOUBLE) AS confidence FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def i25_difficulty(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(half_up(1 - F.avg(F.col("l_discount") * 10), 3).alias("difficulty"), F.least(F.lit(1.0), n / 50).alias("confidence"), n.alias("n")).where("n >= 5").drop("n")


@query("i39_budget", "SELECT user_id, floor(sum(value) * 1000 + 0.5)::BIGINT AS spent, coalesce(CASE WHEN user_id % 10 = 0 THEN 0 END, 1000000) AS ceiling, floor(sum(value) * 1000 + 0.5)::BIGINT >= coalesce(CASE WHEN user_id % 10 = 0 THEN 0 END, 1000000) AS stopped FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1")
def i39_budget(spark, sf_dir):
    spent = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")).groupBy("user_id").agg(F.floor(F.sum("value") * 1000 + 0.5).cast("long").alias("spent"))
    return spent.withColumn("ceiling", F.coalesce(F.when(F.col("user_id") % 10 == 0, 0), F.lit(1_000_000))).withColumn("stopped", F.col("spent") >= F.col("ceiling"))


@query("i40_reminders", "SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-30' AND user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30')")
def i40_reminders(spark, sf_dir):
    e, day = table(spark, sf_dir, "events"), F.lit("2024-01-30").cast("timestamp_ntz")
    return e.where(F.col("ts") < day).select("user_id").distinct().join(e.where(F.col("ts") >= day), "user_id", "left_anti")


@query("i46_revealed", "SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size = 1")
def i46_revealed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item")).union(table(spark, sf_dir, "part").where("p_size = 1").select("p_partkey")).distinct()
