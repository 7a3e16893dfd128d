"""More queries of the study product: snapshots, cards, coverage, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.functions.core import half_up
from studylake.operators import relational as R
from studylake.operators import retrieval
from studylake.plans.learning import MASTERY, mastered
from studylake.plans.retrieval import RANKED
from studylake.registry import query
from studylake.sources.tables import table as t

c = F.col


def years(s, d):
    return t(s, d, "lineitem").join(t(s, d, "orders"), c("l_orderkey") == c("o_orderkey")).select("l_partkey", F.year("o_orderdate").alias("y")).distinct()


@query("i10_mastery_upsert", f"SELECT user_id, chapter, mastery FROM ({MASTERY}) UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 'view', 0.5::DOUBLE)) v")
def i10_mastery_upsert(s, d):
    """Old snapshot rows survive only where nothing was computed anew."""
    now = mastered(s, d).select("user_id", "chapter", "mastery")
    old = now.select("user_id", "chapter", F.lit(0.0).alias("mastery")).unionByName(s.createDataFrame([(-1, "view", 0.5)], "user_id long, chapter string, mastery double"))
    return R.latest_wins(old, now, ["user_id", "chapter"])


@query("i14_effort", "SELECT user_id, date_trunc('month', ts)::DATE AS month, count(DISTINCT ts::DATE) AS days, floor(count(DISTINCT event_type) / 5 * 1000 + 0.5) / 1000 AS coverage FROM events GROUP BY 1, 2")
def i14_effort(s, d):
    return t(s, d, "events").groupBy("user_id", F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.countDistinct(c("ts").cast("date")).alias("days"), half_up(F.countDistinct("event_type") / 5, 3).alias("coverage"))


@query("i17_activity", "SELECT day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day) LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) USING (day)")
def i17_activity(s, d):
    days = t(s, d, "events").groupBy(c("ts").cast("date").alias("day")).agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    return R.day_spine(days, ["g"], "day", "2024-01-01", "2024-01-30", ["n"]).select("day", "n")


@query("i20_exam_years", """
WITH y AS (SELECT DISTINCT l_partkey, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT l_partkey, count(*) AS years, count(*) FILTER (y > 1997) AS recent FROM y GROUP BY 1)
SELECT p_brand, p_partkey, years, recent FROM (SELECT p_brand, p_partkey, years, recent, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, recent DESC, p_partkey) AS rn FROM r JOIN part ON p_partkey = l_partkey WHERE recent > 0) WHERE rn <= 4""")
def i20_exam_years(s, d):
    seen = years(s, d).groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("years"), F.count(F.when(c("y") > 1997, 1)).alias("recent")).where("recent > 0")
    return R.top_per_group(seen.join(t(s, d, "part"), "p_partkey"), ["p_brand"], [c("p_size"), F.desc("recent"), c("p_partkey")], 4).select("p_brand", "p_partkey", "years", "recent")


@query("i22_due_by_chapter", "SELECT event_type AS chapter, count(*) AS due FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2) WHERE last <= TIMESTAMP '2024-01-20' GROUP BY 1")
def i22_due_by_chapter(s, d):
    last = t(s, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return last.where(c("last") <= F.lit("2024-01-20").cast("timestamp_ntz")).groupBy(c("event_type").alias("chapter")).agg(F.count("*").alias("due"))


@query("i23_deck", "SELECT user_id, count(*) AS total, count(*) FILTER (last <= TIMESTAMP '2024-01-20') AS due, min(last) FILTER (last > TIMESTAMP '2024-01-20')::DATE AS next_due FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2) GROUP BY 1")
def i23_deck(s, d):
    limit = F.lit("2024-01-20").cast("timestamp_ntz")
    last = t(s, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return last.groupBy("user_id").agg(F.count("*").alias("total"), F.count(F.when(c("last") <= limit, 1)).alias("due"), F.min(F.when(c("last") > limit, c("last"))).cast("date").alias("next_due"))


@query("i26_unseen_first", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY seen, doc_id) AS rn FROM (SELECT source, min(doc_id) AS doc_id, max((doc_id IN (SELECT doc_id FROM labels))::INT) AS seen FROM documents GROUP BY source, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))) WHERE rn <= 5")
def i26_unseen_first(s, d):
    """One of each text, those not seen before first, then topped up with seen ones."""
    seen = t(s, d, "labels").select("doc_id", F.lit(1).alias("s")).distinct()
    items = t(s, d, "documents").join(seen, "doc_id", "left").groupBy("source", F.sha2(F.regexp_replace("text", "\\s+", ""), 256)).agg(F.min("doc_id").alias("doc_id"), F.max(F.coalesce("s", F.lit(0))).alias("seen"))
    return R.top_per_group(items, ["source"], [c("seen"), c("doc_id")], 5).select("source", "doc_id")


@query("i38_cycle_choice", """
WITH x AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, bool_and(o_totalprice > 0) AS usable, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT median(n) AS m FROM x WHERE usable)
SELECT p, y, n FROM (SELECT p, y, n, row_number() OVER (PARTITION BY p ORDER BY abs(n - m), y DESC) AS rn FROM x, m WHERE usable) WHERE rn = 1""")
def i38_cycle_choice(s, d):
    x = t(s, d, "orders").groupBy(F.year("o_orderdate").alias("y"), c("o_orderpriority").alias("p")).agg(F.every(c("o_totalprice") > 0).alias("usable"), F.count("*").alias("n")).where("usable")
    both = x.crossJoin(F.broadcast(x.agg(F.median("n").alias("m"))))  # one row
    return R.distinct_on(both, ["p"], [F.abs(c("n") - c("m")), F.desc("y")]).select("p", "y", "n")


@query("i44_subject_hub", """
SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS in_debt,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS orders FROM nation""")
def i44_subject_hub(s, d):
    """Each count is one grouped pass; the small results meet at the subject."""
    customer = t(s, d, "customer")
    per = t(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    a = customer.join(per, "c_custkey", "left").groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.count(F.when(c("c_acctbal") < 0, 1)).alias("in_debt"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"))
    b = t(s, d, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return t(s, d, "nation").join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").select("n_nationkey", "n_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "in_debt", "suppliers", "orders")])


@query("i45_coverage", "SELECT count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')) AS covered, count(*) AS chapters FROM part")
def i45_coverage(s, d):
    used = t(s, d, "lineitem").where("l_returnflag = 'R'").select(c("l_partkey").alias("p_partkey")).distinct().withColumn("u", F.lit(1))
    return t(s, d, "part").join(used, "p_partkey", "left").agg(F.count("u").alias("covered"), F.count("*").alias("chapters"))


@query("h08_knn_with_scheme", f"SELECT probe_id, vec_id, sim FROM (SELECT probe_id, vec_id, sim, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, vec_id) AS rn FROM ({RANKED}) WHERE vec_id % 2 = 0) WHERE rn <= 3")
def h08_knn_with_scheme(s, d):
    """Only rows that have a scheme (here: even ids) are candidates."""
    e = t(s, d, "embeddings")
    return retrieval.knn(e, e.where("vec_id % 2 = 0"), ["label"], 3).select("probe_id", "vec_id", "sim")


@query("h20_hand_over", f"SELECT probe_id, vec_id FROM ({RANKED}) WHERE rn <= CASE WHEN label < 5 THEN 12 ELSE 20 END")
def h20_hand_over(s, d):
    """Twelve passages for questions of the first five labels, twenty for others."""
    e = t(s, d, "embeddings")
    near = retrieval.knn(e, e, ["label"], 20).join(e.select(c("vec_id").alias("probe_id"), "label"), "probe_id")
    return near.where(c("rn") <= F.when(c("label") < 5, 12).otherwise(20)).select("probe_id", "vec_id")


@query("h23_apply_order", "SELECT label, row_number() OVER (PARTITION BY label ORDER BY coalesce(list_position([9, 3, 7], vec_id % 10), 99), vec_id) AS place, vec_id FROM embeddings")
def h23_apply_order(s, d):
    """Rows that the given order names come first, in its order; the others follow as they were."""
    place = F.array_position(F.array(F.lit(9), F.lit(3), F.lit(7)).cast("array<bigint>"), c("vec_id") % 10)
    rows = t(s, d, "embeddings").select("label", "vec_id", F.when(place > 0, place).otherwise(99).alias("at"))
    return R.row_numbers(rows, ["label"], ["at", "vec_id"], "place").select("label", "place", "vec_id")
