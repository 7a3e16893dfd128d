"""Relational queries: filters, joins, aggregates, windows, sets, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.functions.core import half_up, mean
from studylake.operators import relational as R
from studylake.registry import query
from studylake.sources.tables import table as t

c = F.col


def simple(name, sql, build):
    """A query of one expression."""
    query(name, sql)(build)


# ---- scans and filters
simple("a01_projection", "SELECT o_orderkey, o_totalprice FROM orders", lambda s, d: t(s, d, "orders").select("o_orderkey", "o_totalprice"))
simple("a02_point_lookup", "SELECT * FROM customer WHERE c_custkey = 42", lambda s, d: t(s, d, "customer").where("c_custkey = 42").limit(1))
simple("a14_inline_values", "SELECT n_nationkey, tag FROM nation JOIN (VALUES (1, 'x'), (3, 'y'), (99, 'z')) v(k, tag) ON n_nationkey = k", lambda s, d: t(s, d, "nation").join(F.broadcast(s.createDataFrame([(1, "x"), (3, "y"), (99, "z")], "n_nationkey int, tag string")), "n_nationkey").select("n_nationkey", "tag"))
simple("b01_not_equal", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 100000", lambda s, d: t(s, d, "orders").where((c("o_orderstatus") != "F") & (c("o_totalprice") > 100000)).select("o_orderkey"))
simple("b02_scope_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)", lambda s, d: t(s, d, "part").where(R.in_list(c("p_size"), [1, 5, 9])).select("p_partkey"))
simple("b02_empty_scope", "SELECT p_partkey FROM part WHERE false", lambda s, d: t(s, d, "part").where(R.in_list(c("p_size"), [])).select("p_partkey"))
simple("b03_any_array", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = ANY(['A', 'R'])", lambda s, d: t(s, d, "lineitem").where(c("l_returnflag").isin("A", "R")).agg(F.count("*").alias("n")))
simple("b05_or_across_relations", "SELECT s_suppkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000 OR n_regionkey = 1", lambda s, d: t(s, d, "supplier").join(F.broadcast(t(s, d, "nation")), c("s_nationkey") == c("n_nationkey"), "left").where((c("s_acctbal") > 9000) | (c("n_regionkey") == 1)).select("s_suppkey"))
simple("b06_some", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", lambda s, d: t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey"))
simple("b06_none", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda s, d: t(s, d, "customer").join(t(s, d, "orders"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey"))
simple("b07_not_contains", "SELECT p_partkey FROM part WHERE NOT contains(p_name, 'a')", lambda s, d: t(s, d, "part").where(~c("p_name").contains("a")).select("p_partkey"))
simple("b08_case_insensitive", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%'", lambda s, d: t(s, d, "customer").where(c("c_mktsegment").ilike("%build%")).select("c_custkey"))
simple("b10_patterns", "SELECT doc_id, text LIKE '%the %' AS has_the, regexp_matches(text, '[0-9]{4}') AS digits, NOT regexp_matches(text, '(?i)LICENSE') AS no_license FROM documents", lambda s, d: t(s, d, "documents").select("doc_id", c("text").like("%the %").alias("has_the"), c("text").rlike("[0-9]{4}").alias("digits"), (~c("text").rlike("(?i)LICENSE")).alias("no_license")))
simple("b11_between_length", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 200 AND 2000", lambda s, d: t(s, d, "documents").where(F.length("text").between(200, 2000)).select("doc_id"))
simple("b12_distinct_from", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1", lambda s, d: t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left").where(~c("quality").eqNullSafe(1)).select("doc_id"))
simple("b13_time_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'", lambda s, d: t(s, d, "events").where((c("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (c("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id"))
simple("b14_case_guard", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS paid FROM events", lambda s, d: t(s, d, "events").select("event_id", F.when(c("event_type") == "purchase", c("value")).otherwise(0.0).alias("paid")))
simple("b15_boolean_projection", "SELECT d.doc_id, l.quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)", lambda s, d: t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left").select("doc_id", c("quality").isNotNull().alias("labelled")))
simple("b16_own_edition_else_all", "SELECT doc_id FROM (SELECT doc_id, lang = 'fr' AS mine, max(lang = 'fr') OVER (PARTITION BY source) AS any_mine FROM documents) WHERE mine OR NOT any_mine", lambda s, d: t(s, d, "documents").select("doc_id", (c("lang") == "fr").alias("mine"), F.max(c("lang") == "fr").over(Window.partitionBy("source")).alias("any_mine")).where("mine or not any_mine").select("doc_id"))
simple("b18_constraints", "SELECT l_orderkey, rule FROM (SELECT l_orderkey, unnest(list_filter([CASE WHEN NOT l_quantity BETWEEN 1 AND 49 THEN 'quantity' END, CASE WHEN NOT ((l_returnflag = 'N') <> (l_linestatus = 'F')) THEN 'status' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem)", lambda s, d: R.violations(t(s, d, "lineitem"), {"quantity": c("l_quantity").between(1, 49), "status": (c("l_returnflag") == "N") != (c("l_linestatus") == "F")}, "l_orderkey"))


@query("b04_wildcard", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def b04_wildcard(s, d, status=None, priority="1-URGENT"):
    orders = t(s, d, "orders")
    for column, value in (("o_orderstatus", status), ("o_orderpriority", priority)):
        if value is not None:
            orders = orders.where(c(column) == value)
    return orders.select("o_orderkey")


# ---- joins
def chain(s, d):
    return t(s, d, "customer").join(F.broadcast(t(s, d, "nation")), c("c_nationkey") == c("n_nationkey")).join(F.broadcast(t(s, d, "region")), c("n_regionkey") == c("r_regionkey"))


simple("c01_join_chain", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", lambda s, d: chain(s, d).select("c_custkey", "n_name", "r_name"))
simple("c02_left_join", "SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)", lambda s, d: t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left").select("doc_id", "toxic"))
simple("c03_coalesced_key", "SELECT p_partkey, n_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey JOIN nation ON n_nationkey = coalesce(s_nationkey, p_size % 25)", lambda s, d: t(s, d, "part").join(t(s, d, "supplier"), c("p_partkey") == c("s_suppkey"), "left").withColumn("k", F.coalesce("s_nationkey", c("p_size") % 25)).join(F.broadcast(t(s, d, "nation")), c("k") == c("n_nationkey")).select("p_partkey", "n_name"))
simple("c04_left_join_predicate", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000", lambda s, d: t(s, d, "orders").join(t(s, d, "customer").where("c_acctbal > 5000"), c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", "c_name"))
simple("c06_semi_join", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)", lambda s, d: t(s, d, "part").join(t(s, d, "lineitem").where("l_quantity > 45"), c("p_partkey") == c("l_partkey"), "left_semi").select("p_partkey"))
simple("c07_anti_join", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)", lambda s, d: t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left_anti").select("doc_id"))
simple("c08_exists_in_or", "SELECT c_custkey, c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS flagged FROM customer", lambda s, d: t(s, d, "customer").join(t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey"), F.lit(True).alias("u")).distinct(), "c_custkey", "left").select("c_custkey", ((c("c_acctbal") < 0) | c("u").isNotNull()).alias("flagged")))
simple("c10_prefix_twins", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE left(e.text, 120) = left(d.text, 120) AND e.doc_id < d.doc_id)", lambda s, d: t(s, d, "documents").select("doc_id", F.left("text", F.lit(120)).alias("k")).join(t(s, d, "documents").groupBy(F.left("text", F.lit(120)).alias("k")).agg(F.min("doc_id").alias("first")), "k").where("doc_id > first").select("doc_id"))
simple("c11_containment_within_key", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey AND contains(a.n_name, left(b.n_name, 1))", lambda s, d: t(s, d, "nation").select(c("n_name").alias("a"), "n_regionkey", c("n_nationkey").alias("x")).join(t(s, d, "nation").select(c("n_name").alias("b"), "n_regionkey", c("n_nationkey").alias("y")), "n_regionkey").where((c("x") != c("y")) & (F.instr("a", F.left("b", F.lit(1))) > 0)).select("a", "b"))
simple("c14_lateral_first", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey", lambda s, d: t(s, d, "customer").join(t(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey")), "c_custkey", "left").select("c_custkey", "o_orderkey"))
simple("c15_values_cross_filter", "SELECT n_name, y FROM nation, (VALUES (1), (2)) v(y) WHERE n_nationkey % 2 = y - 1", lambda s, d: t(s, d, "nation").withColumn("y", F.explode(F.array(F.lit(1), F.lit(2)))).where("n_nationkey % 2 = y - 1").select("n_name", "y"))
simple("c17_probe", "SELECT c_custkey, coalesce(m, 0.0) AS mean_price FROM customer LEFT JOIN (SELECT o_custkey, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey", lambda s, d: t(s, d, "customer").join(t(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(half_up(F.avg("o_totalprice"), 2).alias("m")), "c_custkey", "left").select("c_custkey", F.coalesce("m", F.lit(0.0)).alias("mean_price")))


@query("c18_within_48h", "SELECT s.event_id AS session_id, a.event_id AS answer_id FROM events s JOIN events a ON s.user_id = a.user_id AND a.ts >= s.ts AND a.ts < s.ts + INTERVAL 48 HOUR WHERE s.event_type = 'signup' AND a.event_type = 'purchase'")
def c18_within_48h(s, d):
    e = t(s, d, "events")
    sessions = e.where("event_type = 'signup'").select("user_id", c("event_id").alias("session_id"), c("ts").alias("start"))
    answers = e.where("event_type = 'purchase'").select("user_id", c("event_id").alias("answer_id"), c("ts").alias("at"))
    return R.within(sessions, answers, ["user_id"], "start", "at", 48).select("session_id", "answer_id")


simple("c20_update_from", "SELECT s_suppkey, coalesce(CASE WHEN r_name = 'ASIA' THEN 0.0 END, s_acctbal) AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", lambda s, d: t(s, d, "supplier").join(F.broadcast(t(s, d, "nation")), c("s_nationkey") == c("n_nationkey")).join(F.broadcast(t(s, d, "region")), c("n_regionkey") == c("r_regionkey")).select("s_suppkey", F.coalesce(F.when(c("r_name") == "ASIA", 0.0), "s_acctbal").alias("s_acctbal")))

# ---- aggregates
simple("d01_group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1", lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")))
simple("d02_conditional", "SELECT count(*) FILTER (event_type = 'error') AS wrong, count(*) FILTER (event_type = 'purchase') AS right_, floor(sum(value) FILTER (event_type = 'view') * 100 + 0.5) / 100 AS viewed FROM events", lambda s, d: t(s, d, "events").agg(F.count(F.when(c("event_type") == "error", 1)).alias("wrong"), F.count(F.when(c("event_type") == "purchase", 1)).alias("right_"), half_up(F.sum(F.when(c("event_type") == "view", c("value"))), 2).alias("viewed")))
simple("d03_sum_or_zero", "SELECT coalesce(sum(value), 0) AS total FROM events WHERE event_type = 'absent'", lambda s, d: t(s, d, "events").where("event_type = 'absent'").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total")))
simple("d04_distinct_counts", "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem", lambda s, d: t(s, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")))
simple("d05_distinct_per_group", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1", lambda s, d: t(s, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts")))
simple("d06_years_desc", "SELECT l_partkey, array_to_string(list_reverse_sort(list(DISTINCT year(o_orderdate))), ',') AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", lambda s, d: t(s, d, "lineitem").join(t(s, d, "orders"), c("l_orderkey") == c("o_orderkey")).select("l_partkey", F.year("o_orderdate").alias("y")).groupBy("l_partkey").agg(F.array_join(F.reverse(F.array_sort(F.collect_set("y"))), ",").alias("years")))
simple("d07_ordered_list_of_k", "SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 5 GROUP BY 1", lambda s, d: R.top_per_group(t(s, d, "events"), ["user_id"], [c("ts"), c("event_id")], 5).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]), ",").alias("ids")))
simple("d08_average_having", "SELECT user_id, floor((1 - avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE least(1.0, value / 500) END)) * 1000 + 0.5) / 1000 AS difficulty FROM events GROUP BY 1 HAVING count(*) >= 5", lambda s, d: t(s, d, "events").groupBy("user_id").agg(half_up(1 - F.avg(F.when(c("event_type") == "error", 0.0).otherwise(F.least(F.lit(1.0), c("value") / 500))), 3).alias("difficulty"), F.count("*").alias("n")).where("n >= 5").drop("n"))
simple("d09_having_filtered", "SELECT source, count(*) FILTER (quality = 0) AS low FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) FILTER (quality = 0) > 1", lambda s, d: t(s, d, "documents").join(t(s, d, "labels"), "doc_id").groupBy("source").agg(F.count(F.when(c("quality") == 0, 1)).alias("low")).where("low > 1"))
simple("d11_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer", lambda s, d: t(s, d, "customer").join(t(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n")))
simple("d13_min_text", "SELECT source, min(lang) AS lang FROM documents GROUP BY 1", lambda s, d: t(s, d, "documents").groupBy("source").agg(F.min("lang").alias("lang")))
simple("d14_group_sorted", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1", lambda s, d: t(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority"))
simple("d15_month_sum", "SELECT user_id, date_trunc('month', ts)::DATE AS month, floor(sum(value) * 100 + 0.5) / 100 AS spent FROM events GROUP BY 1, 2", lambda s, d: t(s, d, "events").groupBy("user_id", F.date_trunc("month", "ts").cast("date").alias("month")).agg(half_up(F.sum("value"), 2).alias("spent")))
simple("d16_relation_count", "SELECT p_partkey, count(l_orderkey) FILTER (l_returnflag = 'R') AS returned FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1", lambda s, d: t(s, d, "part").join(t(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n")), "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("returned")))
simple("d17_two_level_fold", "SELECT n_regionkey, sum(n)::BIGINT AS customers, count(*) AS nations FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", lambda s, d: t(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(F.broadcast(t(s, d, "nation")), c("c_nationkey") == c("n_nationkey")).groupBy("n_regionkey").agg(F.sum("n").alias("customers"), F.count("*").alias("nations")))
simple("d18_weighted_mean", "SELECT l_suppkey, floor(sum(l_discount * l_quantity) / sum(l_quantity) * 10000 + 0.5) / 10000 AS mean FROM lineitem GROUP BY 1", lambda s, d: t(s, d, "lineitem").groupBy("l_suppkey").agg(half_up(F.sum(c("l_discount") * c("l_quantity")) / F.sum("l_quantity"), 4).alias("mean")))
simple("d19_mean_of_ratios", "SELECT user_id, floor(avg(least(1.0, value / 500)) * 20 * 10 + 0.5) / 10 AS mark FROM events GROUP BY 1", lambda s, d: t(s, d, "events").groupBy("user_id").agg(half_up(mean(F.least(F.lit(1.0), c("value") / 500)) * 20, 1).alias("mark")))
simple("d20_scope_verdict", "SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) WHEN count(DISTINCT event_type) <= 3 THEN 'few' END AS scope FROM events GROUP BY 1", lambda s, d: t(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k")).select("user_id", F.when(F.size("k") == 1, c("k")[0]).when(F.size("k") <= 3, "few").alias("scope")))
simple("d21_recent_five", "SELECT user_id, string_agg(event_id, ',' ORDER BY ts DESC, event_id DESC) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY 1", lambda s, d: R.top_per_group(t(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id")), False), lambda x: x["event_id"]), ",").alias("ids")))
simple("d22_medians", "SELECT l_suppkey, median(l_quantity) AS median, list_sort(list(l_quantity))[(count(*) // 2 + 1)::INT] AS upper_middle FROM lineitem GROUP BY 1", lambda s, d: t(s, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("median"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity DESC)").alias("upper_middle")))
simple("d23_nearest_rank", "SELECT lang, list_sort(list(n_chars))[(floor((count(*) - 1) * 0.9) + 1)::INT] AS p90 FROM documents GROUP BY 1", lambda s, d: R.nearest_ranks(t(s, d, "documents"), ["lang"], "n_chars", {"p90": 0.9}))
simple("d24_word_counts", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1", lambda s, d: t(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
simple("d25_threshold_sweep", "SELECT th, floor(avg((value >= th)::INT) * 1000000 + 0.5) / 1000000 AS share FROM events, (SELECT unnest([100.0, 200.0, 300.0, 400.0])::DOUBLE AS th) GROUP BY 1", lambda s, d: t(s, d, "events").select("value", F.explode(F.array(*[F.lit(x) for x in (100.0, 200.0, 300.0, 400.0)])).alias("th")).groupBy("th").agg(half_up(F.avg((c("value") >= c("th")).cast("int")), 6).alias("share")))
simple("d26_distinct", "SELECT DISTINCT lang, source FROM documents", lambda s, d: t(s, d, "documents").select("lang", "source").distinct())

# ---- windows
simple("e01_stratified", "SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM documents) WHERE rn <= 10", lambda s, d: R.top_per_group(t(s, d, "documents"), ["lang"], [F.md5(c("doc_id").cast("string").cast("binary")), c("doc_id")], 10).select("doc_id", c("rn").cast("long").alias("rn")))
simple("e02_rank_of_aggregate", "SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY max(o_totalprice) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1", lambda s, d: R.distinct_on(t(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("m")), ["o_custkey"], [F.desc("m"), c("o_orderpriority")]).select("o_custkey", "o_orderpriority"))
simple("e03_losers", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn > 1", lambda s, d: t(s, d, "documents").select("doc_id", F.row_number().over(Window.partitionBy(F.md5(c("text").cast("binary"))).orderBy(F.desc("n_chars"), "doc_id")).alias("rn")).where("rn > 1").select("doc_id"))
simple("e04_survivor", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text), source) AS survivor FROM documents", lambda s, d: t(s, d, "documents").select("doc_id", F.min("doc_id").over(Window.partitionBy(F.md5(c("text").cast("binary")), "source")).alias("survivor")))
simple("e07_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", lambda s, d: R.distinct_on(t(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), c("o_orderkey")]).select("o_custkey", "o_orderkey"))
simple("e08_nulls_last", "SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) AS rn FROM documents LEFT JOIN labels USING (doc_id)) WHERE rn <= 20", lambda s, d: t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left").orderBy(F.desc_nulls_last("quality"), "doc_id").limit(20).select("doc_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("quality"), "doc_id")).cast("long").alias("rn")))
DAYS = "(SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)"


def daily(s, d):
    return t(s, d, "events").groupBy("user_id", c("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


simple("e09_streak", f"SELECT user_id, max(CASE WHEN last >= DATE '2024-01-29' THEN n ELSE 0 END) AS streak FROM (SELECT user_id, island, max(day) AS last, count(*) AS n FROM (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM {DAYS}) GROUP BY 1, 2) GROUP BY 1", lambda s, d: R.streaks(daily(s, d), ["user_id"], "day", F.lit("2024-01-30").cast("date")))
simple("e10_spine", f"SELECT user_id, day, coalesce(n, 0) AS n FROM (SELECT user_id, day FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day)) LEFT JOIN {DAYS} USING (user_id, day)", lambda s, d: R.day_spine(daily(s, d), ["user_id"], "day", "2024-01-01", "2024-01-30", ["n"]))
simple("e11_now_and_before", "SELECT user_id, floor(coalesce(avg(value), 0) * 100 + 0.5) / 100 AS now_, floor(coalesce(avg(value) FILTER (ts < TIMESTAMP '2024-01-04'), 0) * 100 + 0.5) / 100 AS before FROM events GROUP BY 1", lambda s, d: t(s, d, "events").groupBy("user_id").agg(half_up(F.coalesce(F.avg("value"), F.lit(0.0)), 2).alias("now_"), half_up(F.coalesce(F.avg(F.when(c("ts") < F.lit("2024-01-04").cast("timestamp_ntz"), c("value"))), F.lit(0.0)), 2).alias("before")))
simple("e12_tumbling", "SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", lambda s, d: t(s, d, "events").groupBy(F.date_trunc("day", "ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n")))
simple("e13_trailing", "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-25') AS week, count(*) FILTER (ts >= TIMESTAMP '2024-01-18') AS fortnight, count(*) FILTER (ts >= TIMESTAMP '2024-01-04') AS month FROM events", lambda s, d: t(s, d, "events").agg(*[F.count(F.when(c("ts") >= F.lit(x).cast("timestamp_ntz"), 1)).alias(n) for n, x in (("week", "2024-01-25"), ("fortnight", "2024-01-18"), ("month", "2024-01-04"))]))

# ---- sort, sets, JSON, arrays
simple("f01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", lambda s, d: t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice"))
simple("f02_boolean_sort", "SELECT c_custkey FROM customer ORDER BY (c_mktsegment = 'BUILDING') DESC, c_acctbal DESC, c_custkey LIMIT 20", lambda s, d: t(s, d, "customer").orderBy((c("c_mktsegment") == "BUILDING").desc(), F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey"))
simple("f03_page", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50", lambda s, d: t(s, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(50).limit(25).select("p_partkey"))
simple("f05_top_up", "SELECT event_id FROM events ORDER BY (ts > TIMESTAMP '2024-01-15'), ts, event_id LIMIT 50", lambda s, d: t(s, d, "events").orderBy(c("ts") > F.lit("2024-01-15").cast("timestamp_ntz"), "ts", "event_id").limit(50).select("event_id"))
simple("f06_by_correlated_count", "SELECT p_partkey, n FROM (SELECT p_partkey, count(DISTINCT year(o_orderdate)) AS n FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ORDER BY n DESC, md5(p_partkey::VARCHAR) LIMIT 20", lambda s, d: t(s, d, "lineitem").join(t(s, d, "orders"), c("l_orderkey") == c("o_orderkey")).join(t(s, d, "part"), c("l_partkey") == c("p_partkey"), "left_semi").groupBy(c("l_partkey").alias("p_partkey")).agg(F.countDistinct(F.year("o_orderdate")).alias("n")).orderBy(F.desc("n"), F.md5(c("p_partkey").cast("string").cast("binary"))).limit(20))
simple("f07_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", lambda s, d: t(s, d, "customer").select(c("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey")).distinct())
simple("f08_union_all", "SELECT 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier", lambda s, d: t(s, d, "customer").select(F.lit("customer").alias("kind"), c("c_acctbal").alias("balance")).unionByName(t(s, d, "supplier").select(F.lit("supplier").alias("kind"), c("s_acctbal").alias("balance"))))
simple("f11_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", lambda s, d: t(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))
simple("f10_json_array_guard", "SELECT event_id, CASE WHEN starts_with(ltrim(props), '[') THEN json_array_length(props) ELSE 0 END::BIGINT AS n FROM events", lambda s, d: t(s, d, "events").select("event_id", F.when(F.startswith(F.ltrim("props"), F.lit("[")), F.coalesce(F.json_array_length("props"), F.lit(0))).otherwise(0).cast("long").alias("n")))
simple("f14_json_rewrite", "SELECT event_id, regexp_replace(props, '\"k\"', '\"key\"') AS props FROM events", lambda s, d: t(s, d, "events").select("event_id", F.regexp_replace("props", '"k"', '"key"').alias("props")))
simple("f15_lines", "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1", lambda s, d: t(s, d, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("lines")))
simple("f16_empty_array", "SELECT doc_id, coalesce(len(CASE WHEN lang = 'fr' THEN [1] END), 0)::BIGINT AS n FROM documents", lambda s, d: t(s, d, "documents").select("doc_id", F.size(F.coalesce(F.when(c("lang") == "fr", F.array(F.lit(1))), F.array().cast("array<int>"))).cast("long").alias("n")))
simple("f17_membership", "SELECT vec_id FROM embeddings WHERE list_contains([1, 3, 5], label)", lambda s, d: t(s, d, "embeddings").where(F.array_contains(F.array(F.lit(1), F.lit(3), F.lit(5)), c("label"))).select("vec_id"))
simple("f18_canonical_hash", "SELECT n_nationkey, sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') AS h FROM nation", lambda s, d: t(s, d, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct(c("n_nationkey").alias("key"), c("n_name").alias("name"))), 256).alias("h")))

# ---- scalar functions
simple("g01_strings", "SELECT doc_id, left(text, 10) AS l, length(text) AS n, trim(lower(left(text, 30))) AS low, strpos(text, 'the') AS at, regexp_extract(text, '[0-9]+') AS digits FROM documents", lambda s, d: t(s, d, "documents").select("doc_id", F.left("text", F.lit(10)).alias("l"), F.length("text").cast("long").alias("n"), F.trim(F.lower(F.left("text", F.lit(30)))).alias("low"), F.instr("text", "the").cast("long").alias("at"), F.regexp_extract("text", "[0-9]+", 0).alias("digits")))
simple("g02_regexp_replace", "SELECT doc_id, md5(regexp_replace(text, '[^\\p{L}]+', '', 'g')) AS h FROM documents", lambda s, d: t(s, d, "documents").select("doc_id", F.md5(F.regexp_replace("text", r"[^\p{L}]+", "").cast("binary")).alias("h")))
simple("g03_translate", "SELECT doc_id, md5(translate(text, 'éèêçàâùü', 'eeecaa')) AS h FROM documents", lambda s, d: t(s, d, "documents").select("doc_id", F.md5(F.translate("text", "éèêçàâùü", "eeecaa").cast("binary")).alias("h")))
simple("g06_hashes", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents", lambda s, d: t(s, d, "documents").select("doc_id", F.md5(c("text").cast("binary")).alias("m"), F.sha2("text", 256).alias("s")))
simple("g08_format_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events", lambda s, d: t(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")))
simple("g09_civil_days", "SELECT event_id, (ts + INTERVAL 2 HOUR)::DATE AS local_day, date_trunc('week', ts + INTERVAL 2 HOUR)::DATE AS week, isodow(ts + INTERVAL 2 HOUR)::BIGINT - 1 AS weekday, date_diff('day', (ts + INTERVAL 2 HOUR)::DATE, DATE '2024-02-01') AS days_left FROM events", lambda s, d: t(s, d, "events").withColumn("local_day", F.to_date(F.from_utc_timestamp(c("ts").cast("timestamp"), "Asia/Beirut"))).select("event_id", "local_day", F.trunc("local_day", "week").alias("week"), F.weekday("local_day").cast("long").alias("weekday"), F.datediff(F.lit("2024-02-01").cast("date"), "local_day").cast("long").alias("days_left")))
simple("g13_luhn", "SELECT p_partkey, list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (len(x) - i) % 2 = 0 THEN x[i]::INT ELSE x[i]::INT * 2 - CASE WHEN x[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS valid FROM (SELECT p_partkey, p_partkey::VARCHAR AS x FROM part)", lambda s, d: t(s, d, "part").select("p_partkey", F.call_function("luhn_check", c("p_partkey").cast("string")).alias("valid")))
simple("g14_micro_dollars", "SELECT event_id, floor(value * 1000 * 0.15 + length(event_type) * 0.6 + 0.5)::BIGINT AS micro FROM events", lambda s, d: t(s, d, "events").select("event_id", F.floor(c("value") * 1000 * 0.15 + F.length("event_type") * 0.6 + 0.5).cast("long").alias("micro")))
