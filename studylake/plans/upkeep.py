"""Queries of upkeep: merges of duplicates, stray copies, backups before updates, single use, search of sessions, plans towards an exam."""

from pyspark.sql import functions as F

from studylake.functions import text as X
from studylake.operators import planning as P
from studylake.operators import upkeep
from studylake.plans.planning import SUBJECT_SQL, subject
from studylake.plans.learning import MASTERY, mastered
from studylake.registry import query
from studylake.sources import files
from studylake.sources.tables import table as t

c = F.col
CHAPTERS = """chapters AS (SELECT p_partkey, p_brand, trim(regexp_replace(strip_accents(lower(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'É' || p_name || '!' ELSE 'é ' || p_name END)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name, p_size FROM part),
allowed AS (SELECT name, max(n) AS n FROM (SELECT name, p_size, count(*) AS n FROM chapters GROUP BY ALL) GROUP BY 1),
merged AS (SELECT p_brand, name, p_partkey AS loser, survivor FROM (SELECT *, row_number() OVER w AS rn, first_value(p_partkey) OVER w AS survivor FROM chapters WINDOW w AS (PARTITION BY p_brand, name ORDER BY p_partkey)) x JOIN allowed USING (name) WHERE rn > greatest(n, 1))"""


def merged(s, d):
    """Chapters are parts, whose names are written in three ways; subjects are brands, books sizes."""
    name = F.when(c("p_partkey") % 3 == 0, F.upper("p_name")).when(c("p_partkey") % 3 == 1, F.concat(F.lit("É"), "p_name", F.lit("!"))).otherwise(F.concat(F.lit("é "), "p_name"))
    chapters = t(s, d, "part").select("p_partkey", "p_brand", X.title_key(name).alias("name"), "p_size")
    allowed = chapters.groupBy("name", "p_size").agg(F.count("*").alias("n")).groupBy("name").agg(F.max("n").alias("n"))
    return upkeep.duplicates(chapters, ["p_brand", "name"], "p_partkey", allowed)


@query("k12_merged_duplicates", f"WITH {CHAPTERS} SELECT * FROM merged")
def k12_merged_duplicates(s, d):
    return merged(s, d)


@query("k12_moved_links", f"""WITH {CHAPTERS},
links AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
each AS (SELECT coalesce(survivor, l_partkey) AS l_partkey, l_suppkey, score, survivor IS NOT NULL AS moved, l_partkey AS was FROM links LEFT JOIN merged ON loser = l_partkey)
SELECT l_partkey, l_suppkey, score, moved FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY moved, was) AS k FROM each) WHERE k = 1""")
def k12_moved_links(s, d):
    """Links of parts to suppliers after the merge: a survivor keeps its own, losers' links are added where it has none."""
    links = t(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("score"))
    return upkeep.moved_links(links, merged(s, d), "l_partkey", "l_suppkey")


@query("k13_contained_strays", r"""
WITH rows AS (SELECT doc_id, source, text FROM documents UNION ALL SELECT doc_id + 1000000000, source, 'pt. ' || text FROM documents WHERE doc_id % 7 = 0),
r AS (SELECT doc_id, source, left(regexp_replace(text, '[^\p{L}]+', '', 'g'), 100) AS w FROM rows), o AS (SELECT doc_id, source, left(regexp_replace(text, '[^\p{L}]+', '', 'g'), 80) AS h FROM documents)
SELECT doc_id FROM r WHERE EXISTS (SELECT 1 FROM o WHERE o.source = r.source AND o.doc_id <> r.doc_id AND length(h) >= 20 AND contains(w, h))""")
def k13_contained_strays(s, d):
    """Documents, and copies of some with stray characters in front, that hold the beginning of another document of their source."""
    docs = t(s, d, "documents").select("doc_id", "source", "text")
    strays = docs.where("doc_id % 7 = 0").select((c("doc_id") + 1_000_000_000).alias("doc_id"), "source", F.concat(F.lit("pt. "), "text").alias("text"))
    return upkeep.contained_strays(docs.unionByName(strays), docs, ["source"], "doc_id", "text")


@query("n01_backup_then_update", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_acctbal < 0 THEN s_acctbal END AS backed_up, s_acctbal AS undone FROM supplier")
def n01_backup_then_update(s, d):
    """Negative balances are set to zero: what they were is written first, then table and backup appear together; the backup brings the old table back."""
    path = files.shared_path(s, "balances")
    old = t(s, d, "supplier").select("s_suppkey", "s_acctbal")
    files.publish({"supplier": old}, path)
    files.backup_then_update(s, path, "supplier", old.where("s_acctbal < 0").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"], "backup_balances")
    parts = files.published(s, path)
    undone = files.undone(parts["supplier"], parts["backup_balances"], ["s_suppkey"]).withColumnRenamed("s_acctbal", "undone")
    return parts["supplier"].join(parts["backup_balances"].withColumnRenamed("s_acctbal", "backed_up"), "s_suppkey", "left").join(undone, "s_suppkey")


@query("n04_used_tokens", """
WITH r AS (SELECT event_id, user_id, ts >= TIMESTAMP '2024-01-15' AS late FROM events WHERE event_type = 'click'), x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY late, event_id) AS k FROM r)
SELECT event_id, user_id, k = 1 AND user_id % 4 > 0 AS granted FROM x""")
def n04_used_tokens(s, d):
    """Two batches of requests for tokens that may be used once; every fourth token is used up before. The second batch sees what the first one took."""
    e = t(s, d, "events")
    state = e.select("user_id").distinct().select("user_id", F.when(c("user_id") % 4 == 0, -1).cast("long").alias("used_by"))
    asked = e.where("event_type = 'click'").select("event_id", "user_id", (c("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).alias("late"))
    state, first = upkeep.use_once(state, asked.where("NOT late").drop("late"), "user_id", "event_id")
    _, second = upkeep.use_once(state, asked.where("late").drop("late"), "user_id", "event_id")
    return first.unionByName(second)


SOUGHT = ["the", "la ", "reaux", "%", "zz"]
FOLD = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query("h27_session_search", rf"""
WITH m AS (SELECT conv_id, turn, role, {FOLD} AS f, left(regexp_replace(text, '\s+', ' ', 'g'), 120) AS excerpt, count(*) OVER (PARTITION BY conv_id) AS messages FROM conversations),
h AS (SELECT * FROM m JOIN (SELECT unnest({SOUGHT}) AS query) ON contains(f, query))
SELECT query, conv_id, any_value(messages) AS messages, count(*) AS found, arg_min(excerpt, (role <> 'user', turn)) AS excerpt FROM h GROUP BY query, conv_id""")
def h27_session_search(s, d):
    """Conversations that hold a searched text, with the beginning of the message that shows it best."""
    return upkeep.session_search(t(s, d, "conversations"), SOUGHT, "conv_id", "turn", "role", "text", X.fold_arabic(c("text")))


FOCUS = "1 + (14 - greatest(0, least(days, 14))) / 14 * 2"
NEAR = f"CASE WHEN subject = examined AND days <= 14 THEN {FOCUS} END"


@query("i30_focused_queue", f"""
WITH m AS (SELECT *, {SUBJECT_SQL} AS subject, CASE WHEN user_id % 3 = 0 THEN 'web' WHEN user_id % 3 = 1 THEN 'shop' END AS examined, user_id % 16 AS days FROM ({MASTERY})),
base AS (SELECT *, {NEAR} AS ramp, CASE WHEN mastery >= 0.7 THEN 0.0 ELSE greatest(0.0, 1 - mastery) * CASE WHEN attempts >= 5 THEN 1.0 ELSE 0.5 END END AS plain FROM m),
weights AS (SELECT *, CASE WHEN ramp IS NOT NULL THEN CASE WHEN mastery >= 0.7 THEN 0.15 ELSE plain END * ramp ELSE plain END AS weight, CASE WHEN subject = examined THEN greatest(1, floor({FOCUS} + 0.5)) ELSE 1 END AS pulls FROM base),
turns AS (SELECT *, floor(sum(weight) OVER (PARTITION BY user_id) * 1000000 + 0.5) / 1000000 AS total, row_number() OVER w AS n, ceil(row_number() OVER w / pulls) AS turn, first_value(-weight) OVER w AS lead, first_value(chapter) OVER w AS first
  FROM weights WHERE weight > 0 WINDOW w AS (PARTITION BY user_id, subject ORDER BY weight DESC, chapter))
SELECT user_id, chapter, row_number() OVER (PARTITION BY user_id ORDER BY turn, lead, first, n) AS place, greatest(1, floor(weight / total * 1440 / 30 + 0.5))::INT AS sessions FROM turns""")
def i30_focused_queue(s, d):
    """The queue of sessions before an exam: the examined subject weighs more and, as the day comes near, takes up to three chapters a turn."""
    examined = F.when(c("user_id") % 3 == 0, "web").when(c("user_id") % 3 == 1, "shop")
    rows = mastered(s, d).withColumn("subject", subject()).withColumn("days", F.when(c("subject") == examined, c("user_id") % 16))
    weighted = rows.withColumn("weight", P.chapter_weight(c("mastery"), c("attempts"), c("days")))
    queue = P.session_queue(weighted, ["user_id"], "weight", "subject", "chapter", F.lit(1440), pulls=P.focus_pulls(c("days")))
    return queue.select("user_id", "chapter", c("place").cast("long").alias("place"), "sessions")
