"""Queries of retrieval rules: index, pools, containment, re-ordering, hand-over, back-fill; linking and evaluation by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.functions.core import half_up
from studylake.operators import relational as R
from studylake.operators import retrieval
from studylake.plans.retrieval import ALL, BEST, COS, LEX, RANKED, WORDS, lexical_hits, per_label
from studylake.registry import query
from studylake.sources.tables import table as t

c = F.col
@query("h02_index")
def h02_index(s, d):
    """Ten nearest by the inverted-list index, for the vectors whose id is divisible by 20 against all; its recall against the exact scan is tested."""
    e = t(s, d, "embeddings")
    return retrieval.index_search(e.where("vec_id % 20 = 0"), e, 10).select("probe_id", "vec_id", "sim")


@query("h05_pool", f"""WITH v AS ({RANKED}), {LEX.strip()}
SELECT probe_id, vec_id, sim FROM (SELECT v.probe_id, v.vec_id, sim, row_number() OVER (PARTITION BY v.probe_id ORDER BY sim DESC, v.vec_id) AS k FROM v LEFT JOIN lex ON lex.probe_id = v.probe_id AND lex.vec_id = v.vec_id WHERE v.probe_id % 20 = 0 AND (v.rn <= 120 OR rank IS NOT NULL)) WHERE k <= 40""")
def h05_pool(s, d):
    """The nearest and the hits of the term index together, rescored; queries are the vectors whose id is divisible by 20."""
    e = t(s, d, "embeddings")
    return retrieval.candidate_pool(e.where("vec_id % 20 = 0"), e, ["label"], lambda pairs: lexical_hits(s, d, pairs), 40).select("probe_id", "vec_id", "sim")


@query("h07_provenance", f"""
WITH m AS (SELECT l_orderkey, floor(sum(l_quantity) * 100 + 0.5) / 100 AS marks, count(*) > 1 AS has_scheme FROM lineitem GROUP BY 1)
SELECT probe_id, vec_id, sim, year(o_orderdate) AS y, o_orderpriority AS session, coalesce(marks, 0.0) AS marks, coalesce(has_scheme, false) AS has_scheme
FROM ({RANKED}) LEFT JOIN orders ON o_orderkey = vec_id LEFT JOIN m ON l_orderkey = vec_id WHERE rn <= 5""")
def h07_provenance(s, d):
    """Hits with the year, session, marks and scheme of the item that they come from."""
    e = t(s, d, "embeddings")
    marks = t(s, d, "lineitem").groupBy(c("l_orderkey").alias("vec_id")).agg(half_up(F.sum("l_quantity"), 2).alias("marks"), (F.count("*") > 1).alias("has_scheme"))
    item = t(s, d, "orders").select(c("o_orderkey").alias("vec_id"), F.year("o_orderdate").alias("y"), c("o_orderpriority").alias("session"))
    hits = retrieval.knn(e, e, ["label"], 5).join(item, "vec_id", "left").join(marks, "vec_id", "left")
    return hits.select("probe_id", "vec_id", "sim", "y", "session", F.coalesce("marks", F.lit(0.0)).alias("marks"), F.coalesce("has_scheme", F.lit(False)).alias("has_scheme"))


OWNED = f"SELECT a.vec_id AS probe_id, b.vec_id, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = b.vec_id % 5 AND a.vec_id <> b.vec_id"


def owned(s, d, k):
    e = t(s, d, "embeddings").withColumn("owner", c("vec_id") % 5)
    return retrieval.knn(e, e, ["owner"], k)


@query("h09_private", f"SELECT probe_id, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, vec_id) AS rn FROM ({OWNED})) WHERE rn <= 4")
def h09_private(s, d):
    """The owner (five of them, by id) is the scope: nobody sees another's documents."""
    return owned(s, d, 4).select("probe_id", "vec_id", "sim")


# Words of a question that say nothing about it.
GENERIC = ("solve", "please", "plz", "question")
ASKED = f"list_filter({WORDS.format('text')}, lambda w: NOT list_contains({list(GENERIC)}, w))"


@query("h15_containment", f"""
WITH a AS (SELECT item_id, {ASKED} AS w FROM benchmark), b AS (SELECT doc_id, {ASKED} AS w FROM documents)
SELECT item_id AS asked_id, doc_id AS id, floor(len(list_intersect(a.w, b.w)) / len(a.w) * 1000000 + 0.5) / 1000000 AS containment FROM a, b WHERE len(a.w) >= 7 AND len(list_intersect(a.w, b.w)) / len(a.w) >= 0.9 - 1e-9""")
def h15_containment(s, d):
    own = F.array_except(retrieval.long_words(c("text"), strip=False), F.array(*map(F.lit, GENERIC)))
    side = lambda name, key: t(s, d, name).select(c(key).alias("id"), own.alias("words"))
    return retrieval.contained(side("benchmark", "item_id"), side("documents", "doc_id"))


STRIPPED = "list_distinct(list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda w: len(w) > 3))"


@query("h16_overlap", f"""
WITH b AS (SELECT item_id, {STRIPPED} AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS shared, len(list_intersect(a.w, b.w)) >= 0.7 * least(len(a.w), len(b.w)) AS near_copy FROM b a JOIN b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0""")
def h16_overlap(s, d):
    """Shared words of items, counted over an inverted index of them; 0.7 of the shorter makes a near copy."""
    words = t(s, d, "benchmark").select(c("item_id"), retrieval.long_words(c("text")).alias("w")).withColumn("n", F.size("w"))
    terms = words.select("item_id", "n", F.explode("w").alias("t"))
    pairs = terms.select(c("item_id").alias("a"), c("n").alias("na"), "t").join(terms.select(c("item_id").alias("b"), c("n").alias("nb"), "t"), "t").where("a < b")
    return pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).select("a", "b", "shared", (c("shared") >= 0.7 * F.least("na", "nb")).alias("near_copy"))


EXPLAINS, ASKS = ("(?i)" + "|".join(x) for x in (retrieval.EXPLAINS, retrieval.ASKS))


@query("h17_explaining_first", f"SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY floor((doc_id % 50 / 50 + CASE WHEN doc_id % 9 = 0 THEN 0.03 ELSE 0 END + CASE WHEN regexp_matches(left(text, 600), '{EXPLAINS}') THEN 0.02 ELSE 0 END - CASE WHEN regexp_matches(left(text, 600), '{ASKS}') THEN 0.03 ELSE 0 END) * 10000 + 0.5) DESC, doc_id) AS rn FROM documents) WHERE rn <= 8")
def h17_explaining_first(s, d):
    rank = retrieval.explaining_first(c("doc_id") % 50 / 50, c("text"), F.when(c("doc_id") % 9 == 0, "definition").otherwise("prose"))
    return R.top_per_group(t(s, d, "documents").withColumn("r", F.floor(rank * 10000 + 0.5)), ["source"], [F.desc("r"), c("doc_id")], 8).select("source", "doc_id", c("rn").cast("long").alias("rn"))


@query("h18_shared_vocabulary", """
WITH q AS (SELECT source, list_distinct(regexp_extract_all(arg_min(text, doc_id), '\\p{L}{3,}')) AS w FROM documents GROUP BY 1),
x AS (SELECT source, doc_id, len(list_filter(w, lambda v: contains(text, v)))::INT AS shared FROM documents JOIN q USING (source)),
y AS (SELECT *, max(shared) OVER (PARTITION BY source) AS m FROM x)
SELECT source, doc_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shared DESC, doc_id) AS rn FROM y WHERE shared > 0 OR m = 0) WHERE rn <= 4""")
def h18_shared_vocabulary(s, d):
    """The first document of each source asks, the documents of the source are the hits, in order of id."""
    docs = t(s, d, "documents")
    first = docs.groupBy("source").agg(F.min(F.struct("doc_id", "text"))["text"].alias("q"))
    words = first.select("source", F.regexp_extract_all("q", F.lit("\\p{L}{3,}"), F.lit(0)).alias("words"))
    return retrieval.share_vocabulary(docs.select("source", "doc_id", "text"), words, "source", "words", "text", "doc_id").select("source", "doc_id", "shared")


@query("h21_tier", f"""
WITH v AS (SELECT probe_id, sim FROM ({RANKED}) WHERE rn = 1), p AS (SELECT probe_id, max(sim) AS own FROM ({OWNED}) GROUP BY 1)
SELECT probe_id, CASE WHEN sim >= 0.85 THEN 'exact' WHEN sim >= 0.45 THEN 'concept' WHEN own >= 0.3 THEN 'personal' ELSE 'refused' END AS tier FROM p LEFT JOIN v USING (probe_id)""")
def h21_tier(s, d):
    e = t(s, d, "embeddings")
    public = retrieval.knn(e, e, ["label"], 1).select("probe_id", "sim")
    own = owned(s, d, 1).select("probe_id", c("sim").alias("own"))
    tier = F.when(c("sim") >= 0.85, "exact").when(c("sim") >= 0.45, "concept").when(c("own") >= 0.3, "personal").otherwise("refused")
    return own.join(public, "probe_id", "left").select("probe_id", tier.alias("tier"))


@query("h24_backfill", """
WITH x AS (SELECT doc_id, md5(text) AS k, doc_id IN (SELECT vec_id FROM embeddings) AS has FROM documents),
y AS (SELECT *, min(CASE WHEN has THEN doc_id END) OVER (PARTITION BY k) AS held, min(doc_id) OVER (PARTITION BY k) AS first FROM x)
SELECT doc_id, CASE WHEN has THEN 'kept' WHEN held IS NOT NULL THEN 'reused' WHEN doc_id = first THEN 'new' ELSE 'shared' END AS action, coalesce(CASE WHEN has THEN doc_id END, held, first) AS vector_of FROM y""")
def h24_backfill(s, d):
    """Which documents need a vector: one for each new text, none where an equal text has one. Texts are grouped before the join, so copies meet as one row."""
    have = t(s, d, "embeddings").select(c("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    docs = t(s, d, "documents").select("doc_id", F.md5(c("text").cast("binary")).alias("k")).join(have, "doc_id", "left")
    group = docs.groupBy("k").agg(F.min(F.when(c("has"), c("doc_id"))).alias("held"), F.min("doc_id").alias("first"))
    action = F.when(c("has"), "kept").when(c("held").isNotNull(), "reused").when(c("doc_id") == c("first"), "new").otherwise("shared")
    return docs.join(group, "k").select("doc_id", action.alias("action"), F.coalesce(F.when(c("has"), c("doc_id")), "held", "first").alias("vector_of"))


@query("h25_budget", """
WITH h AS (SELECT doc_id, left(text, 6000) AS h FROM documents), a AS (SELECT doc_id, h, length(regexp_replace(h, '[\\x00-\\x7F]', '', 'g')) AS o FROM h)
SELECT doc_id, length(h)::INT AS kept, md5(h) AS hash FROM a WHERE 0.5 * (length(h) - o) + 3 * o <= 7000""")
def h25_budget(s, d):
    """Documents' starts for the embedding; none here has so many other letters that the estimate cuts (rules are tested apart)."""
    head = t(s, d, "documents").select("doc_id", retrieval.within_budget(c("text")).alias("h"))
    return head.select("doc_id", F.length("h").alias("kept"), F.md5(c("h").cast("binary")).alias("hash"))


@query("h26_quoted_titles", """
WITH q AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[«"“]\\s*([^«»"“”\\n]{4,80}?)\\s*[»"”]', 1))) AS title FROM conversations)
SELECT q.conv_id, q.turn, trim(title) AS title, min(c.turn) AS found FROM q LEFT JOIN conversations c ON c.conv_id = q.conv_id AND c.turn <> q.turn AND contains(c.text, trim(title)) GROUP BY 1, 2, 3""")
def h26_quoted_titles(s, d):
    """Quoted titles with the first other turn of the conversation that holds them."""
    talk = t(s, d, "conversations")
    asked = talk.select("conv_id", "turn", F.explode(retrieval.quoted_titles(c("text"))).alias("title"))
    other = talk.select("conv_id", c("turn").alias("at"), "text")
    hit = asked.join(other, "conv_id").where((c("at") != c("turn")) & F.contains("text", c("title"))).groupBy("conv_id", "turn", "title").agg(F.min("at").alias("found"))
    return asked.join(hit, ["conv_id", "turn", "title"], "left")


@query("c09_theta_anti", f"SELECT vec_id FROM embeddings b WHERE NOT EXISTS (SELECT 1 FROM embeddings a WHERE a.label = b.label AND a.vec_id < b.vec_id AND {COS} >= 0.6)")
def c09_theta_anti(s, d):
    """Vectors without an earlier close one in their scope."""
    e = t(s, d, "embeddings")
    close = retrieval.close_pairs(e, e, ["label"], 0.6).where("probe_id > vec_id").select(c("probe_id").alias("vec_id"))
    return e.join(close, "vec_id", "left_anti").select("vec_id")


@query("c13_lateral_nearest", f"SELECT vec_id, (SELECT b.probe_id FROM ({RANKED}) b WHERE b.vec_id = e.vec_id ORDER BY sim DESC, probe_id LIMIT 1) AS nearest FROM embeddings e")
def c13_lateral_nearest(s, d):
    e = t(s, d, "embeddings")
    best = retrieval.knn(e, e, ["label"], 1).select(c("probe_id").alias("vec_id"), c("vec_id").alias("nearest"))
    return e.select("vec_id").join(best, "vec_id", "left")


@query("d10_best_by_group", f"SELECT probe_id, label, max(sim) AS best FROM ({ALL}) GROUP BY 1, 2")
def d10_best_by_group(s, d):
    return per_label(s, d).select("probe_id", "label", "best")


@query("g11_cosine", f"SELECT a.vec_id, {COS} AS sim FROM embeddings a JOIN (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) b ON true")
def g11_cosine(s, d):
    e = t(s, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(c("embedding").alias("p"))  # one row
    return e.crossJoin(F.broadcast(first)).select("vec_id", half_up(R.cosine(c("embedding"), c("p")), 6).alias("sim"))


@query("k09_cross_refile", f"SELECT probe_id, mine, label FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY best DESC, label) AS rn FROM ({BEST}) WHERE mine < 5 AND label >= 5) WHERE rn = 1")
def k09_cross_refile(s, d):
    """Misfiled items of one half of the labels take their best label of the other."""
    return R.distinct_on(per_label(s, d).where("mine < 5 and label >= 5"), ["probe_id"], [F.desc("best"), c("label")]).select("probe_id", "mine", "label")


@query("k14_generated_copies", f"SELECT probe_id AS vec_id, max(sim) >= 0.8 AS rejected FROM ({RANKED}) WHERE vec_id < probe_id GROUP BY 1")
def k14_generated_copies(s, d):
    """A new item is rejected if an earlier one of its scope is as close as 0.8."""
    e = t(s, d, "embeddings")
    live = e.where("embedding is not null").select("vec_id", "label")
    later = live.join(live.groupBy("label").agg(F.min("vec_id").alias("first")), "label").where("vec_id > first").select("vec_id")
    copies = retrieval.close_pairs(e, e, ["label"], 0.8).where("vec_id < probe_id").select(c("probe_id").alias("vec_id"), F.lit(True).alias("copy")).distinct()
    return later.join(copies, "vec_id", "left").select("vec_id", F.coalesce("copy", F.lit(False)).alias("rejected"))


PARTS = f"SELECT a.vec_id // 100 AS item, b.label, max({COS}) AS best FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2"


@query("k17_links_by_part", f"SELECT item, label, best FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY best DESC, label) AS rn FROM ({PARTS}) WHERE best >= 0.25) WHERE rn <= 2")
def k17_links_by_part(s, d):
    """The query vectors of a hundred ids are parts of one item: the best that any part reaches counts, two links at most."""
    best = per_label(s, d).groupBy(F.floor(c("probe_id") / 100).alias("item"), "label").agg(F.max("best").alias("best")).where("best >= 0.25D")
    return R.top_per_group(best, ["item"], [F.desc("best"), c("label")], 2).select("item", "label", "best")


@query("m05_subject_gates", f"""
WITH b AS ({BEST}), i AS (SELECT mine, list_sort(list(best)) AS a FROM b WHERE label = mine GROUP BY 1), o AS (SELECT mine, max(best) AS w FROM b WHERE label <> mine GROUP BY 1),
p AS (SELECT mine, a[1 + floor((len(a) - 1) * 0.1)::INT] AS p10, greatest(0.3, floor((w + 0.02) * 1000000 + 0.5) / 1000000) AS safe FROM i JOIN o USING (mine) WHERE len(a) >= 3)
SELECT mine, CASE WHEN safe <= p10 THEN least(0.5, greatest(p10, safe)) ELSE 0.5 END AS gate FROM p""")
def m05_subject_gates(s, d):
    """A gate for each label from the scores that its questions reach in it and elsewhere; 0.5 stays where they overlap."""
    best = per_label(s, d)
    own = best.where("label = mine")
    low = R.nearest_ranks(own, ["mine"], "best", {"p10": 0.1}).join(own.groupBy("mine").agg(F.count("*").alias("n")).where("n >= 3"), "mine")
    worst = best.where("label <> mine").groupBy("mine").agg(F.max("best").alias("w"))
    safe = F.greatest(F.lit(0.3), half_up(c("w") + 0.02, 6))
    gates = low.join(worst, "mine")
    return gates.select("mine", F.when(safe <= c("p10"), F.least(F.lit(0.5), F.greatest(c("p10"), safe))).otherwise(0.5).alias("gate"))


@query("m07_helpfulness", "SELECT source, count(*) AS judged, floor(avg(quality) * 1000 + 0.5) / 1000 AS helpful FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def m07_helpfulness(s, d):
    return t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("judged"), half_up(F.avg("quality"), 3).alias("helpful"))


@query("m08_filing", f"SELECT mine, count(*) AS n, count(*) FILTER (label = mine) AS agreed FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY best DESC, label) AS rn FROM ({BEST})) WHERE rn = 1 GROUP BY 1")
def m08_filing(s, d):
    """How often the nearest label is the one that an item is filed under."""
    best = R.distinct_on(per_label(s, d), ["probe_id"], [F.desc("best"), c("label")])
    return best.groupBy("mine").agg(F.count("*").alias("n"), F.count(F.when(c("label") == c("mine"), 1)).alias("agreed"))
