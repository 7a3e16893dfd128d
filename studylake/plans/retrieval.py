"""Retrieval, linking and evaluation queries on vectors and texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.functions.core import half_up
from studylake.operators import relational as R
from studylake.operators import retrieval
from studylake.registry import query
from studylake.sources.tables import table as t

c = F.col

COS = "floor(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) * 1000000 + 0.5) / 1000000"
PAIRS = f"SELECT a.vec_id AS probe_id, b.vec_id, a.label, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id"
RANKED = f"SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, vec_id) AS rn FROM ({PAIRS})"
ALL = f"SELECT a.vec_id AS probe_id, a.label AS mine, b.label, {COS} AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0"


def per_label(s, d):
    """Queries are the vectors whose id is divisible by 20, against all: probe_id, mine, label, best."""
    e = t(s, d, "embeddings")
    probes = e.where("vec_id % 20 = 0")
    best = retrieval.best_by_group(probes, e, "label")
    return best.join(probes.select(c("vec_id").alias("probe_id"), c("label").alias("mine")), "probe_id").select("probe_id", "mine", "label", "best")


BEST = f"SELECT probe_id, mine, label, max(sim) AS best FROM ({ALL}) GROUP BY 1, 2, 3"


@query("h01_knn", f"SELECT probe_id, vec_id, sim, rn FROM ({RANKED}) WHERE rn <= 5")
def h01_knn(s, d):
    e = t(s, d, "embeddings")
    return retrieval.knn(e, e, ["label"], 5).select("probe_id", "vec_id", "sim", c("rn").cast("long").alias("rn"))


@query("h10_near_duplicate_guard", f"SELECT probe_id, vec_id, sim >= 0.8 AS blocked FROM ({RANKED}) WHERE rn = 1")
def h10_near_duplicate_guard(s, d):
    e = t(s, d, "embeddings")
    return retrieval.knn(e, e, ["label"], 1).select("probe_id", "vec_id", (c("sim") >= 0.8).alias("blocked"))


query("h11_best_per_group", BEST.replace("max(sim) AS best", "max(sim) AS best"))(per_label)


GATED = f"SELECT probe_id, sim, CASE WHEN label % 4 = 1 THEN 0.2 + label / 10 WHEN len(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06FF}}]')) > 3 THEN 0.45 ELSE 0.5 END AS gate FROM ({RANKED}) JOIN documents ON doc_id = probe_id WHERE rn = 1"


@query("h12_tiers", f"SELECT probe_id, CASE WHEN sim >= 0.85 THEN 'exact' WHEN sim >= gate THEN 'concept' ELSE 'refused' END AS tier FROM ({GATED})")
def h12_tiers(s, d):
    """Questions are the texts of the documents of the vectors; every fourth label has a measured gate of its own, the others the script's."""
    e = t(s, d, "embeddings")
    asked = retrieval.knn(e, e, ["label"], 1).join(e.select(c("vec_id").alias("probe_id"), "label"), "probe_id").join(t(s, d, "documents").select(c("doc_id").alias("probe_id"), "text"), "probe_id")
    own = F.when(c("label") % 4 == 1, 0.2 + c("label") / 10)
    return asked.select("probe_id", retrieval.gate(c("sim"), retrieval.concept_gate(c("text"), own)).alias("tier"))


@query("h13_lead", f"SELECT probe_id, floor((s[1] - s[len(s) // 2 + 1]) * 1000000 + 0.5) / 1000000 AS lead FROM (SELECT probe_id, list_reverse_sort(list(sim)) AS s FROM ({RANKED}) WHERE rn <= 8 GROUP BY 1)")
def h13_lead(s, d):
    e = t(s, d, "embeddings")
    sims = retrieval.knn(e, e, ["label"], 8).groupBy("probe_id").agg(F.sort_array(F.collect_list("sim"), False).alias("s"))
    return sims.select("probe_id", half_up(c("s")[0] - F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1), 6).alias("lead"))


WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(nfd(lower({0})), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+'), lambda w: len(w) > 3))"
# DuckDB has no decomposition of letters: the accents of the tables' languages are put apart by hand; the marks then part the words.
SPREAD = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[äâà]', 'a ', 'g'), '[éèêë]', 'e ', 'g'), '[íîï]', 'i ', 'g'), '[óöô]', 'o ', 'g'), '[úüûù]', 'u ', 'g')"
WORDS = WORDS.replace("nfd(lower({0}))", SPREAD.replace("{0}", "replace(replace(lower({0}), 'ñ', 'n '), 'ç', 'c ')"))


@query("h14_word_overlap", f"""
WITH b AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, floor(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) * 1e6 + 0.5) / 1e6 AS jaccard,
  floor(len(list_intersect(a.w, b.w)) / len(a.w) * 1e6 + 0.5) / 1e6 AS containment, floor(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) * 1e6 + 0.5) / 1e6 AS overlap
FROM b a JOIN b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0""")
def h14_word_overlap(s, d):
    """Pairs with a word in common, found through an index of words."""
    b = t(s, d, "benchmark").select("item_id", retrieval.long_words(c("text"), strip=False).alias("w"))
    one = b.select(c("item_id").alias("a"), c("w").alias("wa"))
    two = b.select(c("item_id").alias("b"), c("w").alias("wb"))
    near = one.select("a", F.explode("wa").alias("k")).join(two.select("b", F.explode("wb").alias("k")), "k").where("a < b").select("a", "b").distinct()
    both = near.join(one, "a").join(two, "b")
    return both.select("a", "b", *[half_up(x, 6).alias(n) for n, x in R.overlaps(c("wa"), c("wb")).items()])


LEX_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query("h03_lexical", f"""
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({LEX_WORDS}) AS term FROM benchmark),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
i AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({LEX_WORDS}) AS term FROM documents) GROUP BY 1, 2)
SELECT query_id, id, floor(sum(tf / (tf + 1)) * 1000000 + 0.5) / 1000000 AS rank FROM i JOIN q USING (term) JOIN n USING (query_id) GROUP BY query_id, id, n.n HAVING count(*) = n.n""")
def h03_lexical(s, d):
    """Whole items ask; documents must have all their words."""
    words = F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    plain = F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")  # in quotes, "or" is a word
    return retrieval.search(t(s, d, "documents"), t(s, d, "benchmark").select(c("item_id").alias("query_id"), plain.alias("question")))


HELD = "len(list_filter(range(1, len(d.w) + 1), lambda i: d.w[i] = q.w[{0}]))"
PHRASE = "len(list_filter(range(1, len(d.w)), lambda i: d.w[i] = q.w[{0}] AND d.w[i + 1] = q.w[{1}]))"


@query("h04_lexical_rank", f"""
WITH q AS (SELECT item_id AS query_id, {LEX_WORDS} AS w FROM benchmark WHERE len({LEX_WORDS}) >= 7), d AS (SELECT doc_id AS id, {LEX_WORDS} AS w FROM documents),
x AS (SELECT query_id, id, {PHRASE.format(1, 2)} AS a, {HELD.format(4)} AS no, {HELD.format(5)} AS b, {PHRASE.format(6, 7)} AS c FROM q, d WHERE list_contains(d.w, q.w[1]) AND list_contains(d.w, q.w[2]) OR list_contains(d.w, q.w[5]) AND list_contains(d.w, q.w[6])),
y AS (SELECT query_id, id, greatest(CASE WHEN a > 0 AND no = 0 THEN floor(a / (a + 1) * 1000000 + 0.5) / 1000000 ELSE 0 END, CASE WHEN b > 0 AND c > 0 THEN floor((b / (b + 1) + c / (c + 1)) * 1000000 + 0.5) / 1000000 ELSE 0 END) AS rank FROM x)
SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS rn FROM y WHERE rank > 0) WHERE rn <= 10""")
def h04_lexical_rank(s, d):
    """Ten best by rank for questions with a phrase, an excluded word and an alternative, made of the first words of each item."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    at = lambda i: c("w")[i - 1]
    asked = t(s, d, "benchmark").select(c("item_id").alias("query_id"), w.alias("w")).where("size(w) >= 7")
    text = F.concat(F.lit('"'), at(1), F.lit(" "), at(2), F.lit('" -'), at(4), F.lit(' or "'), at(5), F.lit('" "'), at(6), F.lit(" "), at(7), F.lit('"'))
    found = retrieval.search(t(s, d, "documents"), asked.select("query_id", text.alias("question")))
    return R.top_per_group(found, ["query_id"], [F.desc("rank"), c("id")], 10).select("query_id", "id", "rank")


#: Documents of vectors ask with their third word and the phrase of their first two; hits are other documents with a vector of the same label.
LEX = f"""
q AS (SELECT doc_id AS probe_id, label, {LEX_WORDS} AS w FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id % 20 = 0 AND len({LEX_WORDS}) >= 3),
d AS (SELECT doc_id AS vec_id, label, {LEX_WORDS} AS w FROM documents JOIN embeddings ON vec_id = doc_id),
lex AS (SELECT probe_id, vec_id, floor((a / (a + 1) + b / (b + 1)) * 1000000 + 0.5) / 1000000 AS rank FROM (
  SELECT probe_id, vec_id, q.w, {PHRASE.format(1, 2)} AS a, {HELD.format(3)} AS b FROM q JOIN d ON q.label = d.label AND probe_id <> vec_id AND list_contains(d.w, q.w[1]) AND list_contains(d.w, q.w[3])) q WHERE a > 0 AND b > 0)"""


def lexical_hits(s, d, pairs=None):
    """probe_id, vec_id, rank of the questions above; of the given pairs (probe_id, vec_id) only, if there are any."""
    e = t(s, d, "embeddings").where("embedding is not null").select("vec_id", "label")
    docs = t(s, d, "documents").join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    w = F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    asked = docs.where("doc_id % 20 = 0").select(c("doc_id").alias("query_id"), w.alias("w")).where("size(w) >= 3")
    question = F.concat(F.lit('"'), c("w")[0], F.lit(" "), c("w")[1], F.lit('" "'), c("w")[2], F.lit('"'))
    asked_of = None if pairs is None else pairs.select(c("probe_id").alias("query_id"), c("vec_id").alias("id"))
    found = retrieval.search(docs, asked.select("query_id", question.alias("question")), pairs=asked_of).where("query_id <> id")
    mine = e.select(c("vec_id").alias("query_id"), c("label").alias("mine"))
    return found.join(mine, "query_id").join(e.select(c("vec_id").alias("id"), "label"), "id").where("mine = label").select(c("query_id").alias("probe_id"), c("id").alias("vec_id"), "rank")


@query("h06_hybrid", f"""
WITH v AS ({RANKED}), {LEX.strip()},
x AS (SELECT v.probe_id AS query_id, v.vec_id AS id, sim, rank FROM v LEFT JOIN lex ON lex.probe_id = v.probe_id AND lex.vec_id = v.vec_id WHERE rn <= 30 AND v.probe_id % 20 = 0),
y AS (SELECT *, floor((sim + 0.15 * coalesce(rank / max(rank) OVER (PARTITION BY query_id), 0)) * 1000000 + 0.5) / 1000000 AS blend FROM x)
SELECT query_id, id, sim, blend FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, id) AS rn FROM y) WHERE rn <= 5""")
def h06_hybrid(s, d):
    """Queries are the vectors whose id is divisible by 20, against all of their label."""
    e = t(s, d, "embeddings")
    near = retrieval.cut(retrieval.knn(e.where("vec_id % 20 = 0"), e, ["label"], 30).select("probe_id", "vec_id", "sim"))
    vector = near.select(c("probe_id").alias("query_id"), c("vec_id").alias("id"), "sim")
    lex = lexical_hits(s, d, near).select(c("probe_id").alias("query_id"), c("vec_id").alias("id"), "rank")
    return retrieval.hybrid(vector, lex, 5).select("query_id", "id", "sim", "blend")


@query("h19_merge_hits", f"SELECT vec_id, max(sim) AS sim FROM ({RANKED}) WHERE rn <= 3 GROUP BY 1")
def h19_merge_hits(s, d):
    e = t(s, d, "embeddings")
    return retrieval.knn(e, e, ["label"], 3).groupBy("vec_id").agg(F.max("sim").alias("sim"))


@query("k06_superseded", f"SELECT DISTINCT greatest(probe_id, vec_id) AS loser FROM ({PAIRS}) WHERE sim >= 0.8")
def k06_superseded(s, d):
    e = t(s, d, "embeddings")
    return retrieval.close_pairs(e, e, ["label"], 0.8).select(F.greatest("probe_id", "vec_id").alias("loser")).distinct()


@query("k07_links", f"SELECT probe_id, label, best FROM (SELECT *, max(best) OVER (PARTITION BY probe_id) AS top, row_number() OVER (PARTITION BY probe_id ORDER BY best DESC, label) AS rn FROM ({BEST})) WHERE best >= 0.25 AND best >= top - 0.03 AND rn <= 3")
def k07_links(s, d):
    w = Window.partitionBy("probe_id")
    ranked = per_label(s, d).withColumn("top", F.max("best").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("best"), "label")))
    return ranked.where("best >= 0.25 and best >= top - 0.03D and rn <= 3").select("probe_id", "label", "best")


#: A move needs a best label of at least the floor, a lead over the second of more than the margin, and a filed label that is not among the first three.
FLOOR, LEAD, AMONG = 0.25, 0.03, 3


@query("k08_refile", f"""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY best DESC, label) AS rn FROM ({BEST})),
y AS (SELECT probe_id, mine, max(label) FILTER (rn = 1) AS label, max(best) FILTER (rn = 1) AS first, max(best) FILTER (rn = 2) AS second, bool_or(rn <= {AMONG} AND label = mine) AS kept FROM x GROUP BY 1, 2)
SELECT probe_id, mine, CASE WHEN kept THEN 'kept' WHEN first < {FLOOR} THEN 'too weak' WHEN floor((first - coalesce(second, 0)) * 1000000 + 0.5) / 1000000 <= {LEAD} THEN 'several topics' ELSE 'moved' END AS verdict, label FROM y""")
def k08_refile(s, d):
    """What becomes of each item: it stays among its nearest labels, or where evidence is weak or two labels are as near; else it moves to the nearest."""
    ranked = R.top_per_group(per_label(s, d), ["probe_id"], [F.desc("best"), c("label")], AMONG)
    at = lambda n, column: F.max(F.when(c("rn") == n, c(column)))
    top = ranked.groupBy("probe_id", "mine").agg(at(1, "label").alias("label"), at(1, "best").alias("first"), at(2, "best").alias("second"), F.bool_or(c("label") == c("mine")).alias("kept"))
    lead = half_up(c("first") - F.coalesce("second", F.lit(0.0)), 6)
    verdict = F.when(c("kept"), "kept").when(c("first") < FLOOR, "too weak").when(lead <= LEAD, "several topics").otherwise("moved")
    return top.select("probe_id", "mine", verdict.alias("verdict"), "label")


@query("m01_leave_one_out", f"""
WITH n AS (SELECT probe_id, sim FROM ({RANKED}) WHERE rn = 1)
SELECT 'tier ' || CASE WHEN sim >= 0.85 THEN 'exact' WHEN sim >= 0.45 THEN 'concept' ELSE 'refused' END AS figure, count(*)::DOUBLE AS value FROM n GROUP BY 1
UNION ALL SELECT 'mean', floor(avg(sim) * 10000 + 0.5) / 10000 FROM n
UNION ALL SELECT 'duplicates', count(*) FILTER (sim >= 0.97)::DOUBLE FROM n
UNION ALL SELECT 'refusal rate', floor(avg((sim < 0.45)::INT) * 10000 + 0.5) / 10000 FROM n
UNION ALL SELECT 'refused at ' || th, floor(avg((sim < th)::INT) * 10000 + 0.5) / 10000 FROM n, (SELECT unnest([0.3, 0.4, 0.5, 0.6]) AS th) GROUP BY th
UNION ALL SELECT 'warning: many refusals', 1 FROM n HAVING avg((sim < 0.45)::INT) > 0.5""")
def m01_leave_one_out(s, d):
    """Every vector asks for its nearest other: tiers, refusals at several gates, duplicates of 0.97 or more, and a warning where over half are refused."""
    e = t(s, d, "embeddings")
    near = retrieval.knn(e, e, ["label"], 1)
    share = lambda th: half_up(F.avg((c("sim") < th).cast("int")), 4)
    tiers = near.groupBy(F.concat(F.lit("tier "), retrieval.gate(c("sim"))).alias("figure")).agg(F.count("*").cast("double").alias("value"))
    whole = near.agg(half_up(F.avg("sim"), 4).alias("mean"), F.count(F.when(c("sim") >= 0.97, 1)).cast("double").alias("duplicates"), share(0.45).alias("refusal rate"), *[share(th).alias(f"refused at {th}") for th in (0.3, 0.4, 0.5, 0.6)])
    figures = whole.unpivot([], [f"`{x}`" for x in whole.columns], "figure", "value")
    warning = whole.where("`refusal rate` > 0.5").select(F.lit("warning: many refusals").alias("figure"), F.lit(1.0).alias("value"))
    return tiers.unionByName(figures).unionByName(warning)


@query("m02_lift", f"SELECT floor((avg((label = mine)::INT) - 0.1) / 0.9 * 10000 + 0.5) / 10000 AS lift FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY best DESC, label) AS rn FROM ({BEST})) WHERE rn = 1")
def m02_lift(s, d):
    top = R.distinct_on(per_label(s, d), ["probe_id"], [F.desc("best"), c("label")])
    return top.agg(half_up((F.avg((c("label") == c("mine")).cast("int")) - 0.1) / 0.9, 4).alias("lift"))


@query("m03_recall", f"SELECT mine, count(*) FILTER (rn <= 1)::DOUBLE / count(*) AS top1, count(*) FILTER (rn <= 3)::DOUBLE / count(*) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY best DESC, label) AS rn FROM ({BEST})) WHERE label = mine GROUP BY 1")
def m03_recall(s, d):
    ranked = per_label(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("best"), "label"))).where("label = mine")
    return ranked.groupBy("mine").agg((F.count(F.when(c("rn") <= 1, 1)) / F.count("*")).alias("top1"), (F.count(F.when(c("rn") <= 3, 1)) / F.count("*")).alias("top3"))


@query("m04_threshold", f"SELECT mine = label AS own, list_sort(list(best))[(floor((count(*) - 1) * 0.1) + 1)::INT] AS p10, list_sort(list(best))[(floor((count(*) - 1) * 0.9) + 1)::INT] AS p90 FROM ({BEST}) GROUP BY 1")
def m04_threshold(s, d):
    both = per_label(s, d).withColumn("own", c("mine") == c("label"))
    return R.nearest_ranks(both, ["own"], "best", {"p10": 0.1, "p90": 0.9})


@query("m06_agreement", "SELECT source, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS agreed FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def m06_agreement(s, d):
    return t(s, d, "documents").join(t(s, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count(F.when((c("quality") == 1) & (c("toxic") == 0), 1)).alias("agreed"))


@query("m09_snapshot_compare", "SELECT CASE WHEN a.doc_id IS NULL THEN 'gained' WHEN b.doc_id IS NULL THEN 'lost' WHEN a.n - b.n > 20 THEN 'shortened' ELSE 'same' END AS change, count(*) AS n FROM (SELECT doc_id, n_chars AS n FROM documents WHERE lang <> 'es') a FULL JOIN (SELECT doc_id, least(n_chars, 5000) AS n FROM documents WHERE lang <> 'de') b ON a.doc_id = b.doc_id GROUP BY 1")
def m09_snapshot_compare(s, d):
    docs = t(s, d, "documents")
    a = docs.where("lang <> 'es'").select("doc_id", c("n_chars").alias("a"))
    b = docs.where("lang <> 'de'").select("doc_id", F.least("n_chars", F.lit(5000)).alias("b"))
    change = F.when(c("a").isNull(), "gained").when(c("b").isNull(), "lost").when(c("a") - c("b") > 20, "shortened").otherwise("same")
    return a.join(b, "doc_id", "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))
