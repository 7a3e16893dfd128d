"""Queries of files, page layout, text repair, joins by name and the remaining relational forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.functions import classify, repair
from studylake.functions import text as X
from studylake.functions.core import half_up
from studylake.operators import layout, retrieval
from studylake.operators import relational as R
from studylake.registry import query
from studylake.sources import files
from studylake.sources.tables import table as t

c = F.col


def sql_text(x):
    return "'" + x.replace("'", "''") + "'"


def per_text(rule):
    """A rule of one text as a column function, in Arrow batches; null stays null."""
    return F.pandas_udf(lambda s: s.map(lambda x: x if x is None else rule(x)), "string")


def with_results(lines, result, name):
    """lines of each order, in order, with the element of result (an array over an order's rows) that is theirs; groups are arrays, many to an Arrow batch."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", *[x for x in lines.columns if x not in ("l_orderkey", "l_linenumber", "l_partkey")])))
    each = lines.groupBy("l_orderkey").agg(rows.alias("rows")).withColumn("found", result)
    return each.select("l_orderkey", F.explode(F.arrays_zip("rows", "found")).alias("x")).select("l_orderkey", "x.rows.*", c("x.found").alias(name))


# ---- files
@query("a04_csv_export", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def a04_csv_export(s, d):
    """Written for spreadsheets (byte order mark, lines that end in CR LF) and read back."""
    path = files.shared_path(s, "export")
    files.write_spreadsheet_csv(t(s, d, "nation").select(c("n_nationkey").alias("k"), c("n_name").alias("name")), path)
    return files.read_csv(s, path, "k int, name string")


@query("a05_csv_bom", "SELECT n_name AS name, n_nationkey AS k FROM nation")
def a05_csv_bom(s, d):
    """Rows whose first column starts with a byte order mark lose it when they are read."""
    path = files.shared_path(s, "bom")
    files.write_csv(t(s, d, "nation").select(F.concat(F.lit(files.BOM), "n_name").alias("name"), c("n_nationkey").alias("k")), path)
    return files.read_csv(s, path, "name string, k int")


@query("a08_page_files", "SELECT page_id::INT AS page, regexp_replace(html, '\\s+', ' ', 'g') AS text FROM pages")
def a08_page_files(s, d):
    """Pages as files page-NNN.md in one folder, read whole."""
    path = files.shared_path(s, "pages")
    files.write_pages(t(s, d, "pages").select(c("page_id").alias("page"), F.regexp_replace("html", "[\\t\\n\\f\\r ]+", " ").alias("text")), path)
    return files.read_pages(s, path)


@query("a09_inventory", "SELECT octet_length(encode(h)) AS size, sha256(h) AS sha256, count(*) OVER (PARTITION BY h) AS copies FROM (SELECT html AS h FROM pages)")
def a09_inventory(s, d):
    path = files.shared_path(s, "inventory")
    files.write_pages(t(s, d, "pages").select(c("page_id").alias("page"), c("html").alias("text")), path)
    return files.inventory(s, path + "/*.md").select("size", "sha256", "copies")


@query("a12_changed_objects", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 5 = 0 OR o_orderstatus = 'P'")
def a12_changed_objects(s, d):
    """Objects to put: those whose key or content the store does not hold."""
    rows = t(s, d, "orders").select(c("o_orderkey").alias("key"), F.sha2("o_orderstatus", 256).alias("sha256"), "o_orderstatus")
    stored = rows.where("key % 5 <> 0").select("key", F.when(c("o_orderstatus") == "P", "old").otherwise(c("sha256")).alias("sha256"))
    return files.changed_objects(stored, rows.select("key", "sha256")).select("key")


# ---- predicates, joins, aggregates, JSON
@query("b09_folded_ilike", "SELECT doc_id FROM documents WHERE strip_accents(text) ILIKE '%tra%'")
def b09_folded_ilike(s, d):
    return t(s, d, "documents").where(X.without_accents(c("text")).ilike("%tra%")).select("doc_id")


@query("b17_live_rows", "SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey WHERE o_custkey IS NULL")
def b17_live_rows(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").select(c("o_custkey").alias("c_custkey"), c("o_custkey").alias("gone")).distinct(), "c_custkey", "left").where(c("gone").isNull()).select("c_custkey")


@query("c05_subquery_key", "SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = coalesce((SELECT max(o_custkey) FROM orders x WHERE x.o_orderkey = l_orderkey AND x.o_orderstatus = 'F'), 1)")
def c05_subquery_key(s, d):
    """The key is a subquery's value or a fallback: joined first, then coalesced."""
    orders = t(s, d, "orders")
    key = orders.where("o_orderstatus = 'F'").groupBy(c("o_orderkey").alias("l_orderkey")).agg(F.max("o_custkey").alias("k"))
    lines = t(s, d, "lineitem").join(orders.select(c("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(key, "l_orderkey", "left")
    return lines.withColumn("c_custkey", F.coalesce("k", F.lit(1))).join(t(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", "left").select("l_orderkey", "l_linenumber", "o_custkey", "c_name")


@query("c12_equal_names", "SELECT DISTINCT a.p_partkey AS a, b.p_brand AS into_ FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_brand <> b.p_brand")
def c12_equal_names(s, d):
    """Parts that another brand has under the same name and type; grouped first, so that a frequent name does not make pairs of rows."""
    part = t(s, d, "part")
    brands = part.groupBy("p_name", "p_type", c("p_brand").alias("into_")).agg(F.lit(1).alias("one"))
    return part.select(c("p_partkey").alias("a"), "p_name", "p_type", "p_brand").join(brands, ["p_name", "p_type"]).where("p_brand <> into_").select("a", "into_")


@query("c16_query_tokens", "SELECT doc_id FROM documents, (SELECT ['the', 'and'] AS q) WHERE len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9]+'), q)) = 2")
def c16_query_tokens(s, d):
    asked = F.array(F.lit("the"), F.lit("and"))
    return t(s, d, "documents").where(F.size(F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), asked)) == 2).select("doc_id")


@query("c19_overlap_join", """
WITH f AS (SELECT vec_id, label, (vec_id * 37 % 900)::DOUBLE AS top, (vec_id * 37 % 900 + 40 + vec_id % 50)::DOUBLE AS bottom FROM embeddings), p AS (SELECT DISTINCT label, k, (k * 250)::DOUBLE AS a, (k * 250 + 240)::DOUBLE AS b FROM embeddings, (VALUES (0), (1), (2), (3)) v(k)),
x AS (SELECT vec_id, k, greatest(0.0, least(bottom, b) - greatest(top, a)) / (bottom - top) AS share, a FROM f JOIN p USING (label))
SELECT vec_id, CASE WHEN share >= 0.5 THEN k END AS owner FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, a) AS rn FROM x) WHERE rn = 1""")
def c19_overlap_join(s, d):
    e = t(s, d, "embeddings")
    top = (c("vec_id") * 37 % 900).cast("double")
    figures = e.select("vec_id", "label", top.alias("top"), (top + 40 + c("vec_id") % 50).alias("bottom"))
    parts = e.select("label").distinct().withColumn("part", F.explode(F.array(*map(F.lit, range(4))))).select("label", "part", (c("part") * 250.0).alias("top"), (c("part") * 250.0 + 240).alias("bottom"))
    return layout.figure_owner(figures, parts, ["label"]).select("vec_id", "owner")


@query("d12_json_sum", "SELECT l_orderkey, floor(sum(l_quantity) * 100 + 0.5) / 100 AS marks, count(*) AS criteria FROM lineitem GROUP BY 1")
def d12_json_sum(s, d):
    """Marks summed over the elements of a JSON array."""
    js = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(c("l_quantity").alias("points")))).alias("j"))
    marks = F.aggregate(F.from_json("j", "array<struct<points:double>>"), F.lit(0.0), lambda a, x: a + x["points"])
    return js.select("l_orderkey", half_up(marks, 2).alias("marks"), F.json_array_length("j").cast("long").alias("criteria"))


@query("e05_hash_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS rn FROM documents) WHERE rn <= 3")
def e05_hash_sample(s, d):
    return R.top_per_group(t(s, d, "documents"), ["source"], [F.md5(c("doc_id").cast("string").cast("binary"))], 3).select("source", "doc_id")


@query("e06_random_sample")
def e06_random_sample(s, d):
    """A random sample of 50 with a fixed seed; a sampling operator, so there is no SQL."""
    return t(s, d, "documents").select("doc_id").orderBy(F.rand(7), "doc_id").limit(50)


@query("f04_filter_then_limit", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def f04_filter_then_limit(s, d):
    return t(s, d, "orders").where("o_orderstatus = 'P'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey")


@query("f09_tagged_union", "SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def f09_tagged_union(s, d):
    return R.union_all([t(s, d, "customer").select(F.lit("customer").alias("kind"), c("c_custkey").alias("id")), t(s, d, "supplier").select(F.lit("supplier").alias("kind"), c("s_suppkey").alias("id"))])


@query("f12_array_length", "SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE 2 END AS n FROM events")
def f12_array_length(s, d):
    js = F.when(c("event_type") == "click", "[]").otherwise(F.to_json(F.array("props", "event_type")))
    return t(s, d, "events").select("event_id", F.json_array_length(js).alias("n"))


@query("f13_rebuilt_array", "SELECT l_orderkey, count(*)::INT AS n, string_agg(l_linenumber || '.' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def f13_rebuilt_array(s, d):
    """Elements of a nested array changed in place, in their order."""
    parts = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    edited = F.transform("p", lambda x: x.withField("label", F.concat_ws(".", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))))
    return parts.select("l_orderkey", F.size("p").alias("n"), F.array_join(edited["label"], ",").alias("parts"))


@query("g07_bounds", "SELECT event_id, least(1.0, greatest(0.0, coalesce(nullif(value, 0) / 100, 0.5))) AS x FROM events")
def g07_bounds(s, d):
    return t(s, d, "events").select("event_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nullif("value", F.lit(0.0)) / 100, F.lit(0.5)))).alias("x"))


@query("g10_decay", "SELECT o_orderkey, floor(exp(-(o_orderkey % 60) / 14.0) * 1000000 + 0.5) / 1000000 AS w FROM orders")
def g10_decay(s, d):
    return t(s, d, "orders").select("o_orderkey", half_up(F.exp(-(c("o_orderkey") % 60) / 14.0), 6).alias("w"))


@query("g12_term_rank", "SELECT doc_id, floor(tf / (tf + 1) * 1000000 + 0.5) / 1000000 AS rank FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '\\bthe\\b'))::DOUBLE AS tf FROM documents) WHERE tf > 0")
def g12_term_rank(s, d):
    tf = F.regexp_count(F.lower("text"), F.lit("\\bthe\\b")).cast("double")
    return t(s, d, "documents").withColumn("tf", tf).where("tf > 0").select("doc_id", half_up(c("tf") / (c("tf") + 1), 6).alias("rank"))


@query("g15_numerals", "SELECT l_linenumber, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'][l_linenumber] AS roman, l_linenumber AS number FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def g15_numerals(s, d):
    """Roman numerals written by a rule and read back."""
    n = t(s, d, "lineitem").select("l_linenumber").distinct().withColumn("roman", X.to_roman(c("l_linenumber")))
    return n.select("l_linenumber", "roman", X.number_of(c("roman")).cast("int").alias("number"))


# ---- dedupe and entity resolution
@query("k04_shared_chunks", """
WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, source) AS keep FROM documents)
SELECT DISTINCT quality AS chapter, keep FROM labels JOIN m USING (doc_id)""")
def k04_shared_chunks(s, d):
    """Links of equal chunks of a source move to the one kept, each once."""
    docs = t(s, d, "documents").select("doc_id", "source", F.md5(c("text").cast("binary")).alias("h"))
    keep = docs.groupBy("source", "h").agg(F.min("doc_id").alias("keep"))
    moved = docs.join(keep, ["source", "h"]).select("doc_id", "keep")
    return t(s, d, "labels").join(moved, "doc_id").select(c("quality").alias("chapter"), "keep").distinct()


@query("k10_track_sharing", """
WITH x AS (SELECT doc_id, lang, source, md5(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS k FROM documents)
SELECT DISTINCT ON (b.lang, a.k) b.lang AS into_, a.k, a.doc_id FROM x a JOIN (SELECT DISTINCT source, lang FROM x) b ON a.source = b.source AND a.lang <> b.lang WHERE NOT EXISTS (SELECT 1 FROM x c WHERE c.lang = b.lang AND c.k = a.k) ORDER BY b.lang, a.k, a.doc_id""")
def k10_track_sharing(s, d):
    """Texts offered to the other languages of their source that have no copy of them, one of each text and language."""
    x = t(s, d, "documents").select("doc_id", "lang", "source", F.md5(F.regexp_replace("text", "\\s+", "").cast("binary")).alias("k"))
    first = x.groupBy("source", "lang", "k").agg(F.min("doc_id").alias("doc_id"))
    offers = first.join(x.select("source", c("lang").alias("into_")).distinct(), "source").where("lang <> into_")
    best = offers.groupBy("into_", "k").agg(F.min("doc_id").alias("doc_id"))
    return best.join(x.select(c("lang").alias("into_"), "k").distinct(), ["into_", "k"], "left_anti")


@query("k13_stray_copies", """
WITH x AS (SELECT doc_id, source, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS f FROM documents)
SELECT doc_id FROM x a WHERE EXISTS (SELECT 1 FROM x b WHERE b.source = a.source AND b.doc_id < a.doc_id AND left(b.f, 30) = left(a.f, 30))""")
def k13_stray_copies(s, d):
    """Copies that start as an earlier text of their source does, white space apart."""
    x = t(s, d, "documents").select("doc_id", "source", F.left(F.regexp_replace("text", "\\s+", ""), F.lit(30)).alias("h"))
    first = x.groupBy("source", "h").agg(F.min("doc_id").alias("first"))
    return x.join(first, ["source", "h"]).where("doc_id > first").select("doc_id")


STOPS = "len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains([{0}], w)))"
EN, FR = (STOPS.format(", ".join(f"'{w}'" for w in words)) for words in (X.ENGLISH, X.FRENCH))


@query("k16_wrong_language", f"SELECT doc_id FROM documents WHERE lang = 'en' AND {FR} > {EN} OR lang = 'fr' AND {EN} > {FR}")
def k16_wrong_language(s, d):
    """Documents filed under English or French that read as the other."""
    found = X.language(c("text"))
    return t(s, d, "documents").where(((c("lang") == "en") & (found == "fr")) | ((c("lang") == "fr") & (found == "en"))).select("doc_id")


@query("k18_paper_probe", """
WITH d AS (SELECT doc_id, source, regexp_replace(lower(text), '[^a-z]+', '', 'g') AS f FROM documents)
SELECT i.item_id, d.doc_id, d.source FROM (SELECT item_id, left(regexp_replace(lower(text), '[^a-z]+', '', 'g'), 60) AS p FROM benchmark) i JOIN d ON length(p) = 60 AND contains(d.f, p)""")
def k18_paper_probe(s, d):
    """Which documents hold the first sixty letters of an item, by one pass over the documents' letters."""
    letters = lambda x: F.regexp_replace(F.lower(x), "[^a-z]+", "")
    probes = t(s, d, "benchmark").select("item_id", F.left(letters("text"), F.lit(60)).alias("p")).where("length(p) = 60")
    docs = t(s, d, "documents").select("doc_id", "source", letters("text").alias("f")).where("length(f) >= 60")
    return retrieval.holders(docs, probes, "f", "item_id", "p").select("item_id", "doc_id", "source")


# ---- texts
FOLDED = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
KIND = " ".join(f"WHEN regexp_matches(f, {sql_text('(?i)' + p)}) THEN '{k}'" for p, k in ((classify.ESSAY_HEADER, "essay high"), (classify.ESSAY_ORDER, "essay high"), (classify.DOCUMENT, "comprehension high"), (classify.POINTING, "concept low")))


@query("j07_question_kind", f"SELECT doc_id, CASE {KIND} ELSE 'concept high' END AS kind FROM (SELECT doc_id, {FOLDED} AS f FROM documents)")
def j07_question_kind(s, d):
    kind = classify.question_kind(classify.fold_question(c("text")))
    return t(s, d, "documents").withColumn("k", kind).select("doc_id", F.concat_ws(" ", "k.kind", "k.confidence").alias("kind"))


MESSAGE = "trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[!?.,;:…\"''«»()\\[\\]-]', ' ', 'g'), '\\s+', ' ', 'g'))"
ANY = lambda words: f"len(list_filter([{', '.join(map(sql_text, words))}], lambda p: contains(f, p))) > 0"


@query("j08_intent", f"""SELECT conv_id, turn, CASE WHEN f = '' THEN 'smalltalk' WHEN len(string_split(f, ' ')) <= 4 AND list_contains([{', '.join(map(sql_text, classify.COURTESY))}], f) THEN 'smalltalk'
WHEN len(string_split(f, ' ')) > 30 THEN 'curriculum' WHEN {ANY(classify.PLANNING)} THEN 'planning' WHEN {ANY(classify.CAPABILITY)} THEN 'capability' ELSE 'curriculum' END AS intent FROM (SELECT conv_id, turn, {MESSAGE} AS f FROM conversations)""")
def j08_intent(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", classify.intent(classify.fold_message(c("text"))).alias("intent"))


@query("j04_chunks")
def j04_chunks(s, d):
    """Chunks of each document with the source as their trail; a fold over blocks, tested on literals and by the words that it keeps."""
    found = F.pandas_udf(lambda x, y: pd.Series([layout.chunks(v or "", trail or "") for v, trail in zip(x, y, strict=True)], dtype=object), "array<struct<text:string,page:int>>")
    parts = t(s, d, "documents").select("doc_id", F.posexplode(found("text", "source")).alias("seq", "c"))
    return parts.select("doc_id", "seq", "c.text", "c.page")


@query("j17_repaired_lines")
def j17_repaired_lines(s, d):
    """Soft-wrapped lines joined; a rule of lines, tested on literals."""
    return t(s, d, "documents").select("doc_id", per_text(layout.unwrapped)("text").alias("text"))


@query("l10_moved_offsets", """
WITH x AS (SELECT doc_id, text AS a, 'Preface. ' || replace(text, ' ', '  ') AS b, length(text) // 2 AS o FROM documents WHERE length(text) > 200),
y AS (SELECT *, lower(regexp_replace(b, '\\s+', '', 'g')) AS flat, string_split(b, '') AS ch FROM x),
z AS (SELECT *, list_filter(range(1, len(ch) + 1), lambda i: NOT regexp_matches(ch[i], '\\s')) AS places FROM y),
p AS (SELECT *, unnest([60, 40, 25, 15, -60, -40, -25]) AS n, unnest(range(1, 8)) AS step FROM z),
q AS (SELECT *, lower(regexp_replace(CASE WHEN n > 0 THEN substr(a, o + 1, n) ELSE substr(a, greatest(o + n, 0) + 1, least(o, -n)) END, '\\s+', '', 'g')) AS piece FROM p),
r AS (SELECT *, instr(flat, piece) AS hit FROM q WHERE length(piece) > 0),
u AS (SELECT *, CASE WHEN n > 0 THEN places[hit] - 1 ELSE places[hit + length(piece) - 1] END AS found FROM r WHERE hit > 0 AND instr(substr(flat, hit + 1), piece) = 0)
SELECT x.doc_id, m.place::INT AS place FROM x LEFT JOIN (SELECT doc_id, arg_min(found, step) AS place FROM u GROUP BY 1) m USING (doc_id)""")
def l10_moved_offsets(s, d):
    """The middle of each text found again after an edit of its spaces and its head; lost where no piece beside it is there once."""
    docs = t(s, d, "documents").where(F.length("text") > 200)
    new = F.concat(F.lit("Preface. "), F.replace(c("text"), F.lit(" "), F.lit("  ")))
    return docs.select("doc_id", layout.moved_offset(c("text"), F.floor(F.length("text") / 2).cast("int"), new).alias("place"))


@query("j19_word_bags", """
WITH w AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark) GROUP BY 1, 2), z AS (SELECT item_id, sum(n) AS z FROM w GROUP BY 1)
SELECT a.item_id AS a, b.item_id AS b, floor(2 * sum(least(a.n, b.n)) / (x.z + y.z) * 1000 + 0.5) / 1000 AS dice FROM w a JOIN w b ON a.w = b.w AND a.item_id < b.item_id JOIN z x ON x.item_id = a.item_id JOIN z y ON y.item_id = b.item_id GROUP BY 1, 2, x.z, y.z""")
def j19_word_bags(s, d):
    """Dice overlap of the bags of words of items, over an inverted index."""
    w = t(s, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("n"))
    sized = w.withColumn("z", F.sum("n").over(Window.partitionBy("item_id")))
    side = lambda k: sized.select(c("item_id").alias(k), "w", c("n").alias(f"n{k}"), c("z").alias(f"z{k}"))
    shared = side("a").join(side("b"), "w").where("a < b").groupBy("a", "b", "za", "zb").agg(F.sum(F.least("na", "nb")).alias("m"))
    return shared.select("a", "b", half_up(2 * c("m") / (c("za") + c("zb")), 3).alias("dice"))


@query("j22_title_key", "SELECT p_partkey, trim(regexp_replace(strip_accents(lower(p_name)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM part")
def j22_title_key(s, d):
    return t(s, d, "part").select("p_partkey", X.title_key(c("p_name")).alias("key"))


# ---- structure
@query("l05_visuals", """
WITH v AS (SELECT o_custkey AS paper, o_orderkey AS visual_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS g, o_orderpriority <> '5-LOW' AS ok FROM orders WHERE o_orderstatus <> 'P'),
x AS (SELECT *, g IS NULL OR bool_and(ok) OVER (PARTITION BY paper, g) AS whole, CASE WHEN g IS NULL THEN visual_id ELSE min(visual_id) OVER (PARTITION BY paper, g) END AS head FROM v)
SELECT paper, visual_id, row_number() OVER (PARTITION BY paper ORDER BY head, visual_id)::INT AS place FROM x WHERE ok AND whole""")
def l05_visuals(s, d):
    rows = t(s, d, "orders").select(
        c("o_custkey").alias("paper"), c("o_orderkey").alias("visual_id"), F.when(c("o_orderkey") % 3 > 0, c("o_orderkey") % 4).alias("group_key"), F.lit(1).alias("group_part"),
        c("o_orderkey").alias("reading_order"), F.when(c("o_orderstatus") == "P", "retired").otherwise("active").alias("status"), "o_orderpriority",
    )
    return layout.select_visuals(rows, ["paper"], c("o_orderpriority") != "5-LOW").select("paper", "visual_id", "place")


@query("l04_owner_level", """
SELECT l_partkey, CASE WHEN count(DISTINCT CASE WHEN q THEN top END) >= 2 THEN 'EXERCISE_SHARED' WHEN count(DISTINCT CASE WHEN q THEN top END) = 0 THEN 'EXERCISE_CONTEXT'
  WHEN count(*) FILTER (q AND NOT sub) = 0 AND count(DISTINCT CASE WHEN q AND sub THEN label END) = 1 THEN 'SUBQUESTION' ELSE 'QUESTION' END AS level
FROM (SELECT l_partkey, l_returnflag <> 'N' AS q, l_linenumber % 2 AS top, l_linenumber AS label, l_linestatus = 'F' AS sub FROM lineitem) GROUP BY 1""")
def l04_owner_level(s, d):
    refs = t(s, d, "lineitem").select("l_partkey", F.when(c("l_returnflag") != "N", "question").otherwise("stimulus").alias("role"), (c("l_linenumber") % 2).alias("top"), c("l_linenumber").alias("label"), (c("l_linestatus") == "F").alias("sub"))
    return layout.owner_level(refs, ["l_partkey"])


@query("l08_bound_rows", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS n, l_partkey % 5 = 0 AS bare, l_partkey % 2 || '.' || l_partkey % 3 AS name FROM lineitem),
f AS (SELECT *, CASE WHEN NOT bare THEN (SELECT min(p.n) FROM r p WHERE p.l_orderkey = r.l_orderkey AND p.n < 3 AND p.name = r.name) END AS own FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN bare THEN last_value(own IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY n) ELSE own END AS INTEGER) AS part FROM f""")
def l08_bound_rows(s, d):
    """Lines of an order bound to the parts that its first three name; a row without a label goes with the one before, one of no part with none."""

    @F.pandas_udf("array<int>")
    def bound(keys: pd.Series) -> pd.Series:
        named = keys.map(lambda ks: [("A" if k % 2 else "B", str(k % 3 + 1)) for k in ks])
        return pd.Series([layout.bind_rows([() if k % 5 == 0 else x for k, x in zip(ks, n, strict=True)], n[:3]) for ks, n in zip(keys, named, strict=True)])

    return with_results(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), bound(c("rows")["l_partkey"]), "part")


@query("l11_page_order", """
WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 7 % 50 END AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
y AS (SELECT *, max(CASE WHEN n IS NOT NULL OR i = 1 THEN i END) OVER (PARTITION BY o_custkey ORDER BY i) AS head FROM x)
SELECT y.o_custkey, y.o_orderkey, row_number() OVER (PARTITION BY y.o_custkey ORDER BY coalesce(h.n, -1), y.head, y.i)::INT AS place FROM y JOIN x h ON h.o_custkey = y.o_custkey AND h.i = y.head""")
def l11_page_order(s, d):
    """Pages of a book in printed order; a page without a number stays behind the one before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = F.when(c("o_orderkey") % 4 > 0, c("o_orderkey") * 7 % 50)
    pages = t(s, d, "orders").withColumn("i", F.row_number().over(w)).withColumn("h", F.when(n.isNotNull() | (c("i") == 1), F.struct(F.coalesce(n, F.lit(-1)).alias("n"), c("i").alias("at"))))
    placed = pages.withColumn("h", F.last("h", ignorenulls=True).over(w))
    return placed.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("h.n", "h.at", "i")).alias("place"))


@query("l12_reading_order")
def l12_reading_order(s, d):
    """Boxes of each order as read; a recursive cut, tested on literals."""
    x = (c("l_partkey") % 2) * 0.5
    y = (c("l_linenumber") % 10) * 0.09
    boxes = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x0"), y.alias("y0"), (x + 0.4).alias("x1"), (y + 0.05).alias("y1"))

    @F.pandas_udf("array<int>")
    def places(rows: pd.Series) -> pd.Series:
        orders = [layout.reading_order([tuple(map(float, b)) for b in boxes]) for boxes in rows]
        return pd.Series([[p for _, p in sorted(zip(o, range(1, len(o) + 1), strict=True))] for o in orders])

    flat = F.transform("rows", lambda r: F.array(r["x0"], r["y0"], r["x1"], r["y1"]))
    return with_results(boxes, places(flat), "place").drop("x0", "y0", "x1", "y1")


@query("l14_union_box", "SELECT l_orderkey, min(x) AS x0, min(y) AS y0, max(x + 10) AS x1, max(y + 5) AS y1 FROM (SELECT l_orderkey, l_partkey % 100 AS x, l_suppkey % 100 AS y FROM lineitem) GROUP BY 1")
def l14_union_box(s, d):
    b = t(s, d, "lineitem").select("l_orderkey", (c("l_partkey") % 100).alias("x"), (c("l_suppkey") % 100).alias("y"))
    return b.groupBy("l_orderkey").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(c("x") + 10).alias("x1"), F.max(c("y") + 5).alias("y1"))
