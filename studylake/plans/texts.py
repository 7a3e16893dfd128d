"""Text, dedupe, data repair, file and job queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.functions import repair
from studylake.functions import text as X
from studylake.functions.core import half_up
from studylake.operators import relational as R
from studylake.operators import words
from studylake.registry import query
from studylake.sources import files
from studylake.sources.tables import table as t

c = F.col


def text_hash():
    return F.md5(c("text").cast("binary"))


@query("a03_csv_round_trip", "SELECT doc_id, text, lang FROM documents")
def a03_csv_round_trip(s, d):
    path = files.shared_path(s, "csv")
    files.write_csv(t(s, d, "documents").select("doc_id", "text", "lang"), path)
    return files.read_csv(s, path, "doc_id long, text string, lang string")


@query("a07_nested_json", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def a07_nested_json(s, d):
    path = files.shared_path(s, "json")
    t(s, d, "nation").coalesce(1).agg(F.collect_list(F.struct(c("n_nationkey").alias("k"), c("n_name").alias("name"))).alias("papers")).write.json(path)
    return files.read_nested(s, path, "papers array<struct<k:int,name:string>>", "papers")


@query("a13_manifest", "SELECT CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM orders GROUP BY 1")
def a13_manifest(s, d):
    orders = t(s, d, "orders")
    saved = files.manifest(orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    edited = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(c("o_orderkey") % 7 == 0, "X").otherwise(c("o_orderstatus")).alias("o_orderstatus"))
    return files.compare_manifests(saved, files.manifest(edited, "o_orderkey")).groupBy("state").agg(F.count("*").alias("n"))


@query("a15_snapshot", "SELECT * FROM region")
def a15_snapshot(s, d):
    path = files.shared_path(s, "snapshot")
    region = t(s, d, "region")
    region.write.parquet(path)
    return s.read.schema(region.schema).parquet(path)


@query("a17_ndjson", "SELECT conv_id, turn, role, text FROM conversations")
def a17_ndjson(s, d):
    path = files.shared_path(s, "ndjson")
    files.write_ndjson(t(s, d, "conversations"), path)
    return files.read_ndjson(s, path, "conv_id long, turn long, role string, text string")


#: Texts in compatibility forms and with accents, and what the folds make of them (literals: the tables' texts have none of the former).
FORMS = [("ﬁne ①②", "fine 12"), ("ＡＢＣ　１", "ABC 1"), ("x²½", "x21⁄2"), ("ﻼ", "لا"), ("plain", "plain"), ("Å", "Å")]


@query("g04_nfkc", "SELECT doc_id, md5(text) AS h FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, md5('{b}'))" for i, (_, b) in enumerate(FORMS)) + ")")
def g04_nfkc(s, d):
    """The tables' texts are in compatibility form already, so the fold leaves them as they are; the literals are not."""
    texts = t(s, d, "documents").select("doc_id", "text").unionByName(s.createDataFrame([(-i - 1, a) for i, (a, _) in enumerate(FORMS)], "doc_id long, text string"))
    return texts.select("doc_id", F.md5(X.nfkc(c("text")).cast("binary")).alias("h"))


@query("g05_accents", "SELECT doc_id, md5(replace(strip_accents(replace(text, 'ß', chr(1))), chr(1), 'ß')) AS h FROM documents")
def g05_accents(s, d):
    """Marks of decomposed letters go; a letter that does not decompose stays (the SQL's function would spell ß out, so it is set aside there)."""
    return t(s, d, "documents").select("doc_id", F.md5(X.without_accents(c("text")).cast("binary")).alias("h"))


@query("g16_stated_marks", "SELECT item_id, try_cast(list_last(list_filter(regexp_extract_all(right(text, 220), '[0-9]+'), lambda x: len(x) < 3)) AS INT) AS marks FROM benchmark")
def g16_stated_marks(s, d):
    last = F.filter(F.regexp_extract_all(F.right("text", F.lit(220)), F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x) < 3)
    return t(s, d, "benchmark").select("item_id", F.try_element_at(last, F.lit(-1)).try_cast("int").alias("marks"))


@query("j05_identity", "SELECT sha256(source || ':' || text) AS id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def j05_identity(s, d):
    return t(s, d, "documents").groupBy(F.sha2(F.concat("source", F.lit(":"), "text"), 256).alias("id")).agg(F.min("doc_id").alias("doc_id"))


# Fixed values of the kinds of passages, in the order in which they are tried.
KINDS = (
    ("definition", "\\b(definition|définition)\\b|تعريف|on appelle|est appelée?|est appelé|on dit qu|est dite?\\b|se définit|is called|is defined|we call|on nomme|يسمى|يعرف بأنه"),
    ("theorem", "\\b(theorem|théorème|property|propriété|corollaire|corollary|lemme|lemma|axiome|axiom)\\b|نظرية|مبرهنة|خاصية|il en résulte que|on en déduit que"),
    ("worked_example", "\\b(example|exemple|worked|application|activité|activity)\\b|مثال|تطبيق"),
    ("formula", "[$][$]"),
)
#: The edge of a word of ASCII letters, digits and underscores, as the patterns mean it.
ASCII_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: What the tables' texts are given to exercise the kinds, by the remainder of their id.
LEADS = {0: "On appelle suite ", 1: "Le théorème de ", 2: "Worked example: ", 3: "$$x$$ ", 4: "يسمى العدد ", 5: "is calledback", 6: "propriétés "}
LED = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LEADS.items()) + " ELSE '' END || text"


@query("j06_kind", f"SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(x, '{p}') THEN '{k}'" for k, p in KINDS)} ELSE 'method' END AS kind FROM (SELECT doc_id, lower({LED}) AS x FROM documents)")
def j06_kind(s, d):
    """Kinds of passages: what each text asserts most, with leads that exercise them."""
    text = F.lower(F.expr(LED))
    kind = F.lit("method")
    for name, pattern in reversed(KINDS):
        kind = F.when(text.rlike(pattern.replace("\\b", ASCII_EDGE)), name).otherwise(kind)
    return t(s, d, "documents").select("doc_id", kind.alias("kind"))


@query("j09_language", r"""
SELECT doc_id, CASE WHEN l = 0 THEN NULL WHEN e > f THEN 'en' WHEN f > e THEN 'fr' END AS language FROM (
  SELECT doc_id, len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) AS l,
    (SELECT count(*) FROM (SELECT unnest(string_split_regex(x, '[^\p{L}\p{N}_]+')) AS w) WHERE w IN ('the','and','of','is','to','in','that','with')) AS e,
    (SELECT count(*) FROM (SELECT unnest(string_split_regex(x, '[^\p{L}\p{N}_]+')) AS w) WHERE w IN ('le','la','les','des','et','est','une','dans','que')) AS f
  FROM (SELECT doc_id, text, lower(text) AS x FROM documents))""")
def j09_language(s, d):
    return t(s, d, "documents").select("doc_id", X.language(c("text")).alias("language"))


GRAMS = "SELECT doc_id, g, count(*) AS n, any_value(z) AS z FROM (SELECT doc_id, z, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT doc_id, w, len(w) AS z, unnest(range(1, len(w) - 6)) AS i FROM (SELECT doc_id, {0} AS w FROM documents) WHERE len(w) >= 16)) GROUP BY 1, 2"
SPLIT = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
#: Texts with the letters that only some scripts have, by the remainder of the id, and readings of them, as the tables have none.
PAGE = "text || CASE doc_id % 9 WHEN 0 THEN ' ـ' WHEN 1 THEN ' ﻼ' WHEN 2 THEN ' ٣' ELSE '' END"
CONF, WEAK = "0.75 + (doc_id % 11) / 50.0D", "(doc_id % 13) / 100.0D"


@query("j10_page_gates", f"""
WITH p AS (SELECT doc_id, source, {PAGE} AS text, {CONF.replace('D', '::DOUBLE')} AS conf, {WEAK.replace('D', '::DOUBLE')} AS weak FROM documents),
m AS (SELECT source, median(length(text)) AS m FROM p GROUP BY 1),
g AS (SELECT doc_id, max(n) AS n, max(n) * 8 / any_value(z) AS cover FROM ({GRAMS.format(SPLIT).replace('FROM documents', 'FROM p')}) GROUP BY 1)
SELECT doc_id, array_to_string(list_filter([CASE WHEN conf < 0.85 THEN 'low-confidence' END, CASE WHEN weak > 0.08 THEN 'many-weak-tokens' END, CASE WHEN length(text) < m * 0.4 THEN 'short-page' WHEN length(text) > m * 2.5 THEN 'long-page' END,
  CASE WHEN g.n > 3 AND cover > 0.15 THEN 'repetition-loop' END, CASE WHEN contains(text, 'ﻼ') THEN 'presentation-forms' END, CASE WHEN contains(text, 'ـ') THEN 'tatweel' END, CASE WHEN contains(text, '٣') THEN 'arabic-indic-digits' END], lambda x: x IS NOT NULL), ',') AS flags
FROM p JOIN m USING (source) LEFT JOIN g USING (doc_id)""")
def j10_page_gates(s, d):
    """Every gate of a page against the median of its source; the text is looked at where it is, and only lengths are grouped."""
    pages = t(s, d, "documents").select("doc_id", "source", F.expr(PAGE).alias("text"), F.expr(CONF).alias("conf"), F.expr(WEAK).alias("weak"))
    medians = pages.groupBy("source").agg(F.median(F.length("text")).alias("m"))
    return pages.join(medians, "source").select("doc_id", F.array_join(repair.page_flags(c("text"), c("conf"), c("weak"), c("m")), ",").alias("flags"))


@query("j11_repeated_ngram", f"SELECT d.doc_id, coalesce(n, 0)::INT AS most, coalesce(floor(n * 8 / z * 1000000 + 0.5) / 1000000, 0) AS coverage FROM documents d LEFT JOIN (SELECT doc_id, max(n) AS n, any_value(z) AS z FROM ({GRAMS.format(SPLIT)}) GROUP BY 1) g USING (doc_id)")
def j11_repeated_ngram(s, d):
    """Counted within each text, without a shuffle."""
    return t(s, d, "documents").select("doc_id", repair.repeated_gram(c("text")).alias("r")).select("doc_id", "r.most", half_up(c("r.coverage"), 6).alias("coverage"))


@query("j12_rare_words", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents), v AS (SELECT w, count(*) AS n FROM w GROUP BY 1),
o AS (SELECT doc_id, floor(count(*) FILTER (n < 2) / count(*) * 1000 + 0.5) / 1000 AS odd FROM w JOIN v USING (w) GROUP BY 1),
k AS (SELECT doc_id, source, len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]')) AS a, len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) AS l FROM documents),
b AS (SELECT source, sum(a) > sum(l) AS arabic FROM k GROUP BY 1),
r AS (SELECT doc_id, source, odd, floor(CASE WHEN arabic THEN l ELSE a END / (a + l) * 1000 + 0.5) / 1000 AS script FROM k JOIN b USING (source) JOIN o USING (doc_id) WHERE a + l > 0)
SELECT source, doc_id, odd, script FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor((odd * 2 + script) * 1000 + 0.5) DESC, doc_id) AS rn FROM r) WHERE rn <= 12""")
def j12_rare_words(s, d):
    """The twelve worst pages of each source: share of words that the corpus has once, and of letters of the other script.

    A word that stands once has one document, so the documents need no join with the vocabulary.
    """
    pages, once = words.counts_and_single_words(t(s, d, "documents"), "doc_id", "text", ["source"])
    rare = once.groupBy("doc_id").agg(F.count("*").alias("rare"))
    pages = pages.where("n > 0 and a + l > 0")
    book = pages.groupBy("source").agg((F.sum("a") > F.sum("l")).alias("arabic"))
    told = pages.join(rare, "doc_id", "left").join(book, "source")
    told = told.select("source", "doc_id", half_up(F.coalesce("rare", F.lit(0)) / c("n"), 3).alias("odd"), half_up(F.when(c("arabic"), c("l")).otherwise(c("a")) / (c("a") + c("l")), 3).alias("script"))
    return R.top_per_group(told, ["source"], [F.desc(F.floor((c("odd") * 2 + c("script")) * 1000 + 0.5)), c("doc_id")], 12).select("source", "doc_id", "odd", "script")


#: Chapters, items and passages made of the tables: what the monitor looks for is put into some texts, by the remainder of the id.
CHAPTER = "doc_id % 53"
ITEM_TEXT = "CASE doc_id % 17 WHEN 0 THEN 'Relevez dans le texte deux mots. ' WHEN 1 THEN 'Flux financiers et PIB. ' WHEN 2 THEN 'prix de lâ€™eau ' WHEN 3 THEN 'وزارة التربية والتعليم العالي ' WHEN 4 THEN 'see هذا النص العربي الطويل ' ELSE '' END || text"
ANSWER = "CASE doc_id % 7 WHEN 0 THEN 'No official answer was recorded.' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'because' END"


@query("j14_monitor", f"""
WITH ch AS (SELECT k AS chapter, 'T' || k % 3 AS track, CASE k % 4 WHEN 0 THEN 'Francais' ELSE 'S' || k % 4 END AS subject, CASE WHEN k % 4 = 1 THEN 'ar' ELSE 'fr' END AS language FROM (SELECT unnest(range(0, 60)) AS k) WHERE k % 10 <> 9),
it AS (SELECT {CHAPTER} AS chapter, doc_id::VARCHAR AS item_id, {ITEM_TEXT} AS text, {ANSWER} AS official, doc_id % 5 = 0 AS rejected FROM documents),
pa AS (SELECT conv_id % 57 AS chapter, conv_id || '-' || turn AS item_id, CASE WHEN turn % 5 = 1 THEN 'lâ€™eau ' ELSE '' END || text AS text FROM conversations),
j AS (SELECT * FROM it JOIN ch USING (chapter)),
x AS (
  SELECT 'no_textbook_material' AS code, track, subject, chapter, chapter::VARCHAR AS item_id FROM ch WHERE chapter NOT IN (SELECT chapter FROM pa)
  UNION ALL SELECT 'no_practice', track, subject, chapter, chapter::VARCHAR FROM ch WHERE chapter NOT IN (SELECT chapter FROM it)
  UNION ALL SELECT 'broken_encoding', track, subject, chapter, item_id FROM j WHERE contains(text, 'â€™')
  UNION ALL SELECT 'foreign_cover', track, subject, chapter, item_id FROM j WHERE language <> 'ar' AND contains(text, 'وزارة التربية')
  UNION ALL SELECT 'foreign_script', track, subject, chapter, item_id FROM j WHERE language <> 'ar' AND contains(text, 'هذا النص العربي')
  UNION ALL SELECT 'placeholder_answer', track, subject, chapter, item_id FROM j WHERE official LIKE 'No %'
  UNION ALL SELECT 'invalid_french_exercise', track, subject, chapter, item_id FROM j WHERE subject = 'Francais' AND (contains(text, 'Flux financiers et PIB') OR length(text) > 800 AND len(regexp_extract_all(text, '(?:^|\n)\\s*[0-9]{{1,2}}\\s*[-.)]')) >= 4)
  UNION ALL SELECT 'missing_passage', track, subject, chapter, item_id FROM j WHERE contains(text, 'dans le texte')
  UNION ALL SELECT 'missing_answer', track, subject, chapter, item_id FROM j WHERE NOT rejected AND trim(coalesce(official, '')) = ''
  UNION ALL SELECT 'oversized_item', track, subject, chapter, item_id FROM j WHERE length(text) > 5000
  UNION ALL SELECT 'broken_textbook_text', track, subject, chapter, item_id FROM pa JOIN ch USING (chapter) WHERE contains(text, 'lâ€™eau'))
SELECT CASE WHEN code IN ('no_textbook_material', 'no_practice', 'missing_answer', 'oversized_item') THEN 'warning' ELSE 'critical' END AS severity, * FROM x""")
def j14_monitor(s, d):
    """All codes of the content monitor; sorted, it reads critical first, then by track, subject, chapter and code."""
    k = c("id")
    chapters = s.range(60).select(k.alias("chapter"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("track"), F.when(k % 4 == 0, "Francais").otherwise(F.concat(F.lit("S"), (k % 4).cast("string"))).alias("subject"), F.when(k % 4 == 1, "ar").otherwise("fr").alias("language"), (k % 10 == 9).alias("cancelled"))
    none = F.lit(None).cast("string")
    items = t(s, d, "documents").select(F.expr(CHAPTER).alias("chapter"), c("doc_id").alias("item_id"), F.expr(ITEM_TEXT).alias("text"), none.alias("latex"), none.alias("passage"), F.expr(ANSWER).alias("official"), none.alias("model"), (c("doc_id") % 5 == 0).alias("rejected"))
    passages = t(s, d, "conversations").select((c("conv_id") % 57).alias("chapter"), F.concat_ws("-", "conv_id", "turn").alias("item_id"), F.concat(F.when(c("turn") % 5 == 1, "lâ€™eau ").otherwise(""), "text").alias("text"))
    return repair.monitor(chapters, items, passages).orderBy("severity", "track", "subject", "chapter", "code")


#: What ends a paper or stands between its lines, by the remainder of the id, and what of it stays.
TAILS = {0: "(2 points)|(0.5 pt)|Page 2 of 3||", 1: "(2 points)|Session ordinaire 2019", 2: "1/2", 3: "الاستثنائيّة|٣ علامات|علامتان ونصف", 4: "Name:", 5: "plain end"}
KEPT = {0: "", 1: "(2 points)", 2: "", 3: "", 4: "", 5: "plain end"}
INSIDE = "Ordinary session of 2020"


def _cases(values):
    own = " ".join(f"WHEN {k} THEN " + " || chr(10) || ".join(f"'{x}'" for x in v.split("|")) for k, v in values.items())
    return f"CASE doc_id % 6 {own} END"


@query("j15_furniture", f"""
SELECT doc_id, md5(CASE WHEN e = '' THEN regexp_replace(text, '(?:^|\n)\\s*$', '') ELSE text || chr(10) || e END) AS h FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS text, {_cases(KEPT)} AS e FROM documents WHERE length(text) > 100)""")
def j15_furniture(s, d):
    """Texts with furniture between their first line and the rest and at their end lose it, a lone mark excepted."""
    flat = F.regexp_replace("text", "\\s+", " ")
    paper = F.concat(F.lit(INSIDE + "\n"), flat, F.lit("\n"), F.expr(_cases(TAILS)))
    return t(s, d, "documents").where(F.length("text") > 100).select("doc_id", F.md5(repair.without_furniture(paper).cast("binary")).alias("h"))


@query("j21_content_key", "SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS k FROM documents")
def j21_content_key(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.content_key(c("text")).cast("binary")).alias("k"))


@query("k01_exact_groups", "SELECT doc_id, survivor FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY (quality IS NOT NULL) DESC, doc_id) AS survivor FROM documents LEFT JOIN labels USING (doc_id)) WHERE doc_id <> survivor")
def k01_exact_groups(s, d):
    """The best of each group by an aggregate that combines before the shuffle, so a group of a third of all rows is no single task's."""
    docs = t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left").select("doc_id", text_hash().alias("h"), c("quality").isNull().alias("bare"))
    best = docs.groupBy("h").agg(F.min(F.struct("bare", "doc_id")).alias("b"))
    return docs.join(best, "h").select("doc_id", c("b.doc_id").alias("survivor")).where("doc_id <> survivor")


@query("k02_prefix_groups", "SELECT left(text, 120) AS k, source, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def k02_prefix_groups(s, d):
    return t(s, d, "documents").groupBy(F.left("text", F.lit(120)).alias("k"), "source").agg(F.count("*").alias("n")).where("n > 1")


@query("k03_remap", "SELECT DISTINCT coalesce(s, l_partkey) AS part, l_suppkey FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS s FROM part) ON p_partkey = l_partkey")
def k03_remap(s, d):
    part = t(s, d, "part")
    kept = part.join(part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("s")), ["p_name", "p_brand"]).select(c("p_partkey").alias("l_partkey"), "s")
    return t(s, d, "lineitem").join(kept, "l_partkey", "left").select(F.coalesce("s", "l_partkey").alias("part"), "l_suppkey").distinct()


@query("k05_orphans", "SELECT count(*) AS n FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)")
def k05_orphans(s, d):
    return t(s, d, "labels").join(t(s, d, "documents"), "doc_id", "left_anti").agg(F.count("*").alias("n"))


@query("k11_twins_across", "SELECT DISTINCT a.source AS a, b.source AS b FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.source < b.source")
def k11_twins_across(s, d):
    """Pairs of sources with a common text; copies within a source count once, and there are few sources."""
    each = t(s, d, "documents").select(text_hash().alias("h"), "source").distinct()
    return each.select("h", c("source").alias("a")).join(each.select("h", c("source").alias("b")), "h").where("a < b").select("a", "b").distinct()


@query("k12_duplicate_names", "SELECT name, n FROM (SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1) WHERE n > 1")
def k12_duplicate_names(s, d):
    return t(s, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query("k15_thin", "SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) < 60")
def k15_thin(s, d):
    return t(s, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("doc_id").alias("docs")).where("docs < 60")


@query("l13_majority_offset", "SELECT source, o FROM (SELECT source, o, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, abs(o), o) AS rn FROM (SELECT source, (n_chars % 7) - 3 AS o FROM documents) GROUP BY 1, 2) WHERE rn = 1")
def l13_majority_offset(s, d):
    votes = t(s, d, "documents").groupBy("source", (c("n_chars") % 7 - 3).alias("o")).agg(F.count("*").alias("n"))
    return R.distinct_on(votes, ["source"], [F.desc("n"), F.abs("o"), c("o")]).select("source", "o")


@query("n02_insert_missing", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM (VALUES (100, 'NEW')) v")
def n02_insert_missing(s, d):
    new = s.createDataFrame([(1, "OTHER"), (100, "NEW")], "n_nationkey int, n_name string")
    return R.insert_missing(t(s, d, "nation").select("n_nationkey", "n_name"), new, ["n_nationkey"])


@query("n03_upsert", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 1 UNION ALL SELECT * FROM (VALUES (1, 'OTHER'), (100, 'NEW')) v")
def n03_upsert(s, d):
    new = s.createDataFrame([(1, "OTHER"), (100, "NEW")], "n_nationkey int, n_name string")
    return R.latest_wins(t(s, d, "nation").select("n_nationkey", "n_name"), new, ["n_nationkey"])


@query("n06_sweep", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_orderdate < TIMESTAMP '1998-01-01' OR o_totalprice > 400000 OR o_orderpriority = '1-URGENT') ORDER BY o_orderdate, o_orderkey LIMIT 50")
def n06_sweep(s, d):
    due = (c("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")) | (c("o_totalprice") > 400000) | (c("o_orderpriority") == "1-URGENT")
    return t(s, d, "orders").where((c("o_orderstatus") == "O") & due).orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("n08_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-23'")
def n08_purge(s, d):
    return t(s, d, "events").where(c("ts") >= F.lit("2024-01-23").cast("timestamp_ntz")).select("event_id")


@query("j13_split_words", """
WITH w AS (SELECT doc_id, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS x FROM documents)), v AS (SELECT w FROM w GROUP BY 1 HAVING count(*) >= 5)
SELECT a.doc_id, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN v ON v.w = a.w || b.w GROUP BY 1""")
def j13_split_words(s, d):
    x = t(s, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("x"))
    v = x.select(F.explode("x").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n >= 5").select("w")
    pairs = F.zip_with("x", F.slice("x", 2, F.size("x") + 1), lambda a, b: F.concat(a, b))
    return x.select("doc_id", F.explode(pairs).alias("w")).where("w is not null").join(v, "w").groupBy("doc_id").agg(F.count("*").alias("n"))
