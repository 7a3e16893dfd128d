"""Queries of papers' and books' structure; the papers are composed from the tables' own texts, line by line, by rules that SQL has too."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.operators import geometry, papers
from studylake.registry import query
from studylake.sources.tables import table as t

c = F.col
WORD = r"[^\\x20\\x09-\\x0D]+"


def composed(s, d, line, size):
    """doc_id, place, line: every document's words, so many a line; `line` is SQL over x (a line's words), i (its number) and doc_id, the same in both dialects."""
    words = t(s, d, "documents").select("doc_id", F.expr(f"regexp_extract_all(coalesce(text, ''), '{WORD}', 0)").alias("w"))
    n = f"CAST((size(w) + {size - 1}) / {size} AS INT)"
    cut = f"transform(if({n} > 0, sequence(0, {n} - 1), array()), k -> named_struct('i', CAST(k AS BIGINT), 'x', array_join(slice(w, {size} * k + 1, {size}), ' ')))"
    lines = words.select("doc_id", F.posexplode(F.expr(cut)).alias("place", "l")).select("doc_id", "place", "l.*")
    return lines.select("doc_id", "place", F.expr(line).alias("line"))


def whole(lines):
    """doc_id, paper: the lines of each document together."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("paper"))


def sql_words(size):
    """SQL of the lines' words: doc_id, i, x."""
    return rf"""SELECT doc_id, i, array_to_string(list_slice(w, {size} * i + 1, {size} * i + {size}), ' ') AS x FROM (
  SELECT doc_id, w, unnest(range(0, (len(w) + {size - 1}) // {size})) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents))"""


def sql_lines(line, size):
    """SQL of a common table `lines`: doc_id, i, line."""
    return f"lines AS (SELECT doc_id, i, {line} AS line FROM ({sql_words(size)}))"


# ---- L06
KIND = "((doc_id * 7 + i * 5) % 11)"
PAPER_LINE = f"""CASE {KIND} WHEN 0 THEN 'Exercise ' || (1 + i % 9) || ' (' || (3 + i % 6) || ' points) ' || x WHEN 1 THEN chr(CAST(65 + i % 3 AS INT)) || '- ' || x WHEN 2 THEN (1 + i % 4) || ') ' || x
  WHEN 3 THEN (1 + i % 4) || ') ' || x WHEN 4 THEN chr(CAST(97 + i % 3 AS INT)) || '. ' || x WHEN 5 THEN '1-' || (1 + i % 3) || ': ' || x WHEN 6 THEN '9) ' || left(x, 2) ELSE x END
  || CASE WHEN {KIND} BETWEEN 2 AND 5 AND i % 4 = 0 THEN ' (' || (1 + i % 3) || '.5 pts)' ELSE '' END"""


def re2(pattern):
    return pattern.replace("'", "''")


@query("l06_paper_parts", f"""
WITH {sql_lines(PAPER_LINE, 8)},
told AS (SELECT *, regexp_extract(line, '{re2(papers.HEAD)}', 1) AS head, regexp_extract(line, '{re2(papers.SECTION)}', 1) AS sec, regexp_extract(line, '{re2(papers.PART)}', 1) AS lab, regexp_extract(line, '{re2(papers.PART)}', 2) AS body FROM lines),
state AS (SELECT *, CASE WHEN head <> '' THEN 'h' WHEN sec <> '' THEN 's' WHEN lab <> '' THEN 'p' END AS kind FROM told),
numbered AS (SELECT *, count(*) FILTER (kind = 'h') OVER w AS exercise, count(kind) OVER w AS opened FROM state WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
sectioned AS (SELECT *, last_value(CASE WHEN kind = 's' THEN sec || '.' WHEN kind = 'h' THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section, first_value(kind) OVER g AS opener, first_value(lab) OVER g AS label
  FROM numbered WINDOW g AS (PARTITION BY doc_id, opened ORDER BY i)),
parts AS (SELECT doc_id, exercise, coalesce(section, '') || translate(label, '-–', '..') AS label, i, CASE WHEN kind = 'p' THEN body ELSE line END AS piece FROM sectioned WHERE opener = 'p'),
joined AS (SELECT doc_id, exercise, label, trim(regexp_replace(string_agg(piece, ' ' ORDER BY i), '[ \\t]+', ' ', 'g'), ' ') AS answer, min(i) AS place FROM parts GROUP BY ALL)
SELECT doc_id, CAST(exercise AS INTEGER) AS exercise, label, sha256(answer) AS answer_sha256, TRY_CAST(replace(nullif(regexp_extract(answer, '{re2(papers.STATED)}', 1), ''), ',', '.') AS DOUBLE) AS marks, CAST(place AS INTEGER) AS place
FROM joined WHERE length(answer) >= {papers.LEAST_ANSWER}""".replace("\\\\t", "\\t"))
def l06_paper_parts(s, d):
    """Papers of all documents' words: heads, sections, labels of three forms, stated marks, lines that go on, labels that come again."""
    found = papers.paper_parts(whole(composed(s, d, PAPER_LINE, 8)), "doc_id", "paper")
    return found.select("doc_id", "exercise", "label", F.sha2("answer", 256).alias("answer_sha256"), "marks", "place")


# ---- L07
@query("l07_scheme_rows", """
WITH r AS (SELECT p_partkey // 12 AS g, p_partkey % 12 AS r, (p_partkey // 12) % 3 AS kind, p_name FROM part),
kinds AS (SELECT g, count(*) + 1 AS n, count(*) FILTER (r % 4 <> 3) AS labels, count(*) FILTER (r % 4 <> 3) AS marks FROM r GROUP BY 1),
led AS (SELECT g, r, p_name, kind, CASE WHEN r % 4 = 3 THEN (SELECT max(b.r) FROM r b WHERE b.g = a.g AND b.r < a.r) ELSE r END AS lead FROM r a WHERE kind < 2 AND g IN (SELECT g FROM kinds WHERE n >= 3 AND labels >= n * 0.5 AND marks >= n * 0.4)),
own AS (SELECT *, CASE WHEN kind = 1 AND lead = 5 AND EXISTS (SELECT 1 FROM r b WHERE b.g = led.g AND b.r = 4) THEN 4 ELSE lead END AS source FROM led WHERE lead IS NOT NULL)
SELECT g AS paper, 0 AS "table", (1 + source // 3) || '.' || chr(CAST(97 + source % 3 AS INTEGER)) AS label, string_agg(p_name, ' ' ORDER BY r) AS answer, CAST(0.5 + (source % 3) * 0.5 AS DOUBLE) AS mark FROM own GROUP BY g, source""")
def l07_scheme_rows(s, d):
    """Marking schemes of twelve parts each: a third as lines of pipes, a third as HTML from right to left with cells that span rows and columns, a third that are no schemes."""
    r, kind = c("p_partkey") % 12, F.floor(c("p_partkey") / 12) % 3
    label = F.concat((F.floor(r / 3) + 1).cast("string"), F.lit("."), F.chr(97 + r % 3))
    mark = (0.5 + r % 3 * 0.5).cast("string")
    goes_on = r % 4 == 3
    pipe = F.concat(F.lit("| "), F.when(goes_on, "").otherwise(label), F.lit(" | "), "p_name", F.lit(" | "), F.when(goes_on, "").when(kind == 2, F.lit("see above")).otherwise(mark), F.lit(" |"))
    td = lambda x, more="": F.concat(F.lit(f"<td{more}>"), x, F.lit("</td>"))
    html = F.concat(F.lit("<tr>"), td(F.when(goes_on, "").otherwise(mark)), td(c("p_name")), F.when(r == 4, td(label, " rowspan=2")).when((r == 5) & c("after_4"), "").otherwise(td(F.when(goes_on, "").otherwise(label))), F.lit("</tr>"))
    parts = t(s, d, "part").select("p_partkey", "p_name", F.floor(c("p_partkey") / 12).alias("paper"))
    fours = parts.where(r == 4).select("paper", F.lit(True).alias("after_4"))
    rows = parts.join(fours, "paper", "left").fillna(False, ["after_4"]).select("paper", r.alias("r"), F.when(kind == 1, html).otherwise(pipe).alias("line"), kind.alias("kind"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    title = F.concat(F.lit("Scheme of paper "), c("paper").cast("string"))
    texts = rows.groupBy("paper", "kind").agg(body.alias("b")).select("paper", F.when(c("kind") == 1, F.concat(F.lit("<table><tr><th colspan=3>"), title, F.lit("</th></tr>\n"), "b", F.lit("</table>"))).otherwise(F.concat(F.lit("| "), title, F.lit(" | | |\n| --- | --- | --- |\n"), "b")).alias("text"))
    return papers.scheme_rows(papers.table_cells(texts, "paper", "text"), "paper")


# ---- L09
BOOK = r"""docs AS (SELECT doc_id, doc_id // 20 AS book, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS j, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sized AS (SELECT *, 1 + len(w) // 300 AS n, CASE WHEN len(w) = 0 THEN 'Untitled' ELSE array_to_string(list_slice(w, 1, 5), ' ') END AS title FROM docs),
entries AS (SELECT book, j AS place, title, CAST(3 + coalesce(sum(n) OVER (PARTITION BY book ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS page, n,
  CASE WHEN j % 4 = 0 THEN (j // 4 + 1)::VARCHAR ELSE (j // 4 + 1) || '.' || (j % 4) END AS number, CASE WHEN j % 4 = 0 THEN 1 ELSE 2 END AS depth, CASE WHEN j % 4 > 0 THEN j - j % 4 END AS parent FROM sized),
pages AS (SELECT book, page + book % 5 + 2 + k AS scan, CASE WHEN k = 0 THEN title ELSE title || ' ' || k END AS head FROM (SELECT *, unnest(range(0, n)) AS k FROM entries) UNION ALL SELECT book, unnest(range(1, 3 + book % 5 + 2)), 'Front' FROM (SELECT DISTINCT book FROM entries))"""


def books(s, d):
    """(contents: book, text; pages: book, scan, title). A book is the documents of twenty ids; a document is a chapter or section, its length its pages."""
    docs = t(s, d, "documents").select("doc_id", F.floor(c("doc_id") / 20).alias("book"), F.expr(f"regexp_extract_all(coalesce(text, ''), '{WORD}', 0)").alias("w"))
    from pyspark.sql.window import Window

    order = Window.partitionBy("book").orderBy("doc_id")
    title = F.when(F.size("w") == 0, "Untitled").otherwise(F.array_join(F.slice("w", 1, 5), " "))
    sized = docs.select("book", "doc_id", (1 + F.floor(F.size("w") / 300)).alias("n"), title.alias("title"), (F.row_number().over(order) - 1).alias("j"))
    page = 3 + F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.concat((F.floor(c("j") / 4) + 1).cast("string"), F.when(c("j") % 4 > 0, F.concat(F.lit("."), (c("j") % 4).cast("string"))).otherwise(""))
    rows = sized.select("book", "j", "n", "title", page.alias("page"), number.alias("number"))
    line = F.concat("number", F.lit(" "), "title", F.lit(" ..... "), c("page").cast("string"))
    contents = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("j", line.alias("line")))).alias("l")).select("book", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    shift = c("book") % 5 + 2
    inner = rows.select("book", F.posexplode(F.sequence(F.lit(0), c("n") - 1)).alias("p", "k"), "title", (c("page") + shift).alias("at")).select("book", (c("at") + c("k")).alias("scan"), F.when(c("k") == 0, c("title")).otherwise(F.concat_ws(" ", "title", c("k").cast("string"))).alias("title"))
    front = rows.select("book").distinct().select("book", F.explode(F.sequence(F.lit(1).cast("long"), shift + 2)).alias("scan"), F.lit("Front").alias("title"))
    return contents, inner.unionByName(front)


@query("l09_contents", f"WITH {BOOK} SELECT book, CAST(place AS INTEGER) AS place, number, title, page, depth, CAST(parent AS INTEGER) AS parent FROM entries")
def l09_contents(s, d):
    """Entries of composed contents pages with what they lie under."""
    return papers.contents(books(s, d)[0], "book", "text")


@query("l09_page_offsets", f"""WITH {BOOK},
votes AS (SELECT e.book, p.scan - e.page AS "offset", count(*) AS votes FROM entries e JOIN pages p ON p.book = e.book AND p.head = e.title WHERE p.scan - e.page BETWEEN -5 AND 60 GROUP BY ALL)
SELECT book, "offset", votes FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY votes DESC, abs("offset"), "offset") AS k FROM votes) WHERE k = 1""")
def l09_page_offsets(s, d):
    """The offset of each book's scan, by votes of the pages that titles head; copied documents vote for wrong ones."""
    contents, pages = books(s, d)
    return papers.page_offsets(papers.contents(contents, "book", "text"), pages, "book")


@query("l09_chapter_pages", f"""WITH {BOOK} SELECT p.book, p.scan, CAST((SELECT max(place) FROM entries e WHERE e.book = p.book AND e.page + p.book % 5 + 2 <= p.scan) AS INTEGER) AS place FROM pages p""")
def l09_chapter_pages(s, d):
    """Every page of every book in the span of one entry, by the offset that the votes gave."""
    contents, pages = books(s, d)
    entries = papers.contents(contents, "book", "text")
    return papers.chapter_pages(entries, papers.page_offsets(entries, pages, "book"), pages, "book")


# ---- L04
NOUN = "CASE i % 3 WHEN 0 THEN 'Document' WHEN 1 THEN 'Figure' ELSE 'Table' END"
FIGURE_LINE = f"""CASE (doc_id + i) % 4 WHEN 0 THEN {NOUN} || ' ' || (1 + i % 7) || CASE WHEN i % 5 = 0 THEN 'a' ELSE '' END || '. ' || x
  WHEN 1 THEN 'Use documents ' || (1 + i % 3) || ' to ' || (3 + i % 4) || ', ' || (5 + i % 3) || 'a; then explain: ' || x || '?' WHEN 2 THEN 'See fig. ' || (1 + i % 7) || ' and tables ' || (1 + i % 4) || '-' || (2 + i % 4) || '. ' || x ELSE '> ' || x END"""


@query("l04_named_owners", f"""
WITH {sql_lines(FIGURE_LINE, 6)},
captions AS (SELECT doc_id, i AS caption, lower(split_part({NOUN}, ' ', 1)) AS kind, 1 + i % 7 AS number, CASE WHEN i % 5 = 0 THEN 'a' ELSE '' END AS suffix FROM lines WHERE (doc_id + i) % 4 = 0),
asked AS (
  SELECT doc_id, i, 'document' AS kind, CAST(unnest(range(1 + i % 3, 4 + i % 4)) AS BIGINT) AS number, '' AS suffix FROM lines WHERE (doc_id + i) % 4 = 1 AND 3 + i % 4 > 1 + i % 3
  UNION SELECT doc_id, i, 'document', unnest([1 + i % 3, 3 + i % 4]), '' FROM lines WHERE (doc_id + i) % 4 = 1
  UNION SELECT doc_id, i, 'document', 5 + i % 3, 'a' FROM lines WHERE (doc_id + i) % 4 = 1
  UNION SELECT doc_id, i, 'figure', 1 + i % 7, '' FROM lines WHERE (doc_id + i) % 4 = 2
  UNION SELECT doc_id, i, 'table', unnest([1 + i % 4, 2 + i % 4]), '' FROM lines WHERE (doc_id + i) % 4 = 2)
SELECT a.doc_id, CAST(a.i AS INTEGER) AS place, a.kind, CAST(a.number AS INTEGER) AS number, a.suffix, CAST(arg_min(caption, (abs(caption - a.i), caption)) AS INTEGER) AS caption
FROM asked a LEFT JOIN captions k ON k.doc_id = a.doc_id AND k.kind = a.kind AND k.number = a.number AND (k.suffix = a.suffix OR k.suffix = '' OR a.suffix = '') GROUP BY ALL""")
def l04_named_owners(s, d):
    """Figures that the lines of composed papers name, in lists and ranges, with the caption that owns each."""
    return papers.owners_named(composed(s, d, FIGURE_LINE, 6).select("doc_id", "place", c("line").alias("text")), "doc_id")


# ---- L03, L14: pages of orders. Lines that were returned are figures, the others stretches of exercises, four to a page.
ROWS = """rows AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS n FROM lineitem),
figures AS (SELECT l_orderkey, n AS figure, 1 + n // 4 AS page, CAST(l_partkey % 900 AS DOUBLE) AS top, CAST(l_partkey % 900 + 40 + l_suppkey % 80 AS DOUBLE) AS bottom, CAST(100 + l_partkey % 800 AS DOUBLE) AS width FROM rows WHERE l_returnflag = 'R'),
stretches AS (SELECT l_orderkey, 1 + n // 4 AS page, 1 + n // 3 AS ordinal, CAST(n % 4 * 250 + floor(l_quantity) AS DOUBLE) AS top, CAST(n % 4 * 250 + floor(l_quantity) + 60 + floor(l_discount * 1000) AS DOUBLE) AS bottom FROM rows WHERE l_returnflag <> 'R')"""


def order_pages(s, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    rows = t(s, d, "lineitem").withColumn("n", F.row_number().over(order) - 1)
    page, top = F.floor(c("n") / 4) + 1, (c("l_partkey") % 900).cast("double")
    figures = rows.where("l_returnflag = 'R'").select("l_orderkey", c("n").alias("figure"), page.alias("page"), top.alias("top"), (top + 40 + c("l_suppkey") % 80).alias("bottom"), (100 + c("l_partkey") % 800).cast("double").alias("width"), F.lit(1000.0).alias("page_height"), F.lit(1000.0).alias("page_width"))
    start = (c("n") % 4 * 250 + F.floor("l_quantity")).cast("double")
    stretches = rows.where("l_returnflag <> 'R'").select("l_orderkey", page.alias("page"), (F.floor(c("n") / 3) + 1).alias("ordinal"), start.alias("top"), (start + 60 + F.floor(c("l_discount") * 1000)).alias("bottom"))
    return figures, stretches


@query("l03_figure_places", f"""
WITH {ROWS},
over AS (SELECT f.l_orderkey, f.figure, arg_max(s.ordinal, (greatest(0, least(f.bottom, s.bottom) - greatest(f.top, s.top)), -s.top)) AS inside FROM figures f JOIN stretches s USING (l_orderkey, page)
  WHERE greatest(0, least(f.bottom, s.bottom) - greatest(f.top, s.top)) / greatest(1.0, f.bottom - f.top) >= 0.5 GROUP BY ALL),
above AS (SELECT f.l_orderkey, f.figure, max((s.page, s.bottom, s.ordinal)) AS a FROM figures f JOIN stretches s ON s.l_orderkey = f.l_orderkey AND (s.page, s.bottom) <= (f.page, (f.top + f.bottom) / 2) GROUP BY ALL),
below AS (SELECT f.l_orderkey, f.figure, min((s.page, s.top, s.ordinal)) AS b FROM figures f JOIN stretches s ON s.l_orderkey = f.l_orderkey AND (s.page, s.top) >= (f.page, (f.top + f.bottom) / 2) GROUP BY ALL),
met AS (SELECT f.*, inside, a, b, f.page = 1 AND f.top <= 200 AND f.width >= 600 AND f.bottom - f.top <= 70 AND NOT EXISTS (SELECT 1 FROM stretches s WHERE s.l_orderkey = f.l_orderkey AND s.page = 1 AND s.top < f.bottom) AS banner
  FROM figures f LEFT JOIN over USING (l_orderkey, figure) LEFT JOIN above USING (l_orderkey, figure) LEFT JOIN below USING (l_orderkey, figure)),
told AS (SELECT *, CASE WHEN banner THEN 'BANNER' WHEN inside IS NOT NULL THEN 'INSIDE' WHEN a[3] = b[3] THEN CASE WHEN a[1] = page AND b[1] = page THEN 'INSIDE' ELSE 'CONTINUATION' END ELSE 'GAP' END AS relation FROM met)
SELECT l_orderkey, figure, relation, CASE WHEN relation IN ('BANNER', 'GAP') THEN NULL ELSE coalesce(inside, a[3]) END AS owner,
  CASE WHEN relation = 'GAP' THEN a[3] END AS above, CASE WHEN relation = 'GAP' AND a IS NOT NULL THEN CASE WHEN a[1] <> page THEN 'DISTANT' WHEN top - a[2] <= 100 THEN 'NEAR' ELSE 'SAME_PAGE' END END AS above_relation,
  CASE WHEN relation = 'GAP' THEN b[3] END AS below, CASE WHEN relation = 'GAP' AND b IS NOT NULL THEN CASE WHEN b[1] <> page THEN 'DISTANT' WHEN b[2] - bottom <= 100 THEN 'NEAR' ELSE 'SAME_PAGE' END END AS below_relation,
  CASE WHEN relation = 'BANNER' THEN 'BANNER' WHEN relation <> 'GAP' THEN 'UNIQUE' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'MULTIPLE' WHEN a IS NULL AND b IS NULL THEN 'NONE' ELSE 'WEAK' END AS verdict FROM told""")
def l03_figure_places(s, d):
    """Figures of composed pages, inside stretches, between them, before and after all, and banners."""
    return geometry.figure_places(*order_pages(s, d), "l_orderkey")


@query("l14_grown_boxes")
def l14_grown_boxes(s, d):
    """Figures of composed pages that grow to the short lines around them: the brands and sizes of the parts; a naive loop in the tests gives the same."""
    figures, stretches = order_pages(s, d)
    left = (c("figure") * 37 % 400).cast("double")
    boxes = figures.select("l_orderkey", "page", c("figure").alias("box"), left.alias("x0"), c("top").alias("y0"), (left + 200).alias("x1"), c("bottom").alias("y1"))
    where = F.hash("l_orderkey", "page", "ordinal", "top")
    at = (F.pmod(where, F.lit(500))).cast("double")
    text = F.when(F.pmod(where, F.lit(5)) == 0, "12.5").when(F.pmod(where, F.lit(7)) == 0, "a label that is much too long").otherwise(F.concat(F.lit("Fig. "), c("ordinal").cast("string")))
    height = c("top") + F.pmod(where, F.lit(60))
    lines = stretches.select("l_orderkey", "page", (c("top") * 10).cast("long").alias("line"), at.alias("x0"), height.alias("y0"), (at + 80 + F.pmod(where, F.lit(90))).alias("x1"), (height + 18).alias("y1"), text.alias("text"))
    return geometry.grown_boxes(boxes, lines, ["l_orderkey", "page"])
