"""Queries of text rules on texts that are composed line by line from the documents' and conversations' own words; SQL composes what should come out."""

import pandas as pd
from pyspark.sql import functions as F

from studylake.functions import latex, repair
from studylake.functions import text as X
from studylake.operators import layout
from studylake.plans.papers import composed, sql_lines, sql_words, whole
from studylake.registry import query
from studylake.sources.tables import table as t

c = F.col
NEW_LINE = "chr(10)"


def rule_of_lines(name, line, expected, rule, finish="x", size=8):
    """A query of a rule over composed texts, and SQL that joins the expected pieces of all lines; `finish` is SQL over their whole x."""
    sql = f"SELECT doc_id, md5({finish}) AS h FROM (SELECT doc_id, string_agg({expected}, {NEW_LINE} ORDER BY i) AS x FROM ({sql_words(size)}) GROUP BY doc_id)"

    @query(name, sql)
    def made(s, d):
        return whole(composed(s, d, line, size)).select("doc_id", F.md5(rule(c("paper")).cast("binary")).alias("h"))

    return made


def piece(cases, otherwise):
    return "CASE i % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {otherwise} END"


# ---- folds of Arabic letters. The Latin letters a to t stand for Arabic letters, digits of both kinds, a filler and a mark.
ARABIC = "translate(lower(x), 'abcdefghijklmnopqrst', 'أإآبةتىثؤئجحخدذ٣٤۵ـَ')"
ARABIC_LINE = f"{ARABIC} || '  ' || i"
LETTERS, DIGITS, MARKS = ("أإآٱىةؤئ", "اااايهوي"), ("٠١٢٣٤٥٦٧٨٩", "0123456789"), "ـًٌٍَُِّْٰ"
PERSIAN = "۰۱۲۳۴۵۶۷۸۹"


def folded(of, letters, digits):
    return f"translate({of}, '{letters[0]}{digits[0]}{MARKS}', '{letters[1]}{digits[1]}')"


rule_of_lines("j01_arabic_fold", ARABIC_LINE, ARABIC_LINE, X.fold_arabic, rf"trim(regexp_replace({folded('x', LETTERS, DIGITS)}, '\s+', ' ', 'g'))")
rule_of_lines("j02_arabic_fold_inline", ARABIC_LINE, ARABIC_LINE, X.fold_arabic_inline, rf"CASE WHEN regexp_matches(x, '[\x{{0600}}-\x{{06FF}}]') THEN trim(regexp_replace({folded('x', LETTERS, (DIGITS[0] + PERSIAN, DIGITS[1] * 2))}, '[ \t]+', ' ', 'g'), ' ') ELSE x END")
rule_of_lines("j03_fold_for_search", ARABIC_LINE, ARABIC_LINE, X.fold_for_search, rf"regexp_replace({folded('x', ('أإآٱىة', 'اااايه'), (DIGITS[0] + PERSIAN, DIGITS[1] * 2))}, '[ \t]{{2,}}', ' ', 'g')")


# ---- symbols of a font, delimiters, LaTeX
rule_of_lines("j17_symbol_font", "translate(x, 'abdpz', '\uf061\uf062\uf064\uf0a3\uf0e6')", "translate(x, 'abdpz', 'αβδ≤')", repair.without_symbol_font)

SAFE = "translate(x, chr(92) || '{}$&[]%', 'xxxxxxxx')"
B = "chr(92)"
FORMULAS = {
    0: (f"{SAFE} || ' ' || {B} || '(x^2' || {B} || ') end'", f"{SAFE} || ' $x^2$ end'"),
    1: (f"{SAFE} || ' ' || {B} || '[y' || {B} || '] there'", f"{SAFE} || ' ' || repeat({NEW_LINE}, 2) || '$$' || {NEW_LINE} || 'y' || {NEW_LINE} || '$$' || repeat({NEW_LINE}, 2) || ' there'"),
    2: (f"{SAFE} || ' $$z$$ b'", f"{SAFE} || ' $z$ b'"), 3: ("'$$z$$'", "'$$z$$'"), 4: (f"'is $٣+۴$ and ٣ ' || {SAFE}", f"'is $3+4$ and ٣ ' || {SAFE}"),
    5: (f"{SAFE} || ' $$' || {B} || 'begin{{cases}} a' || {B} || 'end{{cases}}$$'".replace("{{", "{").replace("}}", "}"), f"{SAFE} || repeat({NEW_LINE}, 2) || '$$' || {NEW_LINE} || {B} || 'begin{{cases}} a' || {B} || 'end{{cases}}' || {NEW_LINE} || '$$'".replace("{{", "{").replace("}}", "}")),
    6: (f"'a ' || {B} || {B} || '[2pt] ' || {SAFE}", f"'a ' || {B} || {B} || '[2pt] ' || {SAFE}"),
}
rule_of_lines("j17_delimiters", piece({k: v[0] for k, v in FORMULAS.items()}, SAFE), piece({k: v[1] for k, v in FORMULAS.items()}, SAFE), latex.math_delimiters)

COMMANDS = {
    0: (f"{B} || 'section{{' || {SAFE} || '}}'", f"{NEW_LINE} || '## ' || {SAFE} || {NEW_LINE}"), 1: (f"{B} || 'subsection*{{' || {SAFE} || '}}'", f"{NEW_LINE} || '### ' || {SAFE} || {NEW_LINE}"),
    2: (f"{B} || 'begin{{itemize}} ' || {B} || 'item ' || {SAFE} || ' ' || {B} || 'item[b)] z' || {B} || 'end{{itemize}}'", f"' - ' || {SAFE} || ' b) z'"),
    3: (f"{B} || 'begin{{tabular}}{{|c|c|}} ' || {B} || 'hline a & ' || {SAFE} || ' ' || {B} || {B} || ' ' || {B} || 'hline $x_{{1}}$ & 2 ' || {B} || {B} || {B} || 'end{{tabular}}'", f"'| a | ' || {SAFE} || ' |' || {NEW_LINE} || '| --- | --- |' || {NEW_LINE} || '| $x_{{1}}$ | 2 |'"),
    4: (f"{B} || 'textbf{{' || {SAFE} || '}} see $a_{{1}}$ ' || {B} || 'label{{k}}'", f"{SAFE} || ' see $a_{{1}}$ '"), 5: (f"{B} || 'caption{{' || {SAFE} || '}}'", "''"),
    6: (f"{B} || 'includegraphics[width=1]{{https://x.org/' || i || '.png}} ' || {SAFE}", f"'[figure: not extracted] ' || {SAFE}"),
}
COMMANDS = {k: tuple(x.replace("{{", "{").replace("}}", "}") for x in v) for k, v in COMMANDS.items()}
rule_of_lines("j20_latex_markdown", piece({k: v[0] for k, v in COMMANDS.items()}, SAFE), piece({k: v[1] for k, v in COMMANDS.items()}, SAFE), latex.markdown, r"regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+\n', chr(10), 'g'), '\n{3,}', repeat(chr(10), 2), 'g'), '^\s+|\s+$', '', 'g')")


# ---- J16
LABEL_LINE = "CASE (doc_id + i // 7) % 3 WHEN 0 THEN x WHEN 1 THEN left(x, 12) ELSE CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN 'Doc. ' || i WHEN 2 THEN i || ') of' ELSE left(x, 7) END END"


@query("j16_label_runs", rf"""
WITH {sql_lines(LABEL_LINE, 3)}, s AS (SELECT *, trim(line, ' ') AS s FROM lines),
told AS (SELECT *, s <> '' AND length(s) <= 14 AND len(regexp_extract_all(s, '\S+')) <= 2 AND NOT (regexp_matches(s, '^\(?(\d+(?:[-–.]\d+)*|[a-hA-H]|[IVX]{{1,4}})\s*[-–.)]\s*') AND length(s) > 3)
  AND (regexp_matches(s, '(?i)^doc\.?\s*\d+\.?$') OR NOT regexp_matches(s, '[=?]|[.!:;]$')) AS label FROM s),
runs AS (SELECT *, count(*) FILTER (s <> '' AND NOT label) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM told),
gone AS (SELECT doc_id, run FROM runs WHERE label GROUP BY ALL HAVING count(*) >= 4 AND NOT bool_or(regexp_matches(s, '[→⟶⇌⇒+•]|^[AUGCT]{{3}}\b'))),
kept AS (SELECT r.doc_id, r.i, r.line, g.run IS NOT NULL AND r.label AS dropped FROM runs r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.run = r.run)
SELECT doc_id, md5(CASE WHEN bool_or(dropped) THEN regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), ''), '\n{{3,}}', repeat(chr(10), 2), 'g'), '^\s+|\s+$', '', 'g')
  ELSE string_agg(line, chr(10) ORDER BY i) END) AS h FROM kept GROUP BY doc_id""")
def j16_label_runs(s, d):
    """Composed papers without runs of four or more labels of figures; lines of three words, of one or two, numbers and blanks."""
    line = LABEL_LINE.replace("i // 7", "CAST(floor(i / 7) AS BIGINT)")
    text = whole(composed(s, d, line, 3))
    sent = F.pandas_udf(lambda x: x.map(lambda v: None if v is None else layout.without_label_runs(v)), "string")
    return text.select("doc_id", F.md5(sent("paper").cast("binary")).alias("h"))


# ---- J18
@query("j18_accepted_tables", r"""
WITH x AS (SELECT p_partkey, 'item kind price ' || p_name || ' ' || p_type || ' ' || floor(p_retailprice)::BIGINT AS kept, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_type ELSE '' END || ' ' || CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS lost FROM part),
n AS (SELECT p_partkey, len(regexp_extract_all(lower(kept), '[\p{L}\p{N}]+')) AS b, len(regexp_extract_all(lower(lost), '[\p{L}\p{N}]+')) AS l FROM x)
SELECT p_partkey, CASE WHEN b / (b + l) >= 0.85 THEN 'converted' ELSE 'kept' END AS verdict FROM n""")
def j18_accepted_tables(s, d):
    """Tables of three columns turned into pipes, taken where the bag of words keeps its recall of 0.85 and precision of 0.80; what footnotes lose decides."""
    note = lambda x: F.concat(F.lit(r"\footnote{"), x, F.lit("}"))
    row = F.concat("p_name", F.lit(" & "), "p_type", F.when(c("p_partkey") % 3 == 0, note(F.concat_ws(" ", "p_name", "p_type"))).otherwise(""), F.lit(" & "), F.floor("p_retailprice").cast("string"), F.when(c("p_partkey") % 5 == 0, note(c("p_brand"))).otherwise(""))
    table = F.concat(F.lit("\\begin{tabular}{|l|l|r|} \\hline item & kind & price \\\\ \\hline\n"), row, F.lit(" \\\\ \\hline \\end{tabular}"))
    parts = t(s, d, "part").select("p_partkey", table.alias("old")).withColumn("new", latex.markdown(c("old")))
    bare = F.regexp_replace(F.regexp_replace("old", r"\\begin\{tabular\}\{[^}]*\}|\\end\{tabular\}", " "), r"\\[A-Za-z]+", " ")
    bag = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    both = parts.select("p_partkey", bag(bare).alias("a"), bag(c("new")).alias("b"))
    times = lambda of, w: F.size(F.filter(of, lambda x: x == w))
    common = F.aggregate(F.array_distinct("a"), F.lit(0), lambda n, w: n + F.least(times(c("a"), w), times(c("b"), w)))
    taken = (common / F.size("a") >= 0.85) & (common / F.size("b") >= 0.80)
    return both.select("p_partkey", F.when(taken, "converted").otherwise("kept").alias("verdict"))


# ---- L02: a word of its own stands after each third word of the stream, so the probes are found with gaps.
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query("l02_alignment", f"""
WITH w AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations),
sized AS (SELECT *, len(w) + len(w) // 3 AS n FROM w),
placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM sized)
SELECT conv_id, turn, CASE WHEN len(w) >= 3 THEN CAST(place AS INTEGER) END AS place, CASE WHEN len(w) >= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM placed""")
def l02_alignment(s, d):
    """Each conversation's turns aligned to its stream of words, in which every third word is followed by one that is in no turn; two probes a turn."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    turns = t(s, d, "conversations").select("conv_id", "turn", words.alias("w"))
    streams = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "w"))).alias("x"))

    found = F.pandas_udf(placed, "array<struct<turn:long,place:int,score:double>>")
    return streams.select("conv_id", F.explode(found("x")).alias("m")).select("conv_id", "m.*")


def placed(rows: pd.Series) -> pd.Series:
    return pd.Series([_aligned(turns) for turns in rows])


def _aligned(turns):
    stream, line_of, heads = [], [], []
    for i, turn in enumerate(turns):
        w = [*turn["w"]]
        spread = [x for k, word in enumerate(w) for x in ([word, "\x00"] if k % 3 == 2 else [word])]
        stream += spread
        line_of += [i] * len(spread)
        heads.append([p for p in (w[:8], w[8:16]) if len(p) >= 3])
    return [{"turn": int(turn["turn"]), "place": place, "score": score} for turn, (place, score, _, _) in zip(turns, layout.align(heads, stream, line_of), strict=True)]


# ---- J17: lines of eleven words, headings, parts, blank lines and ends of sentences among them
PLAIN = "translate(x, chr(92) || '{}$&[]%`~', 'xxxxxxxxxxx')"
WRAPPED_LINE = f"CASE (doc_id + i) % 7 WHEN 0 THEN CASE i % 3 WHEN 0 THEN '# ' || i ELSE '' END WHEN 1 THEN i % 9 || ') ' || {PLAIN} WHEN 2 THEN {PLAIN} || '.' ELSE {PLAIN} END"


@query("j17_wrapped_lines", rf"""
WITH {sql_lines(WRAPPED_LINE, 11)},
told AS (SELECT *, regexp_matches(line, '^\s*(\||#{{1,6}}\s|>|-{{3,}}|={{3,}}|```|~~~|\$\$)') AS structural, trim(line) = '' AS blank, regexp_matches(line, '[.!:?;。！？]["''”’)\]]?\s*$') AS ends,
  regexp_matches(line, '^\s*(\d+(\.\d+)*\s*[-.)\]]|[a-zA-Z]\s*[-.)\]]|[IVX]+\s*[-.)\]]|[-*•▪])') AS opens, length(trim(line)) >= 55 AS long FROM lines),
flags AS (SELECT *, i > 0 AND NOT (blank OR opens OR structural OR lag(structural) OVER w OR lag(ends) OVER w) AS goes_on, coalesce(lag(long) OVER w, false) AS after_long FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
state AS (SELECT *, goes_on AND coalesce(max(i) FILTER (after_long) OVER w, -1) > coalesce(max(i) FILTER (NOT goes_on) OVER w, -1) AS joined FROM flags WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, count(*) FILTER (NOT joined) OVER (PARTITION BY doc_id ORDER BY i) AS number FROM state)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY number)) AS h FROM (SELECT doc_id, number, string_agg(line, ' ' ORDER BY i) AS line FROM numbered GROUP BY ALL) GROUP BY doc_id""")
def j17_wrapped_lines(s, d):
    """Soft-wrapped lines of composed texts joined."""
    sent = F.pandas_udf(lambda x: x.map(lambda v: None if v is None else layout.unwrapped(v)), "string")
    return whole(composed(s, d, WRAPPED_LINE, 11)).select("doc_id", F.md5(sent("paper").cast("binary")).alias("h"))
