"""Repair of scanned and converted texts, page gates and the content monitor, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Symbols that a font put at private code points, by their low byte; pieces of tall brackets, which go.
SYMBOLS = {
    0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2A: "∗", 0x2D: "−", 0x40: "≅", 0x5C: "∴", 0x5E: "⊥", 0x60: "‾", 0x7E: "∼",
    **dict(zip(range(0x41, 0x5B), "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ", strict=True)),
    **dict(zip(range(0x61, 0x7B), "αβχδεφγηιϕκλμνοπθρστυϖωξψζ", strict=True)),
    **dict(zip(range(0xA1, 0xA7), "ϒ′≤⁄∞ƒ", strict=True)),
    **dict(zip(range(0xAB, 0xBD), "↔←↑→↓°±″≥×∝∂•÷≠≡≈…", strict=True)),
    **dict(zip(range(0xC0, 0xD2), "ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇", strict=True)),
    **dict(zip(range(0xD5, 0xE2), "∏√⋅¬∧∨⇔⇐⇑⇒⇓◊⟨", strict=True)), 0xE5: "∑", 0xF1: "⟩", 0xF2: "∫",
}
BRACKET_PIECES = {*range(0xE6, 0xF0), *range(0xF3, 0xFF)}
#: Private code points are E000 to F8FF; each page of 256 repeats the font.
_PRIVATE = [(chr(page << 8 | low), SYMBOLS.get(low) or (chr(low) if 0x20 <= low <= 0x7E else "")) for page in range(0xE0, 0xF9) for low in range(256)]
_SHOWN = [(a, b) for a, b in _PRIVATE if b and (ord(a) & 0xFF) not in BRACKET_PIECES]


def without_symbol_font(text: Column) -> Column:
    """Private code points as the symbols they stood for; pieces of brackets, unknown glyphs and invisible operators go."""
    shown = F.translate(text, "".join(a for a, _ in _SHOWN), "".join(b for _, b in _SHOWN))
    return F.when(text.rlike("[\ue000-\uf8ff\u2061-\u2064]"), F.regexp_replace(shown, "[\ue000-\uf8ff\u2061-\u2064]", "")).otherwise(text)


# Fixed values of a paper's furniture: mark cells, footers, letterheads with all spaces removed, and the length of the longest.
_DIGIT = "[0-9٠-٩۰-۹]"
_DAY = "(?:السبت|الأحد|الاثنين|الإثنين|الثلاثاء|الأربعاء|الخميس|الجمعة)"
MARK_LINE = r"(?i)^\s*\(?\s*(?:[ء-يـ\s]{0,30}علام[ء-يـ\s]*|نصف علامة|[0-9٠-٩۰-۹.,½]+\s*(?:pts?|points?|marks?|علامة|علامات)\.?)\s*\)?\s*$"
FOOTER_LINE = (
    r"(?i)^\s*(?:العادي\s?ة|الاستثنائي\s?ة|مشروع|" + _DAY + r"\s+" + _DIGIT + r"{1,2}\s+\S+\s*" + _DIGIT + r"{0,4}|دورة (?:العام|سنة)\s*" + _DIGIT + "{0,4}.{0,20}|امتحانات الشهادة الثانوية.{0,40}"
    r"|وزارة التربية.{0,40}|المديري\s?ة العامة.{0,30}|دائرة الامتحانات.{0,30}|Session (?:ordinaire|extraordinaire).{0,20}|(?:Ordinary|Extraordinary) session.{0,20}|[1-9]\s*/\s*[1-9]|Page\s*[0-9]+\s*(?:of|sur|/)\s*[0-9]+)\s*$"
)
LETTERHEAD = (
    r"(?i)^(?:مشروع|العادية|الاستثنائية|للمكفوفين|" + _DAY + _DIGIT + r"{1,2}\S{2,8}" + _DIGIT + r"{0,4}|دورة(?:العام|سنة)" + _DIGIT + r"{0,4}\S{0,12}|امتحاناتالشهادةالثانوية\S{0,20}|وزارةالتربية\S{0,30}"
    r"|المديريةالعامة\S{0,20}|دائرةالامتحانات\S{0,20}|فرعا?\S{0,40}|مسابقةفيمادة\S{0,30}|المدة:?\S{0,30}|الاسم:?|الرقم:?|(?:Nom|Name|Num[ée]ro|Number):?)$"
)
SMALL_FRACTION, BARE_FIELD = r"^\s*[1-9]\s*/\s*[1-9]\s*$", r"(?i)^\s*(?:nom|name|num[ée]ro|number|الاسم|الرقم)\s*$"
LONGEST = 60


def without_furniture(text: Column) -> Column:
    """Text without the block of mark cells and footers at its end, a lone mark cell excepted, and without footers between its lines."""
    lines = F.split(text, "\n", -1)
    footer = lambda x: (F.length(F.trim(x)) <= LONGEST) & (x.rlike(FOOTER_LINE) | F.regexp_replace(x, "[\\sـً-ْ]+", "").rlike(LETTERHEAD))
    told = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at"), F.when(x.rlike("^\\s*$"), "blank").when(x.rlike(MARK_LINE), "mark").when(footer(x), "footer").otherwise("text").alias("kind"), (footer(x) & ~x.rlike(SMALL_FRACTION) & ~x.rlike(BARE_FIELD)).alias("inside")))
    body = F.coalesce(F.array_max(F.transform(F.filter(told, lambda s: s["kind"] == "text"), lambda s: s["at"])), F.lit(-1))
    state = F.struct(told.alias("told"), body.alias("body"))

    def cleaned(s: Column) -> Column:
        block = F.filter(s["told"], lambda x: x["at"] > s["body"])
        marks = F.size(F.filter(block, lambda x: x["kind"] == "mark")) >= 2
        gone = lambda x: ((x["at"] > s["body"]) & ((x["kind"] == "footer") | ((x["kind"] == "mark") & marks))) | (x["inside"] & (x["kind"] != "blank"))
        kept = F.transform(F.filter(s["told"], lambda x: ~gone(x)), lambda x: x["line"])
        return F.when(F.exists(s["told"], gone), F.regexp_replace(F.array_join(kept, "\n"), r"(?:\A|\n)\s*\z", "")).otherwise(text)

    return F.transform(F.array(state), cleaned)[0]


# Fixed values of the page gates: confidence, share of weak tokens, lengths against the book's median, words of an n-gram, repeats and cover of a loop.
CONFIDENCE, WEAK, SHORT, LONG, GRAM, REPEATS, COVER = 0.85, 0.08, 0.4, 2.5, 8, 3, 0.15


def repeated_gram(text: Column, n: int = GRAM) -> Column:
    """struct(most, coverage): how often the most frequent n-gram of words stands in a text, and the share of the words that it covers; 0 for under 2 n words."""
    words = F.filter(F.split(text, "\\s+", -1), lambda w: w != "")
    grams = lambda w: F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))
    start = F.struct(F.lit("").alias("gram"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def count(s: Column, gram: Column) -> Column:
        run = F.when(s["gram"] == gram, s["run"] + 1).otherwise(1)
        return F.struct(gram.alias("gram"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    most = lambda w: F.when(F.size(w) < 2 * n, 0).otherwise(F.aggregate(grams(w), start, count, lambda s: s["most"]))
    made = lambda w: F.transform(F.array(most(w)), lambda m: F.struct(m.alias("most"), F.when(m == 0, 0.0).otherwise(m * n / F.size(w)).alias("coverage")))[0]
    return F.transform(F.array(words), made)[0]


def page_flags(text: Column, confidence: Column, weak: Column, median: Column) -> Column:
    """The gates that a page fails, in order."""
    size = F.length(text)
    rules = [
        ("low-confidence", confidence < CONFIDENCE), ("many-weak-tokens", weak > WEAK), ("empty", text.rlike("^\\s*$")),
        ("short-page", ~text.rlike("^\\s*$") & (size < median * SHORT)), ("long-page", ~text.rlike("^\\s*$") & (size > median * LONG)),
        ("repetition-loop", F.transform(F.array(repeated_gram(text)), lambda r: (r["most"] > REPEATS) & (r["coverage"] > COVER))[0]),
        ("presentation-forms", text.rlike("[\ufb50-\ufdff\ufe70-\ufeff]")), ("tatweel", F.contains(text, F.lit("ـ"))), ("arabic-indic-digits", text.rlike("[٠-٩۰-۹]")),
    ]
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())


# Fixed values of the monitor: patterns of damage, of a cover, of Arabic text, of missing answers and texts, of unusable exercises; the longest item.
MINISTRY, ARABIC_RUN = r"وزارة\s+التربية\s+والتعليم\s+العالي", r"[\p{IsArabic}\p{M}]{3,}(?:\s+[\p{IsArabic}\p{M}]{2,}){2,}"
BROKEN = "\ufffd|Ã[\u0080-\u00bf]|Â[\u0080-\u00bf]|â(?:€™|€œ|€|€“|€”)"
PLACEHOLDER = r"(?i)no (?:worked |official )?answer (?:was )?recorded|no solution (?:was )?recorded"
NEEDS_TEXT = r"(?i)(?:dans|d'après|selon|en vous (?:appuyant|basant) sur) (?:le )?texte"
FRENCH_PARTS = (r"(?i)(?:^|\n)\s*I\s*[-–—.]\s*Questions\b", r"(?i)(?:^|\n)\s*II\s*[-–—.]\s*Production\s+[ée]crite\b")
PROMPT = r"(?:^|\n)\s*[0-9]{1,2}\s*[-.)]"
JUDGEMENT = (r"(?i)expliquez\s+ce\s+jugement", r"(?i)probl[ée]matique\s+qu[’']?il\s+soul[èe]ve", r"(?i)discutez\s+ce\s+jugement")
ECONOMY = (r"(?i)balance\s+commerciale", r"\bPIB\b", r"(?i)unit[ée]s?\s+mon[ée]taires?", r"(?i)flux\s+financiers?", r"(?i)pouvoir\s+d[’']achat", r"(?i)co[uû]t\s+de\s+production", r"(?i)libert[ée]\s+[ée]conomique")
ANSWER_KEY = r"(?i)(?:(?:questions?\s+)?r[ée]ponses?|[ée]l[ée]ments?\s+de\s+r[ée]ponse)\s+crit[èe]res?\s+d[’']?[ée]valuation"
OVERSIZED, MANY_PROMPTS, LONG_PAPER, FRENCH_COURSE = 5000, 4, 800, "Francais"
CRITICAL = ("broken_encoding", "foreign_cover", "foreign_script", "placeholder_answer", "invalid_french_exercise", "missing_passage", "broken_textbook_text")


def monitor(chapters: DataFrame, items: DataFrame, passages: DataFrame) -> DataFrame:
    """severity, code, track, subject, chapter, item_id: what is wrong with the content of chapters that are not cancelled; one item may have several rows.

    chapters: chapter, subject, track, language, cancelled. items: chapter, item_id, text, latex, passage, official, model, rejected. passages: chapter, item_id, text.
    """
    live = chapters.where(~F.coalesce("cancelled", F.lit(False))).drop("cancelled")
    counts = lambda df, name: df.groupBy("chapter").agg(F.count("*").alias(name))
    seen = live.join(counts(passages, "passages"), "chapter", "left").join(counts(items, "items"), "chapter", "left")
    empty = F.array(F.when(F.col("passages").isNull(), F.lit("no_textbook_material")), F.when(F.col("items").isNull(), F.lit("no_practice")))
    found = [seen.select("track", "subject", "chapter", F.col("chapter").cast("string").alias("item_id"), F.explode(empty).alias("code"))]

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    text, bodies, answers = F.col("text"), ("text", "latex", "passage"), ("official", "model")
    some = lambda columns, pattern: F.concat_ws("\n\n", *[blank(c) for c in columns]).rlike(pattern)
    count = lambda patterns: sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))
    latin, cover = F.col("language") != "ar", some(bodies, MINISTRY)
    french = (count(FRENCH_PARTS) == 2) | ((F.length(text) > LONG_PAPER) & (F.regexp_count(text, F.lit(PROMPT)) >= MANY_PROMPTS)) | (count(JUDGEMENT) == 3) | (count(ECONOMY) >= 2) | text.rlike(ANSWER_KEY)
    rules = {
        "broken_encoding": some(bodies + answers, BROKEN), "foreign_cover": cover & latin, "foreign_script": latin & ~cover & some(bodies + answers, ARABIC_RUN),
        "placeholder_answer": some(answers, PLACEHOLDER), "invalid_french_exercise": (F.col("subject") == FRENCH_COURSE) & french,
        "missing_passage": text.rlike(NEEDS_TEXT) & (F.trim(blank("passage")) == ""),
        "missing_answer": ~F.coalesce("rejected", F.lit(False)) & (F.trim(blank("official")) == "") & (F.trim(blank("model")) == ""), "oversized_item": F.length(text) > OVERSIZED,
    }
    codes = F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()])
    place = live.select("chapter", "track", "subject", "language")
    found.append(items.join(place, "chapter").select("track", "subject", "chapter", F.col("item_id").cast("string").alias("item_id"), F.explode(codes).alias("code")))
    broken = passages.where(text.rlike(BROKEN)).join(place, "chapter")
    found.append(broken.select("track", "subject", "chapter", F.col("item_id").cast("string").alias("item_id"), F.lit("broken_textbook_text").alias("code")))
    every = found[0].unionByName(found[1]).unionByName(found[2]).where("code is not null")
    return every.select(F.when(F.col("code").isin(*CRITICAL), "critical").otherwise("warning").alias("severity"), "code", "track", "subject", "chapter", "item_id")
