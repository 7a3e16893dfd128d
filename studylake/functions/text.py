"""Text rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the Arabic fold: letters that fold to one, digits, marks that go.
ARABIC_FROM = "أإآٱىةؤئ٠١٢٣٤٥٦٧٨٩"
ARABIC_TO = "اااايهوي0123456789"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
# Stop words that tell the languages apart.
ENGLISH = ("the", "and", "of", "is", "to", "in", "that", "with")
FRENCH = ("le", "la", "les", "des", "et", "est", "une", "dans", "que")
MARKS = "[\\u0640\\u064B-\\u0652\\u0670]"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFD", x))


@F.pandas_udf(StringType())
def without_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def compatible(text: Column) -> Column:
    """Compatibility forms folded; texts of ASCII and accented Latin letters have none, and are not sent to Python."""
    plain = text.rlike("^[\\x00-\\x7F\\u00C0-\\u00FF]*$")
    return F.when(plain, text).otherwise(nfkc(F.when(~plain, text)))


def fold_letters(text: Column) -> Column:
    """Compatibility forms, Arabic letters and digits folded, no marks; texts without Arabic are left after the first step."""
    plain = compatible(text)
    return F.when(plain.rlike("[\\u0600-\\u06FF]"), F.regexp_replace(F.translate(plain, ARABIC_FROM, ARABIC_TO), MARKS, "")).otherwise(plain)


def fold_arabic(text: Column) -> Column:
    """The index's fold: letters as above, all white space as one space."""
    return F.trim(F.regexp_replace(fold_letters(text), "(?U)\\s+", " "))


def fold_arabic_inline(text: Column) -> Column:
    """The query's fold: nothing without Arabic letters; Persian digits too; only runs of spaces and tabs collapse."""
    folded = F.regexp_replace(F.translate(F.translate(compatible(text), ARABIC_FROM, ARABIC_TO), PERSIAN_DIGITS, "0123456789"), MARKS, "")
    return F.when(text.rlike("[\\u0600-\\u06FF]"), F.trim(F.regexp_replace(folded, "[ \\t]+", " "))).otherwise(text)


def fold_for_search(text: Column) -> Column:
    """The loader's fold: like the index's for letters and digits of both kinds, with hamza carriers kept; only runs of spaces and tabs collapse."""
    plain = F.regexp_replace(compatible(text), MARKS, "")
    return F.regexp_replace(F.translate(plain, "أإآٱىة٠١٢٣٤٥٦٧٨٩" + PERSIAN_DIGITS, "اااايه" + "0123456789" * 2), "[ \\t]{2,}", " ")


def content_key(text: Column) -> Column:
    return F.regexp_replace(text, "\\s+", "")


def language(text: Column) -> Column:
    """ar, en, fr, mixed or null by script share and stop words. Texts are cut to words once, and Latin letters counted only where there are Arabic ones."""
    stops = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.isin(*ENGLISH, *FRENCH))
    lead = lambda own: 2 * F.size(F.filter(own, lambda w: w.isin(*ENGLISH))) - F.size(own)
    by_words = F.transform(F.array(stops), lambda own: F.sign(lead(own)))[0]
    worded = F.element_at(F.array(F.lit("fr"), F.lit(None), F.lit("en")), by_words.cast("int") + 2)
    arabic, latin = F.regexp_count(text, F.lit("[\\u0600-\\u06FF]")), F.length(F.regexp_replace(text, "[^A-Za-zÀ-ÿ]+", ""))
    scripts = F.transform(F.array(F.struct(arabic.alias("a"), latin.alias("l"))), lambda n: F.when(n["a"] > n["l"] * 2, "ar").when(n["a"] * 2 > n["l"], "mixed"))[0]
    has_arabic = text.rlike("[\\u0600-\\u06FF]")
    return F.when(has_arabic, F.coalesce(scripts, worded)).when(text.rlike("[A-Za-zÀ-ÿ]"), worded)


def title_key(title: Column) -> Column:
    """For comparing titles: lower case, no accents, all that is no letter or digit as one space."""
    return F.trim(F.regexp_replace(without_accents(F.lower(title)), "[^\\p{L}\\p{N}]+", " "))


ROMAN = (("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))


def to_roman(n: Column) -> Column:
    """1 to 39 as Roman numerals."""
    out, left = F.lit(""), n
    for letters, value in ROMAN:
        out, left = F.concat(out, F.repeat(F.lit(letters), F.floor(left / value).cast("int"))), left % value
    return out


def number_of(text: Column) -> Column:
    """The value of Western, Arabic or Persian digits, a Roman numeral up to 39, or a quarter, half or three quarters; null for others."""
    digits = F.translate(F.translate(F.trim(text), "٠١٢٣٤٥٦٧٨٩", "0123456789"), PERSIAN_DIGITS, "0123456789")
    upper = F.upper(digits)
    pairs = F.regexp_count(upper, F.lit("I(?=[VX])"))
    roman = sum((F.regexp_count(upper, F.lit(k)) * v for k, v in (("X", 10), ("V", 5), ("I", 1))), F.lit(0)) - 2 * pairs
    part = F.when(digits == "¼", 0.25).when(digits == "½", 0.5).when(digits == "¾", 0.75)
    return F.when(digits.rlike(r"^\d+([.,]\d+)?$"), F.replace(digits, F.lit(","), F.lit(".")).cast("double")).when(upper.rlike("^X{0,3}(IX|IV|V?I{0,3})$") & (upper != ""), roman.cast("double")).otherwise(part)
