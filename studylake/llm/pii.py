"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern; each is validated (calendar dates, Luhn card numbers, IBAN remainder, address octets, number ranges)
and permuted by a keyed Feistel network over the set of values of its own format. Equal values get equal pseudonyms in every document, and
different values get different ones: each network is a permutation, and the sets of different formats have no value in common.

* Character networks: the two halves of the digits and letters; each round shifts every character of one half within its class (0-9, a-z,
  A-Z) by a keyed hash of the other half. Separators stay. Cards keep a valid check digit, other numbers of their lengths an invalid one,
  IBANs valid check digits. Of telephone numbers the country code and leading zeros stay; the rest is permuted alike however it is
  written, so that an international and a national form of one number are linked.
* Number networks over Z_a x Z_b: social security numbers, IPv4 addresses, and dates of 1900 to 2099 by month and day. A date keeps the
  number and padding of its digits; month-first dates are those that cannot be day-first, and stay so.

Where a network's set is a little larger than the format's, it is applied again until the value is in the format (cycle walking), up to
WALK times; that some value needs more has a probability below 10^-30, and it is then left as it is.

The key never stands in a plan: networks use a key derived from it, which a scalar subquery over a local relation supplies.

Defined results: null and empty texts stay as they are; values that fail validation stay; ties and repeated rows get equal results; an
empty table gives an empty result. Other columns pass through; a column named like the count column is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm._common import spare

#: Rounds of every network, and the most times that one is applied to get back into a format.
ROUNDS, WALK = 8, 60

#: Country codes of telephone numbers that have one or two digits; all others have three (fixed values of the numbering plan).
COUNTRY_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Lengths of IBANs by country (fixed values of the registry); of other countries any length is tried.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_IBANS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())

#: Candidate formats, tried in this order at each place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++",
    "iban": rf"(?<![A-Za-z0-9])(?:(?:{_IBANS})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day": r"(?<![0-9./])[0-9]{1,2}([./])[0-9]{1,2}\SEP[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,5}(?![0-9])",
    "number": r"(?<![A-Za-z0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
    # ten digits with an area code, or a trunk zero with groups of two or a code and one or two groups
    "national": r"(?<![A-Za-z0-9+./-])(?:(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|(?:\(0[0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /-])[0-9]{3,8}(?:[ -][0-9]{3,4})?)(?![A-Za-z0-9])(?![./-][0-9])",
}
PATTERNS["day"] = PATTERNS["day"].replace(r"([./])", "[./]").replace(r"\SEP", "[./]")
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No candidate is without one of these.
NEEDED = "[0-9]{3}|@|[0-9][ ./-][0-9]|[+][0-9]|[A-Z]{2}[0-9]{2}"


def _keyed(key: Column, kind: str, turn: Column, value: Column, bits: int) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), value), bits)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _walked(value: Column, step: Callable[[Column], Column], inside: Callable[[Column], Column]) -> Column:
    """value after one step or more, until it is inside the format; null if WALK steps do not lead there."""

    def turn(s: Column, _: Column) -> Column:
        return F.when(s["ok"], s).otherwise(_let(step(s["v"]), lambda v: F.struct(v.alias("v"), inside(v).alias("ok"))))

    start = F.struct(value.alias("v"), F.lit(False).alias("ok"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, turn, lambda s: F.when(s["ok"], s["v"]))


def _shifted(half: Column, digest: Column) -> Column:
    """Each letter or digit moves within its class by four hexadecimal digits of the digest."""

    def shift(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        moved = lambda first, size: F.char(F.pmod(F.ascii(c) - first + by, F.lit(size)) + first)
        return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26)).when(c.between("A", "Z"), moved(65, 26)).otherwise(c)

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), shift), ""))


def _characters(value: Column, key: Column, kind: str) -> Column:
    """The character network; a half has at most 32 characters, as many as a digest has shifts."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, _shifted(s["l"], _keyed(key, kind, i, s["r"], 512))).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(_shifted(s["r"], _keyed(key, kind, i, s["l"], 512)))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _numbers(x: Column, y: Column, a: int | Column, b: int | Column, key: Column, kind: str) -> Column:
    """The network over Z_a x Z_b, as struct(x, y)."""

    def by(i: Column, other: Column, size: int | Column) -> Column:
        return F.pmod(F.conv(F.substring(_keyed(key, kind, i, other.cast("string"), 256), 1, 15), 16, 10).cast("long"), F.lit(size))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["x"] + by(i, s["y"], a), F.lit(a))).otherwise(s["x"])
        right = F.when(even, s["y"]).otherwise(F.pmod(s["y"] + by(i, s["x"], b), F.lit(b)))
        return F.struct(left.cast("long").alias("x"), right.cast("long").alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def _refill(shape: Column, value: Column, skip: int = 0) -> Column:
    """shape with its letters and digits (after the first `skip`) replaced, in order, by those of value."""

    def put(s: Column, c: Column) -> Column:
        own = c.rlike("^[A-Za-z0-9]$")
        text = F.when(own & (s["i"] > skip), F.concat(s["t"], F.substring(value, (s["i"] - skip).cast("int"), F.lit(1)))).otherwise(F.concat(s["t"], c))
        return F.struct(text.alias("t"), F.when(own, s["i"] + 1).otherwise(s["i"]).alias("i"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), put, lambda s: s["t"])


def _luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload + digit valid."""
    digits = F.reverse(F.split(payload, ""))
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, d: s + d), F.lit(10)).cast("string")


def _remainder97(value: Column) -> Column:
    """value's remainder by 97, letters read as 10 to 35."""

    def add(s: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.pmod(F.when(letter, s * 100 + F.ascii(c) - 55).otherwise(s * 10 + F.ascii(c) - 48), F.lit(97)).cast("int")

    return F.aggregate(F.split(value, ""), F.lit(0), add)


def _month_days(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _real(year: Column, month: Column, day: Column) -> Column:
    return year.between(1900, 2099) & month.between(1, 12) & (day >= 1) & (day <= _month_days(year, month))


def _moved_date(year: Column, month: Column, day: Column, months: tuple[Column | int, Column | int], days: tuple[Column | int, Column | int], key: Column, kind: str) -> Column:
    """struct(year, month, day) of the pseudonym of a real date, among the real dates with such months and days: first, how many."""
    (month_1, n_months), (day_1, n_days) = ((F.lit(first), F.lit(n)) for first, n in (months, days))
    start = F.struct(((year - 1900) * n_months + month - month_1).cast("long").alias("x"), (day - day_1).cast("long").alias("y"))
    date = lambda v: F.struct((F.floor(v["x"] / n_months) + 1900).cast("int").alias("year"), (F.pmod(v["x"], n_months) + month_1).cast("int").alias("month"), (v["y"] + day_1).cast("int").alias("day"))
    inside = lambda v: _let(date(v), lambda d: _real(d["year"], d["month"], d["day"]))
    return _let(_walked(start, lambda v: _numbers(v["x"], v["y"], n_months * 200, n_days, key, kind), inside), date)


def _as_written(number: Column, width: Column, other: Column, most: int) -> tuple[Column, Column]:
    """First, how many: the numbers up to `most` that are written in as many digits, and with a leading zero or not where the other part's one digit tells."""
    long_ = (width == 2) & (other == 1) & (number > 9)
    return F.when(long_, 10).otherwise(1), F.when(long_, most - 9).when((width == 1) | (other == 1), 9).otherwise(most)


def _moved_telephone(digits: Column, key: Column) -> Column:
    """Telephone digits after the country code: leading zeros stay, the rest is permuted among the numbers that begin with no zero."""
    core = F.regexp_replace(digits, "^0+", "")
    moved = _walked(core, lambda v: _characters(v, key, "phone"), lambda v: ~v.startswith("0"))
    return F.when(F.length(core) < 4, digits).otherwise(F.concat(F.regexp_extract(digits, "^0*", 0), F.coalesce(moved, core)))


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one candidate; the candidate itself if it is not valid."""
    whole = {k: "^(?:" + p + ")$" for k, p in PATTERNS.items()}
    part = lambda i: F.regexp_extract(m, r"^([0-9]+)[^0-9]([0-9]+)[^0-9]([0-9]+)$", i)
    one, two, three = (part(i).try_cast("int") for i in (1, 2, 3))
    padded = lambda value, width: F.lpad(value.cast("string"), width, "0")

    local = F.substring_index(m, "@", 1)
    email = F.concat(_refill(local, _characters(F.regexp_replace(local, "[^A-Za-z0-9]", ""), key, "email")), F.substring(m, F.length(local) + 1, F.length(m)))

    plain = F.regexp_replace(m, "[^A-Za-z0-9]", "")
    body = F.substring(plain, F.lit(5), F.length(plain))
    country = F.substring(plain, 1, 2)
    check = lambda moved: F.lpad((F.lit(98) - _remainder97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.when(_remainder97(F.concat(body, F.substring(plain, 1, 4))) == 1, _refill(m, _let(_characters(body, key, "iban"), lambda moved: F.concat(country, check(moved), moved)))).otherwise(m)

    octet = lambda i: F.regexp_extract(m, r"^([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)$", i).try_cast("int")
    spread = lambda s: F.concat_ws(".", *[(F.shiftright(s[h], n) % 256).cast("string") for h in "xy" for n in (8, 0)])
    ip = F.when((octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256) & (octet(4) < 256), _let(_numbers(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, key, "ip"), spread)).otherwise(m)

    iso = F.when(_real(one, two, three), _let(_moved_date(one, two, three, (1, 12), (1, 31), key, "date"), lambda d: F.concat_ws("-", d["year"].cast("string"), padded(d["month"], 2), padded(d["day"], 2)))).otherwise(m)
    wide, wide2 = F.length(part(1)), F.length(part(2))
    signs = [F.regexp_extract(m, "^[0-9]+([./])[0-9]+([./])", i) for i in (1, 2)]
    written = lambda a, b, y: F.concat(padded(a, wide), signs[0], padded(b, wide2), signs[1], y.cast("string"))
    day_first = _let(_moved_date(three, two, one, _as_written(two, wide2, wide, 12), _as_written(one, wide, wide2, 31), key, "date"), lambda d: written(d["day"], d["month"], d["year"]))
    month_first = _let(_moved_date(three, one, two, (1, F.when(wide == 1, 9).otherwise(12)), (13, 19), key, "month first"), lambda d: written(d["month"], d["day"], d["year"]))
    day = F.when(_real(three, two, one), day_first).when(_real(three, one, two), month_first).otherwise(m)

    # areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999
    area = one - F.when(one > 666, 2).otherwise(1)
    rebuilt = lambda s: F.concat_ws("-", *[padded(v, n) for v, n in ((F.floor(s["x"] / 99) + F.when(F.floor(s["x"] / 99) > 664, 2).otherwise(1), 3), (s["x"] % 99 + 1, 2), (s["y"] + 1, 4))])
    ssn = F.when(one.between(1, 899) & (one != 666) & (two > 0) & (three > 0), _let(_numbers(area * 99 + two - 1, three - 1, 898 * 99, 9999, key, "ssn"), rebuilt)).otherwise(m)

    digits = F.regexp_replace(m, "[^0-9]", "")
    telephone = lambda head: F.concat(head, _moved_telephone(F.substring(digits, F.length(head) + 1, F.length(digits)), key))
    phone = F.when(F.length(digits).between(7, 15), _refill(m, telephone(F.regexp_extract(digits, COUNTRY_CODE, 0)))).otherwise(m)
    trunk = F.when((F.length(digits) == 11) & digits.startswith("1"), F.lit("1")).otherwise(F.lit(""))
    national = F.when(F.length(digits).between(9, 12), _refill(m, telephone(trunk))).otherwise(m)

    card = _let(_characters(F.substring(plain, F.lit(1), F.length(plain) - 1), key, "card"), lambda c: F.concat(c, _luhn_digit(c)))
    luhn = lambda v: F.call_function("luhn_check", v)
    other = F.coalesce(_walked(plain, lambda v: _characters(v, key, "number"), lambda v: ~luhn(v)), plain)
    number = _refill(m, F.when(luhn(plain), card).otherwise(other))
    moved = (
        F.when(m.contains("@"), email).when(m.rlike(whole["iban"]), iban).when(m.rlike(whole["ip"]), ip).when(m.rlike(whole["iso"]), iso)
        .when(m.rlike(whole["day"]), day).when(m.rlike(whole["ssn"]), ssn).when(m.startswith("+"), phone)
        .when(m.rlike(whole["number"]), number).when(m.rlike(whole["national"]), national).otherwise(number)
    )
    return F.coalesce(moved, m)


def key_of(df: DataFrame, key: str) -> Column:
    """A key derived from the given one, as a scalar subquery, so that neither stands in a plan."""
    if not key:
        raise ValueError("pseudonyms need a key")
    derived = hmac.new(key.encode(), b"studylake pseudonyms", hashlib.sha256).hexdigest()
    return df.sparkSession.sql("VALUES (:derived)", {"derived": derived}).toDF("derived").scalar()


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pseudonyms") -> DataFrame:
    """df with the texts' personal data replaced, and how many values were, as count_col (None: no such column)."""
    secret, found, new = spare(df, 3)
    text = F.col(text_col)
    marked = df.withColumn(found, F.when(text.rlike(NEEDED), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    marked = marked.withColumn(secret, F.when(F.size(found) > 0, key_of(df, key)))
    marked = marked.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, F.col(secret)))))
    pieces = F.zip_with(F.split(text, PATTERN, -1), F.col(new), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    out = marked.withColumn(text_col, F.when(F.col(new).isNotNull(), F.array_join(pieces, "")).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.when(F.col(new).isNotNull(), changed).otherwise(F.lit(0)).cast("long"))
    return out.drop(secret, found, new)
