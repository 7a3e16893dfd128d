"""The training-data operators against brute force, libraries, round trips and edge cases."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from studylake.llm import decontaminate, html_extract, license_scan, pii, queries, sentencepiece_bpe, simhash, similar, substring_dedup, tiff_media, token_counts, toxicity
from studylake.llm._common import join_hot

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string, __text string, component_id long, n_words int"


def words(n, seed, size=40):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, wordless, very long, repeated rows and ids, and columns with clashing names."""
    long = words(60_000, 1, 5000)
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long + " tail"), (None, "a b c d e f"), (7, "é ü 日本 4111 1111 1111 1111"), (8, "x" * 5000), (9, "tie tie"), (9, "another text under the same id")]
    return spark.createDataFrame([(i, t, "clash", "clash", 99, 7) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def places_of(words):
    out = {}
    for i, w in enumerate(words):
        out.setdefault(w, []).append(i)
    return out


def both(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


# ---- 1
def test_pii_formats(spark, odd):
    texts = ["card 4111 1111 1111 1111.", "n 9807915762804490", "mail und.34@mail7.example.com now", "+1 (017) 555-7713", "ip 97.51.17.173.", "on 2024-02-29 and 31/12/1999", "ssn 123-45-6789", "DE89 3704 0044 0532 0130 00", "2023-02-30 999.1.1.1 000-12-1234", None, ""]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id int, text string")
    rows = pii.pseudonymise(df, "key").orderBy("doc_id").collect()
    n = len(texts)
    for a, b, t in zip(rows[:n], rows[n:], texts, strict=True):
        assert a.text == b.text  # equal values stay linked
        if t is None or t == "" or t.startswith("2023"):
            assert a.text == t and a.n_pseudonyms == 0
        else:
            assert a.text != t and a.n_pseudonyms >= 1
            if "ip" not in t:  # octets have one to three digits
                assert re.sub("[0-9]", "9", a.text) == re.sub("[0-9]", "9", t) or "mail" in t or "/" in t
    digits = [int(x) for x in re.sub(r"\D", "", rows[0].text)][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    plain = re.sub(" ", "", rows[7].text)
    assert int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1
    assert pii.pseudonymise(odd, "key").count() == odd.count() and pii.pseudonymise(odd.limit(0), "key").count() == 0
    assert set(odd.columns) < set(pii.pseudonymise(odd, "key").columns)


def test_pii_prefilter_passes_every_form_alone(spark):
    forms = ["+49 30 12 34 56 78", "+44 20 79 46 09 58", "+1-23-45-67-89", "+12 34 5678", "a@b.c", "1.2.3.4", "1.1.1999", "1/1/1999", "1999-01-01", "123-45-6789", "4111 1111 1111 1", "3714 496353 98431", "1234567890123", "AB12 CDEF GHIJ", "AB12CDEFGHIJ"]
    df = spark.createDataFrame(list(enumerate(forms)), "doc_id int, text string")
    assert df.where(~F.col("text").rlike(pii.NEEDED) | ~F.col("text").rlike(f"^(?:{pii.PATTERN})$")).count() == 0
    rows = pii.pseudonymise(df, "key").orderBy("doc_id").collect()
    assert all(r.n_pseudonyms == 1 and r.text != t for r, t in zip(rows[:13], forms, strict=False))
    lone = pii.pseudonymise(spark.createDataFrame([(1, f"at {forms[0]}"), (2, f"at {forms[0]} in 2024")], "doc_id int, text string"), "key").orderBy("doc_id").collect()
    assert lone[1].text == f"{lone[0].text} in 2024"


def test_pii_national_telephones_and_ibans_before_words(spark):
    texts = ["call (743) 555-3824 now", "call 743-555-3824 now", "+33 6 12 34 56 78", "01 23 45 67 89", "(020) 7946 0958", "030 1234567", "BE68 5390 0754 7034 KBC", "NO93 8601 1117 947 BANK", "DE89370400440532013000 OK"]
    stay = ["05-12-1999 10:30", "pages 200-300 and 0.123456", "version 1.2 of 2024", "+1.5 of 20"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts + stay)), "doc_id int, text string"), "key").orderBy("doc_id").collect()
    shape = lambda t: re.sub("[0-9]", "9", t)
    for r, t in zip(rows, texts, strict=False):
        assert r.text != t and r.n_pseudonyms == 1 and shape(r.text) == shape(t), t
    assert [r.text for r in rows[len(texts) :]] == stay
    assert re.sub(r"\D", "", rows[0].text) == re.sub(r"\D", "", rows[1].text)
    for r, n in zip(rows[6:], (19, 18, 22), strict=False):
        plain = r.text[:n].replace(" ", "")
        assert int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1


def test_pii_is_a_permutation(spark):
    key = F.lit("key")
    n = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 13, "0").alias("m"))
    assert n.select(pii.pseudonym(F.col("m"), key).alias("p")).distinct().count() == 3000
    assert n.select(pii.pseudonym(F.col("m"), F.lit("other")).alias("p")).intersect(n.select(pii.pseudonym(F.col("m"), key))).count() < 50
    days = spark.range(73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    made = [days.select(F.date_format("d", f).alias("m")) for f in ("dd/MM/yyyy", "MM/dd/yyyy", "d/M/yyyy")]
    dates = made[0].union(made[1]).union(made[2]).distinct()
    moved = dates.select(pii.pseudonym(F.col("m"), key).alias("m"))
    assert moved.distinct().count() == dates.count() and moved.exceptAll(dates).isEmpty()  # a permutation of all written dates


def test_pii_formats_share_no_pseudonym(spark):
    """Cards and other numbers, and telephone numbers of every form, stay apart; one number has one pseudonym, however written."""
    rnd = random.Random(9)
    numbers = sorted({"".join(rnd.choices("0123456789", k=rnd.choice((13, 16, 16, 19)))) for _ in range(3000)})
    df = spark.createDataFrame([(n,) for n in numbers], "m string").select("m", pii.pseudonym(F.col("m"), F.lit("k")).alias("p"))
    assert df.select("p").distinct().count() == len(numbers)
    assert df.where(F.call_function("luhn_check", "m") != F.call_function("luhn_check", "p")).isEmpty()
    one = ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "1-555-223-4567", "(555) 223-4567", "+1 555 223 4567"]
    got = [re.sub(r"\D", "", r.text) for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(one)), "doc_id int, text string"), "k").orderBy("doc_id").collect()]
    assert len(set(got[:3])) == 1 and len({g.removeprefix("1") for g in got[3:]}) == 1 and got[0].startswith("1") and got[0] != got[3]
    phones = sorted({f"+49{'0' * rnd.randrange(2)}{rnd.randrange(1000, 20000)}" for _ in range(4000)})
    moved = spark.createDataFrame([(n,) for n in phones], "m string").select(pii.pseudonym(F.col("m"), F.lit("k")).alias("p"))
    assert moved.distinct().count() == len(phones)


def brute_pseudonym(m, key):
    """The networks in plain Python, for telephone numbers, cards and other numbers, dates and addresses."""
    keyed = lambda kind, i, v, bits: hashlib.new(f"sha{bits}", f"{key}|{kind}|{i}|{v}".encode()).hexdigest()

    def chars(v, kind):
        halves = [v[: len(v) // 2], v[len(v) // 2 :]]
        for i in range(8):
            digest = keyed(kind, i, halves[1 - i % 2], 512)
            halves[i % 2] = "".join(str((int(c) + int(digest[4 * j : 4 * j + 4], 16)) % 10) for j, c in enumerate(halves[i % 2]))
        return "".join(halves)

    def numbers(v, sizes, kind):
        v = [*v]
        for i in range(8):
            v[i % 2] = (v[i % 2] + int(keyed(kind, i, v[1 - i % 2], 256)[:15], 16)) % sizes[i % 2]
        return v

    def walk(v, step, inside):
        v = step(v)
        while not inside(v):
            v = step(v)
        return v

    def luhn(v):
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in v[::-1])) % 10 == 0

    def real(y, mo, d):
        return 1900 <= y < 2100 and 1 <= mo <= 12 and 1 <= d <= [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][mo - 1]

    digits = re.sub(r"\D", "", m)
    if m.startswith("+49"):
        zeros = len(digits[2:]) - len(digits[2:].lstrip("0"))
        return f"+49{'0' * zeros}" + walk(digits[2 + zeros :], lambda v: chars(v, "phone"), lambda v: v[0] != "0")
    if m.count(".") == 3:
        a, b, c, d = map(int, m.split("."))
        x, y = numbers((a * 256 + b, c * 256 + d), (65536, 65536), "ip")
        return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    if "/" in m:
        d, mo, y = m.split("/")
        span = lambda own, other, most: (10, most - 9) if len(other) == 1 and int(own) > 9 else (1, 9) if 1 in (len(own), len(other)) else (1, most)
        (low, months), (first, days) = span(mo, d, 12), span(d, mo, 31)
        date = lambda v: (v[0] // months + 1900, v[0] % months + low, v[1] + first)
        moved = date(walk(((int(y) - 1900) * months + int(mo) - low, int(d) - first), lambda v: numbers(v, (200 * months, days), "date"), lambda v: real(*date(v))))
        return f"{moved[2]:0{len(d)}}/{moved[1]:0{len(mo)}}/{moved[0]}"
    if luhn(digits):
        payload = chars(digits[:-1], "card")
        return payload + next(c for c in "0123456789" if luhn(payload + c))
    return walk(digits, lambda v: chars(v, "number"), lambda v: not luhn(v))


def test_pii_against_plain_networks(spark):
    rnd = random.Random(10)
    values = ["".join(rnd.choices("0123456789", k=rnd.choice((13, 15, 16)))) for _ in range(60)] + ["4111111111111111", "5500000000000004"]
    values += [f"+49{rnd.choice(('', '0'))}{rnd.randrange(10**6, 10**9)}" for _ in range(30)] + [".".join(str(rnd.randrange(256)) for _ in range(4)) for _ in range(30)]
    values += [rnd.choice(("{:02}/{:02}/{}", "{}/{}/{}")).format(rnd.randrange(1, 29), rnd.randrange(1, 13), rnd.randrange(1900, 2100)) for _ in range(40)]
    rows = spark.createDataFrame([(v,) for v in values], "m string").select("m", pii.pseudonym(F.col("m"), F.lit("k")).alias("p")).collect()
    assert [r.p for r in rows] == [brute_pseudonym(r.m, "k") for r in rows]


def test_pii_very_long_texts(spark):
    """A megabyte of an address, and much of what each pattern repeats, ends neither in a stack overflow nor in quadratic time."""
    unit = ["a.", "a@" + "a." * 20, "1.", "1-", "1 ", "+1 ", "AB12 ", "a", "7", "12/", "(0"]
    texts = [u * (60_000 // len(u)) for u in unit] + ["a@" + "a." * 500_000 + "aa"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4), "k").orderBy("doc_id").collect()
    assert [len(r.text) for r in rows[:3]] == [len(t) for t in texts[:3]] and rows[-1].n_pseudonyms == 1


def test_pii_keeps_clashing_columns_and_needs_a_key(spark):
    df = spark.createDataFrame([(1, "call +1 555 123 4567", "a", "b", "c")], "doc_id int, text string, __found string, __new string, __0 string")
    row = pii.pseudonymise(df, "k").first()
    assert (row["__found"], row["__new"], row["__0"]) == ("a", "b", "c") and row.n_pseudonyms == 1
    assert "very secret" not in pii.pseudonymise(df, "very secret")._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")


def test_pii_plan_is_native(docs):
    plan = pii.pseudonymise(docs, "key")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 2
def brute_components(ids, fps, radius=2):
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    out, seen = {}, set()
    for i in range(len(x)):
        if i in seen:
            continue
        group, stack = [i], [i]
        seen.add(i)
        while stack:
            for j in np.flatnonzero(near[stack.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
                    group.append(j)
        least = min((ids[g] for g in group if ids[g] is not None), default=None)
        out |= {g: least for g in group}
    return out


def test_masks_cover_every_pair():
    masks = simhash.covering_masks(2, list(range(64)))
    assert len(masks) == 7
    for a in range(64):
        for b in range(a, 64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_simhash_against_brute_force(spark, docs, odd):
    for df in (docs, odd):
        rows = simhash.near_duplicates(df).collect()
        assert len(rows) == df.count()
        fps = [r.fp & (1 << 64) - 1 for r in rows]
        expected = brute_components([r.doc_id for r in rows], fps)
        assert [r.component_id for r in rows] == [expected[i] for i in range(len(rows))]
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"c d e", b"d e f")]
    bits = sum(1 << j for j in range(64) if sum(x >> j & 1 for x in h) > 2)
    assert {r.fp & (1 << 64) - 1 for r in simhash.fingerprints(odd).where("id = 1").collect()} == {bits}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_large_buckets_are_dealt_again(spark):
    base = 0x0123456789ABCDEF
    values = [base ^ 1 << a ^ 1 << b for a in range(40) for b in range(a, 40)][:200] + [base ^ (1 << 63 | 1 << 62 | 1 << 61)]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in dict.fromkeys(values)], "fp long")
    rows = {r.node: r.root for r in simhash.components(simhash.links(df, 2, bucket=16)).collect()}
    ids = [r.fp for r in df.collect()]
    expected = brute_components(ids, [i & (1 << 64) - 1 for i in ids])
    assert all(rows.get(v, v) == expected[i] for i, v in enumerate(ids))


def test_similar_keeps_one_of_each_group(spark, odd):
    text = words(300, 5, 10_000)
    near = text.replace(text.split()[150], "changed")
    df = spark.createDataFrame([(1, near), (0, text), (2, words(300, 6, 10_000)), (3, ""), (4, None), (None, text), (2, words(300, 6, 10_000))], "doc_id int, text string")
    assert both([r.doc_id for r in similar.keep_one(df).collect()], [0, 2, 3])
    assert similar.keep_one(odd).columns == odd.columns
    assert both([r.doc_id for r in similar.keep_one(odd).collect()], [1, 2, 5, 7, 8, 9, 9])
    assert similar.keep_one(odd.limit(0)).count() == 0


def variants(text, n, changes, seed):
    """Copies of a text with some words each replaced by new ones."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        own = text.split()
        for at in rnd.sample(range(len(own)), changes):
            own[at] = f"new{seed}x{i}x{at}"
        out.append(" ".join(own))
    return out


def brute_groups(texts, threshold=0.8):
    """The smallest place of the texts that each is linked to by exact Jaccard similarity, directly or through others."""
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    near = [[j for j, b in enumerate(sets) if len(a & b) >= threshold * len(a | b) - 1e-9] for a in sets]
    root = [None] * len(texts)
    for i in range(len(texts)):
        stack = [i] if root[i] is None else []
        while stack:
            if root[at := stack.pop()] is None:
                root[at] = i
                stack += near[at]
    return root


def test_similar_star_and_shared_passages_against_brute_force(spark):
    base, passage = words(200, 50, 100_000), words(150, 51, 100_000)
    texts = [*variants(base, 120, 4, 52), base, *(f"{passage} {words(60, 100 + i, 100_000)}" for i in range(40))]
    chain = words(260, 53, 100_000).split()
    texts += [" ".join(chain[i * 8 : i * 8 + 150]) for i in range(4)]
    texts += [t for i in range(40) for t in variants(words(6 + i, 54 + i, 100_000), 2, 1, 900 + i)]
    expected = brute_groups(texts)
    assert len(set(expected[:121])) == 1 and len(set(expected[121:161])) == 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == sorted(set(expected))


def test_similar_compares_texts_whose_head_is_another(spark):
    """Two similar texts in one entry with a dissimilar head: linked when the entry's unjoined pairs are compared."""
    a = words(200, 80, 100_000)
    texts = [f"{a} {words(60, 81 + i, 100_000)}" for i in range(6)]
    texts += [t for text in texts[:3] for t in variants(text, 2, 3, 90)]
    expected = brute_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("__node", F.lit("mine")).withColumn("__0", F.lit(7))
    kept = similar.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected)) and {(r["__node"], r["__0"]) for r in kept} == {("mine", 7)}


def test_hot_keys_are_dealt(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        assert both(map(tuple, join_hot(rows, table.where("k % 3 = 0"), "k", how=how).collect()), map(tuple, rows.join(table.where("k % 3 = 0"), "k", how).collect()))


def test_similar_deals_large_entries_again(spark):
    texts = variants(words(200, 60, 100_000), 12, 5, 61)
    nodes = spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("node"), "text")
    groups = [{r.node: r.root for r in similar.similar_groups(nodes, cluster=n).collect()} for n in (similar.CLUSTER, 0)]
    assert groups[0] == groups[1]


def test_similar_block_by_block_against_brute_force(spark, monkeypatch):
    """Over several blocks: half-alike texts, of which some are linked to others than their heads."""
    monkeypatch.setattr(similar, "BLOCK", 16)
    base = words(220, 95, 100_000)
    texts = [t for i, v in enumerate(variants(base, 24, 9, 96)) for t in (v, *variants(v, i % 3, 3, 200 + i))]
    expected = brute_groups(texts)
    assert 1 < len(set(expected)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == sorted(set(expected))


def test_similar_compares_whole_sets(spark):
    """Texts of several thousand shingles just above and just below the threshold, where a sketch of 256 hashes is wrong in many."""
    bases = [words(4000, 700 + i, 10**7) for i in range(24)]
    texts = [t for i, base in enumerate(bases) for t in (base, *variants(base, 1, 88 + i % 12, 800 + i))]
    expected = brute_groups(texts)
    assert 24 < len(set(expected)) < 48
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == sorted(set(expected))


# ---- 3
STRANGE = ["", " ", "  a  b   c ", "\n\n\t", "▁x ▁▁ y", "é€😀 Σας İI", "<unk></s> <s>", "aaaa " * 9, "\x00\x01", "한국어 日本語", "x" * 3000, "﻿z", "🏳️‍🌈", "1234 5.6"]


def strange(n, seed):
    rnd = random.Random(seed)
    return STRANGE + ["".join(rnd.choice("abc  \n\t<|>'sStrévmll013▁Σ日́ 😀#&$") for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_sentencepiece_like_the_library(spark, odd):
    v = sentencepiece_bpe.Vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    texts = strange(400, 1)
    ids, agrees = v.encode(texts)
    assert all(agrees) and ids == v.library.encode(texts, add_eos=True)
    assert [v.decode(i) for i in ids] == [v.library.decode(i) for i in ids]
    rnd = random.Random(2)
    for _ in range(200):
        some = [rnd.randrange(3, 259) if rnd.random() < 0.7 else rnd.randrange(32000) for _ in range(12)]
        assert v.decode(some) == v.library.decode(some)
    rows = sentencepiece_bpe.encode_decode(odd, queries.tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(rows) == odd.count() and all(r.agrees and r.decoded == (r.text or "") for r in rows)
    assert all(r.ids == [2] for r in rows if not r.text)
    assert sentencepiece_bpe.encode_decode(odd.limit(0), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_op3_digests(spark, docs):
    lib = sentencepiece_bpe.Vocabulary(queries.tokenizer_path("piece_bpe_32k.model")).library
    got = {r.doc_id: r for r in queries.op3_sentencepiece(spark, SMALL).collect()}
    for d in docs.collect():
        ids = lib.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


# ---- 4
def test_token_counts_like_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = strange(500, 3) + ["<|endoftext|>abc<|startoftext|>", "x<|endoftext|> \x1c y\x1fz", "<|ENDOFTEXT|>", "it's we'll 'S"]
    assert token_counts.Merges(path).count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    for df in (docs, odd):
        rows = token_counts.token_counts(df.select("doc_id", "text"), path).collect()
        all_ = [r.text or "" for r in df.collect()]
        assert both([(r.n_bytes, r.n_tokens) for r in rows], [(len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for t in all_])
    assert token_counts.token_counts(odd.limit(0), path).count() == 0


def test_token_counts_of_long_words():
    """One long pre-token is merged by places; the same counts as by whole arrays and as the library's."""
    import tokenizers

    path = queries.tokenizer_path("word_bpe_49k.json")
    merges, library = token_counts.Merges(path), tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(4)
    for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 5000), ("ab", 9000), ("a", 7001), ("etaoin", 100_000)):
        word = "".join(rnd.choice(alphabet) for _ in range(n))
        assert merges.survivors_of_long(word.encode()) == len(library.encode(word, add_special_tokens=False).ids)
    for token in (b"aaaa", b"abab", b"hello", b"x"):
        assert merges.survivors_of_long(token) == merges.survivors([token])[0]


# ---- 5
def test_decontamination_against_brute_force(spark, odd):
    rnd = random.Random(4)
    vocabulary = ["a", "b", "c", "dé", "9"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(1, text(12)), (2, text(3)), (3, text(10)), (3, text(14)), (4, ""), (5, None), (None, text(4)), (6, "A, b!")]
    docs = [(i, text(rnd.choice([0, 2, 9, 30, 80]))) for i in range(60)] + [(99, None), (100, "x " + items[0][1].upper() + ". y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        for w in decontaminate.windows_of(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 10):
            windows[w] |= {str(i)} if i is not None else set()
    expected = []
    for i, t in docs:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if (k := tuple(w[p : p + size])) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[k]
        expected.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0))
    for block in (1 << 20, 40):
        got = decontaminate.contamination(df, bench, columns=["doc_id"], block_bytes=block).collect()
        assert both(map(tuple, got), expected)
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


# ---- 6
def toxic_rows(n, seed):
    """Texts in four languages; toxic ones have words of a few stems of their language, most of them not seen before."""
    rnd = random.Random(seed)
    stems = {"de": ("grobl", "schuf"), "fr": ("méch", "vil"), "es": ("ñoñ", "torpe"), "ja": ("愚かな", "悪いこ")}
    rows = []
    for i in range(n):
        lang = list(stems)[i % 4]
        w = [f"{lang}{rnd.randrange(3000)}" for _ in range(60)]
        if toxic := rnd.random() < 0.2:
            for at in rnd.sample(range(60), 4):
                w[at] = rnd.choice(stems[lang]) + rnd.choice("aeiou") + str(rnd.randrange(10**6))
        rows.append((i, " ".join(w), lang, int(toxic)))
    return rows


def test_toxicity_held_out_with_unseen_words(spark):
    df = spark.createDataFrame(toxic_rows(1600, 5), "doc_id long, text string, lang string, toxic int")
    chain = toxicity.train(df.select("doc_id", "text"), df.where("doc_id < 800").select("doc_id", "toxic"))
    assert chain.names == ["kind_1", "kind_2", "toxic"] and chain.figures[0] > 0.9 and chain.figures[1] > 0.99
    held = toxicity.score(df, chain).where("doc_id >= 800").collect()
    for lang in ("de", "fr", "es", "ja"):
        own = [r for r in held if r.lang == lang]
        assert sum(r.rejected for r in own if r.toxic) >= 0.9 * sum(r.toxic for r in own)
    assert sum(not r.rejected for r in held if not r.toxic) >= 0.99 * sum(not r.toxic for r in held)


def test_toxicity_chain_of_label_columns(spark):
    """Later models see the earlier categories: threats are the insults that name a place."""
    rnd = random.Random(6)
    rows = []
    for i in range(800):
        insult, place = rnd.random() < 0.3, rnd.random() < 0.5
        w = words(40, 5000 + i, 3000).split()
        w[3:5] = ["scoundrel" if insult else "person", "harbour" if place else "nowhere"]
        rows.append((i, " ".join(w), int(insult), int(insult and place), int(insult)))
    df = spark.createDataFrame(rows, "doc_id long, text string, insult int, threat int, toxic int")
    chain = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "insult", "threat", "toxic").where("doc_id < 600"), categories=("insult", "threat"))
    held = toxicity.score(df, chain).where("doc_id >= 600").collect()
    assert chain.names == ["insult", "threat", "toxic"]
    assert sum((r.p_threat >= 0.5) == bool(r.threat) for r in held) >= 0.95 * len(held)
    assert sum(r.rejected == bool(r.toxic) for r in held) >= 0.97 * len(held)


def test_toxicity_of_shuffled_labels(spark):
    """Labels that say nothing of the texts: the chain's own figures must not promise more than fresh texts give."""
    rnd = random.Random(9)
    rows = [(i, words(60, i, 3000), int(rnd.random() < 0.15)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.train(df.select("doc_id", "text"), df.where("doc_id < 1500").select("doc_id", "toxic"))
    fresh = toxicity.score(df, chain).where("doc_id >= 1500")
    rejected = fresh.agg(F.avg(F.col("rejected").cast("double"))).first()[0]
    assert chain.figures[0] <= 0.04 and rejected <= 0.01


def test_toxicity_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0), (5, None), (None, 1)], "doc_id long, toxic int")):
        chain = toxicity.train(odd, labels)
        got = toxicity.score(odd, chain)
        assert got.count() == odd.count() and got.where("rejected").count() == 0
    assert toxicity.score(odd.limit(0), chain).count() == 0


# ---- 7
def brute_dedup(rows, window):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, odd, seed):
    rnd = random.Random(seed)
    passages = [words(rnd.randint(8, 30), 100 + i) for i in range(6)]
    rows = [(i, " ".join(rnd.choice([rnd.choice(passages), words(rnd.randint(1, 12), 1000 * seed + i * 7 + j)]) for j in range(rnd.randint(0, 8)))) for i in range(60)]
    rows += [(61, rows[3][1]), (61, rows[3][1]), (62, None), (None, rows[3][1]), (63, passages[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.substring_dedup(df, window=10, k=3).collect()
    assert both(map(tuple, got), brute_dedup(rows, 10))
    own = [(r.doc_id, r.text) for r in odd.collect()]
    assert both(map(tuple, substring_dedup.substring_dedup(odd).collect()), brute_dedup(own, 50))
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0


def test_paths_are_compacted(spark):
    """A chain of five, one that branches, and a piece whose neighbour does not agree."""
    rows = [(i, 2, i - 1 if i > 1 else 0, i + 1 if i < 5 else 0) for i in range(1, 6)]
    rows += [(11, 1, 0, None), (12, 1, 11, 0), (13, 1, 11, 0), (21, 1, None, 22), (22, 1, None, 23), (23, 1, 22, 24), (24, 1, 23, None)]
    pieces = spark.createDataFrame(rows, "piece long, windows int, before long, after long")
    assert both([(r.head, r.total) for r in substring_dedup.compacted(pieces).collect()], [(1, 10), (11, 1), (12, 1), (13, 1), (21, 1), (22, 3)])


def test_spans_are_compared_with_their_source(spark, monkeypatch):
    """A request that the source's words do not answer is found; hashes that clash are tried again under another seed."""
    docs = spark.createDataFrame([(1, "a b c d e")], "id long, text string").withColumn("row", F.xxhash64("text"))
    row = docs.first()["row"]
    good, bad = (1, row, 1, 2, hashlib.sha256(b"b c").digest()), (1, row, 1, 3, hashlib.sha256(b"b c x").digest())
    asked = lambda rows: spark.createDataFrame(rows, "source long, source_row long, source_start int, words int, digest binary")
    assert substring_dedup._unlike(docs, asked([good])).isEmpty() and not substring_dedup._unlike(docs, asked([good, bad])).isEmpty()
    # many requests to one source are dealt to several lists
    monkeypatch.setattr(substring_dedup, "ANSWERED", 1)
    assert substring_dedup._unlike(docs, asked([good] * 3)).isEmpty() and not substring_dedup._unlike(docs, asked([good, bad])).isEmpty()
    seeds = [substring_dedup.Rolling(np.arange(9, dtype=np.uint64), 0, n).spans(np.array([0]), np.array([9]))[0] for n in range(3)]
    assert len(set(seeds)) == 3


# ---- 8
def test_patience_alignment():
    a, b = b"the quick brown fox jumps over the lazy dog".split(), b"so the quick red fox leaps over the very lazy dog".split()
    assert [a[i] for i, _ in license_scan.align(a, b)] == [b"the", b"quick", b"fox", b"over", b"the", b"lazy", b"dog"]
    assert license_scan.increasing([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5]
    assert license_scan.align([], b) == []


def test_license_scan(spark, docs, odd):
    mit = license_scan.TEMPLATES["MIT"]
    df = spark.createDataFrame([(1, "x y " * 80 + mit.replace("free of charge", "for free") + " z " + mit), (2, "Licensed under CC BY-NC 4.0."), (3, "the licence of nothing"), (4, None)], "doc_id int, text string")
    rows = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert (rows[1].license, rows[1].coverage) == ("MIT", 1.0) and [m.name for m in rows[1].matches if m.name == "MIT"] == ["MIT", "MIT"]
    assert rows[2].license == "CC-BY-NC-4.0/notice" and rows[3].license is None and rows[4].license is None
    found = license_scan.scan(docs).where("license is not null").count()
    assert found == docs.where(F.col("text").rlike(r"(?i)license[d,. ]|CC BY-NC")).count()
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(odd.limit(0)).count() == 0


@pytest.mark.parametrize("gap", [0, 1, 20, 40, 60, 100, 200])
def test_license_copies_with_foreign_words(gap):
    """Brute force: the words of one copy with foreign words in its middle align whole, wherever that is, and count once."""
    template = license_scan.Template("MIT", license_scan.TEMPLATES["MIT"])
    foreign = [b"q%d" % i for i in range(600)]
    for cut in (5, 30, 43, 80):
        words = foreign[:100] + template.words[:cut] + foreign[200 : 200 + gap] + template.words[cut:] + foreign[500:]
        brute = license_scan.align(template.words, words)
        assert len(brute) == len(template.words)
        assert template.find(words, places_of(words), 0.8) == [(1.0, 100, 99 + len(template.words) + gap)]


def test_license_copies_with_words_of_their_own():
    """Foreign words that are the template's own, shuffled or drawn, in the middle: what an alignment of the whole text finds is found."""
    rnd = random.Random(3)
    for name in ("MIT", "Apache-2.0", "BSD-3-Clause"):
        template = license_scan.Template(name, license_scan.TEMPLATES[name])
        for trial in range(8):
            foreign = template.words[:] if trial == 0 else [rnd.choice(template.words) for _ in range(rnd.randrange(2 * len(template.words)))]
            rnd.shuffle(foreign)
            cut = len(template.words) // 2 if trial == 0 else rnd.randrange(1, len(template.words))
            words = [b"x"] * 3 + template.words[:cut] + foreign + template.words[cut:]
            if len(license_scan.align(template.words, words)) >= 0.8 * len(template.words):
                assert template.find(words, places_of(words), 0.8)


def test_license_scan_of_a_megabyte_of_notices(spark):
    import time

    notice, template = license_scan.TEMPLATES["MIT"], license_scan.Template("MIT", license_scan.TEMPLATES["MIT"])
    texts = [notice + " " * (i % 2) + "\n" for i in range(2000)] + ["Released under the MIT License. "] * 8000
    rnd = random.Random(1)
    near = [" ".join(w for w in notice.split() if rnd.random() > 0.02) for _ in range(500)]
    began = time.process_time()
    for text in ("".join(texts), "\n".join(near)):
        words = license_scan.words_of(text.encode())
        assert template.find(words, places_of(words), 0.8)
    assert time.process_time() - began < 5


def test_licenses_are_told_apart(spark):
    own = [(n, t) for n, t in sorted(license_scan.TEMPLATES.items())]
    others = ["Released under the Apache License", "the MIT people released a statement under the bridge", "Permission to use this text is granted", None, ""]
    scattered = " ".join(f"{w} {words(40, 300 + i, 5000)}" for i, w in enumerate("Released under the MIT License".split()))
    df = spark.createDataFrame(list(enumerate([t for _, t in own] + [*others, scattered])), "doc_id int, text string")
    rows = license_scan.scan(df).orderBy("doc_id").collect()
    got = [r.license for r in rows]
    assert got[: len(own)] == [n for n, _ in own] and got[len(own) :] == [None] * 6
    assert all(r.n_matches == 1 for r in rows[: len(own)])


# ---- 9
@pytest.mark.parametrize("kind", [tiff_media.NONE, tiff_media.LZW, tiff_media.DEFLATE, tiff_media.PACKBITS])
def test_tiff_round_trips(kind):
    rnd = random.Random(kind)
    for data in (b"", b"a", bytes(300), rnd.randbytes(5000), b"abab" * 900, bytes(64 * 4096 + 1)):
        payload = tiff_media.padded(data)
        for predictor in (1, 2):
            for tiled in (False, True):
                pages = list(tiff_media.pages(tiff_media.write(payload, kind, predictor, tiled)))
                assert [p["page"] for p in pages] == list(range(len(pages))) and b"".join(p["samples"] for p in pages) == payload


def test_tiff_big_endian_16_bit_and_broken(spark):
    pixels = np.array([[1, 2, 300], [4, 5, 6]], ">u2")
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (278, 3, 2), (279, 4, 12)]
    data = struct.pack(">2sHI", b"MM", 42, 20) + pixels.tobytes() + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + bytes(4)
    page = next(tiff_media.pages(data))
    assert np.frombuffer(page["samples"], "u2").tolist() == [1, 2, 300, 4, 5, 6]
    good = tiff_media.write(tiff_media.padded(b"x"))
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, bytearray(good[:-30])), (3, None), (4, bytearray(good)), (5, bytearray(b""))], "id int, media binary")
    rows = tiff_media.decode_pages(df).collect()
    assert sorted({r.id for r in rows}) == [1, 2, 4, 5] and [r.id for r in rows if r.error is None] == [4]
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    assert len(list(tiff_media.pages(bytes(loop)))) == 1


def test_op9_reads_back_what_it_stored(spark, docs):
    got = {r.doc_id: r for r in queries.op9_tiff_media(spark, SMALL).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        p = tiff_media.padded((d.text or "").encode())
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(tiff_media.stored(p)).hexdigest()


def test_tiff_low_bit_first_and_repeated_strips():
    tags = [(256, 3, 4), (257, 3, 1), (258, 3, 8), (259, 3, 1), (266, 3, 2), (273, 4, 8), (278, 3, 1), (279, 4, 4)]
    entry = lambda t, k, v: struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v))
    data = struct.pack("<2sHI", b"II", 42, 12) + bytes([128, 64, 192, 32]) + struct.pack("<H", len(tags)) + b"".join(entry(*x) for x in tags) + bytes(4)
    assert next(tiff_media.pages(data))["samples"] == bytes([1, 2, 3, 4])
    # strips that share one place: the image is much larger than its file, and valid
    strip = zlib.compress(bytes(2048 * 1024))
    n, body = 64, 8 + len(strip)
    arrays = struct.pack(f"<{n}I", *[8] * n) + struct.pack(f"<{n}I", *[len(strip)] * n)
    tags = [(256, 3, 1, 2048), (257, 4, 1, 65536), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, n, body), (278, 4, 1, 1024), (279, 4, n, body + 4 * n)]
    entry = lambda t, k, c, v: struct.pack("<HHI", t, k, c) + (struct.pack("<HH", v, 0) if k == 3 and c == 1 else struct.pack("<I", v))
    data = struct.pack("<2sHI", b"II", 42, body + len(arrays)) + strip + arrays + struct.pack("<H", len(tags)) + b"".join(entry(*x) for x in tags) + bytes(4)
    page = next(tiff_media.pages(data))
    assert page["error"] is None and len(page["samples"]) == 2048 * 65536
    short = data.replace(struct.pack("<HHII", 257, 4, 1, 65536), struct.pack("<HHII", 257, 4, 1, 1 << 30))
    assert next(tiff_media.pages(short))["error"] is not None  # too few strips: nothing is made


def test_tiff_features():
    counts, rough = np.bincount([0, 0, 4, 4], minlength=256), 4
    assert tiff_media.features(counts, rough) == "n=4;distinct=2;mean=2.0000;entropy=1.0000;step=1.0000"


# ---- 10
def test_html_marginals_against_enumeration():
    rnd = np.random.default_rng(1)
    parent, depth = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2])
    unary, pair = rnd.normal(size=(6, 2)), rnd.normal(size=(2, 2))
    total, one = 0.0, np.zeros(6)
    for state in range(64):
        y = [state >> i & 1 for i in range(6)]
        p = np.exp(sum(unary[i, y[i]] for i in range(6)) + sum(pair[y[parent[i]], y[i]] for i in range(1, 6)))
        total += p
        one += p * np.array(y)
    got, edges = html_extract.marginals(unary, parent, depth, pair)
    assert np.allclose(got, one / total) and np.isclose(edges.sum(), 5)


def test_html_held_out_accuracy():
    model, right, all_ = html_extract.trained(), 0, 0
    for page in html_extract.training_pages(80, 1234):
        nodes, runs = html_extract.parse(page)
        for n, p in zip(nodes, model.score([(nodes, runs)])[0], strict=True):
            if n.chars and n.label >= 0:
                all_ += 1
                right += (p > 0.5) == bool(n.label)
    assert right >= 0.97 * all_


def test_html_pages(spark):
    got = {r.page_id: r for r in queries.op10_html_extract(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id].text == " ".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)
    page = '<html><body><nav><ul><li><a href=x>Home page</a></ul></nav><aside class=sidebar><p>related things here</p></aside><main><h1>Title &amp; more</h1><p>First   paragraph of the\n text <b>bold</b>x.<p>Second one, unclosed with enough words.</main><div class=comments><div class=comment><p>I do not agree at all</p></div></div><footer>&copy; me</footer>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<!-- "), (5, "u", "<div" * 3000)], "page_id int, url string, html string")
    rows = html_extract.extract(df).collect()
    assert next(r.text for r in rows if r.page_id == 1) == "Title & more First paragraph of the text boldx. Second one, unclosed with enough words."
    assert len(rows) == 6 and all(r.text == "" for r in rows if r.page_id in (2, 3, 4))
    assert html_extract.extract(df.limit(0)).count() == 0


# ---- pipeline
def test_pipeline_stages(spark, odd):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    at, kept = df, []
    for name, stage in corpus_pipeline.STAGES:
        before = at.count()
        at = stage(spark, at, SMALL)
        kept.append((name, before, at.count()))
        if name != "tokenize":
            assert at.columns == df.columns
    assert all(b >= a for _, b, a in kept) and kept[-1][1] == kept[-1][2] > 0.7 * df.count()
    rows = at.collect()
    assert all(r.agrees and r.round_trip for r in rows)
    assert both([r.doc_id for r in rows], [r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()])


def test_pipeline_handles_odd_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "", "en", "s", 0), (3, "one " * 30_000, "en", "s", 120_000), (4, "mail x.1@y.example.com", "en", "s", 22)]
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = at.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at, empty = stage(spark, at, SMALL), stage(spark, empty, SMALL)
    assert at.count() == 4 and empty.count() == 0


def test_html_headers_footers_and_fragments(spark):
    pages = [
        '<html><body><article><header><p class="byline">By Jane Doe</p></header><h1>Title of it</h1><p>The first paragraph of the article has many words in it.<p>Another paragraph with some more words to read.<footer>Tags: a b</footer></article></body></html>',
        "<main><p>Equation <math><mi>x</mi></math> and words that follow it here today, as many as there are.</p><p>More of the text comes after it, with enough words.</p><template>no</template></main>",
    ]
    texts = [r.text for r in html_extract.extract(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id int, url string, html string")).orderBy("page_id").collect()]
    assert "Jane" not in texts[0] and "Tags" not in texts[0] and texts[0].endswith("words to read.")
    assert texts[1].startswith("Equation x and words") and "no" not in texts[1].split()


def test_html_deep_pages():
    deep = "<html><body><article><h1>Title of it</h1><p>The first paragraph of the article has many words in it.</p>" + "<div>" * 20_000 + "end"
    nodes, runs = html_extract.parse(deep)
    assert len(nodes) > 20_000 and len(html_extract.trained().score([(nodes, runs)])[0]) == len(nodes)


#: Layouts written by hand, apart from the generator: what is read is between the marks [[ and ]].
LAYOUTS = [
    '<!doctype html><html><head><title>t</title></head><body><div id="top"><a href=1>Home</a> | <a href=2>News</a></div><table><tr><td class="menu"><a href=3>One</a><br><a href=4>Two</a></td><td class="content"><h2>[[A storm over the hills]]</h2><p>[[The storm came in the night and took two roofs with it.]]</p><p>[[Nobody was hurt, said the mayor, who had been up since four.]]</p></td></tr></table><p class="copyright">All rights reserved</p></body></html>',
    '<html><body><header class="masthead"><a href="/">The Paper</a></header><main id="content"><section><h1>[[How to bake bread]]</h1><ol><li>[[Mix the flour with water and a little salt until it is smooth.]]</li><li>[[Wait for an hour or two, then bake it in a hot oven.]]</li></ol></section></main><aside><h3>Related</h3><ul><li><a href=1>Cakes</a></li><li><a href=2>Pies</a></li></ul></aside><form><label>Mail</label><input><button>Subscribe</button></form></body></html>',
    '<body><div class="cookie-banner"><p>We use cookies on this site.</p><button>OK</button></div><div class="wrapper"><div class="post"><h1>[[Notes from a small island]]</h1><p>[[It rained for most of the week, and the ferry did not come.]]</p><blockquote>[[Nothing is ever late here, she said, since nothing is expected.]]</blockquote><p>[[On Sunday the sun came out and everyone went to the beach.]]</p></div><div id="comments"><div class="comment"><p>Nice text, thank you!</p></div><div class="comment"><p>I was there last year too.</p></div></div></div><footer><p>Imprint and contact</p></footer></body>',
    '<html><body><nav class="breadcrumb"><a href=1>Docs</a> / <a href=2>API</a></nav><article class="entry"><h1>[[Reading a file]]</h1><p>[[Open the file, read it line by line and close it when you are done.]]</p><pre><code>[[with open(name) as f: print(f.read())]]</code></pre><p>[[The block closes the file by itself even if an error is raised.]]</p><div class="share"><a href=3>Share</a> <a href=4>Print</a></div></article><div class="sidebar"><h4>Popular</h4><ul><li><a href=5>Writing a file</a></li><li><a href=6>Paths</a></li></ul></div></body></html>',
]


def test_html_layouts_by_hand(spark):
    rows = [(i, "u", page.replace("[[", "").replace("]]", "")) for i, page in enumerate(LAYOUTS)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id").collect()
    for r, page in zip(got, LAYOUTS, strict=True):
        assert r.text == " ".join(re.findall(r"\[\[(.*?)\]\]", page)), r.page_id


def test_html_label_attributes_and_formulas(spark):
    page = '<html><body><nav><ul><li><a href=x>Home page</a></ul></nav><article><h1>Title of the page</h1><p>The area of a circle is <math><mi>A</mi><mo>=</mo><mi>pi</mi><msup><mi>r</mi><mn>2</mn></msup><annotation encoding="application/x-tex">A=tex</annotation></math> for every radius, as the drawing <svg viewBox="0 0 9 9"><style>p{}</style><path d="M0 0"/><text>radius r</text></svg> shows to the reader.<p>Second one with enough words for a text.</article></body></html>'
    table = '<html><body><article><h1>Prices of the year</h1><p>All of the prices are listed here for the reader.<table><tr><td data-label="Price">12 euros for each</td></tr></table></article></body></html>'
    rows = html_extract.extract(spark.createDataFrame([(1, "u", page), (2, "u", table)], "page_id int, url string, html string")).collect()
    texts = [next(v for k, v in r.asDict().items() if k not in ("page_id", "url", "html") and isinstance(v, str)) for r in sorted(rows)]
    assert "A=pir2 for every radius, as the drawing radius r shows" in texts[0] and "tex" not in texts[0].replace("text", "") and "Home" not in texts[0]
    assert "12 euros for each" in texts[1]


PAGES_BY_HAND = [
    ('<html><body><article><h1>My title here</h1><p>First para of the article text.</p><section class="comments"><p>Great post I like it</p></section></article></body></html>', "My title here First para of the article text."),
    ('<body><div id="main"><p>Some words &amp; more words in this para of the page.</p><p>Second one too.</p></div><div class="footer">Copyright 2020</div></body>', "Some words & more words in this para of the page. Second one too."),
    ("<body><p>First para of text that is long enough.</p><p>Ok.</p></body>", "First para of text that is long enough. Ok."),
    ("<p>Hello there world</p>", "Hello there world"),
    ('<body><div id="main"><p>Some words &amp; more words in this para of the page.</p><p>More.</p></div><div class="promo">Buy now</div><footer>c 2020</footer></body>', "Some words & more words in this para of the page. More."),
    ("Plain words without any markup at all.", "Plain words without any markup at all."), ("plain <b>bold</b> words", "plain bold words"), ("", ""), ("<script>x</script>", ""),
    ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><h1>Head</h1><p>One para.</p><p>Two para.</p><footer>Foot</footer></body></html>", "Head One para. Two para."),
    ('<div class="wrapper"><div class="nav"><ul><li><a>Home</a></li><li><a>Blog</a></li></ul></div><div class="post"><h2>Short</h2><p>Just one line.</p></div><div id="comments"><h3>2 comments</h3><ul><li><p>nice one</p></li><li><p>agreed indeed</p></li></ul></div></div>', "Short Just one line."),
    ('<body><div class="cookie">We use cookies <button>OK</button></div><main><p>Only sentence.</p></main><aside>Related <a>x</a></aside></body>', "Only sentence."),
]


@pytest.mark.parametrize("page", range(len(PAGES_BY_HAND)))
def test_html_short_and_bare_pages(page):
    html, text = PAGES_BY_HAND[page]
    assert html_extract.trained().texts([html]) == [text]


@pytest.mark.parametrize("page", ["<p><button>" + "<div>" * 20_000, "<b><table><tr><td>" + "<i>x</b>" * 20_000, "<div>" * 20_000 + "x", "<table><tr><td>" * 7000, "<a><p>" * 10_000, "<b>" * 20_000 + "</b>" * 20_000])
def test_html_is_linear_in_depth(page):
    import time

    model = html_extract.trained()
    began = time.process_time()
    model.texts([page])
    assert time.process_time() - began < 2


@pytest.mark.parametrize("value", [0, 1, 2, 255, 65_535, 2**31, 2**32 - 1])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_tags_with_any_value(value, tiled):
    """Each tag of a page in turn with another value, another count and another type: pages or an error, never an exception."""
    data = tiff_media.write(bytes(range(256)) * 4, tiff_media.DEFLATE, 2, tiled)
    (at,) = struct.unpack_from("<I", data, 4)
    (count,) = struct.unpack_from("<H", data, at)
    for i in range(count):
        entry = at + 2 + 12 * i
        for field, form in ((0, "<H"), (2, "<H"), (4, "<I"), (8, "<I")):
            bad = bytearray(data)
            struct.pack_into(form, bad, entry + field, value & (0xFFFF if form == "<H" else 0xFFFFFFFF))
            for page in tiff_media.pages(bytes(bad)):
                assert page["error"] or page["samples"] is not None
    with pytest.raises(ValueError):
        tiff_media.decompress(tiff_media.DEFLATE, zlib.compress(b"x" * 1000), 0)
