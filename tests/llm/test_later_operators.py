"""Whitening, periodic runs and token files against brute force, the library and edge cases."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from studylake.llm import periodic_runs, queries, token_files, whitening

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, __row string, start int, runs int"
BYTE_BPE = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, wordless, very long, repeated rows and ids, and columns with clashing names."""
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long + " " + long), (None, "x y " * 20), (7, "é ü 日本 <|endoftext|>  two"), (8, "x" * 5000), (9, "tie tie"), (9, "another text under the same id")]
    return spark.createDataFrame([(i, t, "clash", "clash", 9, 7) for i, t in rows], SCHEMA).repartition(3)


# ---- 11
def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.1 + rng.normal(size=d)).astype(np.float32)


@pytest.mark.parametrize(("n", "d", "block"), [(400, 7, 32), (300, 70, 32), (150, 9, 2)])
def test_whitening_as_dense_algebra(spark, monkeypatch, n, d, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "HELD_TILES", 3)
    c = vectors(n, d, n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "vec_id long, embedding array<float>").repartition(5)
    x = np.floor(1024 * c.astype(np.float64)).astype(np.int64) + 100_000
    s = x.sum(axis=0)
    y = x - s / n
    v = np.cov(x.T, bias=True)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    rows = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    k = min(8, d)
    assert len(rows) == n * k
    want = y @ axes / np.sqrt(e)
    got = np.array([[rows[i, j + 1].whitened for j in range(k)] for i in range(n)])
    signs = np.sign((want * got).sum(axis=0))
    assert np.allclose(got * signs, want, atol=1e-6)
    for i in range(n):
        r = rows[i, 1]
        assert r.n == n and r.deviation == sum(int(z) ** 2 for z in n * x[i] - s)
    assert np.allclose([rows[0, j + 1].explained for j in range(k)], e / np.trace(v), rtol=1e-9)
    assert all(r.identity_error == rows[0, 1].identity_error < 1e-8 for r in rows.values())


def test_whitening_of_odd_rows(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0]), (None, [0.75, 0.0]), (8, [0.1, 0.9])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id int, embedding array<double>, n int, whitened double")
    found = whitening.whiten(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in found) == sorted([(i, k) for i in ("1", "1", "None", "8") for k in (1, 2)]) and {r.n for r in found} == {4}
    lone = whitening.whiten(df.where("vec_id = 8")).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(1, 0, None, None, 0.0), (2, 0, None, None, 0.0)]
    assert whitening.whiten(df.where("vec_id = 2")).collect() == [] == whitening.whiten(df.limit(0)).collect()


def test_whitening_of_a_flat_direction(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id int, embedding array<double>")
    found = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    assert found[3, 2].whitened is None and found[3, 1].whitened is not None and found[3, 1].identity_error < 1e-9


def test_op11_on_its_table(spark):
    found = queries.op11_whitening(spark, SMALL)
    assert found.count() == 8 * spark.read.parquet(f"{SMALL}/embeddings.parquet").where("embedding IS NOT NULL").count()
    assert found.agg(F.max("identity_error")).first()[0] < 1e-6


# ---- 12
def plain_runs(w, least):
    """All runs by trying each period at each place."""
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def invented(rnd):
    k, n = rnd.choice([1, 2, 2, 3, 5, 30]), rnd.randrange(rnd.choice([15, 60, 150]))
    w = [b"%d" % rnd.randrange(k) for _ in range(n)]
    if rnd.random() < 0.5 and n:
        a = rnd.randrange(n)
        p = rnd.randrange(1, n - a + 1)
        w = w[:a] + [w[a + i % p] for i in range(n - a)]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_as_all_periods_tried(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        docs, least = [invented(rnd) for _ in range(rnd.randrange(1, 6))], rnd.choice([12, 12, 2, 3, 5, 8, 9, 20])
        got = [[tuple(map(int, r)) for r in f] for f in periodic_runs.runs(docs, least)]
        assert got == [plain_runs(d, least) for d in docs]


def test_runs_of_long_texts():
    word, before = [b"a"], [b"b"]
    while len(word) < 3000:
        word, before = word + before, word
    assert [tuple(map(int, r)) for r in periodic_runs.runs([word])[0]] == plain_runs(word, 12)
    assert periodic_runs.runs([[b"x"] * 300_000])[0].tolist() == [[0, 300_000, 1]]


def test_op12_as_its_contract(spark):
    """Against the definition worked out word by word, on all documents whose text is changed or that have runs, and a share of the others."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = got[d.doc_id]
        if n > 1500 and r.n_runs == 0:
            continue
        found = plain_runs(w, 12)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        if found:
            top = min(found, key=lambda f: (-f[1], f[0], f[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*top, 1000 * top[1] // top[2])
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4


def test_runs_of_odd_rows(spark, odd):
    found = periodic_runs.find(odd).collect()
    assert len(found) == 12
    by = {(r.doc_id, r.n_words): r for r in found}
    assert [tuple(x) for x in by[6, 120_000].runs] == [(0, 120_000, 60_000)] and len(by[6, 120_000].collapsed.split()) == 60_000
    assert [tuple(x) for x in by[None, 40].runs] == [(0, 40, 2)] and by[None, 40].collapsed == "x y"
    assert by[2, 0].runs == [] and by[2, 0].collapsed == "" == by[4, 0].collapsed
    assert periodic_runs.find(odd.limit(0)).collect() == []


# ---- 13
def expected(library, docs, end=2):
    start, out = 0, {}
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.setdefault(doc_id, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_op13_as_the_library(spark):
    from tokenizers import Tokenizer

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want = expected(Tokenizer.from_file(BYTE_BPE), docs)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op13_token_files(spark, SMALL).collect()}
    assert got == {k: v[0][:3] for k, v in want.items()}


def test_pieces_as_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, rnd = Tokenizer.from_file(BYTE_BPE), random.Random(5)
    letters = [" ", " ", "  ", "a", "Word", "é", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "'s", "'", "1", ".", ",", "!?", "日", "<|endoftext|>", "😀", "́", "ß", "Ω"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(25))) for _ in range(4000)]
    found = token_files.Pieces(BYTE_BPE).encode(pa.array(texts))
    assert [f.tolist() for f in found] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    other = queries.tokenizer_path("word_bpe_49k.json")
    whole = token_files.Pieces(other)
    assert not whole.splits
    assert [f.tolist() for f in whole.encode(pa.array(texts[:200]))] == [x.ids for x in Tokenizer.from_file(other).encode_batch(texts[:200], add_special_tokens=False)]


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    folder = f"file://{tmp_path}/tokens"
    token_files.write(odd, BYTE_BPE, 2, folder)
    (Path(tmp_path) / "tokens/shard-999999-1.ids").write_bytes(b"a lost attempt's")
    rows = token_files.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    library, at = Tokenizer.from_file(BYTE_BPE), 0
    texts = {(r.doc_id, *library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()}
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 2 and (r.doc_id, *r.ids[:-1]) in texts
        at += r.n_tokens
    shard = next(p for p in sorted(Path(tmp_path, "tokens").glob("*.ids")) if "999999" not in p.name)
    assert np.memmap(shard, "<u2", "r")[0] == rows[0].ids[0]
    empty = f"file://{tmp_path}/empty"
    token_files.write(odd.limit(0), BYTE_BPE, 2, empty)
    assert token_files.read(spark, empty).collect() == []


def test_wide_ids(spark, tmp_path):
    folder = f"file://{tmp_path}/wide"
    token_files.write(spark.createDataFrame([("b", "one"), ("a", None)], "doc_id string, text string"), BYTE_BPE, 70_000, folder)
    assert [(r.doc_id, r.start, r.ids[-1]) for r in token_files.read(spark, folder, "string").orderBy("start").collect()] == [("a", 0, 70_000), ("b", 1, 70_000)]
