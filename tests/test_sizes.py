"""Steps that must grow no faster than their input."""

import math
import random
import time
import tracemalloc
from decimal import Decimal
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from studylake import registry
from studylake.functions import classify, core
from studylake.functions import text as X
from studylake.operators import layout, papers, retrieval, upkeep
from studylake.plans import archives, planning
from studylake.sources import office
from studylake.sources.files import BATCH_ROWS
from studylake.sources.tables import table


def letters(n, seed):
    pick = random.Random(seed)
    return "".join(pick.choice("abcdefghijklmnop") for _ in range(n))


def test_strays_move_a_row_once_a_letter(spark):
    """Heads of every length from 20 to 80: the stretches of each length of each row took minutes."""
    texts = [(i, "s", letters(20 + i % 61 if i % 3 else 150, i)) for i in range(10_000)]
    strays = [(100_000 + i, "s", "1. xy " + x) for i, _, x in texts if i % 50 == 0] + [(200_000, "t", texts[1][2]), (200_001, "s", "--" + texts[1][2][:19]), (200_002, "s", None)]
    originals = spark.createDataFrame(texts, "id int, source string, text string")
    start = time.time()
    found = upkeep.contained_strays(originals.unionByName(spark.createDataFrame(strays, originals.schema)), originals, ["source"], "id", "text").collect()
    assert {r.id for r in found} == {100_000 + i for i in range(0, 10_000, 50)}
    assert time.time() - start < 45


def test_mastery_of_ties_as_in_sql(spark, tmp_path):
    """One attempt each, whose credit times a thousand ends in a half: the weight decides the digit, so its days and their exp must be SQL's."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds((i * 7919 * 1000003) % 259199999999) AS ts, i AS user_id, 'view' AS event_type, i % 1000 / 2 + 0.25 AS value, '' AS props
      FROM range(20000) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    ours = {r.user_id: r.mastery for r in planning.earlier(spark, str(tmp_path)).collect()}
    theirs = dict(con.execute(f"SELECT user_id, mastery FROM ({planning.EARLIER})").fetchall())
    assert [u for u, m in theirs.items() if ours[u] != m] == []


def test_mean_of_ratios_is_the_same_in_any_order(spark, tmp_path):
    """Marks that end in a half exactly: the last bit of a sum decides the digit, so it must be that of the exact sum, in whatever order and parts the rows are read."""
    pick = random.Random(3)
    rows = []
    for user in range(500):
        cents = [pick.randrange(40_000) for _ in range(39)]
        m = (sum(cents) // (125 * 40) + 1) // 2
        rest = 125 * 40 * (2 * m + 1) - sum(cents)
        rows += [(user, x / 100) for x in [*cents, rest]]
    marks = []
    for k, order in enumerate((rows, rows[::-1], sorted(rows, key=lambda r: r[1]))):
        spark.createDataFrame(order, "user_id long, value double").repartition(k + 1).write.parquet(f"{tmp_path}/{k}/events.parquet")
        marks.append({r.user_id: r.mark for r in registry.queries()["d19_mean_of_ratios"](spark, f"{tmp_path}/{k}").collect()})
    assert marks[0] == marks[1] == marks[2]
    held = [[Decimal(repr(min(1.0, v / 500))) for u, v in rows if u == user] for user in range(500)]
    assert marks[0] == {u: math.floor(float(sum(x)) / len(x) * 20 * 10 + 0.5) / 10 for u, x in enumerate(held)}


def test_mean_of_values_without_decimals(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", None), ("a", 0.2), ("b", None), ("c", 1e30), ("c", 1.0), ("d", float("inf")), ("e", -9e17), ("e", -9e17), ("f", float("nan"))], "k string, x double")
    found = {r.k: r.m for r in df.groupBy("k").agg(core.mean(F.col("x")).alias("m")).collect()}
    assert math.isnan(found.pop("f"))
    assert found == {"a": 0.3 / 2, "b": None, "c": (1e30 + 1) / 2, "d": float("inf"), "e": -9e17}


def test_shared_vocabulary_goes_once_over_a_text(spark):
    """Thousands of words of a question in thousands of texts: a search for each word of each text took minutes."""
    words = [letters(9, i) for i in range(4000)]
    texts = [(i, "a", " ".join(words[i % 1000 : i % 1000 + 400])) for i in range(2000)] + [(9001, "b", None), (9000, "b", "zz"), (9002, "c", "abc")]
    asked = spark.createDataFrame([("a", [*words, words[0]]), ("b", ["xyz"]), ("d", ["abc"]), (None, ["q"])], "s string, w array<string>")
    hits = spark.createDataFrame(texts, "id int, s string, t string")
    start = time.time()
    found = retrieval.share_vocabulary(hits, asked, "s", "w", "t", "id", 2).select("s", "id", "shared").collect()
    assert sorted(map(tuple, found)) == [("a", 0, 400), ("a", 1, 400), ("b", 9000, 0), ("b", 9001, 0)]
    assert time.time() - start < 30


def test_texts_go_to_python_in_bounded_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    spark.createDataFrame([(i, "Ⅳ é") for i in range(5000)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = F.pandas_udf(lambda x: x.map(lambda _: len(x)), LongType())
    assert table(spark, str(tmp_path), "documents").select(sizes("text").alias("n")).agg(F.max("n")).first()[0] == BATCH_ROWS


def test_search_of_pairs_alone(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red fox sits, fox"), (3, "blue fox"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, '"red fox"'), (8, "fox -red")], "query_id long, question string")
    every = {tuple(r) for r in retrieval.search(docs, asked).collect()}
    assert {r[:2] for r in every} == {(7, 1), (7, 2), (8, 3)}
    pairs = spark.createDataFrame([(7, 2), (7, 3), (7, 4), (8, 1), (8, 3), (9, 1)], "query_id long, id long")
    assert {tuple(r) for r in retrieval.search(docs, asked, pairs=pairs).collect()} == {r for r in every if r[:2] in {(7, 2), (8, 3)}}


@pytest.mark.parametrize("inline", [False, True])
def test_workbooks_hold_a_row_at_a_time(tmp_path, monkeypatch, inline):
    """100,000 rows of their own texts: a task that keeps a sheet's rows, or all of its shared texts, holds tens of megabytes."""
    monkeypatch.setattr(office, "_attempt", lambda: "00000-1")
    monkeypatch.setattr(office, "SHARED", 1 << 20)
    folder, schema = f"file://{tmp_path}", StructType([StructField("a", LongType()), StructField("b", StringType())])
    office._SheetWriter(folder, False, schema, inline).write(iter([(0, "")]))
    tracemalloc.start()
    office._SheetWriter(folder, False, schema, inline).write((i, f"text & number {i}") for i in range(100_000))
    reader = office._SheetReader(folder, schema)
    read = max(reader.partitions(), key=lambda p: (tmp_path / p.value[0].rpartition("/")[2]).stat().st_size)
    rows = reader.read(read)
    assert list(islice(rows, 2)) == [(0, "text & number 0"), (1, "text & number 1")]
    assert sum(i * (text == f"text & number {i}") for i, text in rows) == sum(range(2, 100_000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 << 20


def test_sheets_have_a_limit_of_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(office, "_attempt", lambda: "00000-1")
    monkeypatch.setattr(office, "SHEET_BYTES", 700)
    folder, schema = f"file://{tmp_path}", StructType([StructField("a", LongType()), StructField("b", StringType())])
    rows = [(i, "x" * (i * 40)) for i in range(30)]
    names = office._SheetWriter(folder, False, schema, True).write(iter(rows)).names
    assert len(names) > 10
    reader = office._SheetReader(folder, schema)
    assert sorted(r for p in reader.partitions() for r in reader.read(p)) == rows


def test_owners_of_names_grow_with_the_lines(spark):
    """A caption in every other line of one paper and a name of it in the others: pairs of them took minutes."""
    n = 80_000
    lines = spark.range(0, n, 1, 4).select(F.lit(1).alias("p"), F.col("id").cast("int").alias("place"), F.when(F.col("id") % 2 == 1, "Figure 1. A town").otherwise("See fig. 1a, here.").alias("text"))
    odd = [(2, 0, "Figure 1a. A"), (2, 1, "See fig. 1b, 1a and 1."), (2, 2, "Figure 1b. B"), (2, 3, "See table 1."), (None, 0, "Table 1. A"), (None, 1, "See table 1.")]
    start = time.time()
    found = {(r.p, r.place, r.kind, r.number, r.suffix): r.caption for r in papers.owners_named(lines.unionByName(spark.createDataFrame(odd, "p int, place int, text string")), "p").collect()}
    expected = {(1, i, "figure", 1, "a"): max(i - 1, 1) for i in range(0, n, 2)}
    expected |= {(2, 1, "figure", 1, "b"): 2, (2, 1, "figure", 1, "a"): 0, (2, 1, "figure", 1, ""): 0, (2, 3, "table", 1, ""): None, (None, 1, "table", 1, ""): None}
    assert found == expected
    assert time.time() - start < 30


def test_question_patterns_look_once_at_a_word(spark):
    """Each alternative looked for its own word's edge at each letter; one look for all of them must find the same texts."""
    pick = random.Random(4)
    pieces = ["sujet", "sujets :", "premier sujet", "essay", "essai argumentatif", "ce jugement", "à votre avis", "a votre avis", "write an essay", "to what extent", "le texte", "l'auteur", "l. 3", "ligne 2", "this", "article", "lines 4",
              "according to the", "your author", "ci-dessus", "the", "above", "cette", "question", "exercise", "d’après le passage", "x", "é", "1", "_", "-", " ", " ", ".", "the problematic", "dissertation", "dans le corpus", "celle-ci"]
    texts = spark.createDataFrame([("".join(pick.choice(pieces) for _ in range(pick.randrange(1, 6))),) for _ in range(5000)], "f string")
    patterns = list(classify.OPENING)
    for plain, quick in [(p, classify.at_words(p)) for p in patterns]:
        assert quick.count(r"|\b") == 0 < plain.count(r"|\b")
        kept = texts.select(F.col("f").rlike("(?i)" + plain).alias("a"), F.col("f").rlike(quick).alias("b")).groupBy("a", "b").count().collect()
        assert {(r.a, r.b) for r in kept} == {(True, True), (False, False)}


def test_language_cuts_a_text_once(spark):
    """Four lists of words were made of each text, and each Latin letter was a match of its own."""
    texts = {None: None, "": None, "12 ?": None, "the cat": "en", "le chat": "fr", "le the": None, "zz": None, "É": None, "سلام": "ar", "سلام the": "mixed", "سلام the and of": "en", "س des chats, la": "fr", "س zzzz": None, "س zz": None, "سس z": "mixed", "سسس z": "ar", "THE Le of": "en"}
    found = {r.t: r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.language(F.col("t")).alias("x")).collect()}
    assert found == texts
    assert str(X.language(F.col("t"))._jc).count("split(") <= 2


def test_owner_levels_keep_a_row_a_group(spark):
    """Distinct counts sent and held each row once for each of them."""
    rows = [(1, "question", 1, 1, True), (1, "question", 2, 1, True), (2, "question", 1, 5, True), (2, "question", 1, 5, True), (2, "stimulus", 3, 6, True), (3, "question", 1, 5, True), (3, "question", 1, 6, True),
            (4, "question", 1, 5, True), (4, "question", 1, 5, False), (5, "stimulus", 1, 1, False), (6, "question", None, 1, True), (7, "question", 1, None, True), (8, "question", 1, 5, None), (9, None, 1, 5, True)]
    found = layout.owner_level(spark.createDataFrame(rows, "p int, role string, top int, label int, sub boolean"), ["p"])
    shared, one, only, none = "EXERCISE_SHARED", "QUESTION", "SUBQUESTION", "EXERCISE_CONTEXT"
    assert {r.p: r.level for r in found.collect()} == {1: shared, 2: only, 3: one, 4: one, 5: none, 6: none, 7: one, 8: one, 9: none}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_containment_reads_the_texts_once(spark):
    """Every text was cut to words three times, and came whole to each pair."""
    seen = spark.sparkContext.accumulator(0)

    def words(texts):
        seen.add(len(texts))
        return texts.str.split(" ")

    cut = F.pandas_udf(words, "array<string>")
    asked = spark.createDataFrame([(1, "a b c d e f g h i j".split()), (2, "a b c".split()), (3, "k l m n o p q".split())], "id int, words array<string>")
    texts = [(10, "a b c d e f g h i z y x"), (11, "a b c d e f g h z"), (12, "q p o n m l k"), (13, ""), (14, None), (15, "a b c")]
    corpus = spark.createDataFrame(texts, "id int, text string").select("id", cut("text").alias("words"))
    assert {tuple(r) for r in retrieval.contained(asked, corpus).collect()} == {(1, 10, 0.9), (3, 12, 1.0)}
    assert seen.value == len(texts)


def test_index_gives_candidates_by_block(spark, monkeypatch):
    """Each list that a probe visits gave its own candidates, and the probe went to each list."""
    pick, made = random.Random(5), []
    rows = [(i, [pick.gauss(0, 1) for _ in range(8)]) for i in range(2000)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = retrieval.top_per_group
    monkeypatch.setattr(retrieval, "top_per_group", lambda df, *more: made.append(df) or whole(df, *more))
    probes = e.where("vec_id % 100 = 0")
    found = {(r.probe_id, r.vec_id) for r in retrieval.index_search(probes, e, 5).collect()}
    assert made[0].groupBy("probe_id").count().agg(F.max("count")).first()[0] <= 5 * 20
    true = {(r.probe_id, r.vec_id) for r in retrieval.knn(probes, e, [], 5).collect()}
    assert len(found) == 20 * 5 and len(found & true) >= 0.9 * len(true)


def test_text_documents_go_by_folders(tmp_path, monkeypatch):
    """Messages named every file, partitions held 64 of them, and files of one name in one task were one."""
    schema, folder = StructType([StructField("name", StringType()), StructField("text", StringType())]), f"file://{tmp_path}"
    batch = lambda rows: iter([pa.RecordBatch.from_pylist(rows, pa.schema({"name": pa.string(), "text": pa.string()}))])
    rows = [{"name": str(i % 900), "text": f"{i}\n\n_x0041_\tand\r {i}"} for i in range(1000)]

    def written(overwrite, *attempts):
        writer = office._TextWriter(folder, overwrite, schema)
        messages = []
        for attempt in attempts:
            monkeypatch.setattr(office, "_attempt", lambda: attempt)  # noqa: B023
            messages.append(writer.write(batch(rows)))
        return writer, messages

    def read(whole):
        reader = office._TextReader(folder, whole)
        parts = reader.partitions()
        found = [x for p in parts for x in reader.read(p)]
        return len(parts), [r for b in found for r in b.to_pylist()] if whole else found

    monkeypatch.setattr(office, "FILES", 300)
    writer, (lost, kept) = written(False, "00000-1", "00000-2")
    writer.commit([kept])  # the first attempt is lost
    assert len(kept.names) == 4
    parts, found = read(True)
    assert parts == 4 and sorted((r["file"].split("-")[0], "\n".join(r["texts"])) for r in found) == sorted((r["name"], r["text"]) for r in rows)
    assert {tuple(r["styles"]) for r in found} == {(None,) * 3}
    parts, found = read(False)
    assert parts == 4 and len(found) == 3000
    writer, messages = written(False, "00000-3")
    writer.abort(messages)
    assert len(read(True)[1]) == 1000
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/other.docx").write_bytes(office._TextWriter._document("other"))
    (tmp_path / "other.docx").write_bytes(office._TextWriter._document("other" * office.SHORT))
    (tmp_path / "notes.txt").write_text("stays")
    parts, found = read(True)
    assert parts == 5 and len(found) == 1002
    writer, messages = written(True, "00000-4")
    writer.commit(messages)
    assert len(read(True)[1]) == 1000 and (tmp_path / "notes.txt").exists()


def test_documents_are_read_without_a_shuffle(spark, tmp_path):
    """Paragraphs went through a shuffle and a list to make documents of them."""
    texts = [(3, "a\nb"), (4, None), (5, ""), (-6, " \n"), (None, "x"), (3, "a\nb")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = archives.a11_text_documents(spark, str(tmp_path))
    theirs = duckdb.sql("SELECT doc_id, md5(coalesce(text, '')) AS h, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS paragraphs FROM '" + f"{tmp_path}/documents.parquet/*.parquet'").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, theirs))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_holds_one_small_tile(k):
    """Tiles of 512 probes and a whole block, several at once, were over 100 MB a task, and each task on larger tables has a whole block."""
    v = np.random.default_rng(3).normal(size=(retrieval.BLOCK, 8)).round(1)
    v[5000:5010] = v[:10]
    v, ids, probes = retrieval._unit(v), np.arange(retrieval.BLOCK) * 2, np.r_[0:600, 9999, 10000:10020]
    p = np.concatenate([v[: len(probes) - 20][np.arange(len(probes) - 20) // 2], v[5000:5020][::-1]])
    tracemalloc.start()
    found = retrieval._nearest(k)(probes, p, ids, v, []).to_pandas()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for probe, x in zip(probes, p, strict=True):
        sims = np.floor(v @ x * 1e6 + 0.5) / 1e6
        sims[ids == probe] = -np.inf
        best = np.lexsort((ids, -sims))[:k]
        mine = found[found.probe_id == probe]
        assert list(mine.vec_id) == list(ids[best]) and list(mine.sim) == list(sims[best])
    assert most < 20 << 20
