"""Rules of papers' structure, files that change together, guarded writes."""

import pytest
from pyspark.sql import functions as F

from studylake.functions import latex, repair
from studylake.operators import upkeep
from studylake.sources import files


def one(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.select(expression.alias("x")).first().x


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    for rule in (latex.markdown, repair.without_furniture, latex.math_delimiters, repair.without_symbol_font):
        assert df.select(rule(F.col("t")).alias("x")).first().x is None


def test_a_lone_mark_stays_and_inner_footers_go(spark):
    paper = "Question\nPage 2 of 3\nmore\n2/3\nend (2 points)\n(2 points)\n\nName:\n"
    assert one(spark, repair.without_furniture(F.col("t")), t=paper) == "Question\nmore\n2/3\nend (2 points)\n(2 points)"
    assert one(spark, repair.without_furniture(F.col("t")), t="a\n(1 pt)\n(2 pts)") == "a"
    assert one(spark, repair.without_furniture(F.col("t")), t="plain\n\n") == "plain\n\n"


def test_repeated_gram(spark):
    loop = "one two three four five six seven eight " * 5
    got = one(spark, repair.repeated_gram(F.col("t")), t=loop)
    assert (got.most, got.coverage) == (5, 1.0)
    assert one(spark, repair.repeated_gram(F.col("t")), t="too short a text").most == 0


def test_readers_follow_the_latest_version(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    assert files.published(spark, path) == {}
    assert files.publish({"a": spark.range(3)}, path) == 1
    assert files.publish({"a": spark.range(5), "b": spark.range(1)}, path) == 2
    assert {k: v.count() for k, v in files.published(spark, path).items()} == {"a": 5, "b": 1}
    (tmp_path / "p/versions/000000000003.claim").touch()  # a writer that took the number and has not written
    assert files.publish({"b": spark.range(7)}, path) == 4
    assert {k: v.count() for k, v in files.published(spark, path).items()} == {"a": 5, "b": 7}


def test_backup_brings_the_old_table_back(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    files.publish({"t": spark.createDataFrame([(1, 1.0), (2, -2.0), (3, None)], "k int, v double")}, path)
    files.backup_then_update(spark, path, "t", spark.createDataFrame([(2, 0.0), (3, 9.0), (4, 4.0)], "k int, v double"), ["k"], "b")
    parts = files.published(spark, path)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(parts["t"]) == [(1, 1.0), (2, 0.0), (3, 9.0)] and rows(parts["b"]) == [(2, -2.0), (3, None)]
    assert rows(files.undone(parts["t"], parts["b"], ["k"])) == [(1, 1.0), (2, -2.0), (3, None)]
    with pytest.raises(ValueError):
        files.backup_then_update(spark, path, "t", parts["b"], ["k"], "b")


def test_single_use(spark):
    state = spark.createDataFrame([("a", None), ("b", 9), ("c", None)], "token string, used_by long")
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "nobody"), (5, None)], "at long, token string")
    after, outcome = upkeep.use_once(state, asked, "token", "at")
    assert sorted(map(tuple, after.collect()), key=str) == [("a", 1), ("b", 9), ("c", None)]
    assert [r.granted for r in outcome.orderBy("at").collect()] == [True, False, False, False, False]


def test_duplicates_and_strays(spark):
    rows = spark.createDataFrame([(1, "s", "x"), (2, "s", "x"), (3, "s", "x"), (4, "t", "x"), (5, "s", "y"), (6, "s", "y")], "id int, subject string, name string")
    allowed = spark.createDataFrame([("x", 2)], "name string, n long")
    merged = upkeep.duplicates(rows, ["subject", "name"], "id", allowed)
    assert sorted((r.loser, r.survivor) for r in merged.collect()) == [(3, 1), (6, 5)]
    links = spark.createDataFrame([(1, "q", 1), (3, "q", 7), (3, "r", 8), (6, "r", 9), (2, "q", 5)], "id int, question string, score int")
    assert sorted(map(tuple, upkeep.moved_links(links, merged, "id", "question").select("id", "question", "score", "moved").collect())) == [(1, "q", 1, False), (1, "r", 8, True), (2, "q", 5, False), (5, "r", 9, True)]
    long = "abcdefghij" * 12
    texts = [(1, long), (2, f"pt. 3 {long}"), (3, "x" * 30 + long), (4, "short"), (5, "pt short"), (6, None), (7, ""), (8, "klmnopqrstuvwxyzklmnop"), (9, "12 ab klmnop-qrstuvwxyz klmnop!")]
    df = spark.createDataFrame([(i, "s", x) for i, x in texts], "id int, source string, text string")
    assert sorted(r.id for r in upkeep.contained_strays(df, df, ["source"], "id", "text").collect()) == [2, 9]


def test_guarded_writes(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_guarded(spark.range(1), f"file://{tmp_path}/x", confirm="file:///elsewhere")


def test_single_words_and_letters(spark):
    from studylake.operators import words

    rows = [(1, "One two TWO", "x"), (2, "three one ²5 سلام", "y"), (3, None, "x"), (None, "alone", "z"), (4, "", "y")]
    pages, once = words.counts_and_single_words(spark.createDataFrame(rows, "id int, text string, source string"), "id", "text", ["source"])
    assert sorted(map(str, map(tuple, pages.collect()))) == sorted(map(str, [(1, "x", 3, 0, 9), (2, "y", 3, 4, 8), (3, "x", 0, 0, 0), (None, "z", 1, 0, 5), (4, "y", 0, 0, 0)]))
    assert sorted(map(str, map(tuple, once.collect()))) == sorted(map(str, [("three", 2), ("سلام", 2), ("alone", None)]))


@pytest.mark.parametrize("block", [2, 100])
def test_texts_that_hold_probes(spark, monkeypatch, block):
    from studylake.operators import retrieval

    monkeypatch.setattr(retrieval, "PROBES", block)
    docs = spark.createDataFrame([(1, "abcabc", "s"), (2, None, "s"), (3, "", "s"), (4, "bca", "t")], "id int, text string, source string")
    probes = spark.createDataFrame([(10, "abc"), (11, "bca"), (12, "abc"), (13, ""), (14, None), (15, "zz")], "k int, p string")
    found = retrieval.holders(docs, probes, "text", "k", "p")
    assert sorted(map(tuple, found.collect())) == [(1, "s", 10), (1, "s", 11), (1, "s", 12), (4, "t", 11)]
    assert retrieval.holders(docs, probes.limit(0), "text", "k", "p").collect() == []


def test_row_numbers_over_hot_groups(spark):
    from pyspark.sql.window import Window

    from studylake.operators import relational

    df = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.lit("cold")).alias("k"), (F.col("id") * 37 % 101).alias("at"), "id").repartition(5)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("at", "id")))
    got = relational.row_numbers(df, ["k"], ["at", "id"])
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert relational.row_numbers(df.limit(0), ["k"], ["at", "id"]).collect() == []
