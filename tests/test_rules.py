"""Rules on small tables whose results are known."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from studylake import registry
from studylake.functions import classify, core, text
from studylake.operators import layout, learning, planning, relational, retrieval, sequential
from studylake.sources import files
from studylake.streaming import mastery as stream

NOW = dt.datetime(2024, 6, 15)
ATTEMPT = "user string, chapter string, attempted_at timestamp, is_correct boolean, score double, max_score double"


def one(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(1).alias("one_"))
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize(("correct", "score", "most", "expected"), [(None, 8.0, 10.0, 0.8), (None, None, None, None), (None, 12.0, 10.0, 1.0), (True, 0.0, 10.0, 1.0), (None, -1.0, 10.0, 0.0), (None, 1.0, 0.0, None)])
def test_credit(spark, correct, score, most, expected):
    df = spark.createDataFrame([(correct, score, most)], "c boolean, s double, m double")
    assert df.select(core.credit(F.col("c"), F.col("s"), F.col("m")).alias("x")).first().x == expected


def test_recency(spark):
    df = spark.createDataFrame([(NOW - dt.timedelta(days=14),), (NOW + dt.timedelta(days=3),)], "t timestamp")
    got = [r.x for r in df.select(core.recency(F.col("t"), F.lit(NOW)).alias("x")).collect()]
    assert got == [pytest.approx(math.exp(-1)), 1.0]


def test_rounding_of_negative_halves(spark):
    assert one(spark, core.half_up(F.lit(-2.5), 0)) == -2.0


def test_mastery_counts_unscored(spark):
    df = spark.createDataFrame([("u", "c", NOW, True, None, None), ("u", "c", NOW, None, None, None)], ATTEMPT)
    row = learning.mastery(df, F.lit(NOW), ["user", "chapter"]).first()
    assert (row.mastery, row.attempts) == (1.0, 2)
    assert learning.mastery(df.limit(0), F.lit(NOW), ["user"]).count() == 0


@pytest.mark.parametrize(("days", "expected"), [([1, 2, 3, 4], 4), ([0, 1, 2], 3), ([2, 3], 0), ([0, 2, 3], 1)])
def test_streak(spark, days, expected):
    """Days before today that have activity; today may be empty yet."""
    today = dt.date(2024, 6, 15)
    df = spark.createDataFrame([("u", today - dt.timedelta(days=n)) for n in days], "user string, day date")
    assert relational.streaks(df, ["user"], "day", F.lit(today)).first().streak == expected


def test_interval_join_has_an_open_end(spark):
    s = spark.createDataFrame([("u", NOW)], "user string, start timestamp")
    a = spark.createDataFrame([("u", NOW), ("u", NOW + dt.timedelta(hours=47, minutes=59)), ("u", NOW + dt.timedelta(hours=48)), ("u", NOW - dt.timedelta(seconds=1))], "user string, at timestamp")
    assert relational.within(s, a, ["user"], "start", "at", 48).count() == 2


def test_empty_scope_matches_nothing(spark):
    assert spark.range(5).where(relational.in_list(F.col("id"), [])).count() == 0


def test_upsert_twice_is_once(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    first = relational.latest_wins(old, new, ["k"])
    assert sorted(map(tuple, relational.latest_wins(first, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_repetition(spark):
    df = spark.createDataFrame([("u", i, i, q) for i, q in enumerate([4.0, 4.0, 4.0, 1.0])], "user string, at int, n int, q double")
    row = sequential.repetition_state(df, ["user"], "at", "n", "q").first()
    assert (row.ease, row.interval, row.repetitions) == (1.96, 1, 0)


def test_paper_sums_exactly():
    items = [("a", 9.5, "x"), ("b", 7.0, "y"), ("c", 6.5, "z"), ("d", 4.0, "x"), ("e", 3.5, "x")]
    assert sequential.assemble_paper(items) == ["a", "b", "e"]
    assert sequential.assemble_paper([("a", 19.0, "x"), ("b", 0.5, "y")]) is None
    assert sequential.assemble_paper([("a", 10.0, "x"), ("b", 5.0, "x"), ("c", 5.0, "y")]) is None
    assert sequential.assemble_paper([("a", 0.25, "x"), ("b", 0.75, "x"), ("c", 19.0, "y")]) == ["a", "b", "c"]


def test_rescaled_marks_sum_to_the_target():
    assert sum(sequential.rescale_marks([1.0, 2.0, 4.0], 20.0)) == 20.0
    assert sequential.rescale_marks([], 20.0) == []


def test_increasing_places():
    assert sequential.increasing_places([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5]
    assert sequential.increasing_places([]) == []


def test_rescaled_marks_have_a_half_at_least():
    assert sequential.rescale_marks([0.1, 10.0], 5.0) == [0.5, 4.5]
    assert sequential.rescale_marks([1.0, 1.0, 1.0], 20.0) == [6.5, 7.0, 6.5] or sum(sequential.rescale_marks([1.0, 1.0, 1.0], 20.0)) == 20.0
    assert sequential.rescale_marks([1.0, 1.0, 1.0], 1.0) == [0.5, 0.5, 0.5]


def test_plan_keeps_room_and_reviews():
    days = [planning.Day(60, None) for _ in range(6)]
    laid = list(planning.lay_out([("a", 0, 9), ("b", 0, 9), ("a", 0, 9), ("c", 2, 0)], days))
    assert laid[:4] == [(0, "a", "quiz", 30), (0, "b", "quiz", 30), (1, "a", "quiz", 30), (1, "c", "flashcards", 20)]
    assert laid[4:] == [(3, "a", "review", 15), (3, "b", "review", 15), (4, "c", "review", 15)]
    assert list(planning.lay_out([], days)) == [] == list(planning.lay_out([("a", 0, 0)], []))
    near = list(planning.lay_out([("a", 0, 9), ("b", 0, 1)], [planning.Day(120, 5)]))
    assert [x[2] for x in near] == ["exam_drill", "quiz"]


def test_plan_holds_three_chapters_a_day():
    laid = list(planning.lay_out([(c, 1, 0) for c in "abcd"], [planning.Day(500, None), planning.Day(500, None)]))
    assert [x[0] for x in laid] == [0, 0, 0, 1]


@pytest.mark.parametrize(("out", "expected"), [(20, 120), (14, 120), (7, 150), (1, 175), (0, 120), (None, 120)])
def test_capacity(spark, out, expected):
    df = spark.createDataFrame([(out,)], "d int")
    assert df.select(planning.daily_capacity(F.col("d"), F.lit(120)).alias("x")).first().x == expected


@pytest.mark.parametrize(("mastery", "attempts", "out", "expected"), [(0.4, 9, None, 0.6), (0.4, 2, None, 0.3), (0.7, 9, None, 0.0), (0.8, 9, 0, 0.45), (0.4, 9, 7, 1.2), (0.4, 9, 30, 0.6)])
def test_chapter_weight(spark, mastery, attempts, out, expected):
    df = spark.createDataFrame([(mastery, attempts, out)], "m double, a int, d int")
    assert df.select(planning.chapter_weight(F.col("m"), F.col("a"), F.col("d")).alias("x")).first().x == pytest.approx(expected)


def test_spread_takes_one_large_of_a_chapter(spark):
    rows = [(1, "x", 6.0), (2, "x", 7.0), (3, "x", 2.0), (4, "y", 1.0), (5, "y", 9.0), (6, "y", 8.0)]
    pool = spark.createDataFrame(rows, "id int, ch string, m double").withColumn("s", F.lit(1))
    got = planning.pick_spread(pool, ["s"], "ch", "m", [F.col("id")], 4)
    assert [r.id for r in got.orderBy("pick").collect()] == [1, 4, 3, 5]


def test_usable_schemes(spark):
    rows = [([("a",), ("b",)], "t"), ([("x" * 201,)], "t"), ([("y" * 70,)], "y" * 90), ([("short",)], None), ([], "t"), (None, "t")]
    df = spark.createDataFrame(rows, "s array<struct<criterion string>>, t string")
    assert [r.x for r in df.select(planning.usable_scheme(F.col("s"), F.col("t")).alias("x")).collect()] == [True, False, False, True, False, False]


def test_folds(spark):
    df = spark.createDataFrame([("أحمـد  ١٢",), ("plain  text",), (None,)], "t string")
    rows = df.select(text.fold_arabic(F.col("t")).alias("a"), text.fold_arabic_inline(F.col("t")).alias("b")).collect()
    assert rows[0].a == rows[0].b == "احمد 12"
    assert (rows[1].a, rows[1].b) == ("plain text", "plain  text")
    assert rows[2].a is None


def test_csv_with_quotes_and_line_ends(spark):
    df = spark.createDataFrame([("a \"b\", c\nd", 1), ("é;x", 2)], "t string, n int")
    path = files.shared_path(spark, "t")
    files.write_csv(df, path)
    assert sorted(map(tuple, files.read_csv(spark, path, "t string, n int").collect())) == sorted(map(tuple, df.collect()))


def test_csv_keeps_white_space_empty_texts_and_nulls(spark):
    odd = ["", None, " a", "a ", "\t", "\n", "a\r\n", "a\r", "\r\nb", '"', '""', ' "', "\\", '\\"', ",", "#a", "null", "a\x00", '\x00"', '"\x00,', "\u2028", "\u3000a"]
    rows = [(i, t, odd[(i * 7 + 1) % len(odd)]) for i, t in enumerate(odd)] + [(None, None, None), (None, "", None)]
    path = files.shared_path(spark, "t")
    files.write_csv(spark.createDataFrame(rows, "n int, t string, u string").repartition(3), path)
    assert sorted(map(repr, map(tuple, files.read_csv(spark, path, "n int, t string, u string").collect()))) == sorted(map(repr, rows))
    path = files.shared_path(spark, "t")
    files.write_spreadsheet_csv(spark.createDataFrame([(1, ""), (2, None), (3, ' "')], "n int, t string").coalesce(1), path)
    assert sorted(map(tuple, files.read_csv(spark, path, "n int, t string").collect())) == [(1, ""), (2, None), (3, ' "')]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("u", "c", NOW - dt.timedelta(days=n), n % 2 == 0, None, None) for n in range(6)]
    df = spark.createDataFrame(rows, ATTEMPT).withColumnRenamed("user", "user_id")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    credit = core.credit(F.col("is_correct"), F.col("score"), F.col("max_score"))
    q = stream.mastery_sums(source, F.lit(NOW), credit).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = stream.mastery_of(spark.table("sums")).first().mastery
    assert got == learning.mastery(df, F.lit(NOW), ["user_id", "chapter"]).first().mastery


def test_index_recall_and_edges(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    probes = e.where("vec_id % 20 = 0")
    near = lambda df: {(r.probe_id, r.vec_id) for r in df.collect()}
    exact = near(retrieval.knn(probes, e, [], 10))
    found = retrieval.index_search(probes, e, 10)
    assert len(exact & near(found)) / len(exact) >= 0.9
    assert found.join(retrieval.pair_similarities(found.select("probe_id", "vec_id"), probes, e).withColumnRenamed("sim", "own"), ["probe_id", "vec_id"]).where("sim <> own").count() == 0
    index = retrieval.fit_index(e)
    assert 20 * 10 <= e.count() / 10 and len(index.encode(index.lists)[0]) * 16 == 64 * 4  # whole vectors that a probe reads; a code is a sixteenth of a vector
    assert retrieval.index_search(probes, e.limit(0), 10).count() == 0
    assert retrieval.index_search(probes.limit(0), e, 10).count() == 0


def test_budget_cuts_other_scripts_earlier(spark):
    df = spark.createDataFrame([("a" * 7000,), ("ع" * 5000,), ("ab" + "ع" * 5000,), ("",), (None,)], "t string")
    assert [None if r.x is None else len(r.x) for r in df.select(retrieval.within_budget(F.col("t")).alias("x")).collect()] == [6000, 2333, 2335, 0, None]


def test_containment_is_exact_behind_the_prefix(spark):
    asked = spark.createDataFrame([(1, [f"w{i}" for i in range(10)]), (2, ["a", "b"]), (3, [f"x{i}" for i in range(7)])], "id long, words array<string>")
    texts = spark.createDataFrame([(10, [f"w{i}" for i in range(1, 12)]), (11, [f"w{i}" for i in range(2, 12)]), (12, []), (13, [f"x{i}" for i in range(7)])], "id long, words array<string>")
    got = {(r.asked_id, r.id, r.containment) for r in retrieval.contained(asked, texts).collect()}
    assert got == {(1, 10, 0.9), (3, 13, 1.0)}


def test_titles_in_quotes(spark):
    df = spark.createDataFrame([("see «The Cat» and \"The  Dog\" and «The Cat», not \"abc\"",), ("none",)], "t string")
    assert [r.x for r in df.select(retrieval.quoted_titles(F.col("t")).alias("x")).collect()] == [["The Cat", "The  Dog"], []]


def test_match_needs_its_first_token_and_local_slack():
    assert layout.Places("a x b c".split()).matches("a b c".split()) == [(1.0, 1, 0)]
    assert layout.Places("x a b".split()).matches("a b".split()) == [(1.0, 0, 1)]
    assert layout.Places("a w x y z b".split()).matches("a b".split()) == [(0.5, 0, 0)]
    assert layout.Places("a b a b".split()).matches("a b".split(), 1) == [(1.0, 0, 2)]
    assert layout.Places([]).matches(["a"]) == layout.Places(["a"]).matches([]) == []


def test_reading_order_of_columns():
    boxes = [(0.55, 0.1, 0.9, 0.12), (0.1, 0.1, 0.45, 0.12), (0.1, 0.13, 0.45, 0.15), (0.55, 0.13, 0.9, 0.15)]
    assert layout.reading_order(boxes) == [1, 2, 0, 3]
    assert layout.reading_order(boxes, rtl=True) == [0, 3, 1, 2]
    assert layout.reading_order([]) == []


def test_label_runs_go_and_content_stays():
    assert layout.without_label_runs("See this.\nNorth\nSouth\n\nEast\nWest\nThe map shows it all here.") == "See this.\n\nThe map shows it all here."
    for kept in ("a\nb", "A\n→ B\nC\nD", "AUC Ile\nGGG Gly\nUUU\nCCC", "1) yes\n2) no\n3) one\n4) two"):
        assert layout.without_label_runs(kept) == kept


def test_soft_wraps():
    long = "Some of this energy must be delivered to every single cell and it must"
    assert layout.unwrapped(f"{long}\ncome from glucose.") == f"{long} come from glucose."
    for kept in (f"{long}.\nNext", f"{long}\n1) part", f"{long}\n| a | b |", "short\nline", f"```\n{long}\nx\n```", f"$$\n{long}\nx\n$$", f"{long}\n\nx"):
        assert layout.unwrapped(kept) == kept


def test_page_numbers():
    assert layout.in_sequence([1, 9, 2, None, 3]) == [True, False, True, False, True]
    assert layout.printed_order([None, 3, None, 1, 2]) == [0, 3, 4, 1, 2]
    assert layout.printed_order([]) == []


@pytest.mark.parametrize(("old", "offset", "new", "expected"), [
    ("alpha beta gamma delta epsilon", 11, "zero alpha  beta gamma delta epsilon", 17), ("alpha", 0, "zero", 0), ("alpha", 99, "zero", 4), ("aa bb", 3, "cc dd", None),
    ("قال أحمد الكتاب", 4, "مقدمة قال احمد الكتاب", 10), ("end of it", 7, "the end ofَ xx", 11),
])
def test_offsets_move_with_their_words(spark, old, offset, new, expected):
    assert one(spark, layout.moved_offset(F.col("a"), F.col("o"), F.col("b")), a=old, o=offset, b=new) == expected


def test_questions_are_searched_by_phrase_exclusion_and_alternative(spark):
    docs = spark.createDataFrame([(1, "La photosynthèse est un processus"), (2, "un processus est long"), (3, "قال الأستاذ: الطاقة الشمسية"), (4, "La tasse est là, la photosynthèse non"), (5, None), (6, "")], "doc_id int, text string")
    asked = [("phrase", '"est un processus"'), ("not", "photosynthèse -tasse"), ("or", "long or tasse"), ("arabic", "الاستاذ الطاقه"), ("none", "-processus"), ("empty", ""), ("all", "est processus")]
    found = retrieval.search(docs, spark.createDataFrame(asked, "query_id string, question string")).collect()
    got = {q: sorted(r.id for r in found if r.query_id == q) for q, _ in asked}
    assert got == {"phrase": [1], "not": [1], "or": [2, 4], "arabic": [3], "none": [], "empty": [], "all": [1, 2]}
    assert {r.rank for r in found if r.query_id == "all"} == {1.0}


def test_concept_gates(spark):
    gate = lambda text_, own: one(spark, retrieval.concept_gate(F.col("t"), F.col("g")), t=text_, g=own)
    assert gate("what is energy", None) == 0.5 and gate("ما هي الطاقة", None) == 0.45 and gate("ما هي الطاقة", 0.7) == 0.7


def test_visuals_of_a_group_go_together(spark):
    rows = [("p", 1, "active", None, None, 5, True), ("p", 2, "active", "g", 2, 1, True), ("p", 3, "active", "g", 1, 3, True), ("p", 4, "active", "h", 1, 0, True), ("p", 5, "active", "h", 2, 9, False), ("p", 6, "retired", None, None, 0, True)]
    df = spark.createDataFrame(rows, "paper string, visual_id int, status string, group_key string, group_part int, reading_order int, ok boolean")
    assert [r.visual_id for r in layout.select_visuals(df, ["paper"], F.col("ok")).orderBy("place").collect()] == [3, 2, 1]


@pytest.mark.parametrize(("text_", "expected"), [("", "smalltalk"), ("Ça va ?", "smalltalk"), ("What should I revise tonight?", "planning"), ("can you help me with my schedule", "planning"), ("Who are you?", "capability"), ("derive x squared", "curriculum"), ("what is this " * 12, "curriculum"), ("من أنت؟", "capability")])
def test_intents(spark, text_, expected):
    assert one(spark, classify.intent(classify.fold_message(F.col("t"))), t=text_) == expected


@pytest.mark.parametrize(("text_", "expected"), [("Sujet : la liberté", ("essay", "high")), ("Discuss the text below", ("essay", "high")), ("Explain this passage", ("comprehension", "high")), ("Solve the following equation", ("concept", "low")), ("Solve x + 1 = 2", ("concept", "high")), ("استخرج من المستند", ("comprehension", "high")), ("ناقش هذا القول", ("essay", "high"))])
def test_question_kinds(spark, text_, expected):
    assert tuple(one(spark, classify.question_kind(classify.fold_question(F.col("t"))), t=text_)) == expected


def test_chunks_keep_all_words_within_bounds():
    text_ = "\n\n".join(["<!-- page 3 -->", "# One", "Word here. " * 300, "$$x^2$$", "tail", "## Two", "Short."])
    found = layout.chunks(text_, "Book")
    assert found[0][0].startswith("Book — One\n\nWord") and found[0][1] == 3
    assert all(len(c) <= layout.MOST + layout.LEAST + 40 for c, _ in found)
    assert sum(c.count("Word here.") for c, _ in found) == 300
    assert found[-1][0].endswith("$$x^2$$\n\ntail\n\nShort.")
    assert layout.chunks("") == []


def test_long_block_is_not_cut_in_a_formula():
    block = "a " * 400 + "$$" + "x. " * 300 + "$$ end. " + "b " * 400
    assert any("$$" + "x. " * 300 + "$$" in p for p in layout.cut_block(block))
    assert [len(p) for p in layout.cut_block("y" * 5000)] == [2200, 2200, 600]


def test_hard_cut_moves_out_of_a_formula():
    shown, inline = "$$" + "x " * 100 + "$$", "$" + "y" * 300 + "$"
    for formula in (shown, inline):
        block = "a" * 2100 + formula + "b" * 3000
        assert [*layout.cut_block(block)][:2] == ["a" * 2100, (formula + "b" * 3000)[: layout.MOST]]
    long = "$$" + "x" * 3000 + "$$"
    assert [*layout.cut_block("a" * 100 + long + "b" * 2300)] == ["a" * 100, long, "b" * 2200, "b" * 100]
    assert [len(p) for p in layout.cut_block("$" + "p" * 5000 + "$")] == [2200, 2200, 602]
    assert layout.chunks("a" * 2100 + shown + "b" * 300, "Book") == [("Book\n\n" + "a" * 2100, None), ("Book\n\n" + shown + "b" * 300, None)]


def test_chunks_have_the_source_as_their_trail(spark, tmp_path):
    shown = "$$" + "x " * 100 + "$$"
    texts = [(1, "# One\n\n" + "Word here. " * 300, "book"), (2, "a" * 2100 + shown + "b" * 300, "paper"), (3, "no source", None), (4, None, "book"), (5, "", "book")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(registry.queries()["j04_chunks"](spark, str(tmp_path)).collect())
    assert [(r.doc_id, r.seq) for r in found] == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    assert all(r.text.startswith("book — One\n\nWord") for r in found[:2])
    assert [r.text for r in found[2:]] == ["paper\n\n" + "a" * 2100, "paper\n\n" + shown + "b" * 300, "no source"]


def test_rows_bind_to_the_longest_label():
    parts = [("A",), ("A", "1"), ("B", "2")]
    assert layout.bind_rows([(), ("A", "1", "c"), (), ("A", "9"), ("C",)], parts) == [None, 1, 1, 0, 0]
    assert layout.bind_rows([("C", "A", "1"), ("B", "2")], parts) == [1, 2]
    assert layout.bind_rows([("C",), ("1",)], parts) == [None, None]
    numbered = [("A", "1"), ("B", "2")]
    assert layout.bind_rows([("A", "1"), ("B", "B"), ("2",), ("Z", "Q")], numbered) == [0, 1, 1, None]


def test_scheme_tables_are_turned():
    rows = [["1.a", "because", "0.5"], ["1.b", "so", "1"], ["2", "thus", "2 pts"]]
    assert layout.oriented(rows) == rows
    assert layout.oriented([r[::-1] for r in rows]) == rows
    assert layout.oriented([["x", "y", "z"]] * 3) is None and layout.oriented([]) is None


@pytest.mark.parametrize(("text_", "expected"), [("٣", 3.0), ("XIV", 14.0), ("ix", 9.0), ("½", 0.5), ("1,5", 1.5), ("", None), ("abc", None)])
def test_numerals(spark, text_, expected):
    assert one(spark, text.number_of(F.col("t")), t=text_) == expected
