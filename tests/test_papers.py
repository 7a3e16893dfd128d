"""Papers, tables, contents pages, figures, LaTeX and alignment on cases by hand and against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from studylake.functions import latex
from studylake.operators import geometry, layout, papers


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()] if columns else df.collect()


# ---- papers
PAPER = """1) before any head (3 marks)
Exercise 1 (7 points) Energy
1) Define energy. (2 pts)
that goes on
A- Heat
1. Say why (1,5 point)
1-2: Show it
a) x
B. Cold
1) yes
Exercice II
1) again
1) and more (4 pts)
(a) no label here"""


def test_parts_of_a_paper(spark):
    df = spark.createDataFrame([(1, PAPER), (2, None), (3, ""), (4, "no parts\nhere")], "id int, text string")
    found = papers.paper_parts(df, "id", "text").orderBy("place").collect()
    assert [tuple(r) for r in found] == [
        (1, 0, "1", "before any head (3 marks)", 3.0, 0), (1, 1, "1", "Define energy. (2 pts) that goes on", 2.0, 2), (1, 1, "A.1", "Say why (1,5 point)", 1.5, 5), (1, 1, "A.1.2", "Show it", None, 6),
        (1, 1, "B.1", "yes", None, 9), (1, 2, "1", "again and more (4 pts) (a) no label here", 4.0, 11),
    ]


TABLES = """| Q | Answer | Mark |
|---|:--:|---|
| 1.a | because \\| so | 0.5 |
|  | more of it |  |
| 1.b | melts | ½ |
text
| x | y | z |
| x | y | z |
| x | y | z |
<table><tr><th colspan="3">Scheme</th></tr><tr><td>1</td><td>hot<br>air</td><td rowspan=2>2</td></tr><tr><td>3</td><td>and &amp; cold</td></tr><tr><td>2 pts</td><td>thus</td><td>3)</td></tr><tr><td>1</td><td>end</td><td>4</td></tr></table>
<table><tr><td rowspan="0" colspan="x">open"""


def test_cells_and_schemes(spark):
    df = spark.createDataFrame([(7, TABLES), (8, None), (9, "")], "id int, text string")
    cells = papers.table_cells(df, "id", "text")
    assert rows(cells.where("table = 2 AND row IN (0, 2)"), "row", "column", "text") == [(0, 0, "Scheme"), (0, 1, ""), (0, 2, ""), (2, 0, "3"), (2, 1, "and & cold"), (2, 2, "2")]
    # the row "2 pts | thus | 3)" has no label first, so it goes on with the one above
    assert rows(papers.scheme_rows(cells, "id"), "table", "label", "answer", "mark") == [
        (0, "1.a", "because | so more of it", 0.5), (0, "1.b", "melts", 0.5), (2, "1", "hot air end", 2.0), (2, "3", "and & cold 2 pts thus 3)", 2.0),
    ]


def test_marks_of_cells(spark):
    cells = ["0.5", "2 pts", "½", "1¾", "20", "21", "0", "", "pts", "3.a", "12,5 points"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, x string").select("i", papers._mark(F.col("x")).alias("m")).orderBy("i")
    assert [r.m for r in df.collect()] == [0.5, 2.0, 0.5, 1.75, 20.0, None, None, None, None, None, 12.5]


def test_contents_nest(spark):
    text = "Contents\n1. Energy ........ 12\n1.1 Heat ..... 13\n1.1.1 Cold     14\n1.2 Air ..... 15\n3 Waves ... 30\nno page\n2.5 Odd ..... 31"
    found = papers.contents(spark.createDataFrame([(1, text), (2, None)], "book int, text string"), "book", "text")
    assert rows(found, "place", "number", "title", "page", "depth", "parent") == [(0, "1", "Energy", 12, 1, None), (1, "1.1", "Heat", 13, 2, 0), (2, "1.1.1", "Cold", 14, 3, 1), (3, "1.2", "Air", 15, 2, 0), (4, "3", "Waves", 30, 1, None), (5, "2.5", "Odd", 31, 2, 4)]


def test_offsets_and_spans(spark):
    entries = spark.createDataFrame([(1, 0, "A", 1), (1, 1, "B", 4), (1, 2, "C", 4), (2, 0, "A", 5)], "book int, place int, title string, page int")
    heads = spark.createDataFrame([(1, 3, "A"), (1, 6, "B"), (1, 9, "A"), (1, 90, "A"), (1, 1, "x"), (2, 4, "A"), (2, 6, "A")], "book int, scan int, title string")
    offsets = papers.page_offsets(entries, heads, "book")
    assert sorted(map(tuple, offsets.collect())) == [(1, 2, 2), (2, -1, 1)]
    pages = spark.createDataFrame([(1, n) for n in range(1, 9)] + [(2, 4), (2, 3)], "book int, scan int")
    assert rows(papers.chapter_pages(entries, offsets, pages, "book"), "book", "scan", "place") == [(1, 1, None), (1, 2, None), (1, 3, 0), (1, 4, 0), (1, 5, 0), (1, 6, 2), (1, 7, 2), (1, 8, 2), (2, 3, None), (2, 4, 0)]


def test_figures_that_lines_name(spark):
    df = spark.createDataFrame([("documents 2 to 4, 6a and Fig. 7b; tableaux 1-2",), ("Docs 5 to 20",), ("figure 3 à 2",), ("none",), (None,)], "t string")
    found = [None if r.x is None else [(k.kind[:3], k.number, k.suffix) for k in r.x] for r in df.select(papers.figures_named(F.col("t")).alias("x")).collect()]
    assert found == [[("doc", 2, ""), ("doc", 3, ""), ("doc", 4, ""), ("doc", 6, "a"), ("fig", 7, "b"), ("tab", 1, ""), ("tab", 2, "")], [("doc", 5, ""), ("doc", 20, "")], [("fig", 3, ""), ("fig", 2, "")], [], None]
    lines = [(1, 0, "Document 1."), (1, 3, "Use document 1."), (1, 6, "Document 1: the heart"), (1, 7, "Read documents 1 and 2a, then figure 9."), (1, 8, "**Document 2**"), (1, 9, "Document 2b. x"), (2, 0, "See document 1")]
    owned = papers.owners_named(spark.createDataFrame(lines, "p int, place int, text string"), "p")
    assert rows(owned, "p", "place", "kind", "number", "caption") == [(1, 3, "document", 1, 0), (1, 7, "document", 1, 6), (1, 7, "document", 2, 8), (1, 7, "figure", 9, None), (2, 0, "document", 1, None)]


# ---- LaTeX
CONVERTED = [
    (r"\title{A book} \author{X} \section{One} see $x_{1}$ \label{a}", "# A book\n\n## One\n see $x_{1}$"), (r"\begin{itemize} \item first \item[b)] second \end{itemize}", "- first b) second"),
    (r"\begin{tabular}{|c|c|} \hline a & b \\ \hline $1$ & 2 \\ \end{tabular}", "| a | b |\n| --- | --- |\n| $1$ | 2 |"), (r"$$\hline$$ \hline end", r"$$\hline$$  end"), ("plain & {x}", "plain & {x}"),
    (r"\includegraphics[width=1]{https://x.org/a.png} \subsection*{Two}", "[figure: not extracted]\n### Two"), (r"open {\textbf{a", "open {a}"), (r"\foo{bar} }", r"\foo{bar} }"),
    (r"\begin{tabular}{ccc} \multicolumn{2}{c}{ab} & c \\ 1 & 2 & {x} \end{tabular} & z", "| ab |  | c |\n| --- | --- | --- |\n| 1 | 2 | {x} | & z"), (r"\footnote{a \textbf{b} c} d \end{center}", "d"),
]
DOLLARS = [
    (r"so \(x^2\) is", "so $x^2$ is"), (r"see \[y\] there", "see \n\n$$\ny\n$$\n\n there"), ("a $$z$$ b", "a $z$ b"), ("$$z$$", "$$z$$"), ("is $٣+۴$ and ٣", "is $3+4$ and ٣"), ("$$a$$ b", "$a$ b"),
    (r"has $$ \begin{cases} a", "has\n\n$$\n\\begin{cases} a\n\\end{cases}\n$$"), (r"a \\[2pt] b", r"a \\[2pt] b"), ("cost $5", "cost $5"), ("a\n$$\nx\n$$\nb", "a\n$$\nx\n$$\nb"), ("open $$x", "open $$x"), (r"\] \)", r"\] \)"),
    ("text $$\\begin{cases}a\\end{cases}$$", "text\n\n$$\n\\begin{cases}a\\end{cases}\n$$"), (r"$$\begin{array}x\begin{cases}y", "$$\n\\begin{array}x\\begin{cases}y\n\\end{cases}\n\\end{array}\n$$"),
]


def test_latex_cases():
    assert [latex.to_markdown(a) for a, _ in CONVERTED] == [b for _, b in CONVERTED]
    assert [latex.with_dollars(a) for a, _ in DOLLARS] == [b for _, b in DOLLARS]


@pytest.mark.parametrize("text", ["\\textbf{" * 30_000, "$" * 100_000, "\\begin{itemize}" * 10_000 + "\\end{center}" * 10_000, "{" * 50_000 + "}" * 50_000, "\\[" * 50_000, "a $ " * 50_000, "$a$ " * 50_000])
def test_hostile_latex_is_linear(text):
    began = time.process_time()
    latex.to_markdown(text)
    latex.with_dollars(text)
    assert time.process_time() - began < 5


# ---- lines and orders
def test_label_runs_and_wraps():
    long = "Some of this energy must be delivered to every single cell and it must"
    assert layout.without_label_runs("See this.\nNorth\nSouth\n\nEast\nWest\nThe map shows it all here.") == "See this.\n\nThe map shows it all here."
    for kept in ("A\n→ B\nC\nD", "AUC Ile\nGGG Gly\nUUU\nCCC", "a\nb", "1) yes\n2) no\n3) one\n4) two"):
        assert layout.without_label_runs(kept) == kept
    assert layout.unwrapped(f"{long}\nof it\nand of that") == f"{long} of it and of that"
    for kept in (f"{long}.\nNext", f"{long}\n1) part", f"$$\n{long}\nx\n$$", "short\nline"):
        assert layout.unwrapped(kept) == kept


def test_orders_and_bindings():
    assert layout.reading_order([(0.55, 0.1, 0.9, 0.12), (0.1, 0.1, 0.45, 0.12), (0.1, 0.13, 0.45, 0.15), (0.55, 0.13, 0.9, 0.15)]) == [1, 2, 0, 3]
    split = lambda x: [tuple(y.split(".")) if y else () for y in x.split("|")]
    assert layout.bind_rows(split("|A.1.c||A.9|C"), split("A|A.1|B.2")) == [None, 1, 1, 0, 0]
    assert layout.bind_rows(split("A.1|B.B|2|Z.Q"), split("A.1|B.2")) == [0, 1, 1, None]


def best_chain(heads, stream, line_of):
    """The chain by trying every candidate after every earlier one."""
    places, begins = layout.Places(stream), {}
    for i, line in enumerate(line_of):
        begins.setdefault(line, i)
    ends = [((0.0, 0, 0), [])]
    for head, probes in enumerate(heads):
        found = {}
        for probe in probes:
            for score, stepped, place in places.matches(probe):
                if score >= layout.FLOOR:
                    at = begins[line_of[place]]
                    found[at] = max(found.get(at, (0.0, 0)), (round(score, 6), -stepped))
        new = []
        for place, (score, stepped) in found.items():
            for (total, less, _), chain in ends:
                if not chain or chain[-1][1] < place:
                    new.append(((round(total + score, 6), less + stepped, -place), [*chain, (head, place)]))
        ends += new
    return max(ends, key=lambda x: x[0])


@pytest.mark.parametrize("seed", range(30))
def test_alignment_as_all_chains(seed):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(8)}" for _ in range(30)]
    line_of = sorted(rnd.randrange(12) for _ in words)
    heads = [[[f"w{rnd.randrange(8)}" for _ in range(3)] for _ in range(rnd.randrange(1, 3))] for _ in range(4)]
    got = layout.align(heads, words, line_of)
    top, chain = best_chain(heads, words, line_of)
    taken = [(i, p) for i, (p, *_) in enumerate(got) if p is not None]
    assert [p for _, p in taken] == sorted({p for _, p in taken})
    assert round(sum(s for _, s, _, _ in got), 2) == pytest.approx(top[0], abs=0.01) and (not chain or taken[-1][1] == chain[-1][1])


def test_alignment_bands():
    head = lambda *probes: [[p.split() for p in probes]]
    assert layout.align(head("solve the equation") + head("find the area"), "solve the equation now later find the area of it".split()) == [(0, 1.0, 0, "EXACT"), (5, 1.0, 0, "EXACT")]
    assert layout.align(head("find the area"), "find the area x y find the area".split()) == [(0, 1.0, 0, "AMBIGUOUS")]
    assert layout.align(head("a b") + [[]], "c d".split()) == [(None, 0.0, 0, "UNRESOLVED")] * 2
    # the second probe finds what the first misses, and the place is its line's start
    assert layout.align(head("lost words here", "the body of it"), "title x the body y of it".split(), [0, 0, 1, 1, 1, 1, 1]) == [(2, 1.0, 1, "EXACT")]
    # a greedy search would give the first head the later place that scores more and leave the second none
    assert [r[0] for r in layout.align(head("a b c d") + head("e f g h"), "a b x d e f g h a b c d".split())] == [0, 4]


# ---- geometry
def test_figures_beside_stretches(spark):
    figures = spark.createDataFrame([(1, 1, 1, 120.0, 180.0, 300.0), (1, 2, 1, 230.0, 260.0, 300.0), (1, 3, 1, 10.0, 60.0, 700.0), (1, 4, 1, 500.0, 600.0, 90.0), (1, 5, 2, 300.0, 320.0, 90.0), (2, 6, 1, 5.0, 9.0, 900.0), (1, 7, 3, 500.0, 510.0, 9.0)], "p int, figure int, page int, top double, bottom double, width double").withColumns({"page_height": F.lit(1000.0), "page_width": F.lit(1000.0)})
    stretches = spark.createDataFrame([(1, 1, 1, 100.0, 200.0), (1, 1, 1, 280.0, 400.0), (1, 2, 2, 350.0, 500.0)], "p int, page int, ordinal int, top double, bottom double")
    found = rows(geometry.figure_places(figures, stretches, "p"), "figure", "relation", "owner", "above", "above_relation", "below", "below_relation", "verdict")
    assert found == [
        (1, "INSIDE", 1, None, None, None, None, "UNIQUE"), (2, "INSIDE", 1, None, None, None, None, "UNIQUE"), (3, "BANNER", None, None, None, None, None, "BANNER"), (4, "GAP", None, 1, "NEAR", 2, "DISTANT", "MULTIPLE"),
        (5, "GAP", None, 1, "DISTANT", 2, "NEAR", "MULTIPLE"), (6, "BANNER", None, None, None, None, None, "BANNER"), (7, "GAP", None, 2, "DISTANT", None, None, "WEAK"),
    ]


def naive_growth(boxes, lines):
    """Rounds over boxes in order of number; the nearest line that may be taken, by a scan of all lines and all boxes."""
    now, left, taken = {k: list(v) for k, v in boxes.items()}, dict(lines), dict.fromkeys(boxes, 0)
    meets = lambda a, b: max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])
    for _ in range(geometry.ROUNDS):
        for k in sorted(now):
            best = None
            for n, t in left.items():
                b = now[k]
                gap_below, gap_above = t[1] - b[3], b[1] - t[3]
                side = 0 if 0 <= gap_below <= geometry.BELOW_GAP else 1 if 0 <= gap_above <= geometry.ABOVE_GAP else None
                if side is None or not b[0] - geometry.OUT <= (t[0] + t[2]) / 2 <= b[2] + geometry.OUT or t[2] - t[0] > b[2] - b[0] + geometry.WIDER:
                    continue
                union = [min(b[0], t[0]), min(b[1], t[1]), max(b[2], t[2]), max(b[3], t[3])]
                if any(meets(union, now[o]) and not meets(boxes[k], boxes[o]) for o in now if o != k):
                    continue
                best = min(best or (9, 0, 0, 0), (side, gap_above if side else gap_below, n, union))
            if best:
                now[k], taken[k] = best[3], taken[k] + 1
                del left[best[2]]
    return {k: (*now[k], taken[k]) for k in now}


def test_growth_as_a_naive_loop(spark):
    rnd, boxes, lines = random.Random(4), {}, {}
    for page in range(60):
        cut = lambda w, h: (lambda x, y: (x, y, x + rnd.randrange(20, w), y + rnd.randrange(5, h)))(rnd.randrange(300) * 1.0, rnd.randrange(500) * 1.0)
        boxes[page] = {i: cut(200, 120) for i in range(rnd.randrange(1, 6))}
        lines[page] = {i: cut(150, 20) for i in range(rnd.randrange(0, 9))}
    b = spark.createDataFrame([(p, i, *x) for p, of in boxes.items() for i, x in of.items()], "page int, box int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([(p, i, *x, "Fig. 1") for p, of in lines.items() for i, x in of.items()] + [(0, 99, 0.0, 0.0, 900.0, 900.0, "12.5"), (0, 98, 0.0, 0.0, 900.0, 900.0, "x" * 25)], "page int, line int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.page, r.box): (r.x0, r.y0, r.x1, r.y1, r.taken) for r in geometry.grown_boxes(b, t, ["page"]).collect()}
    assert got == {(p, i): x for p in boxes for i, x in naive_growth(boxes[p], lines[p]).items()} and any(x[4] for x in got.values())
    meets = lambda a, c: max(a[0], c[0]) < min(a[2], c[2]) and max(a[1], c[1]) < min(a[3], c[3])
    for p, of in boxes.items():
        assert not any(meets(got[p, i], got[p, j]) and not meets(of[i], of[j]) for i in of for j in of if i < j)
