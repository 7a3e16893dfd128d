"""Reading order, alignment and repair of pages; a group is one page or paper, so it is small whatever the number of pages."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studylake.operators.sequential import increasing_places

# Slack of a match, score bands, least margin over a rival, least gaps of the cut as shares of a page.
SLACK, EXACT, STRONG, FLOOR, MARGIN = 3, 0.80, 0.60, 0.45, 0.10
COLUMN_GAP, LINE_GAP = 0.01, 0.004
# Fixed values of the repairs: lengths in characters, patterns of lines.
LABEL, LABEL_RUN, WRAPPED = 14, 4, 55
NUMBERED = re.compile(r"^\(?(\d+(?:[-–.]\d+)*|[a-hA-H]|[IVX]{1,4})\s*[-–.)]\s*")
CONTENT = re.compile(r"[→⟶⇌⇒+•]|^[AUGCT]{3}\b")
SENTENCE_END = re.compile(r"[.!?:;。！？][\"'”’)\]]?\s*$")
OPENS_PART = re.compile(r"^\s*(\d+(\.\d+)*\s*[-.)\]]|[a-zA-Z]\s*[-.)\]]|[IVX]+\s*[-.)\]]|[-*•▪])")
FENCE = re.compile(r"\s*(```|~~~)")
STRUCTURAL = re.compile(r"^\s*(\||#{1,6}\s|>|-{3,}|={3,}|```|~~~|\$\$)")


class Places:
    """Where each token of a stream stands."""

    def __init__(self, stream: Sequence[str]):
        self.of: dict[str, list[int]] = defaultdict(list)
        for place, token in enumerate(stream):
            self.of[token].append(place)

    def follow(self, probe: Sequence[str], start: int) -> tuple[float, int]:
        """(share of the probe found in order, tokens stepped over) from the place of its first token; each next one lies at most SLACK tokens further on."""
        reached, hits = start, 1
        for token in probe[1:]:
            own = self.of.get(token, [])
            nearest = bisect_right(own, reached)
            if nearest < len(own) and own[nearest] <= reached + 1 + SLACK:
                reached, hits = own[nearest], hits + 1
        return hits / len(probe), reached - start + 1 - hits

    def matches(self, probe: Sequence[str], begin: int = 0) -> list[tuple[float, int, int]]:
        """(score, tokens stepped over, place) wherever the probe's first token stands from begin on, best first."""
        starts = self.of.get(probe[0], []) if probe else []
        found = [(*self.follow(probe, at), at) for at in starts[bisect_left(starts, begin) :]]
        return sorted(found, key=lambda m: (-m[0], *m[1:]))


def align(heads: Sequence[Sequence[Sequence[str]]], stream: Sequence[str], line_of: Sequence[int] | None = None) -> list[tuple[int | None, float, int, str]]:
    """(place, score, tokens stepped over, band) of each head in a stream of tokens; places rise from head to head.

    A head is several probes (its first words, the words that follow); each place where a probe's first token stands and at least FLOOR of the probe
    follows is a candidate, moved to the start of its line (line_of: the line of each token), and has the best score that any probe gives it. Of all
    chains of candidates, one for each head or none, that with the greatest sum of scores is taken, of equal ones that which steps over the fewest
    tokens, then the one that ends earliest. The best chain up to a place is kept in a tree of prefixes: n log n for n candidates.

    A rival is a candidate of the same head that does not overlap the one taken; within MARGIN of its score the head is AMBIGUOUS.
    """
    places = Places(stream)
    begins: dict[int, int] = {}
    for i, line in enumerate(line_of or ()):
        begins.setdefault(line, i)
    best: list[tuple[float, int, int, int]] = [(0.0, 0, 0, -1)] * (len(stream) + 2)  # (sum, -stepped, -last place, node) of chains that end before
    nodes: list[tuple[int, int, int]] = []  # head, place, node before

    def up_to(place: int) -> tuple[float, int, int, int]:
        """The best chain whose last place lies before this one."""
        top, i = best[0], place
        while i > 0:
            top, i = max(top, best[i]), i & (i - 1)
        return top

    candidates: list[dict[int, tuple[float, int, int]]] = []
    for head, probes in enumerate(heads):
        found: dict[int, tuple[float, int, int]] = {}
        for probe in probes:
            for score, stepped, place in places.matches(probe):
                if score >= FLOOR:
                    at = begins[line_of[place]] if line_of else place
                    found[at] = max(found.get(at, (0.0, 0, 0)), (round(score, 6), -stepped, len(probe)))
        candidates.append(found)
        chains = [(up_to(place), score, stepped, place) for place, (score, stepped, _) in found.items()]
        for (total, less, _, node), score, stepped, place in sorted(chains, key=lambda x: x[3]):
            nodes.append((head, place, node))
            made, i = (round(total + score, 6), less + stepped, -place, len(nodes) - 1), place + 1
            while i < len(best):
                best[i], i = max(best[i], made), i + (i & -i)
    taken: dict[int, int] = {}
    node = up_to(len(stream) + 1)[3]
    while node >= 0:
        head, place, node = nodes[node]
        taken[head] = place
    out: list[tuple[int | None, float, int, str]] = []
    for head, found in enumerate(candidates):
        if (place := taken.get(head)) is None:
            out.append((None, 0.0, 0, "UNRESOLVED"))
            continue
        score, stepped, size = found[place]
        rival = max((s for p, (s, _, _) in found.items() if abs(p - place) >= size), default=0.0)
        band = next((name for name, least in (("EXACT", EXACT), ("STRONG", STRONG)) if score >= least and score - rival >= MARGIN), "AMBIGUOUS")
        out.append((place, round(score, 3), -stepped, band))
    return out


Box = tuple[float, float, float, float]


def reading_order(boxes: Sequence[Box], rtl: bool = False) -> list[int]:
    """Places of boxes (x0, y0, x1, y1 as shares of the page) as read: the page is cut at its widest empty band again and again."""

    def widest(part: list[int]) -> tuple[float, float, int] | None:
        best = None
        for axis, least in ((0, COLUMN_GAP), (1, LINE_GAP)):
            spans = sorted((boxes[i][axis], boxes[i][axis + 2]) for i in part)
            reach = spans[0][1]
            for low, high in spans[1:]:
                if low - reach >= least and (best is None or low - reach > best[0]):
                    best = (low - reach, (low + reach) / 2, axis)
                reach = max(reach, high)
        return best

    out: list[int] = []
    todo = [list(range(len(boxes)))] if boxes else []
    while todo:
        part = todo.pop()
        band = widest(part) if len(part) > 1 else None
        if band is None:
            out += part
            continue
        _, at, axis = band
        sides: tuple[list[int], list[int]] = ([], [])
        for i in part:
            sides[(boxes[i][axis] + boxes[i][axis + 2]) / 2 >= at].append(i)
        first, second = sides[::-1] if axis == 0 and rtl else sides
        todo += [x for x in (second, first) if x]
    return out


def without_label_runs(text: str) -> str:
    """Text without runs of four or more lines that are labels of a figure; runs that hold an arrow, a bullet or a codon stay."""
    lines = text.split("\n")

    def label(line: str) -> bool:
        s = line.strip()
        if not s or len(s) > LABEL or len(s.split()) > 2 or (NUMBERED.match(s) and len(s) > 3):
            return False
        return bool(re.match(r"doc\.?\s*\d+\.?$", s, re.I)) or not re.search(r"[=?]|[.!:;]$", s)

    def runs() -> Iterator[list[int]]:
        run: list[int] = []
        for i, line in enumerate(lines):
            if label(line):
                run.append(i)
            elif line.strip():
                yield run
                run = []
        yield run

    gone = {i for run in runs() if len(run) >= LABEL_RUN and not any(CONTENT.search(lines[i].strip()) for i in run) for i in run}
    if not gone:
        return text
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for i, x in enumerate(lines) if i not in gone)).strip()


def unwrapped(text: str) -> str:
    """Text with lines joined that a printer broke: after a long line that ends no sentence, outside fences and displayed formulas.

    Lines carry flags: whether a line may go on from the one above, and whether the one above is long. A line is joined if since the last one that
    may not go on there was a long one; joined lines share a number, the running count of lines that are not.
    """
    lines = text.split("\n")
    flag = lambda rule: np.array([bool(rule(x)) for x in lines])
    fences, formulas = flag(FENCE.match), np.array([x.count("$$") for x in lines])
    odd_above = lambda counts: np.r_[0, np.cumsum(counts)[:-1]] % 2 > 0
    inside = odd_above(fences) | odd_above(formulas)
    structural, blank = flag(STRUCTURAL.match), ~flag(str.strip)
    ends = flag(SENTENCE_END.search)
    above = lambda own: np.r_[False, own[:-1]]
    goes_on = ~(inside | fences | blank | flag(OPENS_PART.match) | structural | above(structural) | above(ends))
    goes_on[0] = False
    place = np.arange(len(lines))
    last_long = np.maximum.accumulate(np.where(above(flag(lambda x: len(x.strip()) >= WRAPPED)), place, -1))
    last_stop = np.maximum.accumulate(np.where(goes_on, -1, place))
    joined = goes_on & (last_long > last_stop)
    number = np.cumsum(~joined)
    groups = [[lines[i] for i in own] for own in np.split(place, np.flatnonzero(np.diff(number)) + 1)]
    return "\n".join(" ".join([g[0].rstrip() if len(g) > 1 else g[0], *(x.strip() for x in g[1:-1]), *(x.lstrip() for x in g[1:][-1:])]) for g in groups)


def printed_order(numbers: Sequence[int | None]) -> list[int]:
    """Scan places in printed order; a page without a number stays behind the one before it."""
    key: list[tuple[int, int, int]] = []
    head = (-1, 0)
    for i, n in enumerate(numbers):
        if n is not None or i == 0:
            head = (-1 if n is None else n, i)
        key.append((*head, i))
    return [k[2] for k in sorted(key)]


def in_sequence(numbers: Sequence[int | None]) -> list[bool]:
    """Whether a page's number is in the longest increasing run of numbers."""
    known = [i for i, n in enumerate(numbers) if n is not None]
    good = {known[p] for p in increasing_places([numbers[i] for i in known])}
    return [i in good for i in range(len(numbers))]


# Fixed values of the search for a moved point: characters after it, then before it, that must be found once; letters that count as one.
AFTER, BEFORE = (60, 40, 25, 15), (60, 40, 25)
LETTERS_FROM, LETTERS_TO = "أإآى", "اااي"
#: White space and marks, which do not count.
LIGHT = "[\\s\u064b-\u0652\u0640\u0670]"
MARK = "[\u064b-\u0652\u0640\u0670]"


def moved_offset(old: Column, offset: Column, new: Column) -> Column:
    """Where the point at offset of the old text lies in the new: by what follows it, else by what is before it, if that is found once; null if lost.

    White space and marks do not count, and letters are folded; a point behind what was found lies behind the marks of its last letter.
    """
    folded = lambda x: F.translate(F.lower(F.regexp_replace(x, LIGHT, "")), LETTERS_FROM, LETTERS_TO)
    given = F.struct(folded(new).alias("flat"), F.split(new, "").alias("characters"))

    def placed(given: Column) -> Column:
        """The new text's folded letters, and the places, from 1, of the characters that count."""
        told = F.transform(given["characters"], lambda ch, i: F.when(~ch.rlike(LIGHT), i + 1))
        return F.struct(given["flat"].alias("flat"), F.array_compact(told).alias("counted"))

    def found(text: Column) -> Column:
        flat, counted = text["flat"], text["counted"]

        def once(piece: Column) -> Column:
            """The place, from 1, of a piece that the folded text has once."""
            at = F.position(piece, flat)
            return F.when((F.length(piece) > 0) & (at > 0) & (F.position(piece, flat, at + 1) == 0), at)

        places = [F.try_element_at(counted, once(folded(F.substring(old, offset + 1, F.lit(n))))) - 1 for n in AFTER]
        for n in BEFORE:
            piece = folded(F.substring(old, F.greatest(offset - n, F.lit(0)) + 1, F.least(offset, F.lit(n))))
            end = F.try_element_at(counted, once(piece) + F.length(piece) - 1)
            places.append(end + F.length(F.regexp_extract(F.substring(new, end + 1, F.length(new)), f"^{MARK}*", 0)))
        return F.coalesce(*places)

    moved = F.transform(F.transform(F.array(given), placed), found)[0]
    return F.when(offset <= 0, 0).when(offset >= F.length(old), F.length(new)).otherwise(moved).cast("int")


def figure_owner(figures: DataFrame, parts: DataFrame, page: list[str], share: float = 0.5) -> DataFrame:
    """figures with owner and share: the part of their page that their height overlaps most, if by more than half; columns top, bottom, on parts also part."""
    right = parts.select(*page, "part", F.col("top").alias("__t"), F.col("bottom").alias("__b"))
    common = F.greatest(F.lit(0.0), F.least("bottom", "__b") - F.greatest("top", "__t")) / F.greatest(F.lit(1.0), F.col("bottom") - F.col("top"))
    each = figures.join(right, page, "left").withColumn("share", F.coalesce(common, F.lit(0.0)))
    best = each.groupBy(*figures.columns).agg(F.max(F.struct("share", (-F.col("__t")).alias("t"), "part")).alias("m"))
    return best.select(*figures.columns, F.when(F.col("m.share") >= share, F.col("m.part")).alias("owner"), F.round("m.share", 3).alias("share"))


def owner_level(references: DataFrame, by: list[str]) -> DataFrame:
    """by, level: shared by two or more questions, of one question or its only subquestion, else of the context; columns role, top, label, sub.

    One and several are told apart by least and greatest, so that a row is kept for each group, not for each of its distinct values.
    """
    asks = F.col("role") == "question"
    ends = lambda x: (F.min(x), F.max(x))
    (top, last_top), (sub, last_sub) = ends(F.when(asks, F.col("top"))), ends(F.when(asks & F.col("sub"), F.col("label")))
    whole = F.count(F.when(asks & ~F.col("sub"), 1))
    level = F.when(top < last_top, "EXERCISE_SHARED").when((top == last_top) & (sub == last_sub) & (whole == 0), "SUBQUESTION").when(top == last_top, "QUESTION").otherwise("EXERCISE_CONTEXT")
    return references.groupBy(*by).agg(level.alias("level"))


def select_visuals(rows: DataFrame, by: list[str], eligible: Column) -> DataFrame:
    """Active eligible visuals with place; panels of a group (group_key) go all or none, and stand where the group's first panel does."""
    active = rows.where("status = 'active'").withColumn("__ok", F.coalesce(eligible, F.lit(False)))
    group = Window.partitionBy(*by, "group_key")
    alone = F.col("group_key").isNull()
    whole = active.withColumn("__all", alone | F.every("__ok").over(group)).withColumn("__at", F.when(alone, F.col("reading_order")).otherwise(F.min("reading_order").over(group)))
    order = Window.partitionBy(*by).orderBy("__at", F.coalesce("group_part", F.lit(0)), "reading_order", "visual_id")
    return whole.where("__ok and __all").withColumn("place", F.row_number().over(order)).drop("__ok", "__all", "__at")


# Fixed values of the chunker: target, most and least characters of a chunk.
TARGET, MOST, LEAST = 1200, 2200, 220
FORMULA = re.compile(r"\$\$[\s\S]*?\$\$|\$[^$\n]+\$")
BREAK = re.compile(r"[.!?؟。]\s+|[;؛]\s+|\n")


def cut_block(block: str) -> Iterator[str]:
    """Pieces of a long block: at the first sentence end past the target, else the last before the most, else at the most.

    Never within a formula: a cut that would fall there moves to its start, or past it where a displayed one opens the piece. What lies between two
    single dollars and is longer than the most is prose, and is cut.
    """
    formulas = [m.span() for m in FORMULA.finditer(block)]
    ends = [m.end() for m in BREAK.finditer(block) if not any(a < m.end() < b for a, b in formulas)]
    start = 0
    while len(block) - start > MOST:
        reach = [e for e in ends if start < e <= start + MOST]
        stop = next((e for e in reach if e - start >= TARGET), reach[-1] if reach else start + MOST)
        if split := next(((a, b) for a, b in formulas if a < stop < b), None):
            a, b = split
            stop = a if a > start else b if block.startswith("$$", a) else stop
        if piece := block[start:stop].strip():
            yield piece
        start = stop
    if rest := block[start:].strip():
        yield rest


def chunks(text: str, trail: str = "") -> list[tuple[str, int | None]]:
    """(text, page) of retrievable passages: headings start a new one and are repeated in it, a displayed formula stays with the prose above, a short tail joins the one before."""
    out: list[tuple[str, int | None]] = []
    held: list[str] = []
    heading, page, first = "", None, None

    def close() -> None:
        nonlocal first
        body = "\n\n".join(held).strip()
        held.clear()
        at, first = first, None
        if body and len(body) < LEAST and out:
            out[-1] = (f"{out[-1][0]}\n\n{body}", out[-1][1])
        elif body:
            head = " — ".join(x for x in (trail, heading) if x)
            out.append((f"{head}\n\n{body}" if head else body, at))

    size = lambda: sum(map(len, held)) + 2 * max(0, len(held) - 1)
    for block in filter(None, (b.strip() for b in re.split(r"\n{2,}", text))):
        if mark := re.fullmatch(r"<!--\s*page\s+(\d+)\s*-->", block):
            page = int(mark[1])
            continue
        if title := re.fullmatch(r"#{1,4}\s+(.*)", block):
            close()
            heading = title[1].strip()
            continue
        formula = block.startswith("$$")
        for piece in [block] if formula else cut_block(block):
            if not formula and size() >= LEAST and size() + len(piece) > TARGET:
                close()
            first = page if first is None else first
            held.append(piece)
            if not formula and size() > MOST:
                close()
    close()
    return out


def bind_rows(labels: Sequence[tuple[str, ...]], parts: Sequence[tuple[str, ...]]) -> list[int | None]:
    """The part of each row, None for orphans: that with the longest label that the row's begins with; a row without label goes with the one before.

    Where no part fits, the label is tried with the section of the row before, without its own section, and with letters A to H as numbers.
    """

    def longest(label: tuple[str, ...]) -> int | None:
        fits = [i for i, p in enumerate(parts) if p and label[: len(p)] == p]
        return max(fits, key=lambda i: (len(parts[i]), -i), default=None)

    out: list[int | None] = []
    last: int | None = None
    for label in labels:
        if not label:
            out.append(last)
            continue
        section = next(((x,) for x in parts[last] if not x.isdigit()), ()) if last is not None else ()
        tries = [label, section + label if section else ()]
        if len(label) > 1:
            tries += [label[1:] if not label[0].isdigit() else (), label[:1] + tuple(str(ord(x) - 64) if re.fullmatch("[A-H]", x) else x for x in label[1:])]
        found = next((p for p in (longest(x) for x in tries if x) if p is not None), None)
        out.append(found)
        last = last if found is None else found
    return out


LABEL_CELL = re.compile(r"^[(\[]?(?:\d{1,2}(?:[.\-]\d{1,2})*|[IVX]{1,4}|[A-Ha-h])(?:[.\-](?:\d{1,2}|[a-h]|[IVX]{1,4}))*[.)\-\]]*$")
MARK_CELL = re.compile(r"^\d{0,2}(?:[.,]\d{1,2}|[¼½¾])?\s*(?:pts?|points?|marks?)?\.?$", re.I)


def oriented(table: Sequence[Sequence[str | None]]) -> list[list[str | None]] | None:
    """The table of a marking scheme with labels first and marks last, reversed if only that reading is one; None for other tables."""

    def scheme(rows: list[list[str | None]]) -> bool:
        full = [[x.strip() for x in r if x and x.strip()] for r in rows]
        full = [r for r in full if r]
        labels = sum(bool(LABEL_CELL.match(r[0])) for r in full)
        marks = sum(any(ch.isdigit() or ch in "¼½¾" for ch in r[-1]) and bool(MARK_CELL.match(r[-1])) for r in full)
        return len(full) >= 3 and labels >= len(full) * 0.5 and marks >= len(full) * 0.4

    rows = [list(r) for r in table]
    if len(rows) < 3 or max(map(len, rows)) < 3:
        return None
    back = [r[::-1] for r in rows]
    return rows if scheme(rows) else back if scheme(back) else None
