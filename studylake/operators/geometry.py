"""Where figures stand on their pages: the stretch that each belongs to, and boxes that grow to their captions."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Least share inside, nearness and the banner's top, width and height as shares of a page.
MAJORITY, NEAR, BANNER_TOP, BANNER_WIDTH, BANNER_HEIGHT = 0.5, 0.10, 0.20, 0.60, 0.07


def figure_places(figures: DataFrame, stretches: DataFrame, paper: str) -> DataFrame:
    """A row for each figure with the stretch it belongs to, or those next to it: relation, owner, above, above_relation, below, below_relation, verdict.

    figures: paper, figure, page, top, bottom, width, page_height, page_width. stretches: paper, page, ordinal, top, bottom; those of a page do not
    overlap. A figure of which half or more lies in one stretch is INSIDE it (that stretch then holds the figure's middle). Otherwise the last stretch
    that ends above its middle and the first that begins below it count, on any page: of one exercise on both sides it is INSIDE on the page and
    CONTINUATION beyond; else each is NEAR up to a tenth of the page's height, SAME_PAGE beyond, DISTANT on another page. A wide and low figure at
    the top of page 1, above all stretches, is a BANNER. verdict: UNIQUE, MULTIPLE, WEAK, NONE or BANNER.

    One sweep over a paper's figures and stretches in order of page and height, by windows: no stretch is joined to a figure.
    """
    middle = (F.col("top") + F.col("bottom")) / 2
    box = F.struct("page", "top", "bottom", "ordinal")
    none = F.lit(None).cast(stretches.select(box.alias("s")).schema["s"].dataType)
    opens = stretches.select(paper, "page", F.col("top").alias("__at"), F.lit(1).alias("__order"), box.alias("__open"), none.alias("__shut"))
    shuts = stretches.select(paper, "page", F.col("bottom").alias("__at"), F.lit(0).alias("__order"), none.alias("__open"), box.alias("__shut"))
    wanted = figures.withColumns({"__at": middle, "__order": F.lit(2), "__open": none, "__shut": none})
    swept = opens.unionByName(shuts).unionByName(wanted, allowMissingColumns=True)
    order = [F.col("page"), F.col("__at"), F.col("__order")]
    before = Window.partitionBy(paper).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(paper).orderBy(F.col("page"), F.col("__at"), -F.col("__order")).rowsBetween(1, Window.unboundedFollowing)
    first = Window.partitionBy(paper).orderBy(*order)
    seen = swept.withColumns({
        "__holds": F.last("__open", ignorenulls=True).over(before), "__above": F.last("__shut", ignorenulls=True).over(before),
        "__below": F.first("__open", ignorenulls=True).over(after), "__first": F.first("__open", ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).where("figure IS NOT NULL")
    h, a, b = F.col("__holds"), F.col("__above"), F.col("__below")
    common = F.greatest(F.lit(0.0), F.least("bottom", h["bottom"]) - F.greatest("top", h["top"]))
    inside = F.coalesce((h["page"] == F.col("page")) & (common / F.greatest(F.lit(1.0), F.col("bottom") - F.col("top")) >= MAJORITY), F.lit(False))
    lead = F.col("__first")
    above_all = lead.isNull() | (F.col("page") < lead["page"]) | ((F.col("page") == lead["page"]) & (F.col("bottom") <= lead["top"]))
    banner = (F.col("page") == 1) & above_all & (F.col("top") <= BANNER_TOP * F.col("page_height")) & (F.col("width") >= BANNER_WIDTH * F.col("page_width")) & (F.col("bottom") - F.col("top") <= BANNER_HEIGHT * F.col("page_height"))

    def next_to(s: Column, gap: Column) -> Column:
        return F.when(s.isNull(), None).when(s["page"] != F.col("page"), "DISTANT").when(gap <= NEAR * F.col("page_height"), "NEAR").otherwise("SAME_PAGE")

    both = F.coalesce(a["ordinal"] == b["ordinal"], F.lit(False))
    owner = F.when(banner, None).when(inside, h["ordinal"]).when(both, a["ordinal"])
    relation = F.when(banner, "BANNER").when(inside, "INSIDE").when(both, F.when((a["page"] == F.col("page")) & (b["page"] == F.col("page")), "INSIDE").otherwise("CONTINUATION")).otherwise("GAP")
    lone = relation != "GAP"
    up, down = next_to(a, F.col("top") - a["bottom"]), next_to(b, b["top"] - F.col("bottom"))
    sides = F.when(a.isNotNull() & b.isNotNull(), "MULTIPLE").when(a.isNull() & b.isNull(), "NONE").otherwise("WEAK")
    gap = lambda x: F.when(~lone, x)
    return seen.select(
        paper, "figure", relation.alias("relation"), owner.alias("owner"), gap(a["ordinal"]).alias("above"), gap(up).alias("above_relation"), gap(b["ordinal"]).alias("below"), gap(down).alias("below_relation"),
        F.when(relation == "BANNER", "BANNER").when(lone, "UNIQUE").otherwise(sides).alias("verdict"),
    )


# Fixed values of the growth, in pixels and characters: gaps below and above, longest label, how far a label's middle may stick out and a label be wider.
BELOW_GAP, ABOVE_GAP, LONGEST_LABEL, OUT, WIDER, ROUNDS = 55, 70, 24, 10, 40, 4


def grown_boxes(boxes: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """by, box, x0, y0, x1, y1, taken: boxes with the short lines of text below and above that are their captions.

    boxes: by, box, x0, y0, x1, y1; lines: by, line, x0, y0, x1, y1, text. A line of up to 24 characters with a letter is a box's if its middle is within
    the box, it is hardly wider, and it lies up to 55 below or 70 above. In rounds, until none is taken or four have passed, each box takes the nearest line
    that is left (below before above, then by number); boxes go by number, and a line goes to one box. A box never takes a line whose union with
    it would meet another box as that stands, unless they met before. The boxes and lines of a page are one group, as many as fit on a page.
    """
    labels = lines.where((F.length("text") <= LONGEST_LABEL) & F.col("text").rlike(r"\p{L}"))
    corners = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    ours = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("box", F.array(*corners).alias("at")))).alias("boxes"))
    theirs = labels.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("line", F.array(*corners).alias("at")))).alias("lines"))
    pages = ours.join(theirs, by, "left")

    @F.pandas_udf("array<struct<at:array<double>,taken:int>>")
    def grown(boxes: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([_grown([x["at"] for x in b], [] if t is None else [x["at"] for x in t]) for b, t in zip(boxes, lines, strict=True)])

    each = pages.select(*by, F.explode(F.arrays_zip("boxes", grown("boxes", "lines").alias("grown"))).alias("x"))
    at = F.col("x.grown.at")
    return each.select(*by, F.col("x.boxes.box").alias("box"), *[at[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.col("x.grown.taken").alias("taken"))


def _meet(a: list[float], b: list[float]) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def _grown(boxes: list, lines: list) -> list[dict]:
    """The boxes of one page after their rounds."""
    now, free = [[*map(float, b)] for b in boxes], dict(enumerate([[*map(float, t)] for t in lines]))
    before = [[_meet(a, b) for b in now] for a in now]
    taken = [0] * len(now)
    for _ in range(ROUNDS):
        moved = False
        for i, (x0, y0, x1, y1) in enumerate(now):
            near = []
            for k, t in free.items():
                below, above = t[1] - y1, y0 - t[3]
                if (0 <= below <= BELOW_GAP or 0 <= above <= ABOVE_GAP) and x0 - OUT <= (t[0] + t[2]) / 2 <= x1 + OUT and t[2] - t[0] <= x1 - x0 + WIDER:
                    near.append((False, below, k) if 0 <= below <= BELOW_GAP else (True, above, k))
            for _, _, k in sorted(near):
                t = free[k]
                union = [min(x0, t[0]), min(y0, t[1]), max(x1, t[2]), max(y1, t[3])]
                if not any(j != i and not before[i][j] and _meet(union, b) for j, b in enumerate(now)):
                    now[i], moved = union, True
                    taken[i] += 1
                    del free[k]
                    break
        if not moved:
            break
    return [{"at": b, "taken": n} for b, n in zip(now, taken, strict=True)]
