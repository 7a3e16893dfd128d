"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node with a hidden label, content or not. Unary potentials are a logistic model of the element's tag, class words,
text and links; each parent-child edge has a potential for its pair of labels. Sum-product messages go from the leaves up and from the
root down, so every node gets its exact marginal given the whole page; the text of nodes that are more likely content than not is kept.
Messages of all pages of a batch pass together, one depth at a time.

The model is trained from labelled pages: a generator of invented pages of many layouts labels its own elements (see training_pages).

Defined results: null, empty and text-free pages give empty texts; unclosed, crossed and cut-off markup is read as browsers recover from
it; repeated rows give equal texts; an empty table gives an empty result. Only the id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm._common import id_type, map_slices

# Fixed values of the HTML standard: elements by how they are parsed or shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template annotation annotation-xml desc metadata".split())
#: The attribute that labels the elements of training pages.
LABEL = "data-studylake-label"
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body head html legend option optgroup td th tr tbody thead tfoot".split())
#: A start tag ends an open element of these kinds, unless one of the second kinds is between.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th tbody thead", "table"), "tfoot": ("tr td th tbody", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}

#: An end tag of a phrase does not reach out of these; an open paragraph within these is not ended from inside.
CELLS, SHIELDS = ("td", "th", "table"), ("table", "td", "th", "button")

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
CLASS_WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "parent", "depth", "words", "hidden", "linked", "chars", "links", "label")

    def __init__(self, tag: str, parent: int, depth: int, words: tuple[str, ...] = (), hidden: bool = False, label: int = -1, linked: bool = False):
        self.tag, self.parent, self.depth, self.words, self.hidden = tag, parent, depth, words, hidden
        self.linked = linked or tag == "a"
        self.chars = self.links = 0
        self.label = label


def parse(page: str) -> tuple[list[Element], list[tuple[int, str | None]]]:
    """Elements in page order, and runs of text with the element that holds each; a run of None breaks a block."""
    nodes = [Element("#root", -1, 0)]
    runs: list[tuple[int, str | None]] = []
    open_: list[int] = [0]
    places: defaultdict[str, list[int]] = defaultdict(list)  # where elements of each tag are among the open ones
    at, end = 0, len(page)

    def last(tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0 for none."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def text(raw: str) -> None:
        if raw:
            runs.append((open_[-1], entities.unescape(raw) if "&" in raw else raw))

    def close(to: int) -> None:
        """Leave elements down to place `to` of the open ones."""
        while len(open_) > to:
            left = nodes[open_.pop()].tag
            places[left].pop()
            if left in BLOCK:
                runs.append((open_[-1] if open_ else 0, None))

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not places["p"]:
                runs.append((open_[-1], None))
            elif tag == "br":
                runs.append((open_[-1], " "))
            if (place := last((tag,))) and (tag in BLOCK or place >= last(CELLS)):
                close(place)
            continue
        if tag in CLOSES_P and (place := last(("p",))) > last(SHIELDS):
            close(place)
        if tag in ENDS:
            ended, stop = ENDS[tag]
            while (place := last(ended)) > last(stop):
                close(place)
                if tag != "tr":
                    break
        if tag == "br":
            runs.append((open_[-1], " "))
        if tag in BLOCK:
            runs.append((open_[-1], None))
        words: list[str] = []
        hidden = False
        label = -1
        if "=" in m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    words += CLASS_WORD.findall(value.lower())
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
                elif name == LABEL and value in ("0", "1"):
                    label = int(value)
        if re.search(r"(?:^|\s)hidden(?:\s|$)", m[3]):
            hidden = True
        if tag in VOID:
            continue
        # shapes and styles of a drawing hold no text and say nothing of the text around
        foreign = (m[3].endswith("/") or tag in RAW) and (places["svg"] or places["math"])
        if foreign and m[3].endswith("/"):
            continue
        if not (foreign and tag in RAW):
            nodes.append(Element(tag, open_[-1], nodes[open_[-1]].depth + 1, tuple(words), hidden, label, nodes[open_[-1]].linked))
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if not m[3].endswith("/") or tag in BLOCK:
            places[tag].append(len(open_))
            open_.append(len(nodes) - 1)
    return nodes, runs


#: Words of class, id and role attributes that are features of their own; others share one (fixed values).
CLASS_WORDS = tuple(sorted("article content main post entry body story text page nav menu breadcrumb breadcrumbs navigation header head masthead banner footer foot copyright legal sidebar side aside widget related recommended popular share social ad ads advert advertisement promo sponsor sponsored cookie cookies notice consent gdpr alert popup modal newsletter subscribe signup login form search comment comments reply discussion disqus author byline meta date tags title caption toolbar pagination pager skip".split()))
TAGS = tuple(sorted("#root html head body div p span a b i em strong h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody thead nav header footer aside article main section form button select option label input fieldset figure figcaption blockquote pre code script style title noscript iframe textarea svg template small time address details summary".split()))
#: Tags and class words of elements that hold main text, and of those that hold what is around it (fixed values).
HOLDS_MAIN = frozenset("article main content post entry body story text".split())
HOLDS_OTHER = frozenset("nav aside footer form button menu breadcrumb breadcrumbs navigation masthead banner foot copyright legal sidebar widget related recommended popular share social ad ads advert advertisement promo sponsor sponsored cookie cookies notice consent gdpr alert popup modal newsletter subscribe signup login search comment comments reply discussion disqus pagination pager toolbar".split())
_TAG = {t: i for i, t in enumerate(TAGS)}
_WORD = {w: i for i, w in enumerate(CLASS_WORDS)}
NUMBERS = 14
WIDTH = len(TAGS) + 1 + len(CLASS_WORDS) + 1 + NUMBERS


def features(nodes: list[Element], runs: list[tuple[int, str | None]]) -> list[tuple[list[int], list[float]]]:
    """Sparse features of each element."""
    for holder, run in runs:
        if run is not None and not run.isspace():
            nodes[holder].chars += len(run)
            if nodes[holder].linked:
                nodes[holder].links += len(run)
    total = [n.chars for n in nodes]
    linked = [n.links for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
        linked[nodes[i].parent] += linked[i]
    whole = max(1, total[0])
    main, other = [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes):
        own = {n.tag, *n.words} if n.tag != "body" else set(n.words)
        if i:
            main[i], other[i] = main[n.parent] or bool(own & HOLDS_MAIN), other[n.parent] or bool(own & HOLDS_OTHER)
    some = any(m and not o and t for m, o, t in zip(main, other, total, strict=True))
    out = []
    base = len(TAGS) + len(CLASS_WORDS) + 2
    for i, n in enumerate(nodes):
        index = [_TAG.get(n.tag, len(TAGS))]
        value = [1.0]
        for w in set(n.words):
            index.append(len(TAGS) + 1 + _WORD.get(w, len(CLASS_WORDS)))
            value.append(1.0)
        index += range(base, base + NUMBERS)
        value += [1.0, float(np.log1p(total[i])) / 8, linked[i] / max(1, total[i]), total[i] / whole, float(n.hidden), min(n.depth, 12) / 12, float(total[i] == 0), float(n.chars > 80), float(main[i] and not other[i]), float(other[i]), float(some and not main[i]), float(not some and not other[i]), float(i == 0 and n.chars > 0), float(not some and not other[i] and not n.words and n.tag in PROSE)]
        out.append((index, value))
    return out


#: Elements of running text (fixed values).
PROSE = frozenset("p h1 h2 h3 h4 blockquote pre ul ol li b i em strong code table tr td th".split())
#: Levels of so few nodes are worked on node by node.
FEW = 4


def marginals(unary: np.ndarray, parent: np.ndarray, depth: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node by sum-product, and the expected number of edges by labels.

    unary: n x 2 log potentials; pair[parent's label, child's label]: log potentials.
    """
    n = len(unary)
    compat = np.exp(pair - pair.max())
    (c00, c01), (c10, c11) = compat.tolist()
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    inside = unary.astype(np.float64).copy()
    up = np.zeros((n, 2))
    for level in reversed(levels[1:]):
        if len(level) <= FEW:
            for i in level.tolist():
                a, b = inside[i].tolist()
                top = max(a, b)
                a, b = math.exp(a - top), math.exp(b - top)
                up[i] = message = math.log(a * c00 + b * c01), math.log(a * c10 + b * c11)
                inside[parent[i]] += message
            continue
        x = inside[level]
        x = np.exp(x - x.max(1, keepdims=True))
        message = np.log(x @ compat.T)
        up[level] = message
        np.add.at(inside, parent[level], message)
    down = np.zeros((n, 2))
    edges = np.zeros((2, 2))
    for level in levels[1:]:
        if len(level) <= FEW:
            for i in level.tolist():
                r0, r1 = (inside[parent[i]] + down[parent[i]] - up[i]).tolist()
                top = max(r0, r1)
                r0, r1 = math.exp(r0 - top), math.exp(r1 - top)
                down[i] = math.log(r0 * c00 + r1 * c10), math.log(r0 * c01 + r1 * c11)
                o0, o1 = inside[i].tolist()
                top = max(o0, o1)
                o0, o1 = math.exp(o0 - top), math.exp(o1 - top)
                four = r0 * c00 * o0, r0 * c01 * o1, r1 * c10 * o0, r1 * c11 * o1
                all_ = sum(four)
                edges += ((four[0] / all_, four[1] / all_), (four[2] / all_, four[3] / all_))
            continue
        rest = inside[parent[level]] + down[parent[level]] - up[level]
        rest = np.exp(rest - rest.max(1, keepdims=True))
        down[level] = np.log(rest @ compat)
        own = np.exp(inside[level] - inside[level].max(1, keepdims=True))
        both = rest[:, :, None] * compat * own[:, None, :]
        edges += (both / both.sum((1, 2), keepdims=True)).sum(0)
    belief = inside + down
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief[:, 1] / belief.sum(1), edges


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def score(self, parsed: list[tuple[list[Element], list[tuple[int, str | None]]]]) -> list[np.ndarray]:
        sizes = [len(nodes) for nodes, _ in parsed]
        begin = np.cumsum([0, *sizes])
        index, value, row = [], [], []
        parent, depth = [], []
        for start, (nodes, runs) in zip(begin, parsed, strict=False):
            for i, (ix, vs) in enumerate(features(nodes, runs)):
                index += ix
                value += vs
                row += [start + i] * len(ix)
            parent += [start + n.parent if n.parent >= 0 else -1 for n in nodes]
            depth += [n.depth for n in nodes]
        logit = np.bincount(np.array(row, np.int64), np.array(value) * self.weights[np.array(index, np.int64)], int(begin[-1]))
        p, _ = marginals(np.c_[np.zeros(len(logit)), logit], np.array(parent), np.array(depth), self.pair)
        return [p[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]

    def texts(self, pages: list[str]) -> list[str]:
        parsed = [parse(p) for p in pages]
        return [main_text(nodes, runs, p) for (nodes, runs), p in zip(parsed, self.score(parsed) if parsed else [], strict=True)]


def main_text(nodes: list[Element], runs: list[tuple[int, str | None]], content: np.ndarray) -> str:
    blocks: list[str] = []
    held: list[str] = []
    for holder, run in [*runs, (0, None)]:
        if run is None:
            if held:
                if block := " ".join("".join(held).split()):
                    blocks.append(block)
                held = []
        elif content[holder] > 0.5:
            held.append(run)
    return " ".join(blocks)


# ---- training -------------------------------------------------------------------------------------------------------------------------

LETTERS = "aeioulnrstdméüß"


def training_pages(n: int, seed: int) -> list[str]:
    """Invented pages of many layouts; LABEL says of each element whether its own text is main text (containers of both: of most)."""
    rnd = random.Random(seed)

    def word() -> str:
        return "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(2, 9)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rnd.randint(a, b))) + rnd.choice(".,!?  ")

    def tag(name: str, inner: str, label: int, cls: str = "") -> str:
        attribute = f' {rnd.choice(["class", "id"])}="{cls}"' if cls and rnd.random() < 0.8 else ""
        return f'<{name} {LABEL}="{label}"{attribute}>{inner}</{name}>'

    def links(k: int) -> str:
        return tag("ul", "".join(tag("li", tag("a", words(1, 3), 0), 0) for _ in range(k)), 0)

    def row_of_links(k: int) -> str:
        return rnd.choice(["<br>", " | ", " / ", " "]).join(tag("a", words(1, 3), 0) for _ in range(k))

    def inline(label: int) -> str:
        return words(3, 40) + rnd.choice(["", tag(rnd.choice(["b", "i", "em", "a", "strong", "span", "code"]), words(1, 4), label) + words(2, 15)])

    def block(label: int) -> str:
        kind = rnd.random()
        if kind < 0.7:
            return tag("p", inline(label) if rnd.random() < 0.9 else tag("b", words(1, 12), label) + "<br>", label)
        if kind < 0.78:
            return tag("blockquote", tag("p", inline(label), label), label)
        if kind < 0.86:
            return tag(rnd.choice(["ul", "ol"]), "".join(tag("li", inline(label), label) for _ in range(rnd.randint(2, 5))), label)
        if kind < 0.92:
            return tag(rnd.choice(["h2", "h3"]), words(2, 8), label)
        if kind < 0.95:
            return tag("pre", tag("code", words(5, 30), label), label)
        return tag("table", "".join(tag("tr", "".join(tag("td", words(1, 5), label) for _ in range(3)), label) for _ in range(rnd.randint(2, 4))), label)

    def noise() -> str:
        return rnd.choice([
            lambda: tag("div", words(3, 25), 0, rnd.choice(["ad", "ads", "advert", "advertisement", "promo", "sponsored", "ad banner"])),
            lambda: tag("aside", tag("h3", words(1, 4), 0) + rnd.choice([links(rnd.randint(2, 6)), tag("p", inline(0), 0)]), 0, rnd.choice(["", "sidebar", "related", "widget"])),
            lambda: tag("div", tag("h3", words(1, 4), 0) + links(rnd.randint(2, 6)), 0, rnd.choice(["sidebar", "related", "widget popular", "recommended", "share social"])),
            lambda: tag("div", tag("p", words(5, 30), 0) + tag("button", words(1, 2), 0), 0, rnd.choice(["cookie", "cookie notice", "notice", "consent", "gdpr", "alert", "popup modal"])),
            lambda: tag("form", tag("label", words(1, 4), 0) + "<input>" + tag("select", tag("option", words(1, 2), 0) * 2, 0) + tag("button", words(1, 2), 0), 0, rnd.choice(["", "search", "newsletter", "login", "subscribe signup"])),
            lambda: tag(rnd.choice(["section", "div"]), tag("h3", words(1, 3), 0) + "".join(tag(rnd.choice(["div", "p", "article", "li"]), rnd.choice([tag("span", words(1, 2), 0, "author"), ""]) + tag("p", inline(0), 0), 0, rnd.choice(["comment", "comment reply", ""])) for _ in range(rnd.randint(1, 5))), 0, rnd.choice(["comments", "comments discussion", "comment list", "disqus"])),
            lambda: tag("nav", links(rnd.randint(2, 7)), 0, rnd.choice(["", "menu", "breadcrumb", "pagination pager"])),
            lambda: tag("div", links(rnd.randint(3, 8)), 0, rnd.choice(["menu", "nav", "navigation", "toolbar"])),
            lambda: tag(rnd.choice(["div", "p"]), row_of_links(rnd.randint(2, 6)), 0, rnd.choice(["", "top", "menu", "share social", "skip"])),
            lambda: tag("noscript", words(3, 10), 0) + tag("script", "var x='<p>';", 0) + "<!-- " + words(1, 5) + " -->",
            lambda: tag("p", words(4, 20), 0, rnd.choice(["notice", "advert", "copyright legal", "sponsored"])),
        ])()

    out = []
    for _ in range(n):
        body = [tag(rnd.choice(["h1", "h1", "h2"]), words(2, 10), 1, rnd.choice(["", "", "title"]))] + [block(1) for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 8, 14]))]
        if rnd.random() < 0.3:
            body.insert(rnd.randint(1, len(body)), noise())
        byline = lambda: tag(rnd.choice(["p", "div", "span"]), words(2, 6) + rnd.choice(["", tag("time", words(1, 3), 0), tag("a", words(1, 2), 0)]), 0, rnd.choice(["", "byline", "author", "meta date"]))
        if rnd.random() < 0.25:
            body[0] = tag("header", rnd.choice([body[0] + byline(), byline()]), 0) + ("" if rnd.random() < 0.5 else body[0])
        elif rnd.random() < 0.15:
            body.insert(1, byline())
        if rnd.random() < 0.25:
            body.append(tag("footer", words(1, 12) + rnd.choice(["", byline(), links(2), tag("a", words(1, 2), 0)]), 0, rnd.choice(["", "", "tags", "meta"])))
        wrap = rnd.random()
        inner = "".join(body)
        if wrap < 0.5:
            inner = tag("article", inner, 1, rnd.choice(["", "", "post", "entry content"]))
        elif wrap < 0.7:
            inner = tag("main", inner, 1, rnd.choice(["", "content"]))
        elif wrap < 0.9:
            inner = tag("div", inner, 1, rnd.choice(["content", "main content", "article body", "post entry", "story text", "page content"]))
        else:
            inner = tag("main", tag("article", inner, 1), 1)
        if rnd.random() < 0.2:  # a lone text, with or without a body
            lone = rnd.choice(["".join(body), block(1), words(2, 40), words(2, 12), words(2, 30) + tag("b", words(1, 3), 1) + words(1, 9), words(1, 8) + tag("i", words(1, 3), 1)])
            out.append(rnd.choice([lone, lone, lone, f'<body {LABEL}="{int(not lone.startswith("<"))}">{lone}</body>']))
            continue
        if rnd.random() < 0.2:  # blocks of the body itself
            inner = "".join(body)
        before = [tag("header", tag("div", words(1, 4), 0, "banner") + rnd.choice(["", tag("nav", links(4), 0)]), 0, rnd.choice(["", "masthead"]))] if rnd.random() < 0.5 else []
        before += [tag("nav", links(rnd.randint(3, 8)), 0, rnd.choice(["", "menu"]))] if rnd.random() < 0.7 else []
        before += [noise() for _ in range(rnd.randint(0, 3))]
        after = [noise() for _ in range(rnd.randint(0, 3))]
        after += [tag("footer", words(2, 20) + rnd.choice(["", links(3)]), 0, rnd.choice(["", "footer", "copyright"]))] if rnd.random() < 0.8 else [tag("div", words(2, 12), 0, rnd.choice(["footer", "copyright legal", "foot"]))]
        if rnd.random() < 0.12:  # laid out by a table
            bar = lambda: tag("td", rnd.choice([links(rnd.randint(2, 6)), row_of_links(rnd.randint(2, 6)), words(2, 12)]), 0, rnd.choice(["", "menu", "nav", "sidebar"]))
            cells = [bar() if rnd.random() < 0.7 else "", tag("td", inner, 1, rnd.choice(["", "content", "main", "text"])), bar() if rnd.random() < 0.4 else ""]
            inner = tag("table", tag("tbody" if rnd.random() < 0.3 else "tr", "".join(cells), 0), 0)
        page = "".join([*before, inner, *after])
        if rnd.random() < 0.2:
            page = tag("div", page, 0, rnd.choice(["page", "wrapper", "container"]))
        if rnd.random() < 0.15:  # a fragment
            out.append(page + rnd.choice(["", f'<template {LABEL}="0">{words(1, 4)}</template>']))
            continue
        out.append(f'<html {LABEL}="0"><head {LABEL}="0"><title {LABEL}="0">{words(2, 8)}</title><style {LABEL}="0">p{{}}</style></head><body {LABEL}="0">{page}</body></html>')
    return out


@lru_cache(maxsize=1)
def trained(n: int = 600, seed: int = 7, steps: int = 300) -> Model:
    """All potentials together by maximum likelihood: features and label pairs as expected under the marginals meet those of the labels."""
    index, value, row, labels, parent, depth = [], [], [], [], [], []
    observed = np.zeros((2, 2))
    at = 0
    for nodes, runs in map(parse, training_pages(n, seed)):
        own = [max(0, e.label) for e in nodes]
        first = at
        told = features(nodes, runs)
        own[0] = int(nodes[0].chars > 0)  # only lone texts have words outside of all elements
        for i, (ix, vs) in enumerate(told):
            index += ix
            value += vs
            row += [at] * len(ix)
            parent.append(first + nodes[i].parent if i else -1)
            depth.append(nodes[i].depth)
            if i:
                observed[own[nodes[i].parent], own[i]] += 1
            at += 1
        labels += own
    index, value, row, y = np.array(index), np.array(value), np.array(row), np.array(labels, float)
    parent, depth = np.array(parent), np.array(depth)
    w, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, steps + 1):
        logit = np.bincount(row, value * w[index], at)
        p, edges = marginals(np.c_[np.zeros(at), logit], parent, depth, w[WIDTH:].reshape(2, 2))
        g = np.r_[np.bincount(index, value * (p - y)[row], WIDTH), (edges - observed).ravel()] / at + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(w[:WIDTH], w[WIDTH:].reshape(2, 2))


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", columns: tuple[str, ...] = ("url",), model: Model | None = None) -> DataFrame:
    """id_col, the given columns, text (empty if none) and n_chars (its code points); one row per input row."""
    shared = df.sparkSession.sparkContext.broadcast(model or trained())  # a few hundred numbers

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = shared.value.texts([p or "" for p in part.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    names = ["id", *[f"c{i}" for i in range(len(columns))], "text", "n_chars"]
    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    fields = "".join(f", c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = map_slices(rows, 1, work, f"id {id_type(df, id_col)}{fields}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "text", "n_chars")
