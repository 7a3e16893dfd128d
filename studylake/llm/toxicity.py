"""Toxicity categories by a chain of linear classifiers.

The categories are predicted in a fixed order; each model sees the text's features and the probabilities of the categories before it. In
training those earlier probabilities are out of fold, so that a later model learns how far to trust what it will really see.

Training uses one of each group of copies among at most `max_rows` labelled documents, those whose hashed ids are smallest; scoring
covers every document. The categories before the last are label columns of the caller's, or else kinds found in the data: groups of the
documents labelled toxic that share features. The last category is the label itself, and the threshold at which a document is
rejected is the one at which the out-of-fold probabilities find most, with at most MAX_FALSE of the clean documents rejected. Features and
kinds are chosen on all training documents, so another chain is made without the held-out fifth of them, choices included: its figures on that
fifth are the chain's, and the threshold rises if they ask for it.

Features: words and beginnings of words (a stem marks all its inflections and compounds, also unseen ones), as the logarithm of their
number; of those the ones whose frequency among labelled documents differs between a category's values by over MIN_Z standard errors.

Defined results: null, empty and wordless texts have no features and get the base rates; without a positive label every probability is 0
and nothing is rejected; labels that are null are left out; a document with several labels counts once for each; repeated rows are
scored alike; empty tables give empty results. Scores come after the given columns of df; columns with such names are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.llm._common import bounded, cut, forget, map_slices, slices, texts_of
from studylake.llm.decontaminate import words_of

#: Labelled documents that are trained on, at most; features that models see, at most.
MAX_ROWS, MAX_WORDS = 12_000, 4_000
#: Features that a task counts before it hands the counts on; words whose features a worker keeps.
HELD_WORDS, KEPT_WORDS = 100_000, 300_000
MIN_Z, MIN_DOCS = 3.0, 5
#: Characters of the beginnings of words.
STEMS = range(3, 9)
#: Folds of documents, by their texts, and the one that is held out to judge the chain.
FOLDS, HELD_OUT = 5, 0
#: Kinds of toxic documents that are looked for where the caller has no category columns.
KINDS = 2
#: Share of the clean training documents that may be rejected, and the thresholds that are tried.
MAX_FALSE, THRESHOLDS = 0.003, [n / 20 for n in range(19, 3, -1)]
FINAL = "toxic"


def fold_of(text: bytes) -> int:
    return zlib.crc32(text) % FOLDS


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings; no word holds an asterisk."""
    text = word.decode("utf-8", "ignore")
    return [word, *[text[:n].encode() + b"*" for n in STEMS if n <= len(text)]]


class Reader:
    """Numbers of the known features of texts; keeps those of words seen before."""

    def __init__(self, known: dict[bytes, int]):
        self.known, self.kept = known, {}
        #: First characters that all features of a word begin with.
        self.starts = {f.removesuffix(b"*").decode("utf-8", "ignore")[: STEMS.start] for f in known}

    def read(self, text: bytes) -> dict[int, int]:
        """How often each known feature is in the text."""
        found: dict[int, int] = defaultdict(int)
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        for word, times in Counter(words_of(text)).items():
            own = self.kept.get(word)
            if own is None:
                begun = word.decode("utf-8", "ignore")[: STEMS.start] in self.starts
                own = self.kept[word] = [self.known[f] for f in features_of(word) if f in self.known] if begun else ()
            for f in own:
                found[f] += times
        return found


@dataclass
class Sparse:
    """Documents x features: document numbers in ascending order, feature numbers and values."""

    rows: np.ndarray
    at: np.ndarray
    values: np.ndarray
    n: int

    @classmethod
    def of(cls, found: list[dict[int, int]]) -> Sparse:
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        at = np.fromiter((w for f in found for w in f), np.int64, len(rows))
        return cls(rows, at, np.log1p(np.fromiter((n for f in found for n in f.values()), float, len(rows))), len(found))

    def part(self, inside: np.ndarray) -> Sparse:
        mine = inside[self.rows]
        return Sparse((np.cumsum(inside) - 1)[self.rows[mine]], self.at[mine], self.values[mine], int(inside.sum()))

    def logits(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.at] * self.values, self.n)


@dataclass
class Chain:
    names: list[str]
    words: dict[bytes, int]
    #: One row per model: weights of the features, of earlier categories, bias.
    weights: np.ndarray
    threshold: float = 0.5
    #: Share of toxic documents found and of clean ones kept at the threshold: out of fold, or on documents held out from all choices.
    figures: tuple[float, float] = field(default=(0.0, 1.0))

    def judge(self, probability: np.ndarray, bad: np.ndarray) -> None:
        """Figures on held-out documents. If there are clean ones enough to tell MAX_FALSE and more of them would be rejected, the threshold rises."""
        shares = lambda own, t: float((probability[own] >= t).mean()) if own.any() else 0.0
        if len(self.weights) and (~bad).sum() * MAX_FALSE >= 1:
            held = [t for t in sorted(THRESHOLDS) if t >= self.threshold and shares(~bad, t) <= MAX_FALSE]
            self.threshold = held[0] if held else max(THRESHOLDS)
        self.figures = shares(bad, self.threshold), 1 - shares(~bad, self.threshold)

    def probabilities(self, found: list[dict[int, int]]) -> np.ndarray:
        """documents x categories."""
        out = np.zeros((len(found), len(self.names)))
        x, n = Sparse.of(found), len(self.words)
        for k, weight in enumerate(self.weights):
            out[:, k] = 1 / (1 + np.exp(-(x.logits(weight) + out[:, :k] @ weight[n : n + k] + weight[-1])))
        return out


def _fit(x: Sparse, extra: np.ndarray, y: np.ndarray, n_words: int, steps: int = 200) -> np.ndarray:
    """L2-regularised logistic regression on sparse features and dense extra columns, by Adam over all rows."""
    size = n_words + extra.shape[1] + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    if y.min() == y.max():
        w[-1] = np.clip(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), -12, 12)
        return w
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for step in range(1, steps + 1):
        error = 1 / (1 + np.exp(-(x.logits(w) + extra @ w[n_words:-1] + w[-1]))) - y
        g = np.r_[np.bincount(x.at, error[x.rows] * x.values, n_words), error @ extra, error.sum()] / len(y)
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit_chain(found: list[dict[int, int]], folds: np.ndarray, labels: np.ndarray, words: dict[bytes, int], names: list[str]) -> Chain:
    """labels: documents x categories, in the chain's order."""
    n, k = labels.shape
    if not n or not labels[:, -1].any():
        return Chain(names, words, np.zeros((0, 0)))
    x = Sparse.of(found)
    outside = np.zeros((n, k))  # out-of-fold probabilities
    weights = np.zeros((k, len(words) + k))
    for c in range(k):
        y, extra = labels[:, c].astype(float), outside[:, :c]
        for fold in np.unique(folds):
            inside = folds != fold
            if not inside.any():
                inside = ~inside
            w = _fit(x.part(inside), extra[inside], y[inside], len(words))
            logit = x.logits(w) + extra @ w[len(words) : -1] + w[-1]
            outside[folds == fold, c] = 1 / (1 + np.exp(-logit[folds == fold]))
        w = _fit(x, extra, y, len(words))
        weights[c, : len(words) + c] = w[:-1]
        weights[c, -1] = w[-1]
    bad = labels[:, -1].astype(bool)
    found_, false_ = ([float((outside[own, -1] >= t).mean()) if own.any() else 0.0 for t in THRESHOLDS] for own in (bad, ~bad))
    best = max(range(len(THRESHOLDS)), key=lambda i: (false_[i] <= MAX_FALSE, found_[i] if false_[i] <= MAX_FALSE else -false_[i], THRESHOLDS[i]))
    return Chain(names, words, weights, THRESHOLDS[best], (found_[best], 1 - false_[best]))


def kinds(found: list[dict[int, int]], bad: np.ndarray, n_words: int, k: int = KINDS, rounds: int = 10) -> np.ndarray:
    """documents x kinds: the toxic documents dealt to k groups by shared features (spherical k-means from far apart starts)."""
    out = np.zeros((len(bad), k), bool)
    own = np.flatnonzero(bad)
    own = own[[bool(found[i]) for i in own]]
    if not len(own) or not n_words:
        return out
    x = np.zeros((len(own), n_words), np.float32)
    for row, i in enumerate(own):
        x[row, list(found[i])] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    starts = [int(np.argmax(x @ x.sum(0)))]
    while len(starts) < k:
        starts.append(int(np.argmin((x @ x[starts].T).max(1))))
    centres = x[starts]
    for _ in range(rounds):
        group = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[group == c].sum(0) if (group == c).any() else centres[c] for c in range(k)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    out[own, group] = True
    return out


def _without_copies(rows: DataFrame, size: int = 5, keys: int = 4) -> DataFrame:
    """One row for all that share any of `keys` minimum hashes of word shingles, else the words of one copied text look like evidence."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        least = []
        for text in texts_of(part.column(0)):
            words = words_of(text)
            shingles = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
            least.append([min(xxhash.xxh64_intdigest(s, seed) for s in shingles) >> 1 for seed in range(keys)])
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.list_(pa.int64()))], names=["text", "flags", "least"])

    marked = map_slices(rows, 0, work, "text string, flags array<boolean>, least array<bigint>")
    for k in range(keys):
        first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "flags", "least")).alias("r")
        marked = marked.groupBy(F.col("least")[k].alias("k")).agg(first).select("r.text", "r.flags", "r.least")
    return marked.select("text", "flags")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", categories: tuple[str, ...] = (), max_rows: int = MAX_ROWS) -> Chain:
    """Fit the chain on labelled documents. categories: columns of labels (0 or less and null: no) in the chain's order; none: kinds from the data."""
    names = [*(categories or [f"kind_{i + 1}" for i in range(KINDS)]), FINAL]
    flags = F.array(*[F.coalesce(F.col(c) > 0, F.lit(False)) for c in (*categories, label_col)])
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), flags.alias("flags"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "flags").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "flags")  # max_rows bounds it
    sample, path = cut(_without_copies(rows))

    n_flags = len(categories) + 1
    width = 1 + n_flags

    def count(batches):
        """Features with the number of documents that have them and of those with each flag, then the same of the held-out ones alone."""
        counts: dict[bytes, np.ndarray] = defaultdict(lambda: np.zeros(2 * width, np.int64))

        def give() -> pa.RecordBatch:
            table = np.array([*counts.values()], np.int64).reshape(len(counts), 2 * width)
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *[pa.array(c) for c in table.T]], names=fields.names)
            counts.clear()
            return made

        for batch in batches:
            for part in slices(batch, 0):
                for text, own in zip(texts_of(part.column(0)), part.column(1).to_pylist(), strict=True):
                    mine = np.array([1, *own], np.int64)
                    mine = np.concatenate([mine, mine * (fold_of(text) == HELD_OUT)])
                    counts[b""] += mine  # the number of documents; no feature is empty
                    for f in {f for w in set(words_of(text)) for f in features_of(w)}:
                        counts[f] += mine
                if len(counts) > HELD_WORDS:
                    yield give()
        yield give()

    names_ = ["n", *[f"with_{i}" for i in range(n_flags)]]
    fields = T.StructType([T.StructField("w", T.BinaryType()), *[T.StructField(f"{p}{c}", T.LongType()) for p in ("", "held_") for c in names_]])
    counted = bounded(sample).mapInArrow(count, fields).groupBy("w").agg(*[F.sum(c).alias(c) for c in fields.names[1:]])
    counted, counts_path = cut(counted.where((F.length("w") == 0) | (F.col("n") >= MIN_DOCS)))
    totals = counted.where(F.length("w") == 0).first()
    if not totals or not totals[f"with_{n_flags - 1}"]:
        return Chain(names, {}, np.zeros((0, 0)))

    def chosen_words(number: Callable[[str], F.Column], total: Callable[[str], int]) -> list[bytes]:
        """The features that say most of any flag, by the counts that `number` and `total` give."""

        def evidence(flag: str) -> F.Column:
            bad_n, good_n = total(flag), total("n") - total(flag)
            p, q = (number(flag) + 0.5) / (bad_n + 1.0), (number("n") - number(flag) + 0.5) / (good_n + 1.0)
            return F.abs(p - q) / F.sqrt(p * (1 - p) / (bad_n + 1.0) + q * (1 - q) / (good_n + 1.0))

        z = F.greatest(*[evidence(f"with_{i}") for i in range(n_flags)], F.lit(0.0))
        best = counted.where((F.length("w") > 0) & (number("n") >= MIN_DOCS)).select("w", z.alias("z")).where(F.col("z") > MIN_Z)
        return [bytes(r.w) for r in best.orderBy(F.desc("z"), "w").limit(MAX_WORDS).collect()]

    every = chosen_words(F.col, totals.__getitem__)
    rest = chosen_words(lambda c: F.col(c) - F.col(f"held_{c}"), lambda c: totals[c] - totals[f"held_{c}"])
    union = {w: i for i, w in enumerate(dict.fromkeys(every + rest))}
    shared = docs.sparkSession.sparkContext.broadcast(union)  # at most twice MAX_WORDS

    def describe(part: pa.RecordBatch) -> pa.RecordBatch:
        reader = Reader(shared.value)
        texts = texts_of(part.column(0))
        found = [sorted(reader.read(t).items()) for t in texts]
        kinds_ = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([[f for f, _ in own] for own in found], kinds_), pa.array([[n for _, n in own] for own in found], kinds_), pa.array([fold_of(t) for t in texts], pa.int32()), part.column(1)], names=["found", "times", "fold", "flags"])

    told = map_slices(sample, 0, describe, "found array<int>, times array<int>, fold int, flags array<boolean>").collect()  # at most max_rows short rows
    forget(docs.sparkSession, path)
    forget(docs.sparkSession, counts_path)
    told.sort(key=lambda r: (r.fold, r.found, r.times, r.flags))
    flags = np.array([r.flags for r in told], bool).reshape(len(told), n_flags)
    folds = np.array([r.fold for r in told])

    def by(words: list[bytes], rows: np.ndarray) -> tuple[dict[bytes, int], list[dict[int, int]]]:
        """Numbers of the given features, and those of the given rows."""
        known = {union[w]: i for i, w in enumerate(words)}
        return {w: i for i, w in enumerate(words)}, [{known[f]: n for f, n in zip(told[r].found, told[r].times, strict=True) if f in known} for r in rows]

    def fitted(words: list[bytes], rows: np.ndarray) -> Chain:
        numbers, found = by(words, rows)
        own = flags[rows]
        if not categories:
            own = np.c_[kinds(found, own[:, -1], len(words)), own]
        return fit_chain(found, folds[rows], own, numbers, names)

    chain, held = fitted(every, np.arange(len(told))), np.flatnonzero(folds == HELD_OUT)
    if len(held) and len(held) < len(told):
        # a chain whose features, kinds and weights have not seen the held-out fold tells what to expect
        probability = fitted(rest, np.flatnonzero(folds != HELD_OUT)).probabilities(by(rest, held)[1])[:, -1]
        chain.judge(probability, flags[held, -1])
    return chain


def score(df: DataFrame, chain: Chain, text_col: str = "text", columns: list[str] | None = None, threshold: float | None = None, prefix: str = "") -> DataFrame:
    """The given columns of df (all by default), then p_<category> for each category and rejected, each named with the prefix."""
    names = [f"{prefix}p_{n}" for n in chain.names] + [prefix + "rejected"]
    kept = [c for c in columns or df.columns if c not in names]
    limit = chain.threshold if threshold is None else threshold
    shared = df.sparkSession.sparkContext.broadcast(chain)  # at most MAX_WORDS weights a category

    def run(batches):
        chain = shared.value
        reader = Reader(chain.words)
        for batch in batches:
            for part in slices(batch, 0):
                p = chain.probabilities([reader.read(t) for t in texts_of(part.column(0))])
                made = [pa.array(np.round(p[:, k], 6)) for k in range(len(chain.names))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made, pa.array(p[:, -1] >= limit)], names=fields.names)

    state = df.select(F.col(text_col).alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(kept)])
    fields = T.StructType([*state.schema.fields[1:], *[T.StructField(f"__p{i}", T.DoubleType()) for i in range(len(chain.names))], T.StructField("__rejected", T.BooleanType())])
    out = bounded(state).mapInArrow(run, fields)
    return out.select(*[F.col(f.name).alias(c) for f, c in zip(fields, [*kept, *names], strict=True)])
