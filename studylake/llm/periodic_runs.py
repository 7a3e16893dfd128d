"""Runs of words: maximal stretches that repeat with a smallest period, at least twice.

A run of `least` words or more, of length L and smallest period q, has L >= max(least, 2q), so it overlaps itself, q words on, by at least
max(least - q, q) words, which is least / 2 or more. All its words therefore lie in k-grams, k = least / 2 rounded up, that the document repeats;
other words are masked. Only the segments between masked words are searched, by Main and Lorentz: a segment is halved again and again, and a run that
crosses a middle m with period q extends the match of the words at m with those at m + q or m - q. All middles of one level, of all documents of
a slice, are worked on at once; a match is tested on three words on either side first, and its extensions are found by codes of stretches of 1, 2, 4, …
words, by halving. Extensions are compared word for word (a code stands for one stretch), never by hashes; hashes only mask.

Defined results: null, empty and wordless texts have no words and no runs; repeated rows are searched alike; an empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm._common import id_type, map_slices, texts_of

#: Words compared on either side of a middle before a match is extended, at most.
NEAR = 3
#: Odd factors of the masking hash.
MIX = np.random.default_rng(7).integers(1, 1 << 63, 64, np.int64).astype(np.uint64) | np.uint64(1)


def _codes(docs: list[list[bytes]]) -> np.ndarray:
    """Numbers of all words of all documents, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for words in docs for w in words), np.int64, sum(map(len, docs)))


def _segments(code: np.ndarray, starts: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that lie in k-grams which their document holds more than once."""
    n = len(code)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    hashed = doc[at].astype(np.uint64) * MIX[-1]
    for t in range(k):
        step = code[at + t].astype(np.uint64) + np.uint64(1)
        hashed += (step ^ (step << np.uint64(29))) * MIX[t % 63]
        hashed ^= hashed >> np.uint64(31)
        hashed *= MIX[62 - t % 8]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    # words in repeated grams; segments end where a gram no longer overlaps the next, or another document begins
    change = np.zeros(n + 1, np.int64)
    change[: n - k + 1] += np.bincount(at[again], minlength=n - k + 1)
    change[k:] -= np.bincount(at[again], minlength=n - k + 1)
    inside = np.cumsum(change[:-1]) > 0
    new = np.r_[True, doc[1:] != doc[:-1]]
    first = np.flatnonzero(inside & (new | ~np.r_[False, inside[:-1]]))
    last = np.flatnonzero(inside & (np.r_[new[1:], True] | ~np.r_[inside[1:], False])) + 1
    wide = last - first >= least
    return first[wide], last[wide]


class _Stretches:
    """Codes of the stretches of 1, 2, 4, … words from each place of an array whose segments are apart; a stretch over an end equals no other."""

    def __init__(self, w: np.ndarray, ends: np.ndarray):
        self.levels, size = [w], 1
        own = -1 - np.arange(len(w))
        while True:
            low = self.levels[-1]
            fits = np.flatnonzero(np.arange(len(w)) + 2 * size <= ends)
            if not len(fits):
                break
            pair = low[fits] * (np.int64(2) * len(w)) + low[fits + size]
            _, number, copies = np.unique(pair, return_inverse=True, return_counts=True)
            if copies.max() < 2:
                break
            level = own.copy()
            level[fits] = number
            self.levels.append(level)
            size *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a equal those from b."""
        n = len(self.levels[0])
        found = np.zeros(len(a), np.int64)
        for p in range(len(self.levels) - 1, -1, -1):
            x, y = np.minimum(a + found, n - 1), np.minimum(b + found, n - 1)
            found += (self.levels[p][x] == self.levels[p][y]).astype(np.int64) << p
        return found

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b."""
        found = np.zeros(len(a), np.int64)
        for p in range(len(self.levels) - 1, -1, -1):
            x, y = a - found - (1 << p), b - found - (1 << p)
            ok = x >= 0
            found += (ok & (self.levels[p][np.maximum(x, 0)] == self.levels[p][np.maximum(y, 0)])).astype(np.int64) << p
        return found


def _runs_of_segments(code: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs; segments are put behind one another with words of their own between and around them."""
    sizes = last - first
    side = min(NEAR, -(-least // 4))  # of an overlap of least / 2 words as many lie on one side of the middle
    gap = side + 1
    offset = gap + np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    total = int(offset[-1] + sizes[-1] + gap)
    seg = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    w = np.full(total, -1, np.int64)
    _, dense = np.unique(code[first[seg] + place], return_inverse=True)
    w[offset[seg] + place] = dense
    blank = np.flatnonzero(w < 0)
    w[blank] = dense.max() + 1 + np.arange(len(blank))
    ends = np.arange(total) + 1
    ends[offset[seg] + place] = (offset + sizes)[seg]
    stretches = _Stretches(w, ends)
    near = np.zeros(total, np.uint64)
    for t in range(side):
        near[: total - side + 1] = (near[: total - side + 1] + w[t : total - side + 1 + t].astype(np.uint64)) * MIX[t]
    out = []
    # every place of a segment and its end, with its segment's own start
    seg1 = np.repeat(np.arange(len(sizes)), sizes + 1)
    place1 = np.arange(int((sizes + 1).sum())) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    level = max(1, int(sizes.max() - 1).bit_length())
    while (1 << level) >= least:
        half = 1 << (level - 1)
        # an end of a node is the next one's start too: it is tried with the middles of both
        for back in (0, 1):
            middle = ((place1 - back) >> level << level) + half
            fit = (place1 >= back) & (middle < sizes[seg1]) & (middle != place1)
            if back:
                fit &= (place1 & ((1 << level) - 1)) == 0
            s, at, m = seg1[fit], place1[fit], middle[fit]
            a, b = offset[s] + np.minimum(at, m), offset[s] + np.maximum(at, m)
            close = (near[a] == near[b]) | (near[a - side] == near[b - side])
            a, b, s = a[close], b[close], s[close]
            if len(a):
                q, ahead, behind = b - a, stretches.forward(a, b), stretches.backward(a, b)
                whole = ahead + behind >= np.maximum(q, least - q)
                out.append(np.stack([(a - behind - offset[s] + first[s])[whole], (ahead + behind + q)[whole], q[whole]], axis=1))
        level -= 1
    if not out:
        return np.zeros((0, 3), np.int64)
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    # of one stretch found with several periods the smallest counts
    return found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]] if len(found) else found


def runs(docs: list[list[bytes]], least: int = 12) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start, then period."""
    code = _codes(docs)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    first, last = _segments(code, starts, -(-least // 2), least)
    if not len(first):
        return [np.zeros((0, 3), np.int64)] * len(docs)
    found = _runs_of_segments(code, first, last, least)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    doc = np.searchsorted(starts, found[:, 0], "right") - 1
    found[:, 0] -= starts[doc]
    at = np.searchsorted(doc, np.arange(len(docs) + 1))
    return [found[at[i] : at[i + 1]] for i in range(len(docs))]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed (the text without what runs repeat, words joined by
    one space). Words are what stands between the white space of ASCII; least (2 or more) is a run's least number of words."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        docs = [t.split() for t in texts_of(part.column(1))]
        found = runs(docs, least)
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], names=["start", "length", "period"]))
        left = [b" ".join(collapsed(d, f)).decode() for d, f in zip(docs, found, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in docs], pa.int64()), made, pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {id_type(df, id_col)}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), 1, work, schema)
