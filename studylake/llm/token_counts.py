"""Token counts by rank-synchronous array merging.

Pre-tokens are held in batches as one ragged numpy array of symbol ids. In each step every sequence finds the lowest merge rank among
its adjacent pairs, all sequences merge that pair at once, left to right, and the arrays close up; symbols that survive are counted.

Defined results: null and empty texts have 0 tokens; special strings inside a text are one token each, as the library takes them by
default; repeated rows are counted alike; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm._common import id_type, map_slices

#: Words whose counts a worker keeps; the table is emptied beyond that.
KEPT_WORDS = 1_000_000
#: Symbols of the pre-tokens that are merged together.
BATCH_SYMBOLS = 1 << 19
#: Bytes from which a pre-token is merged by itself.
LONG = 4096
#: White space as the Unicode property has it; str.split() takes the four separators x1C to x1F besides.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Ranks and start symbols of a tokenizers file with word ends (BPE, byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] is None or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a lower-casing BPE vocabulary with word ends")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        letters = byte_characters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.kept: dict[str, int] = {}

    def survivors(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each non-empty pre-token."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        counts = lengths.copy()
        none = np.int64(len(self.keys))
        while len(symbols) > 1:
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == keys) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[rank, none], starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            mine = np.repeat(best, sizes)
            hit = (rank == mine[:-1]) & (rank < none)
            if hit.any():
                # in a run of overlapping pairs of equal symbols every other one merges, from the left
                index = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, 0))
                hit &= (index - begin) % 2 == 0
                left = np.flatnonzero(hit)
                symbols[left] = self.made[rank[left]]
                np.subtract.at(counts, owner[left], 1)
            # finished sequences leave, merged right halves too
            keep = np.repeat(best < none, sizes)
            keep[1:] &= ~hit
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def survivors_of_long(self, token: bytes) -> int:
        """The same for one long pre-token: the places of each rank's pairs are kept, and only pairs beside a merge are looked up anew."""
        raw = np.frombuffer(token, np.uint8)
        symbols = self.inner[raw]
        symbols[-1] = self.last[raw[-1]]
        size = len(symbols)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        there = np.ones(size + 1, bool)
        none = len(self.keys)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            keys = symbols[left] * self.size + symbols[right]
            at = np.searchsorted(self.keys, keys)
            at[at == none] = 0
            return np.where(self.keys[at] == keys, self.ranks[at], none)

        waiting: dict[int, list[np.ndarray]] = {}
        agenda: list[int] = []

        def note(left: np.ndarray) -> None:
            found = ranks(left, after[left])
            left, found = left[found < none], found[found < none]
            order = np.argsort(found, kind="stable")
            left, found = left[order], found[order]
            for places, rank in zip(np.split(left, np.flatnonzero(np.diff(found)) + 1), found[np.r_[True, found[1:] != found[:-1]][: len(found)]].tolist(), strict=False):
                if rank not in waiting:
                    waiting[rank] = []
                    heappush(agenda, rank)
                waiting[rank].append(places)

        note(np.arange(size - 1))
        count = size
        while agenda:
            rank = heappop(agenda)
            left = np.unique(np.concatenate(waiting.pop(rank)))
            left = left[there[left]]
            left = left[after[left] < size]
            left = left[ranks(left, after[left]) == rank]
            if not len(left):
                continue
            # in a run of overlapping pairs of equal symbols every other one merges, from the left
            index = np.arange(len(left))
            begins = np.r_[True, after[left[:-1]] != left[1:]]
            left = left[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
            right = after[left]
            symbols[left] = self.made[rank]
            there[right] = False
            after[left] = after[right]
            inside = after[left] < size
            before[after[left][inside]] = left[inside]
            count -= len(left)
            ahead = before[left]
            note(np.unique(np.r_[ahead[ahead >= 0], left[inside]]))
        return count

    def pretokens(self, word: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return [t.encode() for t in self.split.findall(text)]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.kept]
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = list(words)
        tokens: dict[bytes, int] = {}
        own = [[tokens.setdefault(t, len(tokens)) for t in self.pretokens(w)] for w in new]
        counts = np.zeros(len(tokens), np.int64)
        group, held, first = [], 0, 0
        for t in [*tokens, None]:
            if group and (t is None or held + len(t) > BATCH_SYMBOLS or len(t) > LONG or len(group[0]) > LONG):
                counts[first : first + len(group)] = self.survivors_of_long(group[0]) if len(group[0]) > LONG else self.survivors(group)
                first += len(group)
                group, held = [], 0
            if t is not None:
                group.append(t)
                held += len(t)
        for w, ts in zip(new, own, strict=True):
            self.kept[w] = int(counts[ts].sum()) if ts else 0

    def words(self, text: str) -> tuple[list[str], int]:
        """The words between white space, and the special strings that were among them."""
        special = 0
        if self.special and "<" in text:
            parts = self.special.split(text)
            special = len(parts) - 1
            text = " ".join(parts)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return re.findall(f"[^{WHITE}]+", text), special
        return text.split(), special

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.words(t) for t in texts]
        fresh = set().union(*(w for w, _ in cut)) if cut else set()
        self.learn(fresh)
        kept = self.kept
        return [sum(map(kept.__getitem__, w)) + special for w, special in cut]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens; one row per input row."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in part.column(1).to_pylist()]
        counted = merges(vocabulary).count(texts)
        size = pa.array([len(t.encode()) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0), size, pa.array(counted, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), 1, work, f"id {id_type(df, id_col)}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
