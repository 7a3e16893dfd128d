"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window is the set of its words. Containment must be complete, so its necessary prefix is one token: under a global order by
rarity (documents of the whole corpus that have the word, then the word itself), the rarest one. The join goes from prefix tokens to the
documents that have them; a candidate must leave room for the whole window on both sides of the token (length and positional bounds) and
is verified word by word.

The benchmark's windows reach the workers as broadcast blocks of at most `block_bytes` of item text each, sized before anything is
collected; a larger benchmark takes several blocks, one after the other over all documents.

Defined results: null, empty and wordless texts have no words and no hits; wordless items have no windows; items with the same id count
once; a null item_id hits words but is no item; repeated documents are judged alike; empty tables give no hits. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.llm._common import LOWER_AZ, bounded, cut, map_slices, slices, texts_of

#: Item text in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Lower-cases A-Z and turns ASCII characters other than digits and letters into spaces.
WORDS = bytes(c if b >= 128 or chr(c).isalnum() else 32 for b, c in enumerate(LOWER_AZ))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class Index:
    """Windows of one block: by prefix token, the token's places in windows and their lengths; and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], frequency: dict[bytes, int], size: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for item, text in items:
            for window in windows_of(words_of(text), size):
                known = self.items[b" ".join(window)]
                if item is not None:
                    known.add(item)
                at = min(range(len(window)), key=lambda i: (frequency.get(window[i], 0), window[i], i))
                places[window[at]].add((at, len(window)))
        self.places = {w: sorted(p) for w, p in places.items()}

    def hits(self, words: list[bytes]) -> tuple[set[int], set[str]]:
        """Positions of hit words, ids of items."""
        prefixes = self.places.keys() & set(words)
        hit: set[int] = set()
        found: set[str] = set()
        if not prefixes:
            return hit, found
        for i, w in enumerate(words):
            if w in prefixes:
                for at, length in self.places[w]:
                    start = i - at
                    if start >= 0 and start + length <= len(words) and (items := self.items.get(b" ".join(words[start : start + length]))) is not None:
                        hit.update(range(start, start + length))
                        found |= items
        return hit, found


def _frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that have each word of the vocabulary; no more rows than the block has words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        counts: dict[bytes, int] = defaultdict(int)
        known = shared.value
        for batch in batches:
            for part in slices(batch, 0):
                for text in texts_of(part.column(0)):
                    for w in known.intersection(words_of(text)):
                        counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    rows = bounded(docs).select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.w): r.n for r in rows}


def contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The given columns of df (all by default), then n_words, n_hit, n_items, items_sha256 and contaminated, each named with the prefix.

    Columns of df with such a name are replaced.
    """
    names = [prefix + n for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    kept = [c for c in columns or df.columns if c not in names]
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // block_bytes))
    texts = df.select(F.col(text_col).alias("text"))
    state = df.select(F.col(text_col).alias("__text"), F.lit(None).cast("binary").alias("__hit"), F.lit(None).cast("array<string>").alias("__items"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(kept)])
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        rows = [(r.item, (r.text or "").encode()) for r in own.collect()]  # about block_bytes of text
        index = Index(rows, _frequencies(texts, {w for _, t in rows for w in words_of(t)}), window)
        state = _apply(state, index, block + 1 == blocks)
        if block + 1 < blocks:
            state, _ = cut(state)
    made = [F.col(c).alias(n) for c, n in zip(("__words", "__n_hit", "__n_items", "__sha", "__contaminated"), names, strict=True)]
    return state.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)], *made)


def _apply(state: DataFrame, index: Index, last: bool) -> DataFrame:
    """Add one block's hits to the marks, or after the last block turn them into counts and digests."""
    shared = state.sparkSession.sparkContext.broadcast(index)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        hits: list = []
        found: list = []
        counts: list = []
        for text, before, known in zip(texts_of(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            words = words_of(text)
            places, ids = index.hits(words)
            flags = None
            if before or places:
                flags = np.unpackbits(np.frombuffer(before, np.uint8), count=len(words)) if before else np.zeros(len(words), np.uint8)
                flags[list(places)] = 1
            items = sorted(ids.union(known or ()))
            if last:
                n = 0 if flags is None else int(flags.sum())
                counts.append((len(words), n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0))
            else:
                hits.append(None if flags is None else np.packbits(flags).tobytes())
                found.append(items or None)
        rest = part.columns[3:]
        if last:
            made = [pa.array(c, t) for c, t in zip(zip(*counts, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
            return pa.RecordBatch.from_arrays([*made, *rest], names=names)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.string())), *rest], names=names)

    rest = state.schema.fields[3:]
    start = T._parse_datatype_string("__words long, __n_hit long, __n_items long, __sha string, __contaminated boolean").fields if last else state.schema.fields[:3]
    schema = T.StructType([*start, *rest])
    names = schema.names
    return map_slices(state, 0, work, schema)
