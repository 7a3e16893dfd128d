"""Substring dedup by a compacted de Bruijn graph over words.

The graph's edges are the windows of `window` words (its k-mers); a window leads from its first words to its last, and to the next window
of the same text. Long repeated spans are its repeated nonbranching paths.

* Runs. Of each window the k words with the least hash are its anchor, which depends on nothing but the window's words. Windows that
  follow each other with one anchor are a run, a piece of a path that each task compacts by itself: texts are hashed once, into a table
  of runs with two hashes, the runs before and after, and their place. Runs with equal words are one piece wherever they stand.
* Branches. Anchors that several documents have are live. Where a live anchor has several runs the graph branches; the first copy of
  each of these runs is opened into single windows from its text. Copies of a run beyond the first repeat an earlier document whole.
* Compaction. A piece links to its successor if no occurrence of either has another neighbour. Links are joined and contracted by
  pointer doubling, until each path is known by its first piece and its number of windows; every occurrence of the first piece is one of
  the whole path, so only these are joined to the documents.
* Verification. Each span of a document, runs of paths that follow each other in it and in their source joined, is compared with the words at its
  source's coordinates: both sides' words go into a SHA-256, equal requests to a source meet once. Should hashes of pieces
  have clashed, the graph is built again from other hashes.

Defined results: texts with fewer words than a window, null and empty texts have no windows and keep all words; repeated rows with one
id do not remove each other's words, since no id is smaller; a null id neither removes nor is removed from; an empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from studylake.llm._common import cut, forget, id_type, join_hot, map_slices, texts_of

#: Odd multipliers of the two rolling hashes, and of the mixing of word hashes (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Times that the graph is built with other hashes where a span is not what its source has.
ATTEMPTS = 3
#: Words whose hashes a worker keeps.
KEPT_WORDS = 400_000
#: Text bytes whose hashes are held at once; a word takes several hashes.
HELD_BYTES = 3 << 20
_kept: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_kept) > KEPT_WORDS:
        _kept.clear()
    digest, kept = xxhash.xxh3_64_intdigest, _kept
    for w in set(words):
        if w not in kept:
            kept[w] = digest(w)
    return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any spans of one sequence of word hashes."""

    def __init__(self, words: np.ndarray, which: int, seed: int = 0):
        n = len(words)
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(BASES[which], -1, 1 << 64), np.uint64)])
        powers = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), BASES[which], np.uint64)])[:n]
        own = _mix(words + np.uint64(BASES[1 - which])) if which else words
        if seed:
            own = _mix(own ^ np.uint64(seed * BASES[which] & (1 << 64) - 1))
        self.sums = np.r_[np.uint64(0), np.cumsum(own * powers, dtype=np.uint64)]

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(lengths: np.ndarray, hashes: np.ndarray, window: int, k: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor in several texts whose word hashes stand one after the other: text, start in it, windows, anchor and content
    (hashes of the run's words), piece (a hash of both), before and after (the pieces next to it in its text; 0: none)."""
    names = ("text", "start", "windows", "anchor", "content", "piece", "before", "after")
    if len(hashes) < window:
        return {n: np.zeros(0, np.int64) for n in names}
    first, second = Rolling(hashes, 0, seed), Rolling(hashes, 1, seed)
    at = np.arange(len(hashes) - k + 1)
    nodes = first.spans(at, at + k)
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    ordered = (nodes & ~low) | at.astype(np.uint64)  # the hash, leftmost on a tie
    anchors = (_sliding_minimum(ordered, window - k + 1) & low).astype(np.int64)
    begin = np.cumsum(np.r_[0, lengths[:-1]])
    own = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(np.arange(len(hashes)) - begin[own] + window <= lengths[own])
    if not len(starts):
        return {n: np.zeros(0, np.int64) for n in names}
    anchor, text = anchors[starts], own[starts]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    head = np.flatnonzero(new)
    count = np.diff(np.r_[head, len(starts)])
    start, text, anchor = starts[head], text[head], anchor[head]
    content = second.spans(start, start + count + window - 1)
    piece = _mix(nodes[anchor] ^ (content * np.uint64(BASES[0]))).view(np.int64)
    same = text[1:] == text[:-1]
    before, after = np.r_[0, np.where(same, piece[:-1], 0)], np.r_[np.where(same, piece[1:], 0), 0]
    columns = (text, start - begin[text], count, nodes[anchor].view(np.int64), content.view(np.int64), piece, before, after)
    return dict(zip(names, columns, strict=True))


def split_words(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    words = [t.split() for t in texts]
    return words, np.array([len(w) for w in words], np.int64)


def _runs(docs: DataFrame, kind: str, window: int, k: int, seed: int) -> DataFrame:
    """Every run of every text (columns id, text, row)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        words, lengths = split_words(texts_of(part.column(1)))
        r = runs_of(lengths, word_hashes([w for ws in words for w in ws]), window, k, seed)
        at = pa.array(r["text"])
        own = [pa.array(r[n]) for n in ("anchor", "content", "piece", "before", "after")] + [pa.array(r[n].astype(np.int32)) for n in ("start", "windows")]
        return pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), *own], names=["id", "row", "anchor", "content", "piece", "before", "after", "start", "windows"])

    return map_slices(docs, 1, work, f"id {kind}, row long, anchor long, content long, piece long, before long, after long, start int, windows int", HELD_BYTES)


def _windows(rims: DataFrame, kind: str, window: int, seed: int) -> DataFrame:
    """Single windows of opened runs (column open: start, windows), each a piece; neighbours are the windows next to it that are open too."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, columns = [], []
        for i, (text, spans) in enumerate(zip(texts_of(part.column(1)), part.column(3).to_pylist(), strict=True)):
            hashes = word_hashes(text.split())
            at = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in spans]))
            anchor, content = (Rolling(hashes, which, seed).spans(at, at + window).view(np.int64) for which in (0, 1))
            piece = _mix(anchor.view(np.uint64) ^ (content.view(np.uint64) * np.uint64(BASES[0]))).view(np.int64)
            joined = at[1:] == at[:-1] + 1
            before, after = np.r_[0, np.where(joined, piece[:-1], 0)], np.r_[np.where(joined, piece[1:], 0), 0]
            rows.append(np.full(len(at), i))
            columns.append((anchor, content, piece, before, after, at.astype(np.int32), np.ones(len(at), np.int32)))
        if not rows:
            return None
        at = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), *[pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]], names=["id", "row", "anchor", "content", "piece", "before", "after", "start", "windows"])

    return map_slices(rims, 1, work, f"id {kind}, row long, anchor long, content long, piece long, before long, after long, start int, windows int", HELD_BYTES)


def compacted(pieces: DataFrame) -> DataFrame:
    """head, total: the first piece of each nonbranching path and its number of windows.

    pieces: piece (unique), windows, before and after (0 or null: none or several). A link joins a piece to its successor if each is the
    other's only neighbour; pointers are doubled along the links, so the rounds are a logarithm of the longest path.
    """
    spark = pieces.sparkSession
    nodes = pieces.select("piece", F.nullif("before", F.lit(0)).alias("before"), F.nullif("after", F.lit(0)).alias("after"), F.col("windows").cast("long").alias("total"))
    ahead = nodes.select(F.col("piece").alias("after"), F.col("before").alias("back"))
    linked = nodes.join(ahead, "after", "left").select("piece", "total", "before", F.when(F.col("back") == F.col("piece"), F.col("after")).alias("to"))
    linked, path = cut(linked)
    followed = linked.where("to is not null").select(F.col("to").alias("piece"), F.lit(True).alias("followed"))
    now, now_path = cut(linked.select("piece", "total", "to").join(followed, "piece", "left").select("piece", "total", "to", F.col("followed").isNull().alias("first")))
    forget(spark, path)
    while not now.where("to is not null").isEmpty():
        step = now.select(F.col("piece").alias("to"), F.col("total").alias("more"), F.col("to").alias("next"))
        far = now.where("to is not null").join(step, "to").select("piece", (F.col("total") + F.col("more")).alias("total"), F.col("next").alias("to"), "first")
        new, new_path = cut(now.where("to is null").select("piece", "total", "to", "first").unionByName(far))
        forget(spark, now_path)
        now, now_path = new, new_path
    return now.where("first").select(F.col("piece").alias("head"), "total")


def _spans(occurrences: DataFrame, repeated: DataFrame) -> DataFrame:
    """id, row, start, windows, source, source_row, source_start of each occurrence of a path outside its first document.

    occurrences: all places of pieces; repeated: anchor, content, source (the first document), n (occurrences) of the pieces that several documents have.
    """
    keys = ["anchor", "content"]
    placed, placed_path = cut(join_hot(occurrences, repeated.select(*keys, "source"), *keys, counts=repeated.select(*keys, "n")))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(0).alias(c)
    pieces = placed.groupBy("piece").agg(F.min("windows").alias("windows"), one("before"), one("after"), (F.min("content") != F.max("content")).alias("clash"), F.count("*").alias("n"))
    pieces, pieces_path = cut(pieces.select("piece", "windows", *[F.when(~F.col("clash"), F.col(c)).alias(c) for c in ("before", "after")], "n"))
    heads, _ = cut(compacted(pieces).withColumnRenamed("head", "piece"))
    found, _ = cut(join_hot(placed, heads, "piece", counts=pieces.select("piece", "n")).select("piece", "id", "row", "start", "total", "source"))
    for path in (placed_path, pieces_path):
        forget(placed.sparkSession, path)
    sources = found.where("id = source").groupBy("piece").agg(F.min(F.struct("row", "start")).alias("at")).select("piece", F.col("at.row").alias("source_row"), F.col("at.start").alias("source_start"))
    later = join_hot(found.where("id <> source"), sources, "piece")
    return later.select("id", "row", "start", F.col("total").cast("int").alias("windows"), "source", "source_row", "source_start")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 8, seed: int = 0) -> DataFrame:
    """id, row (XXH64 of the text), start, windows, source, source_row, source_start: runs of windows that also start in a document with a smaller id."""
    spark, kind = df.sparkSession, id_type(df, id_col)
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    keys = ["anchor", "content"]
    runs, runs_path = cut(_runs(docs, kind, window, k, seed))
    edges, edges_path = cut(runs.groupBy(*keys).agg(F.min("id").alias("source"), F.max("id").alias("last"), F.count("*").alias("n")))
    # nodes that more than one document has: with one run nothing branches there, with several windows have to be compared
    nodes = edges.groupBy("anchor").agg(F.min("source").alias("first"), F.max("last").alias("last"), F.count("*").alias("runs")).where("first <> last")
    live, _ = cut(edges.join(nodes.select("anchor", (F.col("runs") > 1).alias("branches")), "anchor").select(*keys, "source", "n", (F.col("source") != F.col("last")).alias("repeats"), "branches"))
    whole, _ = cut(_spans(runs, live.where("repeats")))
    opened = join_hot(runs.select("id", "row", "start", "windows", *keys), live.where("branches").select(*keys, "source"), *keys, counts=live.select(*keys, "n")).where("id = source")
    opened = opened.groupBy("id", "row").agg(F.array_distinct(F.collect_list(F.struct("start", "windows"))).alias("open"))
    opened, opened_path = cut(opened)
    for path in (runs_path, edges_path):
        forget(spark, path)
    rims = docs.join(opened, ["id", "row"]).select("id", "text", "row", "open")
    windows, windows_path = cut(_windows(rims, kind, window, seed))
    shared, _ = cut(windows.groupBy(*keys).agg(F.min("id").alias("source"), F.max("id").alias("last"), F.count("*").alias("n")).where("source <> last").drop("last"))
    parts, _ = cut(_spans(windows, shared))
    for path in (windows_path, opened_path):
        forget(spark, path)
    return whole.unionByName(parts)


def _covered(n: int, starts: list[int], counts: list[int], window: int) -> np.ndarray:
    """Which of n words the windows cover that start at starts[i], starts[i] + 1, and so on, counts[i] of them."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.array(starts, np.int64) + np.array(counts, np.int64) + window - 1, -1)
    return np.cumsum(steps[:-1]) > 0


REQUEST = ["source", "source_row", "source_start", "words", "digest"]


def _merged(spans: list[dict]) -> list[dict]:
    """Spans that overlap or follow each other in the document and in their source, as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["source"], s["source_row"], s["start"] - s["source_start"], s["start"])):
        last = out[-1] if out else None
        if last and all(last[c] == s[c] for c in ("source", "source_row")) and last["start"] - last["source_start"] == s["start"] - s["source_start"] and s["start"] <= last["start"] + last["windows"]:
            last["windows"] = max(last["windows"], s["start"] + s["windows"] - last["start"])
        else:
            out.append(dict(s))
    return out


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


#: Requests to one source that are answered together, about.
ANSWERED = 4096


def _unlike(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests (columns REQUEST) that their source's words do not answer; a source takes its distinct requests in lists of about ANSWERED."""
    place = ["source", "source_row"]
    each, _ = cut(requests.distinct())
    lists = each.groupBy(*place).agg(F.ceil(F.count("*") / ANSWERED).cast("int").alias("lists")).where("lists > 1")
    number = F.coalesce(F.pmod(F.xxhash64("source_start", "words"), F.col("lists")), F.lit(0)).alias("list")
    dealt = each.join(lists, place, "left").select(*REQUEST, number)
    asked = dealt.groupBy(*place, "list").agg(F.collect_list(F.struct(*REQUEST[2:])).alias("asked"))
    sources = docs.select(F.col("id").alias("source"), F.col("row").alias("source_row"), "text").join(cut(asked)[0], place)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        wrong = []
        for text, asked in zip(texts_of(part.column(0)), part.column(1).to_pylist(), strict=True):
            words = text.split()
            wrong.append(sum(_digest(words[a["source_start"] : a["source_start"] + a["words"]]) != a["digest"] for a in asked))
        return pa.RecordBatch.from_arrays([pa.array(wrong, pa.int64())], names=["wrong"])

    return map_slices(sources.select("text", "asked"), 0, work, "wrong long").where("wrong > 0")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 8, digests: bool = False) -> DataFrame:
    """id_col, n_words, n_removed, kept (the words that stay, joined by one space; their SHA-256 as kept_sha256 with digests), one row per input row."""
    kind = id_type(df, id_col)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    name = "kept_sha256" if digests else "kept"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, kept, requests = [], [], [], []
        for text, spans in zip(texts_of(part.column(1)), part.column(2).to_pylist(), strict=True):
            words = text.split()
            left, merged = words, _merged(spans or [])
            if merged:
                covered = _covered(len(words), [m["start"] for m in merged], [m["windows"] for m in merged], window)
                left = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            n.append(len(words))
            gone.append(len(words) - len(left))
            stays = b" ".join(left)
            kept.append(hashlib.sha256(stays).hexdigest() if digests else stays.decode())
            sizes = [m["windows"] + window - 1 for m in merged]
            requests.append([{"source": m["source"], "source_row": m["source_row"], "source_start": m["source_start"], "words": size, "digest": _digest(words[m["start"] : m["start"] + size])} for m, size in zip(merged, sizes, strict=True)])
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(requests, asked)], names=["id", "n_words", "n_removed", name, "asked"])

    asked = pa.list_(pa.struct([("source", to_arrow_type(df.schema[id_col].dataType)), ("source_row", pa.int64()), ("source_start", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())]))
    fields = f"id {kind}, n_words long, n_removed long, {name} string, asked array<struct<source:{kind},source_row:long,source_start:int,words:int,digest:binary>>"
    for seed in range(ATTEMPTS):
        spans = repeated_spans(df, id_col, text_col, window, k, seed)
        lists, _ = cut(spans.groupBy("id", "row").agg(F.collect_list(F.struct("start", "windows", "source", "source_row", "source_start")).alias("spans")))
        joined = docs.join(lists, ["id", "row"], "left").select("id", "text", "spans")
        out, _ = cut(map_slices(joined, 1, work, fields))
        if _unlike(docs, out.select(F.explode("asked").alias("a")).select("a.*")).isEmpty():
            return out.select(F.col("id").alias(id_col), "n_words", "n_removed", name)
    raise RuntimeError("spans differ from their sources under every hash")
