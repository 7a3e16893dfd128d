"""Token ids as flat binary files with 64-bit document offsets, in ascending order of ids of documents.

A data set is a folder of shards and a manifest. A shard holds a range of documents: `.ids`, the flat little-endian unsigned ids (two bytes
each where the vocabulary allows, else four); `.offsets`, 64-bit starts of its documents and the end; `.docs`, an Arrow file of the ids of
its documents. All three can be memory-mapped. The manifest has a row a shard with its base, the ids in all shards before it: prefix sums
of the shards' totals. It is written last, so a folder without one is not a data set. Shards of task attempts that lost are not in the
manifest, and are deleted.

A text is cut at single spaces between characters that are no white space; no pre-token reaches over such a space, and none but the first of a
piece begins with it. The library encodes each new piece, with its space, and a worker keeps the ids. That holds for byte-level vocabularies; with others the library
encodes whole texts.

Defined results: a null or empty text has the end id only; documents of equal id (null comes first) stand in the order of a hash of their
texts, repeated rows beside each other; an empty table gives a data set without shards and reads as no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm._common import bounded, id_type, map_slices
from studylake.llm.token_counts import byte_characters

#: A space that a text may be cut at.
GAP = re.compile(r" (?<=\S )(?=\S)")
#: White space of all alphabets for a pattern without such a class; texts with some of it beside a space, or a space at an end.
WHITE = "\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
UNSAFE = f"[{WHITE}] | [{WHITE}]|^ | $"
#: Words with marks behind them, one to a line: the pre-tokens are each word, each run of marks and each line end. Marks that can begin a contraction
#: or a special token are none.
LETTER, MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", "[!-&(-/:;=?@\\[-`{}~]"
PLAIN = re.compile(f" ?{LETTER}+{MARKS}*(?:\n{LETTER}+{MARKS}*)*")
PRE_TOKEN = re.compile(f" ?{LETTER}+|{MARKS}+|\n")
#: Ids of pieces that a worker keeps, about; then its table starts anew.
KEPT_IDS = 4_000_000
#: Bytes of a shard, about, and documents and ids that are read at a time.
SHARD_BYTES, READ_DOCS, READ_IDS = 256 << 20, 1000, 1 << 20
#: Bytes of texts that are encoded together, and rows a shard that its bounds are taken from.
ENCODED_BYTES, SAMPLED = 4 << 20, 32

#: The character that stands for each byte in byte-level vocabularies.
LETTERS = byte_characters()

MANIFEST = "shard int, name string, width int, n_docs long, n_ids long, base long"


class Pieces:
    """Ids of pieces of texts by the library, kept in flat arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        spec = json.loads(self.library.to_str())
        cuts = spec["pre_tokenizer"] or {}
        own = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]]
        self.splits = cuts.get("type") == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"] and not spec["normalizer"] and not own
        self._fresh()

    def _fresh(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.flat, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.int32), 0
        self.seen = np.zeros(1 << 16, np.int32)

    def _forget_rare(self) -> None:
        """Keep the pieces that more than one call asked for; all go if they take half of the room."""
        often = np.flatnonzero(self.seen[: len(self.known)] > 1)
        lengths = self.starts[often + 1] - self.starts[often]
        if not len(often) or (total := int(lengths.sum())) > KEPT_IDS // 2:
            return self._fresh()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        names = [*self.known]
        self.flat = self.flat[np.arange(total) + np.repeat(self.starts[often] - ends[:-1], lengths)]
        self.known, self.starts, self.used = {names[i]: k for k, i in enumerate(often.tolist())}, ends, total
        self.seen = np.ones(len(often), np.int32)
        return None

    def _add(self, pieces: list[str]) -> None:
        """Number new pieces (with their spaces); ids go behind those that are there."""
        made: list[list[int] | None] = []
        plain, cuts, model, known = PLAIN.fullmatch, PRE_TOKEN.findall, self.library.model.tokenize, {}
        for p in pieces if self.splits else []:
            if plain(p) is None:
                made.append(None)
                continue
            ids: list[int] = []
            for x in cuts(p):
                if (own := known.get(x)) is None:
                    own = known[x] = [t.id for t in model(x.encode().decode("latin-1").translate(LETTERS))]
                ids += own
            made.append(ids)
        made = made or [None] * len(pieces)
        rest = [i for i, m in enumerate(made) if m is None]
        for i, x in zip(rest, self.library.encode_batch([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            made[i] = x.ids
        ends = self.used + np.cumsum([len(m) for m in made])
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(ends[-1], np.int32)])
        self.flat[self.used : ends[-1]] = np.fromiter(chain.from_iterable(made), np.int32, int(ends[-1]) - self.used)
        self.known |= zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True)
        if len(self.known) > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros(len(self.known), np.int32)])
        self.starts, self.used = np.concatenate([self.starts, ends]), int(ends[-1])

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of each text; each but a text's first lacks the space before it."""
        if not self.splits:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        hard = pc.match_substring_regex(texts, UNSAFE)
        if not pc.any(hard).as_py():
            return pc.split_pattern(texts, " ")
        cuts = pc.split_pattern(pc.if_else(hard, "", texts), " ")
        lists = [GAP.split(t) if h else c for h, t, c in zip(hard.to_pylist(), texts.to_pylist(), cuts.to_pylist(), strict=True)]
        return pa.array(lists, pa.list_(pa.string()))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; texts has no nulls."""
        if not len(texts):
            return []
        if self.used > KEPT_IDS:
            self._forget_rare()
        cuts = self._pieces(texts.cast(pa.string()))
        at = cuts.offsets.to_numpy().astype(np.int64)
        coded = cuts.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        number = self._numbers(pc.binary_join_element_wise("", coded.dictionary, " ").to_pylist())[coded.indices.to_numpy()]
        first = at[:-1][np.diff(at) > 0]
        number[first] = self._numbers(coded.dictionary.take(coded.indices.take(pa.array(first))).to_pylist())
        lengths = self.starts[number + 1] - self.starts[number]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[number] - ends[:-1], lengths)]
        return np.split(ids, ends[at[1:-1]])

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces; new ones get theirs."""
        codes = [*map(self.known.get, pieces)]
        if None in codes:
            new = [*dict.fromkeys(p for p, c in zip(pieces, codes, strict=True) if c is None)]
            gc.disable()  # many short lists, none in a cycle
            for i in range(0, len(new), 100_000):
                self._add(new[i : i + 100_000])
            gc.enable()
            codes = [self.known[p] if c is None else c for p, c in zip(pieces, codes, strict=True)]
        own = np.array(codes, np.int64)
        self.seen[own] += 1
        return own


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def width_of(size: int) -> int:
    """Bytes of an id below size."""
    return 2 if size <= 1 << 16 else 4


def encode(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", edges: list[tuple] | None = None) -> DataFrame:
    """doc_id, n_ids, ids (binary: little-endian unsigned, as the files have them), with end_id after each document's own. With edges (as bounds() gives
    them, for columns __hash and __row of df) those columns and the number of the shard too."""
    size = max(pieces_of(tokenizer).size, end_id + 1)
    width = width_of(size)
    carried = ["__hash", "__row"] if edges is not None else []

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([end_id], f"<u{width}").tobytes()
        made = [ids.astype(f"<u{width}").tobytes() + end for ids in pieces_of(tokenizer).encode(pc.fill_null(part.column(0), ""))]
        columns = [*part.columns[1:], pa.array([len(m) // width for m in made], pa.int64()), pa.array(made, pa.binary())]
        if carried:
            rows = zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)
            columns.append(pa.array([bisect_right(edges, (i is not None, 0 if i is None else i, h, p)) for i, h, p in rows], pa.int32()))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *carried, "n_ids", "ids", *["shard"] * bool(carried)])

    rows = df.select(F.col(text_col).alias("__text"), F.col(id_col).alias("doc_id"), *carried)
    more = ("__hash long, __row long, ", ", shard int") if carried else ("", "")
    return map_slices(rows, 0, work, f"doc_id {id_type(df, id_col)}, {more[0]}n_ids long, ids binary{more[1]}", ENCODED_BYTES)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def bounds(rows: DataFrame, n: int, shards: int, keys: list[str]) -> list[tuple]:
    """Keys between shards, from about SAMPLED of the n rows a shard that hashes pick; they change only how full shards are, not what a result is."""
    share = min(1.0, SAMPLED * shards / max(n, 1))
    found = rows.select(*keys).where(F.pmod(F.xxhash64(*keys[1:]), F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    placed = sorted((r[0] is not None, 0 if r[0] is None else r[0], r[1], r[2]) for r in found)
    return [placed[len(placed) * i // shards] for i in range(1, shards)] if placed else []


def write(df: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode df and write a data set to folder, a path that driver and executors share.

    A document's shard follows from its id before it is encoded, so it is encoded once and meets its shard by one shuffle; rows of one id are dealt by
    hashes of their texts and of their places, so a frequent id fills several shards.
    """
    spark = df.sparkSession
    width = width_of(max(pieces_of(tokenizer).size, end_id + 1))
    keys = ["doc_id", "__hash", "__row"]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t")).withColumns({"__hash": F.xxhash64("__t"), "__row": F.xxhash64(F.monotonically_increasing_id())})
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__t")), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(2 * tasks, -(-total * width // (3 * SHARD_BYTES)))
    coded = encode(rows, tokenizer, end_id, "doc_id", "__t", bounds(rows, n, shards, keys))
    dealt = coded.repartition(shards, "shard").sortWithinPartitions("shard", *keys)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, out, done = TaskContext.get().taskAttemptId(), None, []
        for batch in batches:
            shards_of = batch.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(shards_of)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for start, end in zip([0, *ends], ends, strict=False):
                if out is None or out.shard != shards_of[start]:
                    done += [out.close()] if out else []
                    out = _Writer(folder, int(shards_of[start]), attempt, batch.schema.field(1))
                out.add(batch.slice(start, end - start))
        done += [out.close()] if out else []
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # one row a shard, whatever the number of documents
    done = sorted(bounded(dealt.select("shard", "doc_id", "ids", "n_ids")).mapInArrow(put, "shard int, name string, n_docs long, n_ids long").collect())
    bases = [0, *accumulate(r["n_ids"] for r in done)]
    table = [(r["shard"], r["name"], width, r["n_docs"], r["n_ids"], base) for r, base in zip(done, bases, strict=False)]
    _drop_losers(folder, {r["name"] for r in done})
    spark.createDataFrame(table, MANIFEST).coalesce(1).write.parquet(f"{folder.rstrip('/')}/manifest")


class _Writer:
    """The files of one shard, written by one attempt of a task."""

    def __init__(self, folder: str, shard: int, attempt: int, id_field: pa.Field):
        self.store, self.root = _store(folder)
        self.store.create_dir(self.root, recursive=True)
        self.shard, self.name, self.offsets = shard, f"shard-{shard:06d}-{attempt}", [np.zeros(1, np.int64)]
        self.ids, self.docs = (self.store.open_output_stream(f"{self.root}/{self.name}.{x}") for x in ("ids", "docs"))
        self.table = pa.ipc.new_file(self.docs, pa.schema([pa.field("doc_id", id_field.type)]))

    def add(self, rows: pa.RecordBatch) -> None:
        for ids in rows.column(2):
            self.ids.write(ids.as_buffer())
        self.offsets.append(self.offsets[-1][-1] + np.cumsum(rows.column(3).to_numpy()))
        self.table.write_batch(pa.RecordBatch.from_arrays([rows.column(1)], names=["doc_id"]))

    def close(self) -> dict:
        self.table.close()
        for f in (self.ids, self.docs):
            f.close()
        places = np.concatenate(self.offsets)
        with self.store.open_output_stream(f"{self.root}/{self.name}.offsets") as f:
            f.write(places.astype("<i8").tobytes())
        return {"shard": self.shard, "name": self.name, "n_docs": len(places) - 1, "n_ids": int(places[-1])}


def _drop_losers(folder: str, names: set[str]) -> None:
    from pyarrow import fs

    store, root = _store(folder)
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("shard-") and info.base_name.rsplit(".", 1)[0] not in names:
            store.delete_file(info.path)


class Shard:
    """One shard's arrays: memory-mapped where the folder is on a file system of the machine, else read by ranges."""

    def __init__(self, folder: str, name: str, width: int):
        from pyarrow import fs

        self.store, root = _store(folder)
        self.path, self.kind = f"{root}/{name}", np.dtype(f"<u{width}")
        local = isinstance(self.store, fs.LocalFileSystem)
        self.mapped = np.memmap(f"{self.path}.ids", self.kind, "r") if local else None
        self.file = None if local else self.store.open_input_file(f"{self.path}.ids")
        self.offsets = np.memmap(f"{self.path}.offsets", "<i8", "r") if local else np.frombuffer(self.store.open_input_file(f"{self.path}.offsets").read(), "<i8")
        self.docs = pa.ipc.open_file(pa.memory_map(f"{self.path}.docs") if local else self.store.open_input_file(f"{self.path}.docs"))

    def ids(self, start: int, end: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:end]
        return np.frombuffer(self.file.read_at((end - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)


def read(spark: SparkSession, folder: str, id_kind: str = "long", digests: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (array<long>) or, with digests, ids_crc32 (unsigned CRC-32 of the ids as
    little-endian unsigned 32-bit integers). One task a shard, or several shards a task."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    n = max(1, shards.count())
    last = "ids_crc32 long" if digests else "ids array<long>"

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, at = Shard(folder, row["name"], row["width"]), 0
                for k in range(shard.docs.num_record_batches):
                    docs = shard.docs.get_batch(k).column(0)
                    places = np.asarray(shard.offsets[at : at + len(docs) + 1])
                    first = 0
                    while first < len(docs):
                        until = int(np.searchsorted(places, places[first] + READ_IDS, "right")) - 1
                        until = min(max(until, first + 1), first + READ_DOCS, len(docs))
                        ids, ends = shard.ids(int(places[first]), int(places[until])), places[first : until + 1] - places[first]
                        if digests:
                            wide = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
                            made = pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
                        else:
                            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([docs.slice(first, until - first), pa.array(places[first:until] + row["base"], pa.int64()), pa.array(np.diff(ends), pa.int64()), made], names=["doc_id", "start", "n_tokens", last.split()[0]])
                        first = until
                    at += len(docs)

    return shards.repartition(n).mapInArrow(get, f"doc_id {id_kind}, start long, n_tokens long, {last}")
