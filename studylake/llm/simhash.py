"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit positions are dealt to the non-zero vectors of GF(2)^(r+1); table v keeps the positions whose vector is not orthogonal to v.
Any r positions leave some v orthogonal to all their vectors, so two fingerprints that differ in at most r bits agree on every bit
that table v keeps: no pair within the radius is missed, and every collision is verified exactly.

Defined results: a null or wordless text has fingerprint zero and links like any other; texts of fewer words than a shingle are one
shingle; ties (a bit set in exactly half of the hashes) give 0; repeated rows stay and share their component; a null id keeps its row
and never becomes a component id unless the component has no other; an empty table gives an empty result. Only the id and text
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm._common import LOWER_AZ, cut, forget, id_type, join_hot, map_slices, texts_of

#: Seed of XXH64 over a shingle's UTF-8.
SEED = 42
#: A bucket up to this size is verified pair by pair; a larger one is dealt again by finer masks, which is exact as well.
BUCKET = 256


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of `size` words, repeats included."""
    words = text.translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.array([digest(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """A 64-bit fingerprint: bit j is 1 if over half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a signed long), one row per input row."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([majority_bits(shingle_hashes(t, shingle)) for t in texts_of(part.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))], names=["id", "fp"])

    return map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), 1, work, f"id {id_type(df, id_col)}, fp long")


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """2^(radius+1) - 1 masks over the given bit positions; any `radius` positions are all outside some mask."""
    vectors = (1 << (radius + 1)) - 1
    dealt = [(p, i % vectors + 1) for i, p in enumerate(positions)]
    return [sum(1 << p for p, a in dealt if (a & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_edges(lists: pa.Array, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each bucket, by exact distances."""
    left, right = [], []
    for bucket in lists:
        x = np.unique(np.array(bucket.values.to_numpy(zero_copy_only=False), np.int64)).view(np.uint64)
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        todo = np.ones(len(x), bool)
        for root in range(len(x)):
            if not todo[root]:
                continue
            todo[root] = False
            stack = [root]
            while stack:
                at = stack.pop()
                found = np.flatnonzero(near[at] & todo)
                todo[found] = False
                stack += found.tolist()
                left += [x[at]] * len(found)
                right += x[found].tolist()
    return np.array(left, np.uint64).view(np.int64), np.array(right, np.uint64).view(np.int64)


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join all that are within the radius, directly or through others.

    Buckets over the limit are dealt again by covering masks over the bits that their table left out, until what is left out holds so
    few values that a bucket is within the limit; each level multiplies only the rows of oversized buckets.
    """

    def verified(batches):
        for batch in batches:
            a, b = _bucket_edges(batch.column(0), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def dealt(rows: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
        """masks: number of the table, bits that it keeps."""
        tables = F.array(*[F.struct(F.lit(n).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for n, m in masks])
        return rows.select("fp", F.explode(tables).alias("d")).select("fp", "d.t", "d.k")

    everything = list(range(64))
    level = [(v, m) for v, m in enumerate(covering_masks(radius, everything))]
    rows = dealt(distinct, level)
    edges = None
    written: list[str] = []
    kept = dict(level)
    while True:
        sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
        counted, path = cut(sizes)
        written.append(path)
        small = join_hot(rows, counted.where(F.col("n") <= bucket), "t", "k").groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
        found = small.select("fps").mapInArrow(verified, "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        large = counted.where(F.col("n") > bucket)
        if large.isEmpty():
            return edges
        again = []
        finer: dict[int, int] = {}
        tables = [r.t for r in large.select("t").distinct().collect()]  # at most the number of masks, whatever the input
        for t in tables:
            free = [p for p in everything if not kept[t] >> p & 1]
            for v, m in enumerate(covering_masks(radius, free)):
                number = (t + 1) << (radius + 1) | v
                finer[number] = kept[t] | m
                again.append((t, number, kept[t] | m))
        large_rows = join_hot(rows, large.select("t", "k"), "t", "k").select("fp", "t")
        parts = [dealt(large_rows.where(F.col("t") == t).select("fp"), [(n, m) for u, n, m in again if u == t]) for t in tables]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        kept = finer


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component of the edges (a, b), by alternating large-star and small-star.

    Each round moves every neighbour to the smallest one by grouped minima, which are partly aggregated before the shuffle, and joins them
    back with a hub's rows dealt to several tasks. Rounds go on until nothing moves, a logarithm of the longest path in practice; each is
    written to the shared folder, and the last is kept.
    """
    spark = edges.sparkSession

    def canonical(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def told(e: DataFrame):
        """Rows are distinct, so their number and two sums of hashes tell one round from the next."""
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(20,0)"))).first()

    now, path = cut(canonical(edges))
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = told(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = join_hot(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, large_path = cut(large)
        joined = join_hot(large, large.groupBy("a").agg(F.min("b").alias("m")), "a")
        step = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        new, new_path = cut(canonical(step))
        after = told(new)
        same, state = after == state, after
        forget(spark, path)
        forget(spark, large_path)
        now, path = new, new_path
        if same:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """id_col, fp, component_id (the smallest id reachable by links of at most `radius` bits), one row per input row."""
    fps, _ = cut(fingerprints(df, id_col, text_col, shingle))
    nodes, _ = cut(fps.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = components(links(nodes.select("fp"), radius))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    labelled, _ = cut(labelled)
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp, _ = cut(join_hot(labelled, least, "root").select("fp", "component_id"))
    return join_hot(fps, by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
