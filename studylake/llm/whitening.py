"""Whitening of embeddings by a covariance that is computed in tiles.

The dimensions are cut into blocks; a tile is a pair of blocks. Tasks cut their rows into row-blocks and send each tile the two column blocks
of a row-block, dealt by tile and row-block. Whoever gets them multiplies and keeps a running sum a tile; the sums are added up by entry, and the
driver assembles the matrix, which is as large as the vectors are long, whatever the number of rows, and decomposes it.

Entries are counted in whole steps, x = floor(scale * c) + offset, so that sums are exact. Columns travel as differences from the rounded mean in
the narrowest integers, and are centred to the unrounded mean before they are multiplied.

Defined results: vectors that are null, are empty or hold null or non-finite entries go, and so do vectors of another length than the commonest
(of equally common ones the longest). Repeated rows count each time; a null id is kept. A component without variance has null for its whitened
value and takes no part in the identity error. deviation is null where it would pass 63 bits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm._common import bounded, id_type

#: Dimensions of a block, bytes of a row-block's column block at most, about, and tiles whose sums a task holds.
BLOCK, ROW_BYTES, HELD_TILES = 32, 1 << 20, 512


def usable(embedding: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, entry), F.lit(False))


def clean(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that remain, and the length of their vectors (0 without any)."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    first = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = first["d"] if first else 0
    return rows.where(F.size("embedding") == d), d


def sums(rows: DataFrame, steps: Callable[[pa.Array], np.ndarray], whole: bool) -> tuple[int, np.ndarray]:
    """(n, sum of each dimension) of a column of vectors; `steps` turns an Arrow column into a matrix, of whole numbers or not. A task adds up its own
    rows first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = steps(batch.column(0))
                n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([total.tolist()], pa.list_(pa.int64() if whole else pa.float64()))})

    parts = bounded(rows).mapInArrow(add, f"n long, total array<{'long' if whole else 'double'}>")
    found = parts.select("n", F.posexplode("total").alias("k", "t")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).orderBy("k").collect()  # one row a dimension
    return (found[0]["n"] if found else 0), np.array([r["t"] for r in found])


def covariance(rows: DataFrame, steps: Callable[[pa.Array], np.ndarray], n: int, total: np.ndarray) -> np.ndarray:
    """Covariance, divisor n, of a column of vectors; `steps` and the sums as in sums()."""
    d = len(total)
    whole = total.dtype.kind == "i"
    base = np.array([int(t) // n for t in total]) if whole else total / n
    rest = np.array([int(t) % n / n for t in total]) if whole else np.zeros(d)
    cuts = [slice(at, min(at + BLOCK, d)) for at in range(0, d, BLOCK)]
    per_block = max(1, ROW_BYTES // (8 * BLOCK))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            z = steps(batch.column(0)) - base if batch.num_rows else base[:0]
            for start in range(0, len(z), per_block):
                part = z[start : start + per_block]
                kind = np.min_scalar_type(-max(1, int(np.abs(part).max()))) if whole else part.dtype
                sent = [np.ascontiguousarray(part[:, c], kind).tobytes() for c in cuts]
                tiles = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array([i for i, _ in tiles], pa.int32()), "j": pa.array([j for _, j in tiles], pa.int32()), "row_block": pa.array([number * 1000 + start // per_block] * len(tiles), pa.int64()), "kind": [np.dtype(kind).str] * len(tiles),
                    "one": pa.array([sent[i] for i, _ in tiles], pa.binary()), "two": pa.array([None if i == j else sent[j] for i, j in tiles], pa.binary()),
                })

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def give() -> pa.RecordBatch:
            keys = [*held]
            made = pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in keys], pa.int32()), "j": pa.array([j for _, j in keys], pa.int32()), "tile": pa.array([held[k].ravel() for k in keys], pa.list_(pa.float64()))})
            held.clear()
            return made

        for batch in batches:
            for i, j, kind, one, two in zip(*(batch.column(k).to_pylist() for k in ("i", "j", "kind", "one", "two")), strict=True):
                left, right = (np.frombuffer(b, kind).reshape(-1, cuts[k].stop - cuts[k].start) - rest[cuts[k]] for b, k in ((one, i), (one if two is None else two, j)))
                if len(held) >= HELD_TILES and (i, j) not in held:
                    yield give()
                held[i, j] = held.get((i, j), 0) + left.T @ right
        if held:
            yield give()

    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = bounded(rows).mapInArrow(blocks, "i int, j int, row_block long, kind string, one binary, two binary").withColumn("task", F.spark_partition_id())
    tiles = sent.repartition(tasks, "i", "j", "row_block", "task").drop("task", "row_block").mapInArrow(multiply, "i int, j int, tile array<double>")
    entries = tiles.select("i", "j", F.posexplode("tile").alias("k", "v")).groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    v = np.zeros((d, d))
    for i, j, k, x in entries.collect():  # d * d of them at most, whatever the number of rows
        width = cuts[j].stop - cuts[j].start
        a, b = cuts[i].start + k // width, cuts[j].start + k % width
        v[a, b] = v[b, a] = x / n
    return v


def whiten(df: DataFrame, components: int = 8, scale: float = 1024.0, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component (from 1, by falling eigenvalue e): vec_id, component, n, deviation (sum over dimensions of
    (n * x - S)^2), whitened ((x - S / n) on the component, over sqrt(e)), explained (e over the trace), identity_error (greatest absolute entry of
    the whitened values' covariance minus the identity). S: sums of x over all n remaining vectors."""
    spark, kind = df.sparkSession, id_type(df, id_col)
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = clean(df, id_col, vector_col)
    if not d:
        return spark.createDataFrame([], schema)

    def steps(column: pa.Array) -> np.ndarray:
        values = column.flatten().to_numpy(zero_copy_only=False)
        return (np.floor(values * scale).astype(np.int64) + offset).reshape(len(column), -1)

    vectors = rows.select("embedding")
    n, total = sums(vectors, steps, whole=True)
    v = covariance(vectors, steps, n, total)
    e, axes = np.linalg.eigh(v)
    k = min(components, d)
    e, axes, trace = e[::-1][:k], axes[:, ::-1][:, :k], float(np.trace(v))
    real = e > max(trace, 0) * 1e-13 * d
    pulled = axes / np.sqrt(np.where(real, e, 1))
    mean_whole, mean_rest = np.array([int(t) // n for t in total]), np.array([int(t) % n / n for t in total])

    def project(column: pa.Array) -> np.ndarray:
        return (steps(column) - mean_whole - mean_rest) @ pulled

    there = np.flatnonzero(real)
    error = 0.0
    if len(there):
        kept = lambda column: project(column)[:, there]
        spread = covariance(vectors, kept, *sums(vectors, kept, whole=False))
        error = float(np.abs(spread - np.eye(len(there))).max())
    explained = e / trace if trace > 0 else np.full(k, np.nan)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (m := batch.num_rows):
                continue
            x = steps(batch.column(1))
            far = n * x.astype(object) - total.astype(object) if n * float(np.abs(x).max()) > 2**62 else n * x - total
            apart = (far.astype(np.float64) ** 2).sum(axis=1)
            exact = (far * far).sum(axis=1).tolist() if apart.max() < 2**62 else [int(s) if s < 2**63 else None for s in (far.astype(object) ** 2).sum(axis=1)]
            white = np.where(real, project(batch.column(1)), np.nan)
            each = lambda values, t: pa.array(np.tile(values, m), t, from_pandas=True)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(white.ravel(), pa.float64(), from_pandas=True), each(explained, pa.float64()), pa.array(np.full(m * k, error), pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return bounded(rows).mapInArrow(score, schema)
