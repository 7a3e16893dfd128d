"""Near-duplicate groups of word-shingle sets at a similarity: SimHash tables, MinHash tables for what they cannot reach, exact comparison.

Each text has entries in two families of tables. The covering tables of simhash.py over its whole-text fingerprint bring together, with
certainty, every pair within RADIUS bits. At a Jaccard similarity of 0.8 fingerprints differ in 4 to 15 bits, which would take up to 2^16
covering tables; so BANDS tables of ROWS minimum hashes each reach the pairs that lie further apart: one of a similarity s is in none of
them with a probability of (1 - s^ROWS)^BANDS, 4 in 10 million at 0.8 and less above it, whatever the lengths and numbers of texts.

Tables only suggest: links are pairs whose whole shingle sets were compared. Each entry has a head, the text that shares most entries,
since the original of edited copies shares more than they do; a text is first compared with the first of the heads of its entries. What
an entry then still holds of different groups has to be compared among itself: texts that such entries connect form a cluster, and a cluster is compared block
by block, with one matrix product a pair of blocks and only the links that join groups as output, so pairs are never rows. A cluster of
over CLUSTER texts is first dealt again by tables of more hashes (FINE_BANDS of FINE_ROWS: one of 0.8 is missed with a probability
below one in a million), which part texts that are only half alike. Copies of one text count once; texts are told apart by two hashes of 64 bits.

Defined results: null, empty and wordless texts are copies of each other; fewer words than a shingle are one shingle; of each group the
row with the smallest id stays (null ids last), of repeated rows one; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm._common import bounded, cut, forget, join_hot, map_slices, spare, texts_of
from studylake.llm.simhash import components, covering_masks, majority_bits, shingle_hashes

#: Bits of fingerprints that the covering tables reach; tables of minimum hashes, and hashes of each.
RADIUS, BANDS, ROWS = 2, 28, 4
#: Tables of more hashes, for clusters of over CLUSTER texts; texts of a block, and columns of a product.
FINE_BANDS, FINE_ROWS, CLUSTER = 200, 12, 8192
BLOCK, COLUMNS = 256, 8192
#: Text bytes that are described at once; hashes that are permuted at once.
HELD_BYTES, HELD_HASHES = 2 << 20, 1024
_MASKS = np.array(covering_masks(RADIUS, list(range(64))), np.uint64)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64 bits."""
    x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def minimum_hashes(distinct: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n least values of the hashes, each under a permutation of its own."""
    number = np.arange(n, dtype=np.uint64)
    add, factor = _mixed(number, seed)[:, None], (_mixed(number, seed + 1) | np.uint64(1))[:, None]
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), HELD_HASHES):
        least = np.minimum(least, ((distinct[None, at : at + HELD_HASHES] ^ add) * factor).min(axis=1))
    return least


def band_entries(distinct: np.ndarray, fine: bool = False) -> np.ndarray:
    """Keys of the MinHash tables' entries of one text's distinct shingles, 64 bits; texts without any share one entry."""
    if not len(distinct):
        return np.zeros(1, np.uint64)
    bands, rows = (FINE_BANDS, FINE_ROWS) if fine else (BANDS, ROWS)
    key = np.arange(bands, dtype=np.uint64)
    for column in minimum_hashes(distinct, bands * rows, 31 if fine else 21).reshape(bands, rows).T:
        key = _mixed(key ^ column, 23)
    return key


def table_entries(hashes: np.ndarray) -> np.ndarray:
    """Keys of all entries of one text, given the hashes of its shingles, repeats included; signed 64 bits."""
    covering = _mixed((np.uint64(majority_bits(hashes)) & _MASKS) ^ _mixed(np.arange(len(_MASKS), dtype=np.uint64), 24), 25)
    return np.unique(np.r_[band_entries(np.unique(hashes)), covering]).view(np.int64)


def similar_enough(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Of two sets of distinct hashes."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= threshold * (len(a) + len(b) - common) - 1e-9


def _shared(batches):
    """The distinct rows of keys that have several nodes; rows come sorted by key and node. The last row waits for its key's next node."""
    wait: tuple[int, int] | None = None
    several = False
    for batch in batches:
        keys, nodes = (batch.column(i).to_numpy() for i in range(2))
        if wait is not None:
            keys, nodes = np.r_[wait[0], keys], np.r_[wait[1], nodes]
        fresh = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])][: len(keys)]
        keys, nodes = keys[fresh], nodes[fresh]
        if not len(keys):
            continue
        again = keys[1:] == keys[:-1]
        take = np.r_[several, again] | np.r_[again, False]
        wait, several = (keys[-1], nodes[-1]), bool(np.r_[several, again][-1])
        take[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(keys[take], pa.int64()), pa.array(nodes[take], pa.int64())], names=["key", "node"])
    if wait is not None and several:
        yield pa.RecordBatch.from_arrays([pa.array([wait[0]], pa.int64()), pa.array([wait[1]], pa.int64())], names=["key", "node"])


def _several(rows: DataFrame) -> DataFrame:
    """The distinct rows (key, node) of the keys that have several nodes, in one pass over sorted partitions."""
    return bounded(rows).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long")


def _common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: products of their membership matrices, COLUMNS distinct hashes at a time."""
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    total = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(values), COLUMNS):
        mine = slice(*np.searchsorted(at, (low, low + COLUMNS)))
        member = np.zeros((len(a) + len(b), min(COLUMNS, len(values) - low)), np.float32)
        member[row[mine], at[mine] - low] = 1
        total += member[: len(a)] @ member[len(a) :].T
    return total


def _block_links(threshold: float):
    """Of one pair of blocks (columns node, root, own, hashes): links between groups, as few as join what is similar."""

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        own = rows.column("own").to_numpy()
        sides = [np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())]
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in rows.column("hashes")]
        size = np.array([len(x) for x in sets])
        nodes, (_, group) = rows.column("node").to_numpy(), np.unique(rows.column("root").to_numpy(), return_inverse=True)
        common = _common_counts(*([sets[i] for i in side] for side in sides))
        n, m = size[sides[0]][:, None], size[sides[1]][None, :]
        alike = (common >= threshold * (n + m - common) - 1e-6) & (group[sides[0]][:, None] != group[sides[1]][None, :])
        left, right = [], []
        for i, j in np.argwhere(alike):
            i, j = sides[0][i], sides[1][j]
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                left.append(nodes[i])
                right.append(nodes[j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return work


def similar_groups(texts: DataFrame, shingle: int = 5, threshold: float = 0.8, cluster: int = CLUSTER) -> DataFrame:
    """node, root of the texts (columns node, text) that are linked to others."""
    written: list[str] = []

    def entries(part: pa.RecordBatch) -> pa.RecordBatch:
        own = {n: table_entries(shingle_hashes(t, shingle)) for n, t in dict(zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True)).items()}
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own.values()]), pa.int64()), pa.array(np.repeat(np.array([*own], np.int64), [len(k) for k in own.values()]), pa.int64())], names=["key", "node"])

    def sets(part: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.unique(shingle_hashes(t, shingle)) for t in texts_of(part.column(1))]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in own], pa.int64()), pa.array([h.tobytes() for h in own], pa.binary())], names=["node", "n", "hashes"])

    def verified(part: pa.RecordBatch) -> pa.RecordBatch:
        keep = [similar_enough(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), threshold) for a, b in zip(part.column(2), part.column(3), strict=True)]
        return part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def finer(part: pa.RecordBatch) -> pa.RecordBatch:
        made = [band_entries(np.frombuffer(h.as_buffer(), np.uint64), True).view(np.int64) for h in part.column(1)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(made), pa.int64()), pa.array(np.repeat(part.column(0).to_numpy(), [len(k) for k in made]), pa.int64())], names=["key", "node"])

    def kept(df: DataFrame) -> DataFrame:
        df, path = cut(df)
        written.append(path)
        return df

    shared = kept(_several(map_slices(texts.select("node", "text"), 1, entries, "key long, node long", HELD_BYTES)))
    nodes = kept(shared.select("node").distinct())  # a table, whose size decides how texts are joined to it
    alike = texts.select("node", "text").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    described = kept(map_slices(alike, 1, sets, "node long, n long, hashes binary", HELD_BYTES))

    def head_links(rows: DataFrame) -> DataFrame:
        """Links (a, b) between texts and the first of the heads of their entries (key, node), one pair a text."""
        support = rows.groupBy("node").agg(F.count("*").alias("support"))
        heads = rows.join(support, "node").groupBy("key").agg(F.max(F.struct("support", "node")).alias("head"))
        first = join_hot(rows, heads, "key").where("node <> head.node").groupBy("node").agg(F.max("head")["node"].alias("head"))
        pairs = first.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
        numbers = lambda c: described.select(F.col("node").alias(c), F.col("n").alias(f"of_{c}"))
        fits = F.least("of_a", "of_b") >= threshold * F.greatest("of_a", "of_b") - 1e-9
        pairs = kept(kept(pairs).join(numbers("a"), "a").join(numbers("b"), "b").where(fits).select("a", "b"))
        one, other = described.select(F.col("node").alias("a"), "hashes"), described.select(F.col("node").alias("b"), F.col("hashes").alias("others"))
        both = join_hot(join_hot(pairs, one, "a"), other, "b").select("a", "b", "hashes", "others")
        return kept(map_slices(both, 2, verified, "a long, b long", HELD_BYTES))

    def clusters(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """node, root, cluster, size of the texts that entries of several groups connect."""
        labelled = kept(rows.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
        several = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("first")).where("low <> high").select("key", "first")
        held = kept(join_hot(labelled, several, "key").select("node", "root", "first"))
        names = components(held.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("root", "cluster")
        found = kept(held.select("node", "root").distinct().join(names, "node"))
        sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
        return join_hot(found, sizes.withColumnRenamed("n", "size"), "cluster", counts=sizes)

    def blockwise(found: DataFrame) -> DataFrame:
        """Links between the groups of each cluster; a text goes to as many pairs of blocks as its cluster has blocks."""
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = found.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("cluster", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        whole = dealt.join(described.select("node", "hashes"), "node")
        return kept(whole.groupBy("cluster", "i", "j").applyInArrow(_block_links(threshold), "a long, b long"))

    links = head_links(shared)
    roots = kept(components(links))
    found = kept(clusters(shared, roots))
    large = found.where(F.col("size") > cluster)
    if not large.isEmpty():
        mine = described.join(large.select("node"), "node", "left_semi").select("node", "hashes")
        fine = kept(_several(map_slices(mine, 1, finer, "key long, node long", HELD_BYTES)))
        more = head_links(fine)
        closer = clusters(fine, kept(components(links.unionByName(more))))
        links = links.unionByName(more).unionByName(blockwise(kept(closer)))
    links = links.unionByName(blockwise(found.where(F.col("size") <= cluster)))
    out, _ = cut(components(links))
    for path in written:
        forget(texts.sparkSession, path)
    return out


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """df with one row of each group of similar texts."""
    node, row, own = spare(df, 3)
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    marked = df.withColumn(node, F.xxhash64(text_col)).withColumn(row, F.xxhash64(*hashed))
    twin = F.xxhash64(F.concat(F.lit("~"), text_col))
    # different texts of one hash, hardly ever any, are numbered by both hashes
    clashes, _ = cut(marked.groupBy(node).agg(F.min(twin).alias("low"), F.max(twin).alias("high")).where("low <> high").select(node, F.lit(True).alias(own)))
    if not clashes.isEmpty():
        marked = marked.join(clashes, node, "left").withColumn(node, F.when(F.col(own), F.xxhash64(node, twin)).otherwise(F.col(node))).drop(own)
    roots = similar_groups(marked.select(F.col(node).alias("node"), F.col(text_col).alias("text")), shingle, threshold)
    rows = marked.select(F.col(id_col).alias("id"), F.col(node).alias("node"), F.col(row).alias("row"))
    grouped = rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "id", "row")
    stays = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("r")).select(F.col("r.id").alias(own), F.col("r.row").alias(row))
    stays, _ = cut(stays)
    kept = marked.join(stays, row).where(F.col(id_col).eqNullSafe(F.col(own))).dropDuplicates([row, own])
    return kept.select(*df.columns)
