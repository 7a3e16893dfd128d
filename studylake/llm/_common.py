"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count, islice
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one slice of an Arrow batch holds at most, unless a single text is longer.
SLICE_BYTES = 2 << 20

#: Rows of an Arrow batch at most: texts can be long, and a batch is held several times on its way to a worker and back.
BATCH_ROWS = 1000

#: join_hot: a key is hot with over a HOT_SHAREth of the rows; it is dealt to SALTS tasks. Under HOT_ROWS rows none is.
HOT_SHARE, SALTS, HOT_ROWS = 1000, 64, 800

#: Maps A-Z to a-z and leaves every other byte of UTF-8 as it is.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where all is one machine, a temporary one if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def spare(df: DataFrame, n: int) -> list[str]:
    """n names that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return list(islice((name for i in count() if (name := f"__{i}") not in taken), n))


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation. Gives its path too."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()  # lets Spark's cleaner delete the shuffle files that the written table no longer needs
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that cut() wrote and nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def join_hot(rows: DataFrame, table: DataFrame, *keys: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined to table by keys that a large share of the rows may have: those of over a HOT_SHAREth of rows, of which there can be no more
    than HOT_SHARE, are dealt to SALTS tasks each, and their rows of table copied to all of these. counts: keys and n, if they are known."""
    total = rows.count()
    if total < HOT_ROWS:
        return rows.join(table, [*keys], how)
    flag, salt = spare(rows.join(table, [*keys]), 2)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot, _ = cut(counts.where(F.col("n") > max(total // HOT_SHARE, HOT_ROWS // 4)).select(*keys, F.lit(True).alias(flag)))
    if hot.isEmpty():
        return rows.join(table, [*keys], how)
    is_hot = F.coalesce(F.col(flag), F.lit(False))
    dealt = rows.join(F.broadcast(hot), [*keys], "left").withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int"))
    copied = table.join(F.broadcast(hot), [*keys], "left").withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop(flag).join(copied.drop(flag), [*keys, salt], how).drop(salt)


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts in column number `text` hold at most `limit` bytes together."""
    start, held = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    for row, size in enumerate(lengths):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null becomes an empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bounded(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches cut to BATCH_ROWS rows unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(df.sparkSession.conf.get(name, "10000"))
    if not 0 < held <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def map_slices(df: DataFrame, text: int, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow by bounded slices; `work` turns one slice into one batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                if (made := work(part)) is not None and made.num_rows:
                    yield made
        pa.default_memory_pool().release_unused()  # the worker lives on with the next task

    return bounded(df).mapInArrow(run, schema)


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()
