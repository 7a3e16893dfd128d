"""File sources and sinks: CSV, JSON lines, pages of text, binary inventories, snapshots with manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BOM = "﻿"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode a temporary one where spark.checkpoint.dir is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch at most: whole texts are held several times on their way to a Python worker and back.
BATCH_ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches cut to BATCH_ROWS rows unless they are smaller already; for steps that send whole texts to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed, quotes doubled, white space kept, nothing for a null and two quotes for an empty text, header in each part."""
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_spreadsheet_csv(df: DataFrame, path: str) -> None:
    """For spreadsheets: a byte order mark before each part's header, lines that end in CR LF, every field quoted but nulls.

    The line end's CR is part of the last field's line, so each part is written as text: its header line first, then its rows.
    """
    quote = lambda x: F.coalesce(F.concat(F.lit('"'), F.replace(x.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    head = BOM + ",".join(f'"{c}"' for c in df.columns) + "\r\n"
    line = F.concat_ws(",", *[quote(F.col(c)) for c in df.columns])
    part = df.select(line.alias("line"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    first = part.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("i")))
    first.select(F.concat(F.when(F.col("n") == 1, head).otherwise(""), "line", F.lit("\r")).alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted fields may hold line ends; a byte order mark goes from the first column of each row that has it.

    A field without anything is null, two quotes are an empty text: the parser's mark of a null is new each time, so no text can be it. By default the
    parser also takes NULs beside quotes for escapes.
    """
    df = spark.read.schema(schema).csv(path, header=True, escape='"', charToEscapeQuoteEscaping='"', nullValue=uuid.uuid4().hex, multiLine=True, enforceSchema=True)
    first = df.columns[0]
    return df.withColumn(first, F.regexp_replace(first, f"^{BOM}", "")) if dict(df.dtypes)[first] == "string" else df


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_nested(spark: SparkSession, path: str, schema: str, array: str) -> DataFrame:
    """JSON files that hold one array of nested records each: one row per record."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(array).alias("r")).select("r.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page, text of files page-NNN.md."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"page-(\d+)\.md$", 1)
    return spark.read.text(path, wholetext=True).select(number.cast("int").alias("page"), F.col("value").alias("text")).where(F.col("page").isNotNull())


def write_pages(pages: DataFrame, path: str) -> None:
    """page, text as files page-NNN.md: a folder of files, one a page, for tools that read such folders. Each task writes its own pages."""
    target = path

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for page, text in zip(batch["page"], batch["text"], strict=True):
                with store.open_output_stream(f"{root}/page-{page:03d}.md") as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    pages.mapInPandas(write, "n long").agg(F.sum("n")).collect()


def write_guarded(df: DataFrame, target: str, confirm: str) -> None:
    """Write only where the target is the one that was meant."""
    if target != confirm:
        raise ValueError(f"not written: {target} is not the confirmed {confirm}")
    df.write.parquet(target)


def publish(tables: dict[str, DataFrame], path: str) -> int:
    """Write tables beside those that are there, then a version that points to them; the tables of earlier versions that are not written now stay.

    Readers take the latest whole version, so they see all tables or none. Versions are numbered: a writer takes the next number by creating its file,
    which only one of several writers can, so clocks do not matter.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{path}/data/{folder}/{name}")
    claims = _hadoop_path(spark, f"{path}/versions")
    store = claims.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(claims)
    number = max(_versions(spark, path), default=0) + 1
    while not store.createNewFile(_hadoop_path(spark, f"{path}/versions/{number:012d}.claim")):
        number += 1
    held = _pointers(spark, path, before=number)
    rows = sorted((held | {name: folder for name in tables}).items())
    spark.createDataFrame(rows, "name string, folder string").coalesce(1).write.parquet(f"{path}/versions/{number:012d}")
    return number


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole."""
    root = _hadoop_path(spark, f"{path}/versions")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [f.getPath().getName() for f in store.listStatus(root)]
    return sorted(int(n) for n in names if n.isdigit() and store.exists(_hadoop_path(spark, f"{path}/versions/{n}/_SUCCESS")))


def _pointers(spark: SparkSession, path: str, before: int | None = None) -> dict[str, str]:
    """Folders by table of the latest version, or of the latest before a number."""
    known = [n for n in _versions(spark, path) if before is None or n < before]
    return {r["name"]: r["folder"] for r in spark.read.parquet(f"{path}/versions/{known[-1]:012d}").collect()} if known else {}  # the tables of one version


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the latest version."""
    return {name: spark.read.parquet(f"{path}/data/{folder}/{name}") for name, folder in _pointers(spark, path).items()}


def backup_then_update(spark: SparkSession, path: str, name: str, updates: DataFrame, keys: list[str], backup: str) -> int:
    """Update rows of a published table after a backup of what they were: the new table and the backup appear together. An existing backup is an error."""
    tables = published(spark, path)
    if backup in tables:
        raise ValueError(f"the backup {backup} is there already")
    old = tables[name]
    before = old.join(updates.select(*keys), keys, "left_semi")
    after = old.join(updates.select(*keys), keys, "left_anti").unionByName(updates.join(before.select(*keys), keys, "left_semi").select(*old.columns))
    return publish({name: after, backup: before}, path)


def undone(table: DataFrame, backup: DataFrame, keys: list[str]) -> DataFrame:
    """A table with the rows of a backup as they were."""
    return table.join(backup.select(*keys), keys, "left_anti").unionByName(backup.select(*table.columns))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 and how many files have the same bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return files.join(files.groupBy("sha256").agg(F.count("*").alias("copies")), "sha256").select("path", "size", "sha256", "copies")


def manifest(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("sha256"))


def compare_manifests(saved: DataFrame, now: DataFrame) -> DataFrame:
    """key, state: same, changed, missing or new."""
    both = saved.withColumnRenamed("sha256", "old").join(now.withColumnRenamed("sha256", "new"), "key", "full")
    state = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return both.select("key", state.alias("state"))


def changed_objects(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered rows (key, sha256) whose content is not stored under their key yet."""
    return offered.join(stored, ["key", "sha256"], "left_anti")
