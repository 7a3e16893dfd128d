"""Words of a corpus in one pass over its texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from studylake.sources.files import shared_path

#: Words that a task holds before it gives them.
HELD = 200_000


def counts_and_single_words(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, columns, n, a, l: words, Arabic and Latin letters of each text; w, id: the words that the corpus has once, with their text's id).

    Each text is read once, in Arrow batches. A task adds up the words of its texts, so a word leaves it once for each time its table fills; one that
    stands twice leaves without a text. Both tables come from one that is written to the shared folder. Words are runs of letters, in lower case.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    carried = docs.select(*columns).schema.fields
    fields = StructType([StructField("w", StringType()), StructField(id_col, kind), *carried, *[StructField(x, LongType()) for x in ("n", "a", "l")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        word, arabic, latin = regex.compile(r"\p{L}+"), regex.compile("[\\u0600-\\u06FF]+"), regex.compile("[A-Za-zÀ-ÿ]+")
        letters = lambda rule, x: sum(map(len, rule.findall(x)))
        held: dict[str, object] = {}
        many: set[str] = set()

        def give(schema: pa.Schema) -> pa.RecordBatch:
            named = [(w, i, 1) for w, i in held.items() if w not in many] + [(w, None, 2) for w in many]
            held.clear()
            many.clear()
            size = len(named)
            columns = [pa.array([x[0] for x in named], pa.string()), pa.array([x[1] for x in named], schema.field(0).type)]
            columns += [pa.nulls(size, schema.field(k).type) for k in range(2, len(schema))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x[2] for x in named], pa.int64()), *[pa.nulls(size, pa.int64())] * 2], names=fields.names)

        schema = None
        for batch in batches:
            schema = batch.schema
            counts = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = word.findall((x or "").lower())
                for w in found:
                    if w in held:
                        many.add(w)
                    else:
                        held[w] = i
                counts.append((len(found), letters(arabic, x or ""), letters(latin, x or "")))
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.string()), batch.column(0), *batch.columns[2:], *[pa.array([r[k] for r in counts], pa.int64()) for k in range(3)]], names=fields.names)
            if len(held) > HELD:
                yield give(schema)
        if schema is not None and held:
            yield give(schema)

    path = shared_path(spark, "words")
    docs.select(id_col, text_col, *columns).mapInArrow(run, fields).write.parquet(path)
    told = spark.read.schema(fields).parquet(path)
    once = told.where("w IS NOT NULL").groupBy("w").agg(F.sum("n").alias("n"), F.min(id_col).alias(id_col)).where("n = 1").select("w", id_col)
    return told.where("w IS NULL").drop("w"), once
