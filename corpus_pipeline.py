"""A corpus pipeline: each stage takes what the stage before it kept, and its decisions take effect.

toxicity drops what the classifier chain rejects; near_dedup keeps one document of each group of a similarity of 0.8 or more on five-word
shingles; decontaminate drops documents that hold benchmark windows; pii replaces personal data by pseudonyms; tokenize encodes what is
left and checks the round trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm import decontaminate, pii, sentencepiece_bpe, similar, toxicity
from studylake.llm._common import forget, shared_dir, spare
from studylake.llm.queries import pii_key, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, trained on the labels of docs; documents that the chain rejects go.

    Null, empty and wordless texts, and all documents where no label is positive or the labels are empty, stay. Repeated rows are judged
    alike. Other columns pass through, whatever their names; an empty table stays empty.
    """
    mark = spare(docs, 1)[0]
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain, prefix=mark).where(~F.col(f"{mark}rejected")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2's covering tables over fingerprints of five-word shingles, MinHash tables for pairs that lie further apart than masks
    reach, and exact comparison: one document of each group of a similarity of 0.8 or more stays, that with the smallest id.

    Null, empty and wordless texts are copies of each other; of rows without an id and of repeated rows of a group one stays. Other
    columns pass through, whatever their names; an empty table stays empty.
    """
    return similar.keep_one(docs, shingle=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; documents with any word in a window of ten words of a benchmark item go.

    Null, empty and wordless texts stay, as does everything where the benchmark is empty. Repeated rows are judged alike. Other columns
    pass through, whatever their names; an empty table stays empty.
    """
    mark = spare(docs, 1)[0]
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), prefix=mark).where(~F.col(f"{mark}contaminated")).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1; every row stays, with pseudonyms in its text and n_chars (where there is such a column) of the new text.

    Null and empty texts stay as they are, equal values get equal pseudonyms in all rows. Other columns pass through, whatever their
    names; an empty table stays empty.
    """
    out = pii.pseudonymise(docs, pii_key(), count_col=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: doc_id, lang, source, ids, n_tokens, round_trip (the ids decode to the text) and agrees (the library gives the same).

    A null or empty text has the end id only; a null text's round trip holds, as it decodes to nothing. Repeated rows are coded alike; an
    empty table stays empty.
    """
    coded = sentencepiece_bpe.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), columns=["doc_id", "lang", "source", "text"])
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.coalesce(F.col("decoded") == F.col("text"), F.length("decoded") == 0).alias("round_trip"), "agrees")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", replace_personal_data),
    ("tokenize", tokenize),
]

#: The classifier, SimHash, Feistel networks and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written to the shared folder, read again by the next, and deleted when that is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if i:
            forget(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs
