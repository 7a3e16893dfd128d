"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
import os
import secrets
import uuid
import warnings
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm import decontaminate, html_extract, license_scan, periodic_runs, pii, sentencepiece_bpe, simhash, substring_dedup, tiff_media, token_counts, token_files, toxicity, whitening
from studylake.llm._common import id_type, map_slices, shared_dir, texts_of

#: The environment variable that holds the key of pseudonyms.
KEY_VARIABLE = "STUDYLAKE_PII_KEY"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _fresh_key() -> str:
    warnings.warn(f"{KEY_VARIABLE} is unset: pseudonyms are linked within this process only", stacklevel=3)
    return secrets.token_hex(32)


def pii_key() -> str:
    """The key of pseudonyms; where none is set, a secret one that this process makes and forgets."""
    return os.environ.get(KEY_VARIABLE) or _fresh_key()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), columns=["doc_id"], digests=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, columns=["doc_id"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=50, digests=True)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    def measure(batches):
        for batch in batches:
            media = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string())], names=["doc_id", "n_bytes", "media", "media_bytes", "media_sha256"])

    def fold(batches):
        """Pages of a file stand together, so a file is done when the next page 0 comes."""
        sha = counts = None
        size = rough = 0
        tail = b""
        row: tuple = ()
        done: list[tuple] = []

        def finish() -> None:
            done.append((*row, size, sha.hexdigest(), zlib.crc32(tail), tiff_media.features(counts, rough)))

        def give() -> pa.RecordBatch:
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])
            done.clear()
            return made

        for batch in batches:
            for doc, n, media_bytes, media_sha, page, samples, width, error in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if samples is None:
                    raise ValueError(f"stored media of document {doc} can't be read: {error}")
                if page == 0:
                    if sha is not None:
                        finish()
                    sha, counts, size, rough, row = hashlib.sha256(), np.zeros(256, np.int64), 0, 0, (doc, n, media_bytes, media_sha)
                sha.update(samples)
                grey = np.frombuffer(samples, np.uint8)
                counts += np.bincount(grey, minlength=256)
                rough += int(np.abs(np.diff(grey.reshape(-1, width).astype(np.int16), axis=1)).sum())
                size += len(samples)
                tail = samples[-64:]
            if done:
                yield give()
        if sha is not None:
            finish()
            yield give()

    stored = tiff_media.store_texts(table(spark, sf_dir, "documents"))
    kind = stored.schema["doc_id"].dataType.simpleString()
    measured = stored.mapInArrow(measure, f"doc_id {kind}, n_bytes long, media binary, media_bytes long, media_sha256 string")
    pages = tiff_media.decode_pages(measured).select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "samples", "width", "error")
    folded = pages.mapInArrow(fold, f"doc_id {kind}, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    return folded.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: the texts of a tenth of the documents, chosen by the CRC-32 of their decimal ids, repeat a stretch of theirs to the end."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
            g, last = divmod(zlib.crc32(str(doc).encode()), 10)
            words = text.split() if last == 0 else []
            if n := len(words):
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
            out.append(text.decode())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_slices(docs.select("doc_id", "text"), 1, work, f"doc_id {id_type(docs, 'doc_id')}, text string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(with_periods(table(spark, sf_dir, "documents")), least=12)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("top.col2"), F.col("top.length"), -F.col("top.col3")
    milli = F.expr("top.length * 1000 div -top.col3")
    return best.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write(docs, tokenizer_path("byte_bpe_50k.json"), 2, folder)
    return token_files.read(spark, folder, id_type(docs, "doc_id"), digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_simhash, op3_sentencepiece, op4_token_counts, op5_decontaminate, op6_toxicity, op7_substring_dedup, op8_license_scan, op9_tiff_media, op10_html_extract, op11_whitening, op12_periodic_runs, op13_token_files)}


_OP5 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
hits AS (SELECT p.doc_id, p.size, p.i, x.item_id FROM places p JOIN windows x USING (size, k)),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_OP7 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
sources AS (SELECT k, min(doc_id) AS source FROM windows GROUP BY k),
late AS (SELECT doc_id, i FROM windows JOIN sources USING (k) WHERE source < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM late),
every_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM every_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": _OP5, "op7_substring_dedup": _OP7}
