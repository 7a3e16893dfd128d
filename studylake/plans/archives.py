"""Queries of workbooks, text documents and PDFs: what Spark writes from the tables is read back."""

from pyspark.sql import functions as F

from studylake.registry import query
from studylake.sources import files, office, pdf
from studylake.sources.tables import table as t

c = F.col


@query("a06_workbooks", "SELECT 'shared' AS strings, CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS VARCHAR) AS ordered FROM orders UNION ALL SELECT 'inline', o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS VARCHAR) FROM orders")
def a06_workbooks(s, d):
    """Orders as workbooks, one file a task, with shared and with inline texts, and back, one task a sheet."""
    office.register(s)
    rows = t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", c("o_orderdate").cast("string").alias("ordered"))
    out = []
    for strings in ("shared", "inline"):
        path = files.shared_path(s, f"book-{strings}")
        rows.write.format("xlsx").option("strings", strings).mode("append").save(path)
        out.append(s.read.format("xlsx").schema(rows.schema).load(path).select(F.lit(strings).alias("strings"), "*"))
    return out[0].unionByName(out[1])


@query("a11_text_documents", "SELECT doc_id, md5(coalesce(text, '')) AS h, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS paragraphs FROM documents")
def a11_text_documents(s, d):
    """Documents as DOCX files, one a document with a paragraph a line, and back."""
    office.register(s)
    path = files.shared_path(s, "docx")
    t(s, d, "documents").select(c("doc_id").cast("string").alias("name"), "text").write.format("docx").mode("append").save(path)
    whole = s.read.format("docx").option("rows", "documents").load(path)
    return whole.select(F.regexp_extract("file", r"^(-?\d*)-", 1).try_cast("long").alias("doc_id"), F.md5(F.array_join("texts", "\n").cast("binary")).alias("h"), F.size("texts").cast("long").alias("paragraphs"))


@query("a09_pdf_pages", "SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(1 + s_suppkey % 40 AS INTEGER) END AS pages, CASE WHEN s_suppkey % 3 = 0 THEN CAST((SELECT count(*) FROM supplier b WHERE b.s_suppkey % 3 = 0 AND b.s_suppkey % 11 <> 0 AND b.s_suppkey % 40 = a.s_suppkey % 40 AND b.s_suppkey % 2 = a.s_suppkey % 2) AS BIGINT) ELSE 1 END AS copies FROM supplier a WHERE s_suppkey % 11 <> 0 UNION ALL SELECT s_suppkey, NULL, 1 FROM supplier WHERE s_suppkey % 11 = 0")
def a09_pdf_pages(s, d):
    """PDFs of the suppliers, in both forms, a third without what tells them apart and a few broken: pages, and files with the same bytes."""
    path = files.shared_path(s, "pdf")

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                data = pdf.made(1 + k % 40, k % 2 == 1, b"" if k % 3 == 0 and k % 11 else b"%d" % k)
                with store.open_output_stream(f"{root}/{k}.pdf") as out:
                    out.write(data if k % 11 else data[: len(data) // 2])
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    t(s, d, "supplier").select("s_suppkey").mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return pdf.inventory(s, path).select(F.regexp_extract("file", r"^\d+", 0).cast("long").alias("s_suppkey"), "pages", "copies")
