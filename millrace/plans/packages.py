"""Queries on parsed packages: chunks of elements, dataset hashes, the gate before review."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import packages as P
from millrace.sources import archives as A
from millrace.sources.derive import SCOPED_SQL, scoped_documents
from millrace.sources.parsers import parse_documents
from millrace.sources.tables import table


def element_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents' Markdown elements, 50 characters of overlap."""
    found = parse_documents(table(spark, sf_dir, "documents"), "markdown", "doc_id", "text")
    return P.element_chunks(found.withColumn("version_id", F.lit("v-1")), 700, 50)


def _packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fifty ids are a package; documents in it by their ids."""
    docs = scoped_documents(spark, sf_dir).withColumn("package_id", F.floor(F.col("doc_id") / 50)).withColumn("position", F.col("doc_id") % 50)
    docs = docs.withColumn("document_id", F.concat(F.lit("d"), F.col("doc_id"))).withColumn("source_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    packages = docs.select("package_id").distinct().withColumn("manifest_sha256", F.sha2(F.concat(F.lit("m"), F.col("package_id")), 256))
    return packages, docs


def package_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset hash of each package; lines are chunks."""
    packages, docs = _packages(spark, sf_dir)
    docs = docs.select("package_id", "position", "document_id", "source_hash", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("chunks"))
    return P.dataset_hashes(packages, docs)


def package_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with faults put in by id, and how many issues the gate finds of each rule."""
    packages, docs = _packages(spark, sf_dir)
    fault, text = F.col("doc_id") % 23, F.coalesce("text", F.lit(""))
    docs = docs.withColumn("fault", fault).withColumn("path", F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".md"))).withColumn("text", text)
    docs = docs.withColumn("effective_from", F.col("effective_from").cast("string")).withColumn("effective_to", F.col("effective_to").cast("string"))
    files = docs.select("package_id", "path", "document_id", "source_hash", F.when(fault == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    documents = docs.where("fault <> 11").select(
        "package_id", "position", "document_id", "path", F.when(fault == 2, F.sha2("path", 256)).otherwise(F.col("source_hash")).alias("source_hash"), F.col("path").alias("title"),
        F.when(fault == 3, "pdf").otherwise("markdown").alias("format"), "tenant_id", "shop_id", "disclosure_class", (fault == 4).alias("external_allowed"),
        "effective_from", F.when(fault == 13, F.col("effective_from")).otherwise(F.col("effective_to")).alias("effective_to"),
    )
    meta = F.create_map(
        F.lit("tenant_id"), F.col("tenant_id"), F.lit("shop_id"), F.when(fault == 10, "elsewhere").otherwise(F.col("shop_id")), F.lit("source_hash"), F.col("source_hash"),
        F.lit("disclosure_class"), F.col("disclosure_class"), F.lit("effective_from"), F.col("effective_from"),
        F.lit("effective_to"), F.when(fault == 13, F.col("effective_from")).otherwise(F.col("effective_to")),
    )
    content = F.when((fault == 12) & (F.col("n") == 1), "  ").otherwise(F.concat(F.lit("x"), F.col("text")))
    chunks = docs.where("fault not in (5, 11)").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    chunks = chunks.select(
        "package_id", "document_id", F.col("n").alias("chunk_index"), (F.col("n") + F.when(fault == 6, 2).otherwise(1)).alias("section_seq"), F.lit(0).alias("section_chunk_index"),
        F.lit(0).alias("char_start"), (F.length(content) + (fault == 7).cast("int")).alias("char_end"), content.alias("content"),
        F.when(fault == 8, "none").when(fault == 14, F.sha2("text", 256)).otherwise(F.sha2(F.concat("n", "text"), 256)).alias("chunk_hash"),
        F.when(fault == 9, 0).otherwise(5).alias("token_count"), F.lit("text").alias("content_type"), F.lit("text_boundary").alias("split_reason"), meta.alias("metadata"),
    )
    counted = documents.join(chunks.groupBy("package_id", "document_id").agg(F.count(F.lit(1)).alias("chunks")), ["package_id", "document_id"], "left").na.fill(0, ["chunks"])
    stated = packages.join(P.dataset_hashes(packages, counted), "package_id").withColumn("pipeline_version", F.lit("p1"))
    stated = stated.withColumn("dataset_sha256", F.when(F.col("package_id") % 4 == 1, F.reverse("dataset_sha256")).otherwise(F.col("dataset_sha256")))
    stated = stated.withColumn("parsed_manifest_sha256", F.when(F.col("package_id") % 3 != 2, F.col("manifest_sha256")))
    issues = P.package_issues(stated, files, documents, chunks)
    return issues.groupBy("rule").agg(F.count(F.lit(1)).alias("issues"), F.min("subject").alias("first"))


def package_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of documents parsed whole or not at all; some have a changed, a missing or an empty file,
    one of a format that isn't known, or one whose bytes are no text."""
    packages, docs = _packages(spark, sf_dir)
    fault = F.col("doc_id") % 211
    docs = docs.withColumn("path", F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".md"))).withColumn("content", F.when(fault == 5, F.lit("  \n")).otherwise(F.coalesce("text", F.lit(""))).cast("binary"))
    docs = docs.withColumn("content", F.when(fault == 9, F.concat("content", F.unhex(F.lit("FF")))).otherwise(F.col("content"))).withColumn("source_hash", F.sha2("content", 256))
    files = docs.where(fault != 3).select("package_id", "path", F.when(fault == 1, F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content")).alias("content"))
    documents = docs.select("package_id", "position", "document_id", "path", F.when(fault == 7, "pdf").otherwise("markdown").alias("format"), "source_hash")
    return P.package_parse(packages, files, documents)[0]


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of a document's text, its lines as a table and a page, some of them broken: members and
    what is refused."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sink, fault = io.BytesIO(), doc_id % 29
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as out, warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    out.writestr("../up.md" if fault == 1 else "text/whole.md", text)
                    out.writestr("text/whole.md" if fault == 2 else "rows.csv", "a,b\n1,2\n")
                    out.writestr("text" if fault == 3 else "page.html", "<p>page</p>")
                    if fault == 4:
                        link = zipfile.ZipInfo("link")
                        link.external_attr = 0o120777 << 16
                        out.writestr(link, "rows.csv")
                data = sink.getvalue()
                made.append(data[: len(data) // 2] if fault == 5 else data)
            yield pa.record_batch([pa.array([f"a/{i}.zip" for i in batch.column(0).to_pylist()]), pa.array(made, pa.binary())], ["path", "content"])

    out = A.archive_members(docs.mapInArrow(pack, "path string, content binary"), most_bytes=60_000)
    return out.select("archive", "member", "size", "sha256", "issue")


QUERIES = {f.__name__: f for f in (element_chunks, package_hashes, package_gate, package_parse, archive_members)}

ORACLE = {
    "package_hashes": """
SELECT doc_id // 50 AS package_id,
       sha256('{"documents":[' || string_agg('{"chunks":' || len(string_split(coalesce(text, ''), chr(10))) || ',"document_id":"d' || doc_id || '","source_hash":"' || sha256(coalesce(text, '')) || '"}', ',' ORDER BY doc_id)
              || '],"manifest_sha256":"' || sha256('m' || (doc_id // 50)) || '"}') AS dataset_sha256
FROM documents GROUP BY 1""",
    "package_gate": f"""
WITH {SCOPED_SQL},
f(rule, fault, n) AS (VALUES
  ('parse_source_hash_mismatch', 1, 0), ('parse_document_binding_invalid', 2, 0), ('parse_document_metadata_invalid', 3, 0), ('parse_document_metadata_invalid', 4, 0),
  ('parse_empty_chunks', 5, 0), ('parse_chunk_position_invalid', 6, 1), ('parse_chunk_source_invalid', 7, 2), ('parse_chunk_hash_invalid', 8, 2),
  ('parse_chunk_metadata_invalid', 9, 2), ('parse_chunk_metadata_binding_invalid', 10, 2), ('parse_empty_chunk', 12, -1), ('parse_document_metadata_invalid', 13, 0),
  ('parse_duplicate_chunk', 14, -2)),
i AS (
  SELECT rule, (doc_id // 50) || '/d' || doc_id || CASE WHEN n = 0 THEN '' WHEN n = -1 THEN '/1' WHEN n = -2 THEN '/' || sha256(coalesce(text, '')) ELSE '/' || k END AS subject
  FROM scoped JOIN f ON fault = doc_id % 23 CROSS JOIN unnest(range(0, greatest(n, 1))) AS r(k)
  UNION ALL SELECT 'parse_document_count_mismatch', (doc_id // 50)::VARCHAR FROM documents WHERE doc_id % 23 = 11 GROUP BY doc_id // 50
  UNION ALL SELECT DISTINCT 'parse_dataset_hash_mismatch', (doc_id // 50)::VARCHAR FROM documents WHERE doc_id // 50 % 4 = 1
  UNION ALL SELECT DISTINCT 'parse_manifest_binding_invalid', (doc_id // 50)::VARCHAR FROM documents WHERE doc_id // 50 % 3 = 2)
SELECT rule, count(*) AS issues, min(subject) AS first FROM i GROUP BY 1""",
    "archive_members": """
WITH d AS (
  SELECT 'a/' || doc_id || '.zip' AS archive, doc_id % 29 AS f, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
i AS (
  SELECT *, CASE f WHEN 1 THEN 'unsafe_path' WHEN 2 THEN 'duplicate_path' WHEN 5 THEN 'invalid_archive'
                   ELSE CASE WHEN n > 60000 - 19 THEN 'too_large' WHEN f = 3 THEN 'conflicting_paths' WHEN f = 4 THEN 'special_file' END END AS issue
  FROM d)
SELECT archive, NULL AS member, NULL::BIGINT AS size, NULL AS sha256, issue FROM i WHERE issue IS NOT NULL
UNION ALL SELECT archive, 'text/whole.md', n, sha256(t), NULL FROM i WHERE issue IS NULL
UNION ALL SELECT archive, 'rows.csv', 8, sha256('a,b' || chr(10) || '1,2' || chr(10)), NULL FROM i WHERE issue IS NULL
UNION ALL SELECT archive, 'page.html', 11, sha256('<p>page</p>'), NULL FROM i WHERE issue IS NULL""",
}
