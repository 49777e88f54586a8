"""Scoped documents, which the driver's tables hold only in parts: tenant, shop, class and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import table


def scoped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with tenant_id (lang), shop_id (source), disclosure_class (from labels) and a
    half-open date window: 30 days from 2024-01-01 + doc_id % 60 days, open for every fifth id."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    start = F.expr("date_add(date'2024-01-01', cast(doc_id % 60 as int))")
    known = F.col("toxic").isNotNull()
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("shop_id"),
        F.when(F.col("toxic") == 1, "internal_only").when(known, "external_allowed").otherwise("unclassified").alias("disclosure_class"),
        start.alias("effective_from"),
        F.when(F.col("doc_id") % 5 != 0, F.date_add(start, 30)).alias("effective_to"),
        "text",
        "n_chars",
    )


#: The same for the SQL twins, as a WITH clause's body.
SCOPED_SQL = """
scoped AS (
  SELECT d.doc_id, d.lang AS tenant_id, d.source AS shop_id,
         CASE WHEN l.toxic = 1 THEN 'internal_only' WHEN l.toxic IS NOT NULL THEN 'external_allowed' ELSE 'unclassified' END AS disclosure_class,
         date '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER) AS effective_from,
         CASE WHEN d.doc_id % 5 <> 0 THEN date '2024-01-01' + CAST(d.doc_id % 60 + 30 AS INTEGER) END AS effective_to,
         d.text, d.n_chars
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""
