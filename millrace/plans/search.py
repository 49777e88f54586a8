"""Queries on stored indexes: vectors in lists around centroids, posting lists by shop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import postings as P
from millrace.operators import vector_index as V
from millrace.plans.retrieval import ORACLE as RETRIEVAL
from millrace.plans.retrieval import _VECTORS
from millrace.sources.store import shared_path
from millrace.sources.tables import table


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every twentieth one, from as many lists as reach a recall of 0.95 on
    64 of these queries."""
    items = table(spark, sf_dir, "embeddings")
    index = V.build_index(items, shared_path(spark, "ivf"))
    queries = items.where("vec_id % 20 = 0")
    out = V.search_index(index, queries, 5, V.probes_for(index, queries, 5, 0.95))
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def ivf_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all lists probed: the exact answer."""
    items = table(spark, sf_dir, "embeddings")
    index = V.build_index(items, shared_path(spark, "ivf"))
    return V.search_index(index, items.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def ivf_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of a query's own label whose window holds the query's date."""
    start = F.expr("date_add(date'2024-01-01', cast(vec_id % 60 as int))")
    items = table(spark, sf_dir, "embeddings").withColumn("since", F.when(F.col("vec_id") % 7 != 0, start)).withColumn("until", F.when(F.col("vec_id") % 5 != 0, F.date_add(start, 30)))
    index = V.build_index(items, shared_path(spark, "ivf"), scope=("label", "since", "until"))
    queries = items.where("vec_id % 20 = 0").withColumn("day", F.expr("date_add(date'2024-01-01', cast(vec_id % 90 as int))"))
    out = V.search_index(index, queries, 5, valid=("since", "until"), on="day")
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """An index of an older state of the documents, brought up to date: in it the first shop's texts
    differ, the second one is missing, and one is there that is gone now."""
    docs, path = table(spark, sf_dir, "documents"), shared_path(spark, "postings")
    shops = [r[0] for r in docs.select("source").distinct().orderBy("source").limit(2).collect()]
    old = docs.where(F.col("source") != shops[-1]).withColumn("text", F.when(F.col("source") == shops[0], F.concat("text", F.lit(" of old"))).otherwise(F.col("text")))
    old = old.unionByName(docs.where("doc_id % 10 = 0").withColumn("source", F.lit("gone")))
    P.refresh_postings(old, path, "source", "doc_id")
    return path, P.refresh_postings(docs, path, "source", "doc_id")


def postings_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[1]


def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lexical_topk`` from posting lists."""
    path, _ = _refreshed(spark, sf_dir)
    out = P.postings_topk(table(spark, sf_dir, "benchmark"), path, "item_id", 5)
    return out.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "overlap", F.round("score", 6).alias("score"))


def embedding_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to a request for all even ids, with sparse weights, some of them wrong: every issue."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    asked = rows.where("vec_id % 2 = 0").select("vec_id")
    i, f = F.col("vec_id"), F.col("vec_id") % 31
    dense = F.when(f == 1, F.slice("embedding", 1, 3)).when(f == 2, F.transform("embedding", lambda x, k: F.when(k == 1, F.lit("NaN").cast("float")).otherwise(x))).when(f == 3, F.lit(None)).otherwise(F.col("embedding"))
    weight = lambda token, w: F.struct(token.cast("long").alias("token_id"), w.cast("double").alias("weight"))
    usual = F.array(weight(i, F.lit(0.5)), weight(i + 1, F.lit(0.25)))
    sparse = F.when(f == 4, F.array(weight(-i - 1, F.lit(0.5)))).when(f == 5, F.array(weight(i, F.lit(0.5)), weight(i, F.lit(0.1)))).when(f == 6, F.array(weight(i, F.lit("inf")))).when(f == 7, F.slice(usual, 1, 0)).otherwise(usual)
    got = rows.where((i % 2 == 0) & (f != 8) | (i % 50 == 7)).select("vec_id", dense.alias("dense"), sparse.alias("sparse"))
    return V.embedding_issues(asked, got.unionByName(got.where(f == 9)), "vec_id", dims)


QUERIES = {f.__name__: f for f in (embedding_contract, ivf_topk, ivf_exact_topk, ivf_scoped_topk, postings_refresh, postings_topk)}

ORACLE = {
    "embedding_contract": """
WITH g AS (
  SELECT vec_id, vec_id % 31 AS f, CASE vec_id % 31 WHEN 1 THEN embedding[1:3] WHEN 2 THEN list_transform(embedding, lambda x, k: CASE WHEN k = 2 THEN 'NaN'::FLOAT ELSE x END) WHEN 3 THEN NULL ELSE embedding END AS dense,
         CASE vec_id % 31 WHEN 4 THEN [-vec_id - 1] WHEN 5 THEN [vec_id, vec_id] WHEN 6 THEN [vec_id] WHEN 7 THEN [] ELSE [vec_id, vec_id + 1] END AS tokens,
         CASE vec_id % 31 WHEN 6 THEN ['inf'::DOUBLE] ELSE [0.5] END AS weights
  FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 31 <> 8 OR vec_id % 50 = 7),
r AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE f = 9),
d AS (SELECT max(len(embedding)) AS dims FROM embeddings),
x AS (
  SELECT vec_id, 'missing_row' AS issue FROM embeddings WHERE vec_id % 2 = 0 AND vec_id NOT IN (SELECT vec_id FROM r)
  UNION ALL SELECT DISTINCT vec_id, 'unexpected_row' FROM r WHERE vec_id % 2 <> 0
  UNION ALL SELECT vec_id, 'repeated_row' FROM r GROUP BY vec_id HAVING count(*) > 1
  UNION ALL SELECT DISTINCT vec_id, unnest([
    CASE WHEN len(dense) IS DISTINCT FROM dims THEN 'dense_dimensions' END, CASE WHEN len(list_filter(dense, lambda x: NOT isfinite(x))) > 0 THEN 'dense_not_finite' END,
    CASE WHEN len(tokens) = 0 THEN 'sparse_missing' END, CASE WHEN list_min(tokens) < 0 THEN 'sparse_token_invalid' END,
    CASE WHEN len(list_distinct(tokens)) < len(tokens) THEN 'sparse_token_repeated' END, CASE WHEN len(list_filter(weights, lambda x: NOT isfinite(x))) > 0 THEN 'sparse_weight_invalid' END]) FROM r, d)
SELECT vec_id, issue FROM x WHERE issue IS NOT NULL""",
    "ivf_exact_topk": RETRIEVAL["vector_topk_cosine"],
    "ivf_scoped_topk": f"""
WITH {_VECTORS.split("r AS (")[0]}
w AS (SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN date '2024-01-01' + CAST(vec_id % 60 AS INTEGER) END AS since,
             CASE WHEN vec_id % 5 <> 0 THEN date '2024-01-01' + CAST(vec_id % 60 + 30 AS INTEGER) END AS until FROM embeddings),
r AS (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank
      FROM s JOIN w USING (vec_id)
      WHERE same AND coalesce(since <= date '2024-01-01' + CAST(query_id % 90 AS INTEGER), true) AND coalesce(until > date '2024-01-01' + CAST(query_id % 90 AS INTEGER), true))
SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5""",
    "postings_refresh": """
WITH s AS (SELECT source, row_number() OVER (ORDER BY source) AS i FROM (SELECT DISTINCT source FROM documents))
SELECT source AS shop, CASE i WHEN 1 THEN 'rewritten' WHEN 2 THEN 'added' ELSE 'kept' END AS action FROM s
UNION ALL SELECT 'gone', 'dropped'""",
    "postings_topk": RETRIEVAL["lexical_topk"],
}
