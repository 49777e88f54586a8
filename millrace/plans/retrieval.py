"""Queries on lexical and vector retrieval and on ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import metrics as M
from millrace.operators import retrieval as R
from millrace.sources.tables import table


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.lexical_topk(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", 5)
    return found.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "overlap", F.round("score", 6).alias("score"))


def best_chunk_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the ten documents whose best paragraph shares most of its tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("text"))
    out = R.best_overlaps(table(spark, sf_dir, "benchmark"), docs, "item_id", ["doc_id"], 10)
    return out.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("part").alias("chunk_index"), "overlap")


def answer_support_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document holds an item's text word for word, or half of its tokens."""
    items = table(spark, sf_dir, "benchmark")
    found = R.best_overlaps(items, table(spark, sf_dir, "documents"), "item_id", ["doc_id"], 1, whole=True)
    exact = holders(spark, sf_dir, found).groupBy("item_id").agg(F.count(F.lit(1)).alias("holders"))
    best = found.where("rank = 1").select("item_id", (F.col("overlap") / F.col("n_query")).alias("best"))
    out = items.select("item_id").join(best, "item_id", "left").join(exact, "item_id", "left")
    status = F.when(F.col("holders") > 0, "exact").when(F.col("best") >= 0.5, "lexical").otherwise("unsupported")
    return out.select("item_id", F.coalesce("holders", F.lit(0)).alias("holders"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"), status.alias("status"))


def holders(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """item_id and doc_id of documents that hold an item's text word for word. ``found`` has rows of
    null rank for those with all its tokens: no other can hold it, so few texts are looked at."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = found.where("rank is null").select("item_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.join(items.select("item_id", F.col("text").alias("item")), "item_id")
    return rows.where(F.contains("text", "item")).select("item_id", "doc_id")


def _vectors(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return R.vector_topk(rows.where("vec_id % 20 = 0"), rows, limit)


def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _vectors(spark, sf_dir, 5)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def two_stage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten by cosine, then five by the signs that both vectors share; equal ones by the larger id."""
    rows = table(spark, sf_dir, "embeddings")
    signs = lambda v: F.transform(v, lambda x: x > 0)
    found = _vectors(spark, sf_dir, 10).join(rows.select("vec_id", signs("embedding").alias("a")), "vec_id")
    found = found.join(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), signs("embedding").alias("b")), "query_id")
    same = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))
    out = R.ranked(found.withColumn("score", same), ["query_id"], [F.col("score").desc(), F.col("vec_id").desc()], 5, "place")
    return out.select("query_id", "vec_id", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


def _metrics(spark: SparkSession, sf_dir: str, gain: str, floor: float) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _vectors(spark, sf_dir, 10).join(labels, "vec_id")
    found = found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    rows = found.withColumn("relevance", (F.col("label") == F.col("own")).cast("int"))
    return M.mean_metrics(M.query_metrics(rows, "query_id", "relevance", "rank", gain=gain, floor=floor))


def ranking_metrics_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "exp", 0.0)


def ranking_metrics_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "linear", 1.0)


def adjacent_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five turns for each of the first items, with the turns around them."""
    turns = table(spark, sf_dir, "conversations")
    hits = R.best_overlaps(table(spark, sf_dir, "benchmark"), turns, "item_id", ["conv_id", "turn"], 5)
    hits = hits.withColumn("score", F.col("overlap") / F.col("n_query"))
    out = R.with_adjacent(hits, turns, ["conv_id"], "turn", "item_id")
    return out.select("item_id", F.col("rank").cast("long").alias("rank"), "conv_id", "turn", F.round("score", 6).alias("score"))


def dedupe_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("relevance"), F.col("l_linenumber").alias("rank"), F.col("l_orderkey").alias("position"))
    return M.dedupe_rankings(rows, "query", "item", "relevance", "rank", "position")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks of up to 700 characters at sentence ends."""
    rows = X.chunk_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 700)
    whole = [F.col(c).cast("long").alias(c) for c in ("chunk_index", "char_start", "char_end")]
    return rows.select("doc_id", *whole, F.sha2("content", 256).alias("chunk_hash"), "split_reason")


def searchable_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five lines that share most of an item's tokens, with their document's first line as heading and
    the name of a fact; of equal ones a heading comes last."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    lines = lines.select("doc_id", F.get("lines", F.lit(0)).alias("head"), F.posexplode("lines").alias("line", "content"))
    fact = F.element_at(F.array(*(F.lit(k) for k in ("stock", "price", "order_status", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    items = lines.select((F.col("line") == 0).cast("long").alias("is_heading"), "doc_id", F.col("line").cast("long").alias("line"), X.searchable(F.col("content"), F.array("head"), fact).alias("text"))
    out = R.best_overlaps(table(spark, sf_dir, "benchmark"), items, "item_id", ["is_heading", "doc_id", "line"], 5)
    return out.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "line", (F.col("is_heading") == 1).alias("is_heading"), "overlap")


QUERIES = {
    f.__name__: f
    for f in (
        lexical_topk, best_chunk_per_document, answer_support_audit, vector_topk_cosine, two_stage_rerank, ranking_metrics_exp,
        ranking_metrics_linear, adjacent_expansion, dedupe_keep_best, chunk_documents, searchable_topk,
    )
}

_T = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))"
_VECTORS = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, i.vec_id, q.label = i.label AS same, q.e AS a, i.e AS b, round(list_cosine_similarity(q.e, i.e), 9) AS similarity
      FROM v q, v i WHERE q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)"""


def _metric_sql(gain: str, floor: float) -> str:
    g = "(pow(2.0, rel) - 1)" if gain == "exp" else "rel"
    return f"""
WITH {_VECTORS},
m AS (SELECT query_id, rank, same::INTEGER::DOUBLE AS rel, row_number() OVER (PARTITION BY query_id ORDER BY same DESC, rank) AS ideal FROM r WHERE rank <= 10),
q AS (SELECT query_id, max(CASE WHEN rel > 0 AND rank <= 1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN rel > 0 AND rank <= 5 THEN 1 ELSE 0 END) AS h5,
             max(CASE WHEN rel > 0 AND rank <= 10 THEN 1 ELSE 0 END) AS h10, coalesce(1.0::DOUBLE / min(CASE WHEN rel > 0 THEN rank END), 0) AS rr,
             sum({g} / log2(rank + 1)) AS got, greatest(sum({g} / log2(ideal + 1)), {floor}::DOUBLE) AS best FROM m GROUP BY 1)
SELECT count(*) AS queries, round(avg(h1), 6) AS recall_1, round(avg(h5), 6) AS recall_5, round(avg(h10), 6) AS recall_10, round(avg(rr), 6) AS mrr,
       round(avg(CASE WHEN best > 0 THEN got / best ELSE 0 END), 6) AS ndcg FROM q"""


ORACLE = {
    "searchable_topk": f"""
WITH q AS (SELECT item_id, unnest({_T}) AS token FROM benchmark),
l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l[1] AS head, unnest(range(0, len(l))) AS line, unnest(l) AS content FROM l),
t AS (SELECT doc_id, line, content || ' ' || head || (['  stock', ' price', ' order_status', ''])[doc_id % 4 + 1] AS text FROM p),
d AS (SELECT doc_id, line, unnest({_T}) AS token FROM t),
o AS (SELECT item_id, doc_id, line, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, line = 0, doc_id, line) AS rank FROM o)
SELECT item_id, rank, doc_id, line, line = 0 AS is_heading, overlap FROM r WHERE rank <= 5""",
    "lexical_topk": f"""
WITH q AS (SELECT item_id, len(t) AS n, unnest(t) AS token FROM (SELECT item_id, {_T} AS t FROM benchmark)),
d AS (SELECT doc_id, unnest({_T}) AS token FROM documents),
o AS (SELECT item_id, n, doc_id, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap::DOUBLE / n DESC, doc_id) AS rank FROM o)
SELECT item_id, rank, doc_id, overlap, round(overlap::DOUBLE / n, 6) AS score FROM r WHERE rank <= 5""",
    "best_chunk_per_document": f"""
WITH q AS (SELECT item_id, unnest({_T}) AS token FROM benchmark),
p AS (SELECT doc_id, unnest(range(0, len(l))) AS chunk_index, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
d AS (SELECT doc_id, chunk_index, unnest({_T}) AS token FROM p WHERE trim(text) <> ''),
o AS (SELECT item_id, doc_id, chunk_index, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY 1, 2, 3),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY overlap DESC, chunk_index) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM b)
SELECT item_id, rank, doc_id, chunk_index, overlap FROM r WHERE rank <= 10""",
    "answer_support_audit": f"""
WITH q AS (SELECT item_id, len(t) AS n, unnest(t) AS token FROM (SELECT item_id, {_T} AS t FROM benchmark)),
d AS (SELECT doc_id, unnest({_T}) AS token FROM documents),
o AS (SELECT item_id, n, doc_id, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY 1, 2, 3),
b AS (SELECT item_id, max(overlap::DOUBLE / n) AS best FROM o GROUP BY 1),
h AS (SELECT item_id, count(*) AS holders FROM benchmark i JOIN documents d ON contains(d.text, i.text) GROUP BY 1)
SELECT item_id, coalesce(holders, 0) AS holders, round(coalesce(best, 0), 6) AS best,
       CASE WHEN holders > 0 THEN 'exact' WHEN best >= 0.5 THEN 'lexical' ELSE 'unsupported' END AS status
FROM benchmark LEFT JOIN b USING (item_id) LEFT JOIN h USING (item_id)""",
    "vector_topk_cosine": f"WITH {_VECTORS} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5",
    "two_stage_rerank": f"""
WITH {_VECTORS},
c AS (SELECT query_id, vec_id, len(list_filter(list_zip(a, b), lambda x: (x[1] > 0) = (x[2] > 0)))::BIGINT AS score FROM r WHERE rank <= 10)
SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS place FROM c) WHERE place <= 5""",
    "ranking_metrics_exp": _metric_sql("exp", 0.0),
    "ranking_metrics_linear": _metric_sql("linear", 1.0),
    "adjacent_expansion": f"""
WITH q AS (SELECT item_id, len(t) AS n, unnest(t) AS token FROM (SELECT item_id, {_T} AS t FROM benchmark)),
d AS (SELECT conv_id, turn, unnest({_T}) AS token FROM conversations),
o AS (SELECT item_id, n, conv_id, turn, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY 1, 2, 3, 4),
h AS (SELECT *, overlap::DOUBLE / n AS score, row_number() OVER (PARTITION BY item_id ORDER BY overlap::DOUBLE / n DESC, conv_id, turn) AS hit FROM o QUALIFY hit <= 5),
s(o, step) AS (VALUES (0, 0), (1, -1), (2, 1)),
x AS (SELECT DISTINCT item_id, hit, o, h.conv_id, c.turn, score FROM h CROSS JOIN s JOIN conversations c ON c.conv_id = h.conv_id AND c.turn = h.turn + step),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY item_id, conv_id, turn ORDER BY hit, o) = 1)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY hit, o) AS rank, conv_id, turn, round(score, 6) AS score FROM y""",
    "dedupe_keep_best": """
SELECT l_suppkey AS query, l_partkey AS item, l_quantity AS relevance, l_linenumber AS rank, l_orderkey AS position FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_quantity DESC, l_linenumber, l_orderkey) = 1""",
    # A full stop between digits is put out of sight while sentences are told apart; the fold goes
    # sentence by sentence over all documents.
    "chunk_documents": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, text, regexp_extract_all(regexp_replace(regexp_replace(text, '([0-9])[.]([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])[.]([0-9])', '\1' || chr(1) || '\2', 'g'),
         '(?:[^\n。！？；.!?;]*(?:\n+|[。！？；.!?;])|[^\n。！？；.!?;]+)') AS u
  FROM documents),
s AS (
  SELECT doc_id, i, size, (sum(size) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS en
  FROM (SELECT doc_id, unnest(range(1, len(u) + 1)) AS i, unnest(list_transform(u, lambda x: length(x))) AS size FROM t)),
f AS (
  SELECT doc_id, i, size, en, CASE WHEN size > 700 THEN -1 ELSE 0 END::BIGINT AS st FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, s.size, s.en, CASE WHEN s.size > 700 THEN -1 WHEN f.st >= 0 AND s.en - f.st <= 700 THEN f.st ELSE s.en - s.size END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
c AS (
  SELECT doc_id, st, max(en) AS en, false AS hard FROM f WHERE st >= 0 GROUP BY doc_id, st
  UNION ALL
  SELECT doc_id, st, least(st + 700, en), true FROM (SELECT doc_id, en, unnest(range(en - size, en, 700)) AS st FROM f WHERE st < 0)),
k AS (
  SELECT *, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS n, lead(hard) OVER w AS next_hard
  FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY st))
SELECT k.doc_id, chunk_index, st AS char_start, k.en AS char_end, sha256(substr(text, st + 1, k.en - st)) AS chunk_hash,
       CASE WHEN hard OR (NOT next_hard AND NOT regexp_matches(text, '\s|\p{Z}|\x{85}')) THEN 'hard_split' WHEN n = 1 THEN 'element_boundary' ELSE 'sentence_boundary' END AS split_reason
FROM k JOIN t USING (doc_id)""",
}
