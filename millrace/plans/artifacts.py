"""Queries on artifacts, manifests and the context that answers get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import artifacts as A
from millrace.operators import integrity as I
from millrace.operators import retrieval as R
from millrace.plans.retrieval import holders
from millrace.sources.tables import table


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("lang", "source", F.concat(F.lit("v-"), F.col("doc_id")).alias("version"), "text", F.lower("text").alias("parsed"))
    return A.artifact_rows(docs, {"raw": "text", "parsed": "parsed"}, "lang", "source", "version")


def artifact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.set_hash(_artifacts(spark, sf_dir), ["lang", "source", "version"])


def bundle_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest against objects of which some are gone, some cut and some changed."""
    rows = _artifacts(spark, sf_dir)
    n = F.regexp_extract("version", "([0-9]+)", 1).cast("long")
    content = F.when(n % 7 == 1, F.concat("content", F.lit("!").cast("binary"))).when(n % 7 == 2, F.replace(F.col("content").cast("string"), F.lit("e"), F.lit("x")).cast("binary")).otherwise(F.col("content"))
    objects = rows.where(n % 7 != 3).select("object_key", content.alias("content"))
    return A.verify_bundle(rows.where(n % 7 != 4), objects).groupBy("status").agg(F.count("*").alias("objects"))


def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of documents: formats, dates, hashes and repeated texts that break its rules."""
    docs = table(spark, sf_dir, "documents")
    form = F.element_at(F.array(F.lit("markdown"), F.lit("csv"), F.lit("pdf")), (F.col("doc_id") % 3 + 1).cast("int"))
    sha = F.when(F.col("doc_id") % 8 != 0, F.sha2("text", 256)).otherwise(F.md5("text"))
    rows = docs.select("doc_id", form.alias("format"), sha.alias("sha256"), (F.col("doc_id") % 6 - 2).alias("days"), "n_chars")
    checks = [
        I.Check("format_unknown", ~F.col("format").isin("markdown", "csv", "docx", "html")), I.Check("sha256_invalid", ~F.col("sha256").rlike("^[0-9a-f]{64}$")),
        I.Check("window_empty", F.col("days") <= 0), I.Check("too_large", F.col("n_chars") > 20_000),
    ]
    return I.suite([I.row_issues(rows, "doc_id", checks), I.duplicate_issues(rows.where("doc_id % 8 <> 0"), "content_repeated", ["sha256"])])


def context_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the five best documents of an item are all that hold its text word for word."""
    items = table(spark, sf_dir, "benchmark")
    found = R.best_overlaps(items, table(spark, sf_dir, "documents"), "item_id", ["doc_id"], 5, whole=True)
    given = found.where("rank <= 5").select("item_id", "doc_id", F.lit(True).alias("given"))
    needed = holders(spark, sf_dir, found).join(given, ["item_id", "doc_id"], "left").groupBy("item_id")
    needed = needed.agg(F.count(F.lit(1)).alias("needed"), F.count_if(F.col("given").isNull()).alias("missing"))
    out = items.select("item_id").join(needed, "item_id", "left")
    status = F.when(F.col("needed").isNull(), "ineligible").when(F.col("needed") > 5, "exceeded").when(F.col("missing") > 0, "incomplete").otherwise("within_budget")
    return out.select("item_id", F.coalesce("needed", F.lit(0)).alias("needed"), F.coalesce("missing", F.lit(0)).alias("missing"), status.alias("status"))


def assembled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's best three documents, whole and best first, as one text in parts of 32."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    best = R.lexical_topk(items, docs, "item_id", "doc_id", 3).join(docs.select("doc_id", "text"), "doc_id")
    parts = best.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))
    text = F.concat(F.lit("根据当前知识资料："), F.array_join(F.transform("p", lambda x: x["text"]), "；"))
    out = parts.select("item_id", text.alias("answer"))
    return out.select("item_id", "answer", F.ceil(F.length("answer") / 32).alias("deltas"))


QUERIES = {f.__name__: f for f in (artifact_sets, bundle_verification, manifest_issues, context_audit, assembled_answers)}

_T = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))"
_OVERLAP = f"""
q AS (SELECT item_id, len(t) AS n, unnest(t) AS token FROM (SELECT item_id, {_T} AS t FROM benchmark)),
d AS (SELECT doc_id, unnest({_T}) AS token FROM documents),
o AS (SELECT item_id, n, doc_id, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap::DOUBLE / n DESC, doc_id) AS rank FROM o)"""

ORACLE = {
    "artifact_sets": """
WITH a AS (SELECT lang, source, 'v-' || doc_id AS version, unnest(['raw', 'parsed']) AS kind, unnest([text, lower(text)]) AS c FROM documents)
SELECT lang, source, version, count(*) AS artifacts, sum(strlen(c))::BIGINT AS bytes,
       sha256(string_agg(kind || ':' || sha256(c) || ':' || strlen(c), chr(10) ORDER BY kind, sha256(c), strlen(c))) AS set_hash FROM a GROUP BY 1, 2, 3""",
    "bundle_verification": """
WITH a AS (SELECT doc_id % 7 AS m, unnest([text, lower(text)]) AS c FROM documents),
s AS (SELECT CASE WHEN m = 3 THEN 'missing' WHEN m = 4 THEN 'unlisted' WHEN m = 1 THEN 'wrong_size'
                  WHEN m = 2 AND contains(c, 'e') THEN 'wrong_hash' ELSE 'ok' END AS status FROM a)
SELECT status, count(*) AS objects FROM s GROUP BY 1""",
    "manifest_issues": """
WITH r AS (SELECT doc_id, doc_id % 3 AS f, doc_id % 8 AS h, doc_id % 6 - 2 AS days, n_chars, sha256(text) AS s FROM documents)
SELECT 'format_unknown' AS rule, doc_id::VARCHAR AS subject FROM r WHERE f = 2
UNION ALL SELECT 'sha256_invalid', doc_id::VARCHAR FROM r WHERE h = 0
UNION ALL SELECT 'window_empty', doc_id::VARCHAR FROM r WHERE days <= 0
UNION ALL SELECT 'too_large', doc_id::VARCHAR FROM r WHERE n_chars > 20000
UNION ALL SELECT 'content_repeated', s FROM r WHERE h <> 0 GROUP BY s HAVING count(*) > 1""",
    "context_audit": f"""
WITH {_OVERLAP},
h AS (SELECT item_id, doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text)),
m AS (SELECT h.item_id, count(*) AS needed, count(*) FILTER (r.rank IS NULL OR r.rank > 5) AS missing FROM h LEFT JOIN r ON r.item_id = h.item_id AND r.doc_id = h.doc_id GROUP BY 1)
SELECT item_id, coalesce(needed, 0) AS needed, coalesce(missing, 0) AS missing,
       CASE WHEN needed IS NULL THEN 'ineligible' WHEN needed > 5 THEN 'exceeded' WHEN missing > 0 THEN 'incomplete' ELSE 'within_budget' END AS status
FROM benchmark LEFT JOIN m USING (item_id)""",
    "assembled_answers": f"""
WITH {_OVERLAP},
a AS (SELECT item_id, '根据当前知识资料：' || string_agg(text, '；' ORDER BY rank) AS answer FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1)
SELECT item_id, answer, ceil(length(answer) / 32)::BIGINT AS deltas FROM a""",
}
