"""Rule suites over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import integrity as I
from millrace.sources.tables import table



def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    lines = lines.withColumn("item", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    return I.suite([
        I.row_issues(lines, "item", [
            I.Check("quantity_range", (F.col("l_quantity") < 1) | (F.col("l_quantity") > 48)),
            I.Check("discount_range", (F.col("l_discount") < 0) | (F.col("l_discount") > 0.09)),
            I.Check("flag_unknown", ~F.col("l_returnflag").isin("A", "N", "R")),
        ]),
        I.row_issues(orders, "o_orderkey", [I.Check("price_positive", F.col("o_totalprice") <= 0), I.Check("status_unknown", ~F.col("o_orderstatus").isin("F", "O"))]),
        I.duplicate_issues(lines, "item_unique", ["l_orderkey", "l_linenumber"]),
        I.orphan_issues(lines, "order_exists", "l_orderkey", orders, "o_orderkey", "item"),
        I.orphan_issues(orders, "customer_exists", "o_custkey", customer.where("c_custkey % 50 <> 7"), "c_custkey", "o_orderkey"),
    ])


def integrity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integrity(spark, sf_dir)


def readiness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["quantity_range", "discount_range", "flag_unknown", "price_positive", "status_unknown", "item_unique", "order_exists", "customer_exists"]
    return I.readiness(_integrity(spark, sf_dir), rules)


def review_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of documents against the documents: missing ones and changed fields."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    reviewed = docs.where("doc_id % 10 <> 3").withColumn("lang", F.when(F.col("doc_id") % 9 == 0, F.lit("xx")).otherwise(F.col("lang")))
    reviewed = reviewed.withColumn("n_chars", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")))
    return I.changed_issues(docs.where("doc_id % 10 <> 4"), reviewed, "doc_id", ["lang", "source", "n_chars"], "review")


def chunk_integrity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph chunks whose position doesn't follow the one before, or that repeat it."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "")
    line = W.partitionBy("doc_id").orderBy("at")
    rows = chunks.select("doc_id", "at", F.lag("at").over(line).alias("before"), F.lag(F.md5("line")).over(line).alias("hash_before"), F.md5("line").alias("hash"))
    rows = rows.withColumn("subject", F.concat_ws("/", "doc_id", "at"))
    issues = I.row_issues(rows, "subject", [
        I.Check("first_not_zero", F.col("before").isNull() & (F.col("at") != 0)),
        I.Check("gap", F.col("at") != F.col("before") + 1),
        I.Check("repeats", F.col("hash") == F.col("hash_before")),
    ])
    return issues.groupBy("rule").agg(F.count("*").alias("chunks"), F.min("subject").alias("first"))


def case_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by the first that holds: unauthorized, refusal, clarification, else retrieval."""
    turns = table(spark, sf_dir, "conversations")
    text = F.lower("text")
    kind = F.when(F.col("role") == "system", "unauthorized").when(text.rlike("cannot|can't|refuse|sorry"), "refusal").when(F.length("text") < 40, "clarification").otherwise("retrieval")
    return turns.groupBy(kind.alias("kind")).agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))


def tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shops' documents bear each tag, and the share of all documents that do."""
    docs = table(spark, sf_dir, "documents").select("source", F.array_compact(F.array(
        F.when(F.col("n_chars") > 3000, "long"), F.when(F.col("n_chars") < 600, "short"), F.when(F.contains("text", F.lit("\n")), "lines"), F.col("lang"),
    )).alias("tags"))
    total = docs.count()
    rows = docs.select("source", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("shops"))
    return rows.withColumn("share", F.round(F.col("documents") / F.lit(max(total, 1)), 6))


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("shop_id")).agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 5000).alias("large"),
        F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.countDistinct(F.md5("text")).alias("texts"),
    )


def citation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as citations of parts as evidence: those whose evidence is eligible, per order status."""
    evidence = table(spark, sf_dir, "part").where("p_size <= 30 and p_type not like '%BRASS%'").select("p_partkey")
    cited = table(spark, sf_dir, "lineitem").join(evidence, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    out = cited.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("citations"), F.countDistinct("l_partkey").alias("evidence"))


def permission_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for roles made of customers: what is wrong with each, the first thing first."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.element_at(F.array(F.lit("viewer"), F.lit("editor"), F.lit("admin"), F.lit("root")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("role"),
        F.array(F.concat(F.lit("s"), F.col("c_nationkey")), F.concat(F.lit("s"), F.col("c_nationkey") % 5)).alias("shops"), F.length("c_mktsegment").alias("reason"),
    )
    status = (
        F.when(~F.col("role").isin("viewer", "editor", "admin"), "unknown_role").when(F.col("reason") < 9, "short_reason")
        .when(F.size(F.array_distinct("shops")) < F.size("shops"), "repeated_shop").when(F.size(F.array_except("shops", F.array(*(F.lit(f"s{i}") for i in range(20))))) > 0, "foreign_shop")
        .otherwise("valid")
    )
    return rows.groupBy("role", status.alias("status")).agg(F.count("*").alias("requests"))


QUERIES = {
    f.__name__: f
    for f in (
        integrity_issues, readiness_gate, review_drift, chunk_integrity_issues, case_classification, tag_coverage, report_counts, citation_evidence,
        permission_requests,
    )
}

_ISSUES = """
i AS (
  SELECT 'quantity_range' AS rule, l_orderkey || '/' || l_linenumber AS subject FROM lineitem WHERE l_quantity < 1 OR l_quantity > 48
  UNION ALL SELECT 'discount_range', l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_discount < 0 OR l_discount > 0.09::DOUBLE
  UNION ALL SELECT 'flag_unknown', l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R')
  UNION ALL SELECT 'price_positive', o_orderkey::VARCHAR FROM orders WHERE o_totalprice <= 0
  UNION ALL SELECT 'status_unknown', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT 'item_unique', l_orderkey || '/' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'order_exists', l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'customer_exists', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 7))"""

ORACLE = {
    "integrity_issues": f"WITH {_ISSUES} SELECT rule, subject FROM i",
    "readiness_gate": f"""
WITH {_ISSUES}, r(rule) AS (VALUES ('quantity_range'), ('discount_range'), ('flag_unknown'), ('price_positive'), ('status_unknown'), ('item_unique'), ('order_exists'), ('customer_exists'))
SELECT r.rule, count(i.rule) AS issues, count(i.rule) = 0 AS ready FROM r LEFT JOIN i ON r.rule = i.rule GROUP BY 1""",
    "review_drift": """
SELECT rule, doc_id::VARCHAR AS subject FROM (
  SELECT 'review_missing_right' AS rule, doc_id FROM documents WHERE doc_id % 10 = 3
  UNION ALL SELECT 'review_missing_left', doc_id FROM documents WHERE doc_id % 10 = 4
  UNION ALL SELECT 'review_lang_changed', doc_id FROM documents WHERE doc_id % 10 NOT IN (3, 4) AND doc_id % 9 = 0 AND lang IS DISTINCT FROM 'xx'
  UNION ALL SELECT 'review_n_chars_changed', doc_id FROM documents WHERE doc_id % 10 NOT IN (3, 4) AND doc_id % 11 = 0 AND n_chars IS NOT NULL)""",
    "chunk_integrity_issues": """
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
c AS (SELECT doc_id || '/' || pos AS subject, pos, lag(pos) OVER w AS before, line, lag(line) OVER w AS line_before FROM l WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT 'first_not_zero' AS rule, subject FROM c WHERE before IS NULL AND pos <> 0 UNION ALL SELECT 'gap', subject FROM c WHERE pos <> before + 1 UNION ALL SELECT 'repeats', subject FROM c WHERE line = line_before)
SELECT rule, count(*) AS chunks, min(subject) AS first FROM i GROUP BY 1""",
    "case_classification": """
SELECT CASE WHEN role = 'system' THEN 'unauthorized' WHEN regexp_matches(lower(text), 'cannot|can''t|refuse|sorry') THEN 'refusal' WHEN length(text) < 40 THEN 'clarification' ELSE 'retrieval' END AS kind,
       count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1""",
    "tag_coverage": """
WITH t AS (SELECT source, unnest(list_filter([CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN n_chars < 600 THEN 'short' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END, lang], lambda x: x IS NOT NULL)) AS tag FROM documents)
SELECT tag, count(*) AS documents, count(DISTINCT source) AS shops, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM t GROUP BY 1""",
    "report_counts": """
SELECT source AS shop_id, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars > 5000) AS large,
       array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(DISTINCT text) AS texts FROM documents GROUP BY 1""",
    "citation_evidence": """
SELECT o_orderstatus, count(*) AS citations, count(DISTINCT l_partkey) AS evidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 30 AND p_type NOT LIKE '%BRASS%') GROUP BY 1""",
    "permission_requests": """
WITH r AS (SELECT (['viewer', 'editor', 'admin', 'root'])[c_custkey % 4 + 1] AS role, c_nationkey AS a, c_nationkey % 5 AS b, length(c_mktsegment) AS reason FROM customer)
SELECT role, CASE WHEN role = 'root' THEN 'unknown_role' WHEN reason < 9 THEN 'short_reason' WHEN a = b THEN 'repeated_shop' WHEN a >= 20 THEN 'foreign_shop' ELSE 'valid' END AS status,
       count(*) AS requests FROM r GROUP BY 1, 2""",
}
