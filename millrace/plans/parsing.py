"""Queries that parse pages, documents, tables and layout lists into elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.artifacts import robots_allow
from millrace.operators.snapshots import replace_documents
from millrace.sources.parsers import layout_counts, normalize_layout, parse_documents, strict_json
from millrace.sources.tables import table


def parse_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_documents(table(spark, sf_dir, "pages"), "html", "page_id", "html")


def markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse_documents(table(spark, sf_dir, "documents"), "markdown", "doc_id", "text")
    return found.groupBy("document_id", "kind").agg(F.count(F.lit(1)).alias("elements"), F.sum(F.length("text")).alias("chars"))


def csv_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers as a CSV file with two tenants' rows, some with a short row or no header:
    the records of tenant b, and what is wrong."""
    name = F.concat(F.lit('"'), F.regexp_replace("s_name", "#", '""\n'), F.lit('"'))
    tenant = F.when(F.col("s_suppkey") % 3 == 0, "a").when(F.col("s_suppkey") % 3 == 1, "b").otherwise("")
    row = F.concat_ws(",", F.col("s_suppkey").cast("string"), name, tenant)
    lines = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda x: x["row"]), "\n\n").alias("rows"))
    head = F.when(F.col("s_nationkey") % 7 == 3, "key,,tenant_id").when(F.col("s_nationkey") % 7 == 4, "key,key,tenant_id").otherwise("key,name,tenant_id")
    files = lines.select("s_nationkey", F.concat(F.lit("\ufeff"), head, F.lit("\n"), "rows", F.when(F.col("s_nationkey") % 7 == 5, "\nshort,row").otherwise("")).alias("csv"))
    return parse_documents(files, "csv", "s_nationkey", "csv", tenant="b").select("document_id", "element_index", "kind", "text", "first_line", "last_line")


def strict_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as lines of JSON, some cut, wrapped, blank or with a key twice: what is wrong."""
    f, props = F.col("event_id") % 41, F.col("props")
    line = F.when(f == 1, F.substring(props, 1, 4)).when(f == 2, F.concat(F.lit("["), props, F.lit("]"))).when(f == 3, " ").when(f == 4, F.regexp_replace(props, "}$", ', "k": 1}')).otherwise(props)
    return strict_json(table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line").select("event_id", "issue")


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a layout list of several kinds, normalized."""
    kind = F.element_at(F.array(*(F.lit(k) for k in ("text", "Table", "image", "chart", "list"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    item = F.to_json(F.struct(
        kind.alias("type"), F.col("l_returnflag").alias("text"), F.when(F.col("l_linenumber") == 5, 2).alias("text_level"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") - 2).alias("page_no"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber")).alias("page_idx"), F.when(F.col("l_linenumber") == 2, F.lit("i.png")).alias("img_path"),
        F.when(F.col("l_linenumber") == 1, F.array(F.array("l_returnflag", "l_linestatus"), F.array(F.lit("x")))).alias("table_body"),
    ))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", item.alias("item")))).alias("items"))
    lists = lists.select("l_orderkey", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]")).alias("content"))
    return normalize_layout(lists, "l_orderkey", "content")


def layout_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of layout lists, with pages, images, tables and warnings."""
    out = _layout(spark, sf_dir)
    return out.select(F.col("document_id").alias("l_orderkey"), "element_index", "kind", "text", "page_no", F.array_join("image_refs", ",").alias("images"), F.coalesce("table_text", F.lit("")).alias("table_text"), "warning")


def layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversion reports of each layout list: elements, pages, tables, images, assets, warnings."""
    return layout_counts(_layout(spark, sf_dir)).withColumnRenamed("document_id", "l_orderkey").withColumn("page_numbers", F.array_join("page_numbers", ","))


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages' paths the rules of their host bar for two agents."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    part = F.regexp_extract("path", "^(/[^/]*)", 1)
    robots = F.concat(F.lit("User-agent: other\nDisallow: /\nUser-Agent: *\nDisallow:\nDisallow: "), F.when(F.col("page_id") % 3 == 0, part).otherwise("/none/"), F.lit("\r\nuser-agent: mill\nDisallow: /"), F.col("page_id") % 10)
    rows = pages.withColumn("robots", robots)
    out = robots_allow(rows, "robots", "mill", "path").select("page_id", "path", F.col("allowed").alias("mill"), "robots")
    return robots_allow(out, "robots", "other", "path").select("page_id", "mill", F.col("allowed").alias("other"))


def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders after every fifth order was replaced by one line and every seventh removed."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("chunk"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"))
    out = replace_documents(lines, orders.where("doc % 5 = 0").withColumn("chunk", F.lit(100).cast("long")), orders.where("doc % 7 = 0"), "doc")
    return out.groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk").alias("last"))


QUERIES = {f.__name__: f for f in (parse_html_pages, markdown_elements, csv_elements, strict_json_lines, layout_lists, layout_report, robots_rules, replaced_documents)}

ORACLE: dict[str, str] = {
    "strict_json_lines": """
SELECT event_id, CASE event_id % 41 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'blank' WHEN 4 THEN 'invalid_json' END AS issue FROM events""",
    "csv_elements": r"""
WITH r AS (
  SELECT s_nationkey AS n, s_suppkey AS k, replace(s_name, '#', '"' || chr(10)) AS name, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS t, contains(s_name, '#') AS two,
         sum(2 + contains(s_name, '#')::INTEGER) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS upto, count(*) OVER (PARTITION BY s_nationkey) AS all_rows
  FROM supplier),
g AS (SELECT *, (upto - 2 - two::INTEGER + 2)::INTEGER AS first, upto::INTEGER AS last FROM r WHERE t <> 'a' AND n % 7 NOT IN (3, 4, 5))
SELECT n::VARCHAR AS document_id, (row_number() OVER (PARTITION BY n ORDER BY k) - 1)::INTEGER AS element_index, 'table' AS kind,
       'key: ' || k || chr(10) || 'name: ' || name || CASE WHEN t <> '' THEN chr(10) || 'tenant_id: ' || t ELSE '' END AS text, first AS first_line, last AS last_line FROM g
UNION ALL
SELECT n::VARCHAR, 0, 'error', CASE n % 7 WHEN 3 THEN 'csv_header_empty' WHEN 4 THEN 'csv_header_duplicate' ELSE 'csv_column_mismatch:row=' || (max(upto) + 1)::INTEGER END, 0, 0 FROM r WHERE n % 7 IN (3, 4, 5) GROUP BY n""",
    "layout_lists": """
WITH i AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS p, l_linenumber AS n, l_returnflag AS f, l_linestatus AS s,
         (['text', 'table', 'image', 'chart', 'list'])[l_linenumber % 5 + 1] AS raw, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - 2 ELSE l_linenumber + 1 END AS page FROM lineitem),
k AS (SELECT *, CASE WHEN raw = 'text' AND n = 5 THEN 'heading' ELSE raw END AS kind FROM i)
SELECT l_orderkey, p::INTEGER AS element_index, CASE WHEN kind = 'chart' THEN 'text' ELSE kind END AS kind, f AS text, CASE WHEN page >= 1 THEN page::INTEGER END AS page_no,
       CASE WHEN n = 2 THEN 'i.png' ELSE '' END AS images, CASE WHEN n = 1 THEN f || ' | ' || s || chr(10) || 'x' ELSE '' END AS table_text,
       nullif(concat_ws(';', CASE WHEN kind = 'chart' THEN 'unknown_type:chart' END, CASE WHEN page < 1 THEN 'invalid_page_no' END), '') AS warning FROM k""",
    "layout_report": """
WITH i AS (
  SELECT l_orderkey, l_linenumber AS n, l_linenumber % 5 AS m, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - 2 ELSE l_linenumber + 1 END AS page FROM lineitem)
SELECT l_orderkey, count(*) AS elements, coalesce(array_to_string(list_sort(list_distinct(list(page) FILTER (page >= 1))), ','), '') AS page_numbers, count(*) FILTER (m = 1) AS tables, count(*) FILTER (m = 2) AS images,
       count(*) FILTER (n = 2) AS image_assets, count(*) FILTER (m = 3 OR page < 1) AS warnings FROM i GROUP BY 1""",
    "robots_rules": r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, NOT (page_id % 3 = 0 AND starts_with(path, regexp_extract(path, '^(/[^/]*)', 1)) AND regexp_extract(path, '^(/[^/]*)', 1) <> '') AND NOT starts_with(path, CASE WHEN page_id % 3 = 0 THEN '/?' ELSE '/none/' END)
       AND NOT starts_with(path, '/' || page_id % 10) AS mill, NOT starts_with(path, '/') AS other FROM p""",
    "replaced_documents": """
WITH c AS (
  SELECT l_orderkey AS doc, l_linenumber::BIGINT AS chunk FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)
  UNION ALL SELECT o_orderkey, 100 FROM orders WHERE o_orderkey % 5 = 0)
SELECT doc, count(*) AS chunks, max(chunk) AS last FROM c GROUP BY doc""",
}
