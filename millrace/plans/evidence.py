"""Queries over cases, evidence and reports: who may use what, and whether it holds together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import evidence as E
from millrace.operators import snapshots as N
from millrace.sources.derive import SCOPED_SQL, scoped_documents
from millrace.sources.tables import table


def context_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorization contexts, one an order, and whether each holds together."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    role = F.element_at(F.array(*(F.lit(r) for r in ("owner", "admin", "operator", "viewer", "guest"))), (k % 5 + 1).cast("int"))
    shops = F.array(F.col("o_orderstatus"), F.col("o_orderpriority"))
    shop = F.when(k % 3 == 0, F.col("o_orderstatus")).when(k % 3 == 1, "").otherwise("elsewhere")
    valid = E.valid_context(k, F.col("c_mktsegment"), F.when(k % 17 != 0, F.col("o_custkey")), F.col("o_orderdate"), k % 13 != 0, role, shops, shop, k % 7 == 0)
    return orders.select("o_orderkey", valid.alias("valid"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scoped documents as chunks; every seventh is internal, later lines begin later."""
    docs = scoped_documents(spark, sf_dir)
    rows = docs.select("doc_id", "tenant_id", "shop_id", "disclosure_class", "effective_from", "effective_to", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.withColumn("effective_from", F.date_add("effective_from", (F.col("at") % 3).cast("int")))
    return rows.withColumn("disclosure_class", F.when(F.col("at") % 7 == 6, "internal_only").otherwise(F.col("disclosure_class")))


def eligible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, one a benchmark item, with the number of chunks and documents they may use."""
    docs = scoped_documents(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("item_id").join(docs.select(F.col("doc_id").alias("item_id"), "tenant_id", "shop_id"), "item_id")
    cases = items.select(F.col("item_id").alias("case_id"), "tenant_id", "shop_id", F.expr("date_add(date'2024-01-10', cast(item_id % 40 as int))").alias("on"))
    found = E.eligible_chunks(cases, docs, _chunks(spark, sf_dir))
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"))


def canonical_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence fit for an answer, and whether the index has it exactly so."""
    chunks = _chunks(spark, sf_dir).where("at < 3").select("doc_id", "at", "tenant_id", "shop_id", "disclosure_class", F.md5("line").alias("content"))
    kind = F.when(F.col("doc_id") % 6 == 0, "internal").when(F.col("doc_id") % 6 == 1, "unclassified").otherwise("document")
    evidence = chunks.withColumn("source_type", kind).withColumn("customer_eligible", F.col("doc_id") % 5 != 0)
    evidence = evidence.withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.lit("other")).otherwise(F.col("content")))
    fit = E.generation_evidence(evidence)
    return E.canonical(fit, chunks, ["doc_id", "at", "tenant_id", "shop_id", "disclosure_class", "content"]).select("doc_id", F.col("at").cast("long").alias("at"), "canonical")


def fact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether some of their chunks state a fact (here: a number) and some none."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    fact = F.col("line").rlike("[0-9]")
    return lines.groupBy("doc_id").agg(F.max(fact).alias("in_facts"), F.max(~fact).alias("in_knowledge"))


def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first group of words of which a question has one."""
    low = F.lower("text")
    groups = (("shipping", "tion|return"), ("bottle", "ount"), ("towel", "ther"), ("safety", "may|can"))
    out = F.lit(None).cast("string")
    for name, words in reversed(groups):
        out = F.when(low.rlike(words), name).otherwise(out)
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", out.alias("topic"))


def private_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages with endings and folders put to them, and whether they are private."""
    k = F.col("page_id")
    path = F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1), "/+$", "")
    ends = F.element_at(F.array(*(F.lit(x) for x in ("", ".md", "/.env", ".env.example", "/id_rsa.pub", ".py", ".LOG", "/README.md", "-chat_history.json"))), (k % 9 + 1).cast("int"))
    folder = F.element_at(F.array(*(F.lit(x) for x in ("", "data/synthetic/", "Docs/", "src/", "a/.ssh/"))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(folder, path, ends).alias("path")).withColumn("private", X.private_path(F.col("path")))


def refusal_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and whether a refusal is expected, by their tags or points."""
    k = F.col("item_id")
    tags = F.when(k % 4 == 0, F.array(F.lit("faq"), F.lit("revoked"))).when(k % 4 == 1, F.array(F.lit("faq")))
    points = F.when(k % 3 == 0, F.array(F.col("text"), F.lit("请求无法完成"))).when(k % 3 == 1, F.array(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", E.refusal_expected(tags, points).alias("refusal"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 orders that wait most for a review, most urgent first, with their returned lines as JSON."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey")
    lines = lines.agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))))).alias("returned"))
    rank = F.when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("2"), 2).otherwise(3)
    out = orders.withColumn("rank", rank).orderBy("rank", "o_orderdate", "o_orderkey").limit(100)
    out = out.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", F.col("rank").cast("long").alias("rank"), "n_name", "r_name", F.coalesce("returned", F.lit("[]")).alias("returned"))


def seed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region by three roles, as the rows of a small set of values."""
    roles = F.array(*(F.lit(r) for r in ("owner", "operator", "viewer")))
    return table(spark, sf_dir, "region").select("r_name", F.explode(roles).alias("role"))


def hit_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over orders as cases: parts on the first three lines expected, returned ones found."""
    part = F.col("l_partkey")
    cases = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_linenumber") <= 3, part)).alias("expected"), F.collect_set(F.when(F.col("l_returnflag") != "N", part)).alias("found")
    )
    out = E.hit_and_coverage(cases)
    return out.groupBy((F.col("l_orderkey") % 10).alias("part")).agg(
        F.count("hit").alias("cases"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg("coverage").alias("coverage_rate")
    )


def answer_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as expected points, by sentence, against the turns of the conversation with their id."""
    expected = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.split("text", r"(?<=\.)\s").alias("expected"))
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("answer_id"))
    turns = turns.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("generated"))
    return E.composition(expected.join(turns, "answer_id"))


def turn_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns aren't numbered from 0 on without a gap or repeat."""
    rows = table(spark, sf_dir, "conversations").where("conv_id % 5 > 0 or turn <> 1").groupBy("conv_id")
    rows = rows.agg(F.count("turn").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.countDistinct("turn").alias("numbers"))
    return rows.where("first <> 0 or last <> turns - 1 or numbers <> turns").select("conv_id", "turns", "first", "last")


def falling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is below that of their user's event before."""
    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.lag("value").over(line).alias("before"))
    return rows.where("value < before")


def headings_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with the last heading (here: a line under 40 characters) at or before each."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    heading = F.when((F.length("line") < 40) & (F.length("line") > 0), F.col("line"))
    line = W.partitionBy("doc_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("heading", F.last(heading, ignorenulls=True).over(line))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count("heading").alias("headed"), F.countDistinct("heading").alias("headings"))


def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event of each type, ties by the larger id."""
    line = W.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(line)).where("n = 1")
    return rows.select("user_id", "event_type", "event_id", "value")


def first_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").orderBy("item_id").limit(20)


def vector_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by what is wrong with them: dimensions, values that aren't finite; and the cosine distance
    of each good one to the one with the next id. ``embedding_contract`` has the other rules."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 50 == 7, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("v"))
    dims = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("dims"))
    rows = rows.join(F.broadcast(dims))  # one row
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    issue = F.when(F.size("v") != F.col("dims"), "dimensions").when(~finite, "not_finite").otherwise("ok")
    rows = rows.select("vec_id", "v", issue.alias("issue"))
    other = rows.where("issue = 'ok'").select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    out = rows.join(other, "vec_id", "left")
    return out.select("vec_id", "issue", F.when((F.col("issue") == "ok") & F.col("w").isNotNull(), F.round(1 - X.cosine(F.col("v"), F.col("w")), 5)).alias("distance"))


def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records under several field names: the first filled one counts, and numbers are read safely."""
    raw = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type")).alias("name"))
    number = F.when(F.col("event_id") % 11 == 0, "true").when(F.col("event_id") % 11 == 1, "n/a").otherwise(F.col("k"))
    value = F.when(F.lower(number) == "true", 1.0).when(F.lower(number) == "false", 0.0).otherwise(number.try_cast("double"))
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("k"), F.lit("")), F.lit("none"))
    return raw.select("event_id", label.alias("label"), value.alias("value"), value.isNotNull().alias("valid"))


def attribute_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of documents as maps: what is set wins over what is laid on, empty values don't count."""
    base = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    laid = F.create_map(F.lit("lang"), F.lit("xx"), F.lit("size"), F.when(F.col("n_chars") > 500, "long"), F.lit("kind"), F.when(F.col("doc_id") % 2 == 0, "even"))
    new = F.map_filter(laid, lambda k, v: v.isNotNull() & (v != "") & ~F.map_contains_key(base, k))
    pairs = F.array_sort(F.map_entries(F.map_concat(base, new)))
    return table(spark, sf_dir, "documents").where("lang is not null and source is not null").select("doc_id", F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",").alias("attributes"))


def lease_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renewals of leases, an event each by its user: renewed only by the owner, of the same epoch, in time."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    leases = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("lease"))
    leases = leases.select("user_id", (F.col("lease.event_id") % 3).alias("epoch"), F.col("lease.ts").alias("since"))
    asks = events.where("event_type <> 'signup'").withColumn("asked_epoch", F.col("event_id") % 3)
    return N.renew(asks, leases, "user_id", F.expr("interval 6 hours")).select("event_id", "user_id", "outcome")


def owned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of orders set by new rows of their owner; rows of others are conflicts and change nothing."""
    now = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"))
    new = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, -1).otherwise(F.col("o_custkey")).alias("owner"), F.lit(1.0).alias("price"))
    return N.upsert_owned(now, new, "o_orderkey", "owner")


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in review by the decision on them: approved or rejected once, if the hash is still theirs."""
    k = F.col("doc_id")
    versions = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash"), F.when(k % 5 == 0, "approved").otherwise("needs_review").alias("state"))
    hash_seen = F.when(k % 7 == 0, "stale").otherwise(F.md5("text"))
    decisions = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", hash_seen.alias("seen"), F.when(k % 3 == 0, "reject").otherwise("approve").alias("decision"))
    return N.decide(versions, decisions, "doc_id").select("doc_id", "state", "outcome")


def field_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision of documents in which one field is set for named ids only, and ids nobody knows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    new = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    new = new.select((F.col("doc_id") * 2).alias("doc_id"), F.concat(F.lit("q"), F.col("q").cast("string")).alias("set_lang"))
    known = docs.join(new, "doc_id", "left").select("doc_id", F.coalesce("set_lang", "lang").alias("lang"), F.when(F.col("set_lang").isNotNull(), "overridden").otherwise("kept").alias("status"))
    unknown = new.join(docs, "doc_id", "left_anti").select("doc_id", F.col("set_lang").alias("lang"), F.lit("unknown").alias("status"))
    return known.unionByName(unknown)


def sidecar_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of cases against those a sidecar lists: missing, extra, or citing what doesn't exist."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("point", "text"))
    wanted = items.select("item_id", "point").where("(item_id + point) % 9 <> 4")
    sidecar = items.where("(item_id + point) % 7 <> 3").select("item_id", "point", (F.col("item_id") * 400 + F.col("point")).alias("doc_id"), F.lit(True).alias("listed"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("exists"))
    both = wanted.withColumn("wanted", F.lit(True)).join(sidecar, ["item_id", "point"], "full_outer").join(docs, "doc_id", "left")
    issue = F.when(F.col("listed").isNull(), "point_missing").when(F.col("wanted").isNull(), "point_unknown").when(F.col("exists").isNull(), "evidence_unknown")
    return both.select("item_id", F.col("point").cast("long").alias("point"), issue.alias("issue")).where("issue is not null")


QUERIES = {
    f.__name__: f
    for f in (
        context_validity, eligible_chunks, canonical_evidence, fact_documents, keyword_groups, private_paths, refusal_expectations, review_queue,
        seed_expansion, hit_and_coverage, answer_composition, turn_completeness, falling_totals, headings_filled, latest_reports, first_cases,
        vector_contract, normalized_records, attribute_maps, lease_renewal, owned_upsert, review_decisions, field_overrides, sidecar_points,
    )
}

_CHUNKS = f"""
{SCOPED_SQL},
chunks AS (
  SELECT doc_id, tenant_id, shop_id, nth, line, CASE WHEN nth % 7 = 6 THEN 'internal_only' ELSE disclosure_class END AS disclosure_class,
         effective_from + CAST(nth % 3 AS INTEGER) AS effective_from, effective_to
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS nth FROM scoped))"""

ORACLE = {
    "context_validity": """
SELECT o_orderkey,
       c_mktsegment IS NOT NULL AND o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 4
       AND o_orderkey % 3 <> 2 AND (o_orderkey % 7 <> 0 OR o_orderkey % 5 < 2) AS valid
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "eligible_chunks": f"""
WITH {_CHUNKS},
cases AS (
  SELECT item_id AS case_id, tenant_id, shop_id, date '2024-01-10' + CAST(item_id % 40 AS INTEGER) AS day
  FROM benchmark JOIN scoped ON doc_id = item_id)
SELECT case_id, count(*) AS chunks, count(DISTINCT c.doc_id) AS documents
FROM cases k JOIN scoped s ON s.tenant_id = k.tenant_id AND s.shop_id = k.shop_id AND s.effective_from <= day AND (s.effective_to IS NULL OR day < s.effective_to)
JOIN chunks c ON c.doc_id = s.doc_id AND c.disclosure_class = 'external_allowed' AND c.effective_from <= day AND (c.effective_to IS NULL OR day < c.effective_to)
GROUP BY 1""",
    "canonical_evidence": f"""
WITH {_CHUNKS}
SELECT doc_id, nth AS "at", doc_id % 4 <> 0 AS canonical FROM chunks
WHERE nth < 3 AND doc_id % 6 > 1 AND doc_id % 5 <> 0 AND disclosure_class = 'external_allowed'""",
    "fact_documents": """
SELECT doc_id, bool_or(regexp_matches(line, '[0-9]')) AS in_facts, bool_or(NOT regexp_matches(line, '[0-9]')) AS in_knowledge
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""",
    "keyword_groups": """
SELECT conv_id, turn, CASE WHEN lower(text) LIKE '%tion%' OR lower(text) LIKE '%return%' THEN 'shipping' WHEN lower(text) LIKE '%ount%' THEN 'bottle'
  WHEN lower(text) LIKE '%ther%' THEN 'towel' WHEN lower(text) LIKE '%may%' OR lower(text) LIKE '%can%' THEN 'safety' END AS topic
FROM conversations WHERE role = 'user'""",
    "private_paths": r"""
WITH p AS (
  SELECT page_id, ['', 'data/synthetic/', 'Docs/', 'src/', 'a/.ssh/'][1 + page_id % 5]
    || regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/+$', '')
    || ['', '.md', '/.env', '.env.example', '/id_rsa.pub', '.py', '.LOG', '/README.md', '-chat_history.json'][1 + page_id % 9] AS path FROM pages)
SELECT page_id, path,
       page_id % 5 IN (2, 4) OR page_id % 9 IN (2, 4, 6, 8)
       OR (page_id % 9 IN (1, 7) AND page_id % 5 <> 1 AND path NOT IN ('README.md', 'eval/README.md', 'data/web/README.md')) AS private
FROM p""",
    "refusal_expectations": "SELECT item_id, item_id % 4 = 0 OR item_id % 3 = 0 AS refusal FROM benchmark",
    "review_queue": """
WITH q AS (
  SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 3 END::BIGINT AS rank
  FROM orders ORDER BY rank, o_orderdate, o_orderkey LIMIT 100),
l AS (
  SELECT l_orderkey, '[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS returned
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, rank, n_name, r_name, coalesce(returned, '[]') AS returned
FROM q JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN l ON l_orderkey = o_orderkey""",
    "seed_expansion": "SELECT r_name, role FROM region CROSS JOIN (VALUES ('owner'), ('operator'), ('viewer')) AS v(role)",
    "hit_and_coverage": """
WITH c AS (
  SELECT l_orderkey, coalesce(list(DISTINCT l_partkey) FILTER (l_linenumber <= 3), []) AS e, coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag <> 'N'), []) AS f
  FROM lineitem GROUP BY 1)
SELECT l_orderkey % 10 AS part, count(*) AS cases, avg((len(list_intersect(e, f)) > 0)::INTEGER) AS hit_rate, avg(len(list_intersect(e, f)) / len(e)) AS coverage_rate
FROM (SELECT * FROM c WHERE len(e) > 0) GROUP BY 1""",
    "turn_completeness": """
SELECT conv_id, count(*) AS turns, min(turn) AS first, max(turn) AS last FROM conversations WHERE conv_id % 5 > 0 OR turn <> 1
GROUP BY 1 HAVING list_sort(list(turn)) <> range(0, count(*))""",
    "falling_totals": """
SELECT * FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE value < before""",
    "headings_filled": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS nth FROM documents),
h AS (
  SELECT doc_id, last_value(CASE WHEN length(line) BETWEEN 1 AND 39 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS heading
  FROM l)
SELECT doc_id, count(*) AS lines, count(heading) AS headed, count(DISTINCT heading) AS headings FROM h GROUP BY 1""",
    "latest_reports": """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "first_cases": "SELECT * FROM benchmark ORDER BY item_id LIMIT 20",
    "vector_contract": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN embedding[1:3] ELSE embedding END::DOUBLE[] AS v FROM embeddings),
i AS (SELECT *, CASE WHEN len(v) <> (SELECT max(len(embedding)) FROM embeddings) THEN 'dimensions' ELSE 'ok' END AS issue FROM r)
SELECT a.vec_id, a.issue, CASE WHEN a.issue = 'ok' THEN round(1 - list_cosine_similarity(a.v, b.v), 5) END AS distance
FROM i a LEFT JOIN i b ON b.vec_id = a.vec_id + 1 AND b.issue = 'ok'""",
    "normalized_records": """
WITH r AS (
  SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END AS name FROM events),
v AS (
  SELECT *, CASE WHEN event_id % 11 = 0 THEN 1.0 WHEN event_id % 11 = 1 THEN NULL ELSE try_cast(k AS DOUBLE) END AS value FROM r)
SELECT event_id, coalesce(nullif(name, ''), nullif(k, ''), 'none') AS label, value, value IS NOT NULL AS valid FROM v""",
    "attribute_maps": """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'kind=even,' ELSE '' END || 'lang=' || lang || CASE WHEN n_chars > 500 THEN ',size=long' ELSE '' END || ',source=' || source AS attributes
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""",
    "lease_renewal": """
WITH l AS (
  SELECT user_id, event_id % 3 AS epoch, ts AS since FROM events WHERE event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_id, e.user_id, CASE WHEN l.user_id IS NULL THEN 'no_lease' WHEN event_id % 3 <> epoch THEN 'fenced'
  WHEN ts < since OR ts >= since + INTERVAL 6 HOUR THEN 'expired' ELSE 'renewed' END AS outcome
FROM events e LEFT JOIN l ON l.user_id = e.user_id WHERE event_type <> 'signup'""",
    "owned_upsert": """
SELECT o_orderkey, o_custkey AS owner, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 8 <> 0 THEN 1.0 ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 2 <> 0 THEN 'unchanged' WHEN o_orderkey % 8 = 0 THEN 'conflict' ELSE 'updated' END AS outcome
FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN -1 ELSE o_custkey END, 1.0, 'inserted' FROM orders WHERE o_orderkey % 6 = 0""",
    "review_decisions": """
SELECT doc_id,
       CASE WHEN doc_id % 5 = 0 THEN 'approved' WHEN doc_id % 2 <> 0 OR doc_id % 7 = 0 THEN 'needs_review' WHEN doc_id % 3 = 0 THEN 'rejected' ELSE 'approved' END AS state,
       CASE WHEN doc_id % 2 <> 0 THEN 'undecided' WHEN doc_id % 5 = 0 THEN 'not_reviewable' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'decided' END AS outcome
FROM documents""",
    "field_overrides": """
WITH n AS (SELECT 2 * doc_id AS doc_id, 'q' || max(quality) AS lang FROM labels GROUP BY 1)
SELECT d.doc_id, coalesce(n.lang, d.lang) AS lang, CASE WHEN n.lang IS NOT NULL THEN 'overridden' ELSE 'kept' END AS status FROM documents d LEFT JOIN n USING (doc_id)
UNION ALL SELECT doc_id, lang, 'unknown' FROM n WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "sidecar_points": """
WITH p AS (SELECT item_id, unnest(range(0, len(string_split(text, '. ')))) AS point FROM benchmark)
SELECT item_id, point, CASE WHEN (item_id + point) % 7 = 3 THEN 'point_missing' WHEN (item_id + point) % 9 = 4 THEN 'point_unknown' ELSE 'evidence_unknown' END AS issue
FROM p WHERE NOT ((item_id + point) % 7 = 3 AND (item_id + point) % 9 = 4)
  AND ((item_id + point) % 7 = 3 OR (item_id + point) % 9 = 4 OR item_id * 400 + point NOT IN (SELECT doc_id FROM documents))""",
}
