"""Queries on signed contexts, permission revisions, resumed batches and windows in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import alignment as A
from millrace.operators import changes as C
from millrace.operators import signing as S
from millrace.operators.intervals import interval_totals
from millrace.sources.derive import SCOPED_SQL, scoped_documents
from millrace.sources.store import shared_path, stored
from millrace.sources.tables import table
from millrace.streaming import resume as R


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("tenant_id"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey")
    return rows.select("tenant_id", F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"), "c_acctbal", F.concat(F.lit("auth-"), F.col("c_custkey") % 9).alias("permission_revision"))


def readable_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as executions, by tenant: how many can still be read after users were revoked, grants were
    added and removed, and shops closed."""
    users = _users(spark, sf_dir)
    before = users.withColumn("revoked", F.col("c_acctbal") < 0)
    after = users.withColumn("revoked", F.col("c_acctbal") < 500).withColumn("role", F.when(F.col("user_id") % 50 == 0, "admin").otherwise(F.col("role")))
    after = after.withColumn("permission_revision", F.when(F.col("user_id") % 100 == 0, "auth-given").otherwise(F.col("permission_revision")))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("shop_id"), F.col("n_regionkey").alias("tenant_id"))
    grants = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("shop_id")).select("tenant_id", F.col("s_suppkey").alias("acl_id"), "s_acctbal")
    grants = grants.where("tenant_id IN (1, 3)")
    feeds = [
        C.Watch("app_user", ("user_id",), ("role", "revoked"), "app_user_changed", ("update",), "user_id", "permission_revision").feed(before, after),
        C.Watch("acl", ("acl_id",), ("s_acctbal",), "acl_changed").feed(grants.where("tenant_id = 1"), grants.where("tenant_id = 1 AND s_acctbal > 0")),
        C.Watch("shop", ("shop_id",), ("status",), "shop_status_changed", ("update",)).feed(nation.withColumn("status", F.lit("open")), nation.withColumn("status", F.when(F.col("shop_id") == 4, "closed").otherwise("open"))),
    ]
    now = C.revised(after.select("tenant_id", "user_id", "permission_revision"), feeds)
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    runs = runs.join(before.select("tenant_id", "user_id", "permission_revision"), "user_id")
    out = C.readable(runs, now).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("executions"), F.count_if("readable").alias("readable"))
    return out.join(now.groupBy("tenant_id").agg(F.sum("own_changes").alias("own_changes"), F.max("tenant_changes").alias("tenant_changes")), "tenant_id")


def signed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's HMAC under keys of several lengths."""
    items = table(spark, sf_dir, "benchmark").withColumn("key", F.repeat(F.concat(F.lit("k"), F.col("item_id")), (F.col("item_id") % 40).cast("int")))
    return items.select("item_id", F.octet_length("key").cast("long").alias("key_bytes"), S.hmac_sha256(F.col("key"), F.col("text")).alias("mac"))


def batch_resume_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over orders in batches of ten whose records went wrong: what is found of each rule."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("run"), F.col("o_orderkey").alias("case"))
    plan = R.planned_batches(orders, "run", "case", 10)
    run, batch = F.col("run"), F.col("batch")
    records = plan.where((run != 2) | (batch != 2)).withColumn("requests", batch * 10 - F.when((run == 5) & (batch == 3), 25).otherwise(0))
    records = records.withColumn("cost", F.col("requests") + (run == 6).cast("long")).withColumn("ids_hash", F.when(run == 3, F.reverse("ids_hash")).otherwise(F.col("ids_hash")))
    records = records.where((run != 4) | (batch < 3)).select("run", "batch", "ids_hash", "requests", "cost")
    heads = records.groupBy("run").agg(F.max("requests").alias("requests")).withColumn("requests", F.col("requests") + F.when(run == 7, 5).when(run == 8, -5).otherwise(0))
    heads = heads.select("run", F.when(run == 9, "PAUSED").when(run.isin(10, 11), "RUNNING").otherwise("COMPLETE").alias("status"), "requests", (F.col("requests") + (run == 12).cast("long")).alias("cost"), F.when(run.isin(11, 13), 1).cast("long").alias("active_batch"), F.when(run == 11, 7).cast("long").alias("active_requests"))
    return R.record_issues(heads, records, plan).groupBy("run", "issue").agg(F.count(F.lit(1)).alias("found"))


def windows_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day of a customer segment's orders how many of the segment's offers hold: windows of
    which many are long, summed up by pieces."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    days = orders.select("segment", F.to_date("o_orderdate").alias("day")).distinct()
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 13 % 2400).cast("int"))
    offers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey", F.when(F.col("c_custkey") % 11 != 0, start).alias("since"), F.when(F.col("c_custkey") % 7 != 0, F.date_add(start, (F.col("c_custkey") % 300).cast("int"))).alias("until"))
    found = interval_totals(days, offers, ["segment"], "day", "since", "until", "offers", {"ids": "c_custkey"})
    return found.select("segment", F.date_format("day", "yyyy-MM-dd").alias("day"), "offers", "ids")


def corpus_rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of JSON, a hundred ids to a corpus, with fields harmed in the text: every issue."""
    docs = scoped_documents(spark, sf_dir)
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')), F.lit("null"))
    policy = F.concat(*(x for c in ("tenant_id", "shop_id", "disclosure_class", "effective_from", "effective_to") for x in (F.lit(f'"{c}":'), quoted(c), F.lit(","))))
    chunk = lambda n: F.concat(F.lit("{"), policy, F.lit('"chunk_id":"c'), F.col("doc_id"), F.lit(f'-{n}","source_position":{{"n":{n}}}}}'))
    whole = F.concat(F.lit("{"), policy, F.lit('"document_id":"d'), F.col("doc_id"), F.lit('","chunks":['), chunk(1), F.lit(","), chunk(2), F.lit("]}"))
    docs = docs.select("doc_id", whole.alias("json"))
    harmed = F.when(F.lit(False), "")
    for k, (old, new) in enumerate(HARM):
        harmed = harmed.when(F.col("doc_id") % 37 == 2 * k, F.regexp_replace("json", old, new))
    lines = docs.select(F.floor(F.col("doc_id") / 100).alias("artifact_id"), F.col("doc_id").alias("line"), harmed.otherwise(F.col("json")).alias("json"))
    # A corpus is a table that many rules read, not an expression to be computed for each.
    return A.corpus_issues(stored(lines, shared_path(spark, "corpus")))


#: Patterns and what they become, for ids with remainders 0, 2, 4 and so on of 37.
HARM = [
    ('^[{]"tenant_id":"[a-z]*"', '{"tenant_id":7'), ('"document_id":"d[0-9]*"', '"document_id":"d1"'), ('"chunk_id":"c[0-9]*-2"', '"chunk_id":"c-2"'), ('"chunks":.*$', '"chunks":{}}'),
    ('"source_position":[{]"n":1[}]', '"source_position":{}'), ('"effective_from":"2024', '"effective_from":"24'), ('"chunks":.*$', '"chunks":[3,{}]}'), ("[}]$", ""),
    ('"document_id":"d[0-9]*"', '"document_id":null'), ('"disclosure_class":"[a-z_]*","effective_from":"([0-9-]*)","effective_to":[^,]*,', '"disclosure_class":"none","effective_from":"$1","effective_to":"$1",'),
    ('"shop_id":"[a-z0-9]*",("disclosure_class":"[a-z_]*","effective_from":"[0-9-]*","effective_to":[^,]*,"chunk_id":"c[0-9]*-1")', '"shop_id":"other",$1'), ('"chunk_id":"c[0-9]*-1"', '"chunk_id":""'),
]

QUERIES = {f.__name__: f for f in (corpus_rule_issues, readable_executions, signed_contexts, batch_resume_issues, windows_in_force)}

_POLICY = """'"tenant_id":' || coalesce('"' || tenant_id || '"', 'null') || ',"shop_id":' || coalesce('"' || shop_id || '"', 'null') || ',"disclosure_class":"' || disclosure_class
  || '","effective_from":"' || effective_from || '","effective_to":' || coalesce('"' || effective_to || '"', 'null') || ',' """
_HARMED = " ".join(f"WHEN doc_id % 37 = {2 * k} THEN regexp_replace(whole, '{old}', '{new.replace('$', chr(92))}', 'g')" for k, (old, new) in enumerate(HARM))
_DAY = "CASE WHEN json_type({0}, '$.{1}') = 'VARCHAR' AND regexp_full_match({0}->>'$.{1}', '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({0}->>'$.{1}' AS DATE) END"
_UNDATED = "({0}->>'$.{1}' IS NOT NULL AND " + _DAY + " IS NULL)"


def _policy_rules(value: str, prefix: str) -> str:
    days = [_DAY.format(value, f) for f in ("effective_from", "effective_to")]
    undated = [_UNDATED.format(value, f) for f in ("effective_from", "effective_to")]
    known = f"json_type({value}, '$.disclosure_class') = 'VARCHAR' AND ({value}->>'$.disclosure_class') IN ('external_allowed', 'internal_only', 'unclassified')"
    return f"""CASE WHEN NOT coalesce({known}, false) THEN '{prefix}_disclosure_class_invalid' END, CASE WHEN {undated[0]} OR {undated[1]} THEN '{prefix}_date_invalid' END,
    CASE WHEN {days[0]} >= {days[1]} THEN '{prefix}_date_range_invalid' END"""


ORACLE = {
    "corpus_rule_issues": f"""
WITH {SCOPED_SQL},
w AS (
  SELECT doc_id, '{{' || {_POLICY} || '"document_id":"d' || doc_id || '","chunks":[{{' || {_POLICY} || '"chunk_id":"c' || doc_id || '-1","source_position":{{"n":1}}}},{{'
         || {_POLICY} || '"chunk_id":"c' || doc_id || '-2","source_position":{{"n":2}}}}]}}' AS whole FROM scoped),
t AS (SELECT doc_id // 100 AS artifact_id, doc_id AS line, CASE {_HARMED} ELSE whole END AS json FROM w),
j AS (SELECT artifact_id, line, CASE WHEN json_valid(json) THEN json::JSON END AS v FROM t),
i AS (
  SELECT *, CASE WHEN json_type(v, '$.document_id') = 'VARCHAR' THEN nullif(v->>'$.document_id', '') END AS id FROM j),
n AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, id ORDER BY line) AS nth FROM i),
d AS (SELECT * FROM n WHERE id IS NOT NULL AND nth = 1),
e AS (SELECT artifact_id, line, id, v, unnest(range(0, json_array_length(v, '$.chunks')::BIGINT)) AS pos FROM d WHERE json_type(v, '$.chunks') = 'ARRAY'),
c AS (SELECT *, json_extract(v, '$.chunks[' || pos || ']') AS c, id || '/' || (pos + 1) AS path FROM e),
o AS (SELECT *, CASE WHEN json_type(c, '$.chunk_id') = 'VARCHAR' THEN nullif(c->>'$.chunk_id', '') END AS chunk_id FROM c WHERE json_type(c) = 'OBJECT'),
q AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, chunk_id ORDER BY line, pos) AS again FROM o),
x AS (
  SELECT artifact_id, line::VARCHAR AS path, CASE WHEN v IS NULL THEN 'json_input_invalid' WHEN id IS NULL THEN 'corpus_document_id_invalid' END AS code FROM i
  UNION ALL SELECT artifact_id, id, 'duplicate_corpus_document_id' FROM n WHERE id IS NOT NULL AND nth > 1
  UNION ALL SELECT artifact_id, id, unnest([
    CASE WHEN NOT coalesce(json_type(v, '$.tenant_id') = 'VARCHAR' AND v->>'$.tenant_id' <> '' AND json_type(v, '$.shop_id') = 'VARCHAR' AND v->>'$.shop_id' <> '', false) THEN 'corpus_scope_invalid' END,
    {_policy_rules("v", "corpus_document")}, CASE WHEN json_type(v, '$.chunks') IS DISTINCT FROM 'ARRAY' THEN 'corpus_chunks_invalid' END]) FROM d
  UNION ALL SELECT artifact_id, path, 'corpus_chunk_invalid' FROM c WHERE json_type(c) <> 'OBJECT'
  UNION ALL SELECT artifact_id, chunk_id, 'duplicate_corpus_chunk_id' FROM q WHERE chunk_id IS NOT NULL AND again > 1
  UNION ALL SELECT artifact_id, path, unnest([
    CASE WHEN chunk_id IS NULL THEN 'corpus_chunk_id_invalid' END,
    CASE WHEN nullif(c->'$.tenant_id', 'null') IS DISTINCT FROM nullif(v->'$.tenant_id', 'null') OR nullif(c->'$.shop_id', 'null') IS DISTINCT FROM nullif(v->'$.shop_id', 'null') THEN 'corpus_chunk_scope_mismatch' END,
    {_policy_rules("c", "corpus_chunk")},
    CASE WHEN NOT coalesce(json_type(c, '$.source_position') = 'OBJECT' AND c->>'$.source_position' <> '{{}}', false) THEN 'corpus_chunk_source_position_invalid' END]) FROM q
  UNION ALL SELECT artifact_id, path || '/' || f, 'corpus_chunk_policy_mismatch' FROM q, unnest(['disclosure_class', 'effective_from', 'effective_to']) AS t(f)
    WHERE nullif(json_extract(c, '$.' || f), 'null') IS DISTINCT FROM nullif(json_extract(v, '$.' || f), 'null'))
SELECT artifact_id, path, code FROM x WHERE code IS NOT NULL""",
    "readable_executions": """
WITH u AS (SELECT c_custkey AS u, n_regionkey AS t, c_mktsegment AS role, c_acctbal AS b FROM customer JOIN nation ON n_nationkey = c_nationkey),
k AS (
  SELECT u, t, u % 100 = 0 AS by_hand, u % 100 <> 0 AND ((b < 0) <> (b < 500) OR (u % 50 = 0 AND role IS DISTINCT FROM 'admin')) AS own FROM u),
a AS (SELECT count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1 AND NOT s_acctbal > 0),
c AS (SELECT r_regionkey AS t, CASE WHEN r_regionkey = 1 THEN (SELECT n FROM a) ELSE 0 END + (SELECT count(*) FROM nation WHERE n_nationkey = 4 AND n_regionkey = r_regionkey) AS n FROM region),
e AS (SELECT k.t, NOT by_hand AND NOT own AND c.n = 0 AS readable FROM orders JOIN k ON u = o_custkey JOIN c ON c.t = k.t)
SELECT e.t::VARCHAR AS tenant_id, count(*) AS executions, count(*) FILTER (readable) AS readable,
       (SELECT count(*) FILTER (own) FROM k WHERE k.t = e.t) AS own_changes, (SELECT n FROM c WHERE c.t = e.t)::BIGINT AS tenant_changes
FROM e GROUP BY e.t""",
    # The definition once more, on hex digits: keys over a block are hashed, pads are exclusive-or.
    "signed_contexts": """
WITH k AS (SELECT item_id, text, repeat('k' || item_id, (item_id % 40)::INTEGER) AS key FROM benchmark),
p AS (SELECT *, rpad(CASE WHEN strlen(key) > 64 THEN sha256(key) ELSE lower(hex(encode(key))) END, 128, '0') AS h FROM k),
b AS (SELECT *, list_transform(range(0, 64), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INTEGER) AS v FROM p),
x AS (SELECT *, array_to_string(list_transform(v, lambda n: printf('%02x', xor(n, 54))), '') AS ipad, array_to_string(list_transform(v, lambda n: printf('%02x', xor(n, 92))), '') AS opad FROM b)
SELECT item_id, strlen(key) AS key_bytes, sha256(unhex(opad) || unhex(sha256(unhex(ipad) || encode(text)))) AS mac FROM x""",
    "batch_resume_issues": """
WITH o AS (SELECT o_custkey % 40 AS run, (row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1) // 10 + 1 AS batch FROM orders),
p AS (SELECT run, batch FROM o GROUP BY run, batch),
n AS (SELECT run, max(batch) AS n FROM p GROUP BY run),
r AS (SELECT run, batch, batch * 10 - CASE WHEN run = 5 AND batch = 3 THEN 25 ELSE 0 END AS q FROM p WHERE (run <> 2 OR batch <> 2) AND (run <> 4 OR batch < 3)),
d AS (SELECT run, count(*) AS done, max(q) AS spent, max(batch) AS last FROM r GROUP BY run),
i AS (
  SELECT run, 'completed_batches_not_prefix' AS issue FROM r WHERE run = 2 AND batch > 2
  UNION ALL SELECT run, 'batch_ids_mismatch' FROM r WHERE run = 3
  UNION ALL SELECT run, 'batch_budget_invalid' FROM r WHERE (run = 5 AND batch = 3) OR run = 6
  UNION ALL SELECT run, 'complete_batch_count_invalid' FROM d JOIN n USING (run) WHERE run NOT IN (9, 10, 11) AND done <> n
  UNION ALL SELECT run, 'complete_budget_mismatch' FROM d WHERE run IN (7, 8)
  UNION ALL SELECT run, 'request_count_mismatch' FROM d WHERE run = 8
  UNION ALL SELECT run, 'status_invalid' FROM d WHERE run = 9
  UNION ALL SELECT run, 'running_batch_count_invalid' FROM d JOIN n USING (run) WHERE run IN (10, 11) AND done = n
  UNION ALL SELECT run, 'active_batch_mismatch' FROM d WHERE run = 11 AND done <> 0
  UNION ALL SELECT run, 'active_batch_budget_mismatch' FROM d WHERE run = 11
  UNION ALL SELECT run, 'active_batch_unexpected' FROM d WHERE run = 13
  UNION ALL SELECT run, 'cost_units_mismatch' FROM d WHERE run = 12)
SELECT run, issue, count(*) AS found FROM i GROUP BY run, issue""",
    "windows_in_force": """
WITH d AS (SELECT DISTINCT c_mktsegment AS segment, o_orderdate::DATE AS day FROM orders JOIN customer ON c_custkey = o_custkey),
w AS (SELECT c_mktsegment AS segment, c_custkey, date '1995-01-01' + (c_custkey * 13 % 2400)::INTEGER AS s FROM customer)
SELECT d.segment, strftime(day, '%Y-%m-%d') AS day, count(*) AS offers, sum(c_custkey)::BIGINT AS ids
FROM d JOIN w ON d.segment = w.segment AND (c_custkey % 11 = 0 OR s <= day) AND (c_custkey % 7 = 0 OR s + (c_custkey % 300)::INTEGER > day) GROUP BY 1, 2""",
}
