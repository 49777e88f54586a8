"""Queries on documents and pages: scopes, tokens, hashes, text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import scope as S
from millrace.operators.postings import shop_fingerprints
from millrace.operators.snapshots import import_status
from millrace.sources.derive import SCOPED_SQL, scoped_documents
from millrace.sources.tables import table

SHOPS = ("src1", "src2", "src3", "src4")
SHOP_LIST = ", ".join(f"'{s}'" for s in SHOPS)


def scope_filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = S.Scope(tenant="en", shops=SHOPS, role="viewer", on="2024-02-01")
    return S.in_scope(scoped_documents(spark, sf_dir), scope).select("doc_id", "tenant_id", "shop_id", "disclosure_class")


def policy_assess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = [(1, "en", "src1", "viewer", "2024-01-20"), (2, "en", "src2", "admin", "2024-02-20"), (3, "de", "src3", "owner", None)]
    asked = spark.createDataFrame(requests, "request_id int, tenant_id string, shop_id string, role string, on string")
    asked = asked.withColumn("on", F.col("on").cast("date"))
    return S.assess(scoped_documents(spark, sf_dir), asked)


def date_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.lit("2024-02-10").cast("date")
    state = S.date_state(on, F.col("effective_from"), F.col("effective_to"))
    return scoped_documents(spark, sf_dir).groupBy("shop_id", state.alias("state")).agg(F.count(F.lit(1)).alias("documents"))


def acl_gate_authorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    shops = nations.where("n_nationkey < 12").select(F.lit("shop").alias("level"), F.concat(F.lit("src"), F.col("n_nationkey")).alias("resource"), F.col("n_regionkey").alias("principal"), (F.col("n_nationkey") % 3 != 0).alias("granted"))
    docs = table(spark, sf_dir, "documents")
    own = docs.where("doc_id % 7 = 0").select(F.lit("document").alias("level"), F.col("doc_id").cast("string").alias("resource"), (F.col("doc_id") % 5).cast("int").alias("principal"), F.lit(True).alias("granted"))
    found = S.through_gates(docs.select("doc_id", "source"), shops.unionByName(own), {"shop": "source", "document": "doc_id"})
    return found


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"), X.token_count(F.col("text")).alias("n_words"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.col("n_words").cast("long").alias("n_words"), F.md5(F.array_join(F.sort_array("t"), " ").cast("binary")).alias("tokens_md5"))


def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", X.script_profile(F.col("text")).alias("profile")).agg(F.count(F.lit(1)).alias("documents"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kinds = X.secret_kinds(F.col("text"))
    return docs.select("doc_id", *(c.alias(k) for k, c in kinds.items()))


def object_keys_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2("text", 256)
    key = X.object_key(F.col("lang"), F.col("source"), X.version_id(digest, "p1"), "raw", digest)
    return docs.select("doc_id", key.alias("object_key")).withColumn("valid", X.valid_object_key(F.col("object_key")))


def fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash for each shop over its documents in order, so that an index is rebuilt only if it changed."""
    return shop_fingerprints(table(spark, sf_dir, "documents"), "source", "doc_id", "text").withColumnRenamed("shop", "shop_id")


def import_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 3 < 2").select("doc_id", F.md5("text").alias("content_hash"), F.md5("source").alias("meta_hash"))
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    new = docs.select("doc_id", F.md5(changed).alias("content_hash"), F.md5("source").alias("meta_hash"))
    return import_status(old, new, "doc_id")


def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.short_hash(F.col("text")).alias("short_hash"), X.title(F.col("text")).alias("title"))


def answer_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    flags = [F.col("text").rlike(X.marker_pattern(words)).alias(kind) for kind, words in X.MARKERS.items()]
    return turns.select("conv_id", "turn", *flags)


def mock_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", X.mock_embedding(F.col("text"), 64).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return items.select("item_id", F.size("v").cast("long").alias("dims"), F.round(total, 6).alias("total"), F.round(F.element_at("v", 2), 6).alias("second"))


def page_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = X.page_text(F.col("html"))
    return pages.select("page_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("sha256"))


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", X.normalized_url(F.col("url")).alias("url"))
    path = F.regexp_extract("url", "^https?://[^/]+([^?]*)", 1)
    return pages.withColumn("allowed", F.coalesce(X.allowed_path(path, ["/en", "/de/"]), F.lit(False)))


def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs, some with ports, users or fragments, under the policy of one source."""
    f, url = F.col("page_id") % 9, F.col("url")
    changed = F.when(f == 1, F.regexp_replace(url, "^(https?://[^/]+)", "$1:8080")).when(f == 2, F.regexp_replace(url, "^(https?://[^/]+)", "$1:443")).when(f == 3, F.concat(url, F.lit("#top"))).when(f == 4, F.regexp_replace(url, "^(https?://)", "$1me@")).otherwise(url)
    host = F.regexp_extract(url, "^https?://([^/?#]+)", 1)
    hosts = [r[0] for r in table(spark, sf_dir, "pages").select(host.alias("h")).distinct().orderBy("h").limit(2).collect()]
    return table(spark, sf_dir, "pages").select("page_id", X.url_decision(changed, [h.upper() + "." for h in hosts], ["/en", "/de/", "/2024"]).alias("decision"))


def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored once for each host and content; ``copies`` of a content share its first page."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"))
    return pages.groupBy("host", "sha256").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies"), (F.min("size") != F.max("size")).alias("conflict"))


def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^https?://[^/]+/?(.*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), X.safe_path(path).alias("safe"))


def query_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.trim("text")
    facts = F.lower(text).rlike("price|stock|order|价格|库存|订单")
    route = F.when(F.length(text) <= 2, "clarification").when(facts, "query").otherwise("knowledge")
    return table(spark, sf_dir, "conversations").groupBy("role", route.alias("intent")).agg(F.count(F.lit(1)).alias("turns"))


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by what a Markdown reader takes them for."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.trim("line")
    kind = (
        F.when(line == "", "blank").when(F.col("line").rlike(r"^#{1,6}\s+\S"), "heading").when(F.col("line").rlike(r"^\s*```"), "fence")
        .when(line.rlike(r"^\|.*\|$"), "table").when(F.col("line").rlike(r"^\s*([-*+]|[0-9]+[.)])\s+"), "list").otherwise("text")
    )
    return lines.groupBy("doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_lines"))


QUERIES = {
    f.__name__: f
    for f in (
        scope_filter_documents, policy_assess_documents, date_states, acl_gate_authorized, tokenize_documents, script_profile, secret_scan,
        object_keys_hash, fingerprint_index, import_states, document_digests, answer_markers, mock_embeddings, page_text_extract, url_normalize, url_policy,
        snapshot_store, safe_paths, query_routing, line_kinds,
    )
}

_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))"



ORACLE = {
    "scope_filter_documents": f"""
WITH {SCOPED_SQL}
SELECT doc_id, tenant_id, shop_id, disclosure_class FROM scoped
WHERE tenant_id = 'en' AND shop_id IN ({SHOP_LIST}) AND disclosure_class = 'external_allowed'
  AND effective_from <= date '2024-02-01' AND (effective_to IS NULL OR effective_to > date '2024-02-01')""",
    "policy_assess_documents": f"""
WITH {SCOPED_SQL},
req(request_id, tenant_id, shop, role, d) AS (
  VALUES (1, 'en', 'src1', 'viewer', date '2024-01-20'), (2, 'en', 'src2', 'admin', date '2024-02-20'), (3, 'de', 'src3', 'owner', CAST(NULL AS date)))
SELECT r.request_id, s.doc_id,
  CASE WHEN effective_to <= effective_from THEN 'INVALID_POLICY' WHEN d IS NULL THEN 'INVALID_BUSINESS_DATE'
       WHEN s.shop_id IS DISTINCT FROM r.shop THEN 'SCOPE_MISMATCH' WHEN d < effective_from THEN 'NOT_YET_EFFECTIVE'
       WHEN d >= effective_to THEN 'EXPIRED_OR_REVOKED'
       WHEN disclosure_class = 'external_allowed' OR (disclosure_class = 'internal_only' AND role IN ('admin', 'owner')) THEN 'ELIGIBLE'
       WHEN disclosure_class = 'unclassified' THEN 'UNCLASSIFIED_BLOCKED' ELSE 'ACCESS_DENIED' END AS status
FROM req r JOIN scoped s ON s.tenant_id = r.tenant_id""",
    "date_states": f"""
WITH {SCOPED_SQL}
SELECT shop_id, CASE WHEN date '2024-02-10' < effective_from THEN 'not_yet_effective' WHEN date '2024-02-10' >= effective_to THEN 'expired_or_revoked' ELSE 'active' END AS state,
       count(*) AS documents FROM scoped GROUP BY 1, 2""",
    "acl_gate_authorized": """
WITH a AS (
  SELECT 'shop' AS level, 'src' || n_nationkey AS resource, n_regionkey AS principal, n_nationkey % 3 <> 0 AS granted FROM nation WHERE n_nationkey < 12
  UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), CAST(doc_id % 5 AS INTEGER), true FROM documents WHERE doc_id % 7 = 0),
d AS (
  SELECT doc_id, source, source IN (SELECT resource FROM a WHERE level = 'shop') AS by_shop,
         CAST(doc_id AS VARCHAR) IN (SELECT resource FROM a WHERE level = 'document') AS by_document FROM documents),
p AS (SELECT DISTINCT principal FROM a)
SELECT NULL::INTEGER AS principal, doc_id FROM d WHERE NOT coalesce(by_shop, false) AND NOT by_document
UNION ALL
SELECT p.principal, d.doc_id FROM d, p
WHERE (by_shop OR by_document)
  AND (NOT coalesce(by_shop, false) OR EXISTS (SELECT 1 FROM a WHERE level = 'shop' AND resource = d.source AND a.principal = p.principal AND granted))
  AND (NOT by_document OR EXISTS (SELECT 1 FROM a WHERE level = 'document' AND resource = CAST(d.doc_id AS VARCHAR) AND a.principal = p.principal AND granted))""",
    "tokenize_documents": f"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS n_words,
       md5(array_to_string(list_sort(t), ' ')) AS tokens_md5
FROM (SELECT doc_id, text, {_TOKENS} AS t FROM documents)""",
    "script_profile": """
SELECT lang, CASE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed'
                  WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'other' END AS profile,
       count(*) AS documents FROM documents GROUP BY 1, 2""",
    "secret_scan": r"""
SELECT doc_id, regexp_matches(text, '-----BEGIN (OPENSSH |RSA |EC )?PRIVATE KEY-----') AS private_key,
       regexp_matches(text, '(sk-[A-Za-z0-9._-]{24}|LTAI[A-Za-z0-9]{16}|tvly-[A-Za-z0-9_-]{24})') AS token,
       len(list_filter(regexp_extract_all(text, '\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b'), lambda u: u <> '00000000-0000-0000-0000-000000000000')) > 0 AS uuid,
       regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])[A-Z]:[/\\][A-Za-z0-9_]') AS drive_path,
       len(list_filter(string_split_regex(text, '[^A-Za-z0-9_.]+'), lambda a:
         regexp_full_match(a, '(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}') AND list_max(list_transform(string_split(a, '.'), lambda x: TRY_CAST(x AS INTEGER))) <= 255
         AND a <> '0.0.0.0' AND NOT regexp_matches(a, '^(192\.0\.2|198\.51\.100|203\.0\.113|127\.\d+\.\d+)\.'))) > 0 AS address
FROM documents""",
    "object_keys_hash": """
SELECT doc_id, k AS object_key, regexp_matches(k, '^[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*/raw/[0-9a-f]{64}$') AS valid
FROM (SELECT doc_id, concat_ws('/', lang, source, 'v-' || substr(sha256(sha256(text) || 'p1'), 1, 16), 'raw', sha256(text)) AS k FROM documents)""",
    "fingerprint_index": """
WITH b AS (SELECT source, doc_id // 1000 AS k, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text), '|' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2),
m AS (SELECT source, k // 1000 AS k, sum(n) AS n, sha256(string_agg(k || ':' || h, '|' ORDER BY k)) AS h FROM b GROUP BY source, b.k // 1000),
g AS (SELECT source, k // 1000 AS k, sum(n) AS n, sha256(string_agg(k || ':' || h, '|' ORDER BY k)) AS h FROM m GROUP BY source, m.k // 1000)
SELECT source AS shop_id, sum(n)::BIGINT AS documents, sha256(string_agg(k || ':' || h, '|' ORDER BY k)) AS fingerprint FROM g GROUP BY 1""",
    "import_states": """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'IMPORTED' WHEN doc_id % 4 = 0 THEN 'UPDATED' ELSE 'IDEMPOTENT' END AS status FROM documents""",
    "document_digests": r"""
SELECT doc_id, CASE WHEN trim(text) <> '' THEN substr(sha256(text), 1, 12) END AS short_hash,
       substr(regexp_replace(trim(text), '\s+', ' ', 'g'), 1, 24) AS title FROM documents""",
    "answer_markers": r"""
SELECT conv_id, turn,
       regexp_matches(text, '(?i)(^|[^\pL\pN_])(no|not|never|cannot|must not|without)([^\pL\pN_]|$)') OR regexp_matches(text, '不得|不应|不能|不可|禁止|不允许|未|没有|不是') AS polarity,
       regexp_matches(text, '(?i)(^|[^\pL\pN_])(only|at least|at most|no more than|up to|within|except|unless|maximum|minimum)([^\pL\pN_]|$)') OR regexp_matches(text, '仅限|仅|只能|至少|最多|不超过|以内|除外|除非') AS scope,
       regexp_matches(text, '(?i)(^|[^\pL\pN_])(must|should|required|recommended|may|can)([^\pL\pN_]|$)') OR regexp_matches(text, '必须|应当|需要|建议|可以') AS modality,
       regexp_matches(text, '(?i)(^|[^\pL\pN_])(possibly|usually|generally|not guaranteed|cannot guarantee)([^\pL\pN_]|$)') OR regexp_matches(text, '可能|通常|一般|不一定|不保证|无法保证') AS uncertainty
FROM conversations""",
    "mock_embeddings": """
WITH v AS (SELECT item_id, list_transform(range(0, 64), lambda i: ('0x' || substr(sha256(text), CAST((i % 32) * 2 + 1 AS BIGINT), 2))::INTEGER::DOUBLE / 255 * 2 - 1) AS v FROM benchmark)
SELECT item_id, len(v)::BIGINT AS dims, round(list_sum(v), 6) AS total, round(v[2], 6) AS second FROM v""",
    "page_text_extract": r"""
SELECT page_id, length(t)::BIGINT AS n_chars, sha256(t) AS sha256
FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""",
    "url_policy": r"""
WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages ORDER BY h LIMIT 2),
p AS (SELECT page_id, page_id % 9 AS f, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_matches(url, '^https?://[^/?#@\s]+([/?][^#\s]*)?$') AS good FROM pages)
SELECT page_id, CASE WHEN f IN (3, 4) OR NOT good THEN 'invalid_url' WHEN host NOT IN (SELECT h FROM h) THEN 'host_not_allowed' WHEN f = 1 THEN 'port_not_allowed'
                     WHEN NOT (path IN ('/en', '/de/', '/2024') OR starts_with(path, '/en/') OR starts_with(path, '/de/') OR starts_with(path, '/2024/')) THEN 'path_not_allowed' ELSE 'allowed' END AS decision FROM p""",
    "url_normalize": r"""
WITH u AS (
  SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#@\s]+([/?][^#\s]*)?$') THEN
    regexp_extract(url, '^(https?)://', 1) || '://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '\.$', '')
    || CASE WHEN regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) END
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url
  FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|fbclid)')) AS q FROM pages))
SELECT page_id, url, coalesce(p = '/en' OR starts_with(p, '/en/') OR p = '/de/' OR starts_with(p, '/de/'), false) AS allowed
FROM (SELECT *, regexp_extract(url, '^https?://[^/]+([^?]*)', 1) AS p FROM u)""",
    "snapshot_store": """
SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, sha256(html) AS sha256, min(page_id) AS page_id, count(*) AS copies,
       min(strlen(html)) <> max(strlen(html)) AS conflict FROM pages GROUP BY 1, 2""",
    "safe_paths": r"""
SELECT page_id, p AS path, regexp_matches(p, '^[^/\\]+(/[^/\\]+)*$') AND NOT regexp_matches(p, '(^|/)\.\.(/|$)') AS safe
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/?(.*)$', 1) AS p FROM pages)""",
    "query_routing": """
SELECT role, CASE WHEN length(trim(text)) <= 2 THEN 'clarification' WHEN regexp_matches(lower(text), 'price|stock|order|价格|库存|订单') THEN 'query' ELSE 'knowledge' END AS intent,
       count(*) AS turns FROM conversations GROUP BY 1, 2""",
    "line_kinds": r"""
SELECT doc_id, CASE WHEN trim(l) = '' THEN 'blank' WHEN regexp_matches(l, '^#{1,6}\s+\S') THEN 'heading' WHEN regexp_matches(l, '^\s*```') THEN 'fence'
                    WHEN regexp_matches(trim(l), '^\|.*\|$') THEN 'table' WHEN regexp_matches(l, '^\s*([-*+]|[0-9]+[.)])\s+') THEN 'list' ELSE 'text' END AS kind,
       count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1, 2""",
}
