"""Control-plane queries: rollups over jobs, versions, conversations and requests, and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import snapshots as N
from millrace.sources.tables import table



def job_overview_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their items' counts by state; jobs without items stay with zeros."""
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate")
    counts = items.groupBy("l_orderkey").agg(
        F.count("*").alias("items"),
        F.count_if(F.col("l_returnflag") == "R").alias("failed"),
        F.count_if(F.col("l_linestatus") == "O").alias("open"),
        F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("last_done"),
    )
    out = jobs.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.groupBy("o_orderstatus").agg(
        F.count("*").alias("jobs"), F.sum(zero("items")).alias("items"), F.sum(zero("failed")).alias("failed"),
        F.sum(zero("open")).alias("open"), F.count_if(F.col("items").isNull()).alias("empty_jobs"), F.date_format(F.max("last_done"), "yyyy-MM-dd").alias("last_done"),
    )


def source_latest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its number of items and their latest date; 0 and null without any."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("latest"))
    out = table(spark, sf_dir, "supplier").join(items, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("items"), "latest")


def version_history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 latest of each customer's last order, with nation and region."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    last = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o"), F.count("*").alias("versions"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = last.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.select("o_custkey", F.col("o.o_orderkey").alias("o_orderkey"), F.date_format("o.o_orderdate", "yyyy-MM-dd").alias("latest"), "versions", "n_name", "r_name")
    return out.orderBy(F.desc("latest"), F.desc("o_orderkey")).limit(200)


def conversation_anti_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without a system turn, with the turns their users took."""
    turns = table(spark, sf_dir, "conversations")
    out = turns.join(turns.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti")
    return out.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"))


def history_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of a conversation's last six turns, the oldest first; blank ones are left out."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))).where("n <= 6")
    line = F.when(F.col("text").rlike(r"(?U)\S"), F.concat("role", F.lit(": "), "text"))
    rows = F.array_sort(F.collect_list(F.struct(-F.col("n"), line.alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("history"))


def parent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the turn they answer: the one before in their conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    parent = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    out = turns.join(parent, ["conv_id", "turn"], "left")
    return out.groupBy("role", "parent_role").agg(F.count("*").alias("turns"))


def permission_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose stored revision isn't the customer's present one; null differs from any value."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3).alias("stored"))
    now = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 3).alias("now"))
    out = orders.join(now, F.col("o_custkey") == F.col("c_custkey")).where(~F.col("stored").eqNullSafe(F.col("now")))
    return out.groupBy("stored", "now").agg(F.count("*").alias("stale"))


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    new = rows.where("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.lit("-2")))
    return N.upsert(rows.where("c_custkey % 2 = 0"), new, "c_custkey", add=("balance",)).withColumn("balance", F.col("balance").cast("double"))


def insert_ignore_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return N.insert_missing(rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 3 = 0").withColumn("p_brand", F.lit("new")), "p_partkey")


def compare_and_set_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changes = jobs.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "O").otherwise("P").alias("expected"), F.lit("F").alias("to"))
    return N.compare_and_set(jobs, changes, "o_orderkey", "o_orderstatus").groupBy("o_orderstatus", "outcome").agg(F.count("*").alias("jobs"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    state = F.when(F.col("l_linenumber") == 1, "active").when(F.col("l_linenumber") % 3 == 0, "superseded").otherwise("approved")
    versions = lines.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("version_no")).agg(F.max("l_returnflag").alias("content_hash"))
    versions = versions.withColumn("l_linenumber", F.col("version_no")).select("doc_id", "version_no", state.alias("state"), "content_hash")
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    action = F.element_at(F.array(F.lit("publish"), F.lit("rollback"), F.lit("revoke")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    decisions = orders.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("version_no"), F.when(F.col("o_orderkey") % 5 != 0, "N").otherwise("R").alias("content_hash"), action.alias("action"), F.col("o_orderkey").alias("seq"))
    return versions, decisions


def publish_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.publish(*_versions(spark, sf_dir))[0]


def publish_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.publish(*_versions(spark, sf_dir))[1].groupBy("action", "applied").agg(F.count("*").alias("decisions"))


def lease_queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next ten jobs that may be claimed: pending ones, and running ones whose lease is over."""
    jobs = table(spark, sf_dir, "orders")
    due = (F.col("o_orderstatus") == "O") | ((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")))
    head = jobs.where(due & (F.col("o_orderpriority") != "5-LOW")).orderBy("o_orderdate", "o_orderkey").limit(10)
    return head.select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 7 + 1).alias("epoch"))


def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of failed jobs by their attempts: cancelled, a retry after 2 ** n seconds, or failed."""
    attempts = F.col("o_orderkey") % 8
    jobs = table(spark, sf_dir, "orders").select(attempts.alias("attempts"), (F.col("o_orderkey") % 11 == 0).alias("cancelled"))
    outcome = F.when(F.col("cancelled"), "cancelled").when(F.col("attempts") < 5, "retry").otherwise("failed")
    delay = F.when(outcome == "retry", F.pow(F.lit(2), F.least(F.col("attempts"), F.lit(5))).cast("long"))
    return jobs.groupBy("attempts", outcome.alias("outcome"), delay.alias("delay_s")).agg(F.count("*").alias("jobs"))


def ordered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's items in order as one string."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("i"))
    return rows.select("l_orderkey", F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("items"))


def asof_fact_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shipment with the last price at which its part had shipped by the day before."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.col("l_extendedprice").alias("price"))
    left = lines.withColumn("on", F.col("l_shipdate") - F.expr("INTERVAL 1 DAY")).drop("price")
    out = N.as_of(left, lines, "l_partkey", "on", "l_shipdate", "price")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("as_of_price", 4).alias("price"))


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in batches of fifty by id, and how many requests a batch needs."""
    # Ranks come from running counts over ranges of a thousand ids, in ranges of a million; only these are one window.
    cases = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    cases = cases.withColumn("cell", F.floor(F.col("conv_id") / 1000))
    ahead = lambda line: F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cases.groupBy("cell", F.floor(F.col("cell") / 1000).alias("range")).agg(F.count("*").alias("n"))
    ranges = cells.groupBy("range").agg(F.sum("n").alias("n")).select("range", ahead(W.orderBy("range")).alias("first"))
    before = cells.withColumn("within", ahead(W.partitionBy("range").orderBy("cell"))).join(ranges, "range")
    ranks = cases.join(before.select("cell", (F.col("first") + F.col("within")).alias("before")), "cell").withColumn("at", F.col("before") + F.row_number().over(W.partitionBy("cell").orderBy("conv_id")) - 1)
    batches = ranks.groupBy(F.floor(F.col("at") / 50).alias("batch")).agg(F.count("*").alias("cases"), F.sum("turns").alias("turns"))
    return batches.select("batch", "cases", (F.ceil(F.col("turns") / 16) + 3 * F.col("cases")).alias("requests"))


def set_algebra_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of labelled and unlabelled documents by shop: shared ones, differences, subsets."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    rows = docs.groupBy("source").agg(F.collect_set(F.when(F.col("known"), F.col("lang"))).alias("a"), F.collect_set(F.when(F.col("known").isNull(), F.col("lang"))).alias("b"))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return rows.select(
        "source", joined(F.array_intersect("a", "b")).alias("both"), joined(F.array_except("a", "b")).alias("labelled_only"),
        joined(F.array_union("a", "b")).alias("either"), (F.size(F.array_except("b", "a")) == 0).alias("subset"),
    )


def manifest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against items of even keys: both sides, one without the other."""
    a = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("in_manifest"))
    b = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("k")).distinct().withColumn("in_files", F.lit(True))
    out = a.join(b, "k", "full_outer")
    status = F.when(F.col("in_files").isNull(), "missing_file").when(F.col("in_manifest").isNull(), "unreferenced_file").otherwise("matched")
    return out.groupBy(status.alias("status")).agg(F.count("*").alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (
        job_overview_pivot, source_latest_counts, version_history_latest, conversation_anti_stale, history_last6, parent_turns, permission_revisions,
        upsert_snapshot, insert_ignore_snapshot, compare_and_set_jobs, publish_versions, publish_audit, lease_queue_head, retry_backoff, ordered_items,
        asof_fact_price, batch_plan, set_algebra_corpus, manifest_match,
    )
}

_PUBLISH = """
v AS (SELECT l_orderkey AS doc_id, l_linenumber AS version_no, max(l_returnflag) AS content_hash FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN version_no = 1 THEN 'active' WHEN version_no % 3 = 0 THEN 'superseded' ELSE 'approved' END AS state FROM v),
d AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS dv, CASE WHEN o_orderkey % 5 <> 0 THEN 'N' ELSE 'R' END AS dh,
             (['publish', 'rollback', 'revoke'])[CAST(o_orderkey % 3 + 1 AS INTEGER)] AS action FROM orders WHERE o_orderkey % 2 = 0),
x AS (SELECT w.*, action, coalesce(version_no = dv AND content_hash = dh AND ((action = 'publish' AND state = 'approved') OR (action = 'rollback' AND state = 'superseded')), false) AS starts,
             coalesce(version_no = dv AND action = 'revoke' AND state <> 'revoked', false) AS ends FROM w LEFT JOIN d USING (doc_id)),
y AS (SELECT *, bool_or(starts) OVER (PARTITION BY doc_id) AS doc_starts FROM x)"""

ORACLE = {
    "job_overview_pivot": """
WITH c AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_linestatus = 'O') AS open, max(l_shipdate) FILTER (l_linestatus = 'F') AS last_done FROM lineitem GROUP BY 1)
SELECT o_orderstatus, count(*) AS jobs, sum(coalesce(items, 0))::BIGINT AS items, sum(coalesce(failed, 0))::BIGINT AS failed, sum(coalesce(open, 0))::BIGINT AS open,
       count(*) FILTER (items IS NULL) AS empty_jobs, strftime(max(last_done), '%Y-%m-%d') AS last_done
FROM orders LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY 1""",
    "source_latest_counts": """
SELECT s_suppkey, s_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS items, (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem WHERE l_suppkey = s_suppkey) AS latest FROM supplier""",
    "version_history_latest": """
WITH l AS (SELECT o_custkey, o_orderkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey) AS versions FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS latest, versions, n_name, r_name
FROM l JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
ORDER BY latest DESC, o_orderkey DESC LIMIT 200""",
    "conversation_anti_stale": """
SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last_turn FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system') GROUP BY 1""",
    "history_last6": """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations)
SELECT conv_id, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY n DESC) FILTER (regexp_matches(text, '[^\\s\\pZ]')), '') AS history FROM n WHERE n <= 6 GROUP BY 1""",
    "parent_turns": """
SELECT c.role, p.role AS parent_role, count(*) AS turns FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 GROUP BY 1, 2""",
    "permission_revisions": """
SELECT stored, now, count(*) AS stale FROM (SELECT o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END AS stored FROM orders)
JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 END AS now FROM customer) ON o_custkey = c_custkey
WHERE stored IS DISTINCT FROM now GROUP BY 1, 2""",
    "upsert_snapshot": """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '-2' ELSE c_name END AS c_name,
       (CAST(c_acctbal AS DECIMAL(18,2)) * (CASE WHEN c_custkey % 6 = 0 THEN 2 ELSE 1 END))::DOUBLE AS balance FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
    "insert_ignore_snapshot": """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'new' END AS p_brand FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
    "compare_and_set_jobs": """
WITH j AS (SELECT o_orderstatus AS s, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'O' ELSE 'P' END END AS e FROM orders)
SELECT CASE WHEN s = e THEN 'F' ELSE s END AS o_orderstatus, CASE WHEN e IS NULL THEN 'unchanged' WHEN s = e THEN 'applied' ELSE 'conflict' END AS outcome, count(*) AS jobs FROM j GROUP BY 1, 2""",
    "publish_versions": f"""
WITH {_PUBLISH}
SELECT doc_id, version_no, CASE WHEN starts THEN 'active' WHEN ends THEN 'revoked' WHEN doc_starts AND state = 'active' THEN 'superseded' ELSE state END AS state, content_hash FROM y""",
    "publish_audit": f"""
WITH {_PUBLISH}
SELECT action, coalesce(applied, false) AS applied, count(*) AS decisions
FROM d LEFT JOIN (SELECT doc_id, bool_or(starts OR ends) AS applied FROM y GROUP BY 1) USING (doc_id) GROUP BY 1, 2""",
    "lease_queue_head": """
SELECT o_orderkey, o_orderstatus, o_orderkey % 7 + 1 AS epoch FROM orders
WHERE (o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate < timestamp '1997-01-01')) AND o_orderpriority <> '5-LOW' ORDER BY o_orderdate, o_orderkey LIMIT 10""",
    "retry_backoff": """
SELECT attempts, outcome, CASE WHEN outcome = 'retry' THEN CAST(pow(2, least(attempts, 5)) AS BIGINT) END AS delay_s, count(*) AS jobs
FROM (SELECT o_orderkey % 8 AS attempts, CASE WHEN o_orderkey % 11 = 0 THEN 'cancelled' WHEN o_orderkey % 8 < 5 THEN 'retry' ELSE 'failed' END AS outcome FROM orders) GROUP BY 1, 2, 3""",
    "ordered_items": """
SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1""",
    "asof_fact_price": """
WITH f AS (SELECT l_partkey, l_shipdate, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, round(f.price, 4) AS price
FROM (SELECT *, l_shipdate - INTERVAL 1 DAY AS day FROM lineitem) l ASOF LEFT JOIN f ON l.l_partkey = f.l_partkey AND l.day >= f.l_shipdate""",
    "batch_plan": """
WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1), r AS (SELECT turns, (row_number() OVER (ORDER BY conv_id) - 1) // 50 AS batch FROM c)
SELECT batch, count(*) AS cases, (ceil(sum(turns) / 16) + 3 * count(*))::BIGINT AS requests FROM r GROUP BY 1""",
    "set_algebra_corpus": """
WITH d AS (SELECT source, lang, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
s AS (SELECT source, coalesce(list_distinct(list(lang) FILTER (known)), []) AS a, coalesce(list_distinct(list(lang) FILTER (NOT known)), []) AS b FROM d GROUP BY 1)
SELECT source, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS labelled_only,
       array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset FROM s""",
    "manifest_match": """
SELECT CASE WHEN b.k IS NULL THEN 'missing_file' WHEN a.k IS NULL THEN 'unreferenced_file' ELSE 'matched' END AS status, count(*) AS documents
FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 2 = 0) b ON a.k = b.k GROUP BY 1""",
}
