"""Queries on the event log, as batches; ``millrace.streaming`` has the same as streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.snapshots import submit_status
from millrace.sources.tables import table
from millrace.streaming import events as E
from millrace.streaming import leases as L
from millrace.streaming import ordered as O


def event_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their number in their execution, the step from the one before, and gaps over a day."""
    rows = table(spark, sf_dir, "events")
    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    out = rows.select("event_id", "user_id", F.row_number().over(line).cast("long").alias("seq"), (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(line))).alias("step_s"))
    return out.withColumn("gap", F.coalesce(F.col("step_s") > 86400, F.lit(False)))


def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that an execution's next event gets, and its last event."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("last"))
    return rows.select("user_id", (F.col("n") + 1).alias("next_seq"), F.col("last.event_id").alias("last_event"))


def rolling_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests an execution made within an hour, what it spent so far, and whether either
    is over its limit."""
    rows = table(spark, sf_dir, "events").withColumn("s", F.unix_timestamp("ts"))
    line = W.partitionBy("user_id")
    recent = F.count("*").over(line.orderBy("s").rangeBetween(-3600, 0))
    spent = F.sum(F.col("value").cast("decimal(18,4)")).over(line.orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    out = rows.select("event_id", recent.alias("recent"), F.round(spent.cast("double"), 4).alias("spent"))
    return out.withColumn("limited", (F.col("recent") > 3) | (F.col("spent") > 1000))


def error_rate_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures among the events of each quarter of an hour, for windows that begin every five minutes."""
    rows = table(spark, sf_dir, "events")
    out = rows.groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("begins"), "events", "errors", F.round(F.col("errors") / F.col("events"), 6).alias("rate"))


def idempotency_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by key (execution, kind and day): the first is new, others replay it or conflict."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("payload", F.md5(F.get_json_object("props", "$.k")))
    out = submit_status(rows, ["user_id", "event_type", "day"], "payload", ["ts", "event_id"])
    return out.groupBy("event_type", "status").agg(F.count("*").alias("requests"))


def turn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each execution's day: the first terminal event counts, whatever follows it."""
    return E.fold_states(E.transitions(table(spark, sf_dir, "events")))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of workers by who was heard of within a week of the end, and whether all, some or none were."""
    rows = table(spark, sf_dir, "events")
    seen = rows.groupBy("event_type", "user_id").agg(F.max("ts").alias("last"))
    end = F.lit("2024-01-30").cast("timestamp")
    fresh = F.col("last") >= end - F.expr("INTERVAL 7 DAYS")
    out = seen.groupBy("event_type").agg(F.count("*").alias("workers"), F.count_if(fresh).alias("fresh"), F.date_format(F.max(F.when(fresh, F.col("last"))), "yyyy-MM-dd").alias("last_fresh"))
    status = F.when(F.col("fresh") == F.col("workers"), "healthy").when(F.col("fresh") > 0, "degraded").otherwise("unavailable")
    return out.withColumn("status", status)


def lease_fencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of leases whose epoch falls or skips, or that take over a lease that still runs."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 7).alias("epoch"))
    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    before, held = F.lag("epoch").over(line), F.lag("ts").over(line)
    rows = rows.select("event_id", before.alias("before"), "epoch", (F.unix_timestamp("ts") - F.unix_timestamp(held) < 45).alias("live"))
    issue = F.when(F.col("epoch") < F.col("before"), "epoch_fell").when(F.col("epoch") > F.col("before") + 1, "epoch_skipped").when((F.col("epoch") == F.col("before") + 1) & F.col("live"), "live_takeover")
    return rows.where(issue.isNotNull()).groupBy(issue.alias("issue")).agg(F.count("*").alias("transitions"))


def event_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each execution's events in order of their numbers, from a log that lost some and repeats some."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = rows.withColumn("kind", F.when((F.col("event_type") == "purchase") & (F.col("k") >= 90), "completed").otherwise(F.col("event_type")))
    kept = rows.where("event_id % 13 <> 5")
    log = kept.unionByName(kept.where("event_id % 11 = 3").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    return O.released(O.numbered_events(log, "user_id", "ts", "seq", "kind", "props"))


#: Requests are hours apart here, so leases last longer than in service.
TERMS = L.Terms(lease=timedelta(hours=18), attempts=4, backoff=timedelta(hours=3), most_backoff=timedelta(hours=8))


def _lease_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as requests of three workers on a job."""
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "signup"), "claim").when(kind == "click", "renew").when(kind == "error", "fail").otherwise("complete")
    rows = table(spark, sf_dir, "events").withColumn("action", action).withColumn("worker", F.get_json_object("props", "$.k").cast("long") % 3)
    rows = rows.withColumn("action", F.when((F.col("action") == "complete") & (F.get_json_object("props", "$.k").cast("long") >= 30), "renew").otherwise(F.col("action")))
    return L.requests(rows, "user_id", "ts", "event_id", "worker", "action")


def lease_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each request: claims, renewals, expiry and fencing."""
    out = L.lease_log(_lease_requests(spark, sf_dir), TERMS)
    return out.select("job", F.unix_micros("ts").alias("at"), "event_id", "worker", "action", "accepted", "reason", "epoch", "status")


def lease_log_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a log of transitions that the rules don't give: every 17th says the opposite, every
    19th states another epoch."""
    log = L.lease_log(_lease_requests(spark, sf_dir), TERMS).where("event_id IS NOT NULL")
    log = log.withColumn("accepted", F.col("accepted") != (F.col("event_id") % 17 == 0)).withColumn("epoch", F.col("epoch") + (F.col("event_id") % 19 == 0).cast("long"))
    return L.lease_issues(log.select("job", "ts", "event_id", "worker", "action", "accepted", "epoch"), TERMS)


def layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as elements of a layout list: kinds mapped, unknown ones text, pages from 1."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    kind = F.when(F.col("event_type") == "view", "heading").when(F.col("event_type") == "click", "table").when(F.col("event_type") == "purchase", "image").otherwise("text")
    warned = ~F.col("event_type").isin("view", "click", "purchase")
    out = rows.select(kind.alias("kind"), (F.coalesce("k", F.lit(0)) + 1).alias("page_no"), warned.alias("warned"))
    return out.groupBy("kind").agg(F.count("*").alias("elements"), F.countDistinct("page_no").alias("pages"), F.count_if("warned").alias("warnings"))


QUERIES = {
    f.__name__: f
    for f in (
        event_sequence_gaps, next_sequence, rolling_rate_limit, error_rate_trailing, idempotency_conflicts, turn_states, heartbeats, lease_fencing,
        event_release, lease_transitions, lease_log_issues, layout_elements,
    )
}

# The machine once more, a request of every job at a time; times are microseconds.
_LEASES = """
RECURSIVE e AS (
  SELECT user_id AS job, epoch_us(ts) AS t, event_id, (props->>'$.k')::BIGINT % 3 AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
         CASE WHEN event_type IN ('view', 'signup') THEN 'claim' WHEN event_type = 'click' THEN 'renew' WHEN event_type = 'error' THEN 'fail'
              WHEN (props->>'$.k')::BIGINT < 30 THEN 'complete' ELSE 'renew' END AS a
  FROM events),
s AS (
  SELECT DISTINCT user_id AS job, 0::BIGINT AS i, 'pending' AS status, NULL::BIGINT AS worker, 0::BIGINT AS epoch, NULL::BIGINT AS until, NULL::BIGINT AS due, 0::BIGINT AS failures, false AS told,
         [0, 0, 0]::BIGINT[] AS got, NULL::BIGINT AS t, NULL::BIGINT AS event_id, NULL::BIGINT AS w, NULL::VARCHAR AS a, NULL::VARCHAR AS why, false AS ended, NULL::BIGINT AS ended_at, NULL::BIGINT AS ended_of
  FROM events
  UNION ALL
  SELECT job, i, CASE WHEN why IS NOT NULL THEN status WHEN a = 'claim' THEN 'running' WHEN a = 'complete' THEN 'done' WHEN a = 'fail' THEN CASE WHEN failures < 3 THEN 'pending' ELSE 'failed' END ELSE status END,
         CASE WHEN why IS NOT NULL OR a = 'renew' THEN worker WHEN a = 'claim' THEN w END,
         CASE WHEN why IS NULL AND a = 'claim' THEN epoch + 1 ELSE epoch END,
         CASE WHEN why IS NOT NULL THEN until WHEN a IN ('claim', 'renew') THEN t + 64800000000 END,
         CASE WHEN why IS NULL AND a = 'fail' THEN t + least(10800000000 * (2 ** failures)::BIGINT, 28800000000) ELSE due END,
         CASE WHEN why IS NULL AND a = 'fail' THEN failures + 1 ELSE failures END,
         CASE WHEN why IS NULL AND a = 'claim' THEN false ELSE told OR ended END,
         CASE WHEN why IS NULL AND a = 'claim' THEN list_transform(got, lambda g, k: CASE WHEN k = w + 1 THEN epoch + 1 ELSE g END) ELSE got END,
         t, event_id, w, a, why, ended, until, worker
  FROM (
    SELECT s.job, e.i, status, worker, epoch, until, due, failures, told, got, e.t, e.event_id, e.w, e.a, status = 'running' AND until <= e.t AND NOT told AS ended,
           CASE WHEN status IN ('done', 'failed') THEN 'job_' || status
                WHEN e.a = 'claim' THEN CASE WHEN status = 'running' AND until > e.t THEN 'lease_held' WHEN status = 'pending' AND due > e.t THEN 'not_due' END
                WHEN status <> 'running' THEN 'not_running' WHEN got[e.w + 1] = 0 THEN 'never_claimed' WHEN e.w <> worker OR got[e.w + 1] <> epoch THEN 'fenced'
                WHEN until <= e.t THEN 'lease_expired' END AS why
    FROM s JOIN e ON e.job = s.job AND e.i = s.i + 1))"""

ORACLE = {
    "event_release": """
WITH n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
         CASE WHEN event_type = 'purchase' AND (props->>'$.k')::BIGINT >= 90 THEN 'completed' ELSE event_type END AS kind
  FROM events),
p AS (SELECT user_id, seq, kind, props FROM n WHERE event_id % 13 <> 5),
z AS (SELECT user_id, coalesce(min(seq) FILTER (kind = 'completed'), max(seq)) AS top FROM p GROUP BY user_id),
l AS (SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS island FROM n JOIN z USING (user_id) WHERE event_id % 13 = 5 AND seq < top)
SELECT user_id::VARCHAR AS execution, 'event' AS kind, seq, seq AS upto, kind AS type, props AS data FROM p JOIN z USING (user_id) WHERE seq <= top
UNION ALL
SELECT user_id::VARCHAR, 'gap', min(seq), max(seq), NULL, NULL FROM l GROUP BY user_id, island""",
    "lease_transitions": f"""
WITH {_LEASES}
SELECT job::VARCHAR AS job, t AS at, event_id, w::VARCHAR AS worker, a AS action, why IS NULL AS accepted, why AS reason, epoch, status FROM s WHERE i > 0
UNION ALL
SELECT job::VARCHAR, ended_at, NULL, ended_of::VARCHAR, 'expire', true, NULL, epoch - (a = 'claim')::BIGINT, 'running' FROM s WHERE ended""",
    "lease_log_issues": f"""
WITH {_LEASES}
SELECT job::VARCHAR AS job, event_id,
       CASE WHEN event_id % 17 = 0 AND why IS NOT NULL THEN 'accepted_wrongly' WHEN event_id % 17 = 0 THEN 'refused_wrongly' ELSE 'epoch_wrong' END AS issue
FROM s WHERE i > 0 AND (event_id % 17 = 0 OR event_id % 19 = 0 AND why IS NULL)""",
    "event_sequence_gaps": """
SELECT event_id, user_id, row_number() OVER w AS seq, (epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)))::BIGINT AS step_s,
       coalesce((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)))::BIGINT > 86400, false) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "next_sequence": "SELECT user_id, count(*) + 1 AS next_seq, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1",
    "rolling_rate_limit": """
WITH e AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent,
  round((sum(value::DECIMAL(18,4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE, 4) AS spent FROM events)
SELECT *, recent > 3 OR spent > 1000 AS limited FROM e""",
    "error_rate_trailing": """
WITH w AS (SELECT unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 10 MINUTE]) AS s, event_type FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS begins, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM w GROUP BY s""",
    "idempotency_conflicts": """
WITH r AS (SELECT event_type, md5(props->>'$.k') AS p, first_value(md5(props->>'$.k')) OVER w AS f, row_number() OVER w AS n FROM events
           WINDOW w AS (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_type, CASE WHEN n = 1 THEN 'new' WHEN p IS NOT DISTINCT FROM f THEN 'replay' ELSE 'conflict' END AS status, count(*) AS requests FROM r GROUP BY 1, 2""",
    "turn_states": """
WITH t AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS execution, ts, event_id,
                  CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' WHEN 'logout' THEN 'CANCELLED' ELSE 'EXECUTING' END AS to_state FROM events)
SELECT execution, coalesce(arg_min(to_state, (ts, event_id)) FILTER (to_state <> 'EXECUTING'), 'EXECUTING') AS state, count(*) AS events FROM t GROUP BY 1""",
    "heartbeats": """
WITH s AS (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY 1, 2),
h AS (SELECT event_type, count(*) AS workers, count(*) FILTER (last >= timestamp '2024-01-23') AS fresh, strftime(max(last) FILTER (last >= timestamp '2024-01-23'), '%Y-%m-%d') AS last_fresh FROM s GROUP BY 1)
SELECT *, CASE WHEN fresh = workers THEN 'healthy' WHEN fresh > 0 THEN 'degraded' ELSE 'unavailable' END AS status FROM h""",
    "lease_fencing": """
WITH l AS (SELECT event_id % 7 AS epoch, lag(event_id % 7) OVER w AS before, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) < 45 AS live FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT CASE WHEN epoch < before THEN 'epoch_fell' WHEN epoch > before + 1 THEN 'epoch_skipped' WHEN epoch = before + 1 AND live THEN 'live_takeover' END AS issue FROM l)
SELECT issue, count(*) AS transitions FROM i WHERE issue IS NOT NULL GROUP BY 1""",
    "layout_elements": """
SELECT CASE event_type WHEN 'view' THEN 'heading' WHEN 'click' THEN 'table' WHEN 'purchase' THEN 'image' ELSE 'text' END AS kind, count(*) AS elements,
       count(DISTINCT coalesce((props->>'$.k')::BIGINT, 0) + 1) AS pages, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase')) AS warnings FROM events GROUP BY 1""",
}
