"""Ordered release and leases: streams against batches, batches against plain rules."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.streaming import leases as L
from millrace.streaming import ordered as O

EVENTS = "execution string, ts timestamp, seq long, type string, data string"
REQUESTS = "job string, ts timestamp, event_id long, worker string, action string"
START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def write_batches(spark, batches, schema, path):
    """A folder of files that a stream reads one by one, the oldest first."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        spark.range(1).count() if i else None
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, df, tmp_path, name):
    query = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    try:
        query.awaitTermination(180)
        assert query.exception() is None
    finally:
        query.stop()
    return spark.table(name).collect()


def log_of(rng, executions):
    """Events with numbers, in a shuffled order, some repeated, some lost; and those of the end."""
    rows = []
    for e in range(executions):
        n = rng.randint(1, 30)
        for s in range(1, n + 1):
            kind = "completed" if s == n and rng.random() < 0.5 else "delta"
            if rng.random() > 0.12:
                rows += [(f"x{e}", at(s + rng.randint(0, 5)), s, kind, f"{e}/{s}")] * rng.choice([1, 1, 1, 2])
        if rng.random() < 0.3:
            rows.append((f"x{e}", at(40), n + 3, "delta", "behind"))
    rng.shuffle(rows)
    return rows


def test_a_stream_releases_what_the_batch_does(spark, tmp_path):
    rng = random.Random(4)
    rows = log_of(rng, 25)
    # Times go far beyond all patience at the end, so that the timers of all executions ring.
    batches = [rows[k::6] for k in range(6)] + [[("end", at(10_000), 1, "completed", "")], [("end", at(30_000), 1, "completed", "")]]
    stream = O.released_stream(write_batches(spark, batches, EVENTS, str(tmp_path / "in")), patience="10 minutes", late="1 hour")
    got = run(spark, stream, tmp_path, "released")
    batch = O.released(spark.createDataFrame([r for b in batches for r in b], EVENTS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, batch), key=str)
    assert {r["kind"] for r in got} == {"event", "gap"}
    for e in {r["execution"] for r in got}:
        own = [(r["seq"], r["upto"]) for r in got if r["execution"] == e]
        assert own[0][0] == 1 and all(b[0] == a[1] + 1 for a, b in zip(own, own[1:], strict=False))


def plain_release(rows, terminal="completed"):
    out = []
    for e in {r[0] for r in rows}:
        first = {}
        for r in sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1], r[3], r[4])):
            first.setdefault(r[2], r)
        last = 0
        for s in sorted(first):
            if s > last + 1:
                out.append((e, "gap", last + 1, s - 1, None, None))
            out.append((e, "event", s, s, first[s][3], first[s][4]))
            last = s
            if first[s][3] == terminal:
                break
    return out


def test_the_batch_follows_the_rules(spark):
    rows = log_of(random.Random(5), 60)
    got = O.released(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_release(rows), key=str)
    assert O.released(spark.createDataFrame([], EVENTS)).count() == 0
    odd = spark.createDataFrame([(None, at(1), 1, "a", "x"), ("e", None, 1, "a", "x"), ("e", at(1), 0, "a", "x"), ("e", at(1), None, "a", "x"), ("e", at(1), 2, None, None)], EVENTS)
    assert [tuple(r) for r in O.released(O.numbered_events(odd, "execution", "ts", "seq", "type", "data")).orderBy("seq").collect()] == [("e", "gap", 1, 1, None, None), ("e", "event", 2, 2, None, None)]


def test_an_early_event_waits_and_a_late_one_is_a_repeat():
    line = O.Line("completed", timedelta(minutes=10), None)
    frame = lambda *rows: O.pd.DataFrame(rows, columns=["ts", "seq", "type", "data"])
    line.take(frame((at(0), 1, "a", ""), (at(1), 3, "b", "")))
    assert line.out(None) == [("event", 1, 1, "a", "")]
    line.take(frame((at(2), 2, "c", "")))
    assert line.out(None) == [("event", 2, 2, "c", ""), ("event", 3, 3, "b", "")]
    line.take(frame((at(3), 6, "d", "")))
    assert line.out(O.pd.Timestamp(at(602))) == [] and line.out(O.pd.Timestamp(at(604))) == [("gap", 4, 5, None, None), ("event", 6, 6, "d", "")]
    again = O.Line("completed", timedelta(minutes=10), line.state)
    again.take(frame((at(4), 5, "late", ""), (at(5), 7, "completed", ""), (at(6), 8, "x", "")))
    assert again.out(None) == [("event", 7, 7, "completed", "")] and again.state[1]
    with pytest.raises(ValueError, match="interval"):
        O.milliseconds("soon")


def outcome(rows, terms=None):
    """(accepted or why not, epoch) of requests (seconds, worker, action) on one job."""
    job = L.Job(terms or L.Terms())
    return [(job.request(at(s), w, a) or "ok", job.epoch) for s, w, a in rows]


def test_rules_of_leases():
    assert outcome([(0, "a", "claim"), (10, "b", "claim"), (10, "b", "renew"), (44, "a", "renew"), (88, "a", "complete"), (89, "a", "renew"), (90, "b", "claim")]) == [
        ("ok", 1), ("lease_held", 1), ("never_claimed", 1), ("ok", 1), ("ok", 1), ("job_done", 1), ("job_done", 1),
    ]
    # A lease ends at its last moment; who lost it is fenced off.
    assert outcome([(0, "a", "claim"), (45, "a", "complete"), (45, "b", "claim"), (46, "a", "complete"), (47, "b", "complete")]) == [("ok", 1), ("lease_expired", 1), ("ok", 2), ("fenced", 2), ("ok", 2)]
    # Failures wait twice as long each time; the last one ends the job.
    terms = L.Terms(attempts=3, backoff=timedelta(seconds=10), most_backoff=timedelta(seconds=15))
    rows = [(0, "a", "claim"), (1, "a", "fail"), (10, "a", "claim"), (11, "a", "claim"), (12, "a", "fail"), (26, "b", "claim"), (27, "b", "claim"), (28, "b", "fail"), (99, "b", "claim")]
    assert [w for w, _ in outcome(rows, terms)] == ["ok", "ok", "not_due", "ok", "ok", "not_due", "ok", "ok", "job_failed"]
    assert [w for w, _ in outcome([(0, "a", "steal"), (0, None, "claim"), (0, "a", "renew"), (1, "a", "cancel"), (2, "a", "claim")])] == ["unknown_request", "unknown_request", "not_running", "ok", "job_cancelled"]
    assert L.Job(L.Terms()).refusal(at(0), "a", "renew", 1) == "not_running"
    job = L.Job(L.Terms())
    job.request(at(0), "a", "claim")
    assert job.request(at(1), "a", "renew", 0) == "fenced" and job.request(at(1), "a", "renew", 1) is None


def random_requests(rng, jobs, n):
    rows = [(f"j{rng.randrange(jobs)}", at(rng.randint(0, 3000)), i, rng.choice("abc"), rng.choice(["claim", "claim", "renew", "renew", "fail", "complete", "cancel"] if i % 9 == 0 else ["claim", "renew", "renew", "fail"])) for i in range(n)]
    return sorted(rows, key=lambda r: r[1])


def test_a_stream_of_requests_gives_the_log(spark, tmp_path):
    rows = random_requests(random.Random(6), 12, 400)
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    rng = random.Random(7)
    for b in batches:
        rng.shuffle(b)
    batches += [[("end", at(9000), 9999, "a", "cancel")], [("end", at(99_000), 10_000, "a", "claim")]]
    stream = L.lease_stream(write_batches(spark, batches, REQUESTS, str(tmp_path / "in")), late="10 minutes")
    got = [tuple(r) for r in run(spark, stream, tmp_path, "leases") if r["job"] != "end"]
    batch = L.lease_log(spark.createDataFrame(rows, REQUESTS)).collect()
    told = {tuple(r) for r in batch}
    assert told <= set(got)
    # Beyond the batch, timers tell of leases that ran out after the last request.
    more = [r for r in got if r not in told]
    assert all(r[4] == "expire" for r in more) and len(got) == len(set(got))
    last = {}
    for r in sorted(batch, key=lambda r: (r["ts"], r["event_id"] or 0)):
        last[r["job"]] = r
    assert {r[0] for r in more} <= {j for j, r in last.items() if r["status"] == "running"}


def test_a_log_is_checked_row_by_row(spark):
    rows = random_requests(random.Random(8), 5, 200)
    log = L.lease_log(spark.createDataFrame(rows, REQUESTS)).where("event_id IS NOT NULL")
    assert L.lease_issues(log).count() == 0
    wrong = log.withColumn("epoch", F.when(F.col("event_id") == 40, 99).otherwise(F.col("epoch"))).withColumn("accepted", F.col("accepted") != F.col("event_id").isin(10, 20))
    truth = {r["event_id"]: r["accepted"] for r in log.collect()}
    expected = {(i, "refused_wrongly" if truth[i] else "accepted_wrongly") for i in (10, 20)} | ({(40, "epoch_wrong")} if truth[40] else set())
    assert {(r["event_id"], r["issue"]) for r in L.lease_issues(wrong).collect()} == expected
    assert L.lease_log(spark.createDataFrame([], REQUESTS)).count() == 0
    odd = L.requests(spark.createDataFrame([(None, at(0), 1, "a", "claim"), ("j", None, 2, "a", "claim"), ("j", at(0), None, None, None)], REQUESTS), "job", "ts", "event_id", "worker", "action")
    assert [(r["reason"], r["event_id"]) for r in L.lease_log(odd).collect()] == [("unknown_request", None)]


def test_jobs_go_on_over_batches_without_being_held(spark):
    """Batches of three requests give what one fold of a whole job gives; no group is gathered."""
    rng = random.Random(9)
    rows = [(f"j{rng.randint(0, 2)}", at(rng.randint(0, 900)), i, f"w{rng.randint(0, 1)}", rng.choice(["claim", "renew", "fail", "claim", "none"])) for i in range(120)]
    df = spark.createDataFrame(rows, "job string, ts timestamp_ntz, event_id long, worker string, action string").withColumn("ts", F.col("ts").cast("timestamp"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        log = L.lease_log(df)
        got = [(r["job"], r["ts"], r["event_id"] or -1, r["accepted"], r["reason"], r["epoch"]) for r in log.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()]
        assert L.lease_issues(log.where("event_id IS NOT NULL")).isEmpty()
        assert "FlatMapGroups" not in log._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = []
    for name in ("j0", "j1", "j2"):
        mine = pd.DataFrame([r[1:] for r in rows if r[0] == name], columns=["ts", "event_id", "worker", "action"])
        expected += [(name, r[0], r[1] or -1, r[4], r[5], r[6]) for r in L.fold(L.Job(L.Terms()), mine)]
    assert sorted(got, key=str) == sorted(expected, key=str)
