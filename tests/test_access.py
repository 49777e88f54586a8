"""Windows cut into pieces, keyed hashes, changes and revisions, resumed batches."""

import datetime
import hashlib
import hmac
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes as C
from millrace.operators import intervals as I
from millrace.operators import signing as S
from millrace.streaming import resume as R

DAY = datetime.date(1969, 12, 20)


def day(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


@pytest.mark.parametrize("levels", [0, 1, 3, 8])
def test_pieces_cover_a_window_once(spark, levels):
    rng = random.Random(levels)
    rows = [(a, a + rng.randint(-2, 40)) for a in (rng.randint(-60, 60) for _ in range(200))]
    df = spark.createDataFrame(rows, "s int, e int")
    for r in df.select("s", "e", I.pieces(F.col("s"), F.col("e"), levels).alias("p")).collect():
        held = [x for level, k in r["p"] for x in range(k << level, (k + 1) << level)]
        assert sorted(held) == list(range(r["s"], r["e"]))
        assert max(Counter(level for level, _ in r["p"] if level < levels).values(), default=0) <= 2


def test_interval_join_is_a_join_on_windows(spark):
    rng = random.Random(1)
    maybe = lambda n: None if rng.random() < 0.1 else n
    points = [(i, maybe(rng.choice("ab")), day(maybe(rng.randint(0, 60)))) for i in range(80)] + [(0, "a", day(5))]
    windows = [(i, maybe(rng.choice("ab")), day(maybe(s := rng.randint(-10, 70))), day(maybe(s + rng.randint(-3, 30)))) for i in range(120)]
    expected = sorted((p, w) for p, k, d in points for w, c, s, e in windows if k is not None and k == c and d and (s is None or s <= d) and (e is None or e > d))
    a, b = spark.createDataFrame(points, "p int, k string, d date"), spark.createDataFrame(windows, "w int, k string, s date, e date")
    for levels in (0, 5):
        assert sorted((r["p"], r["w"]) for r in I.interval_join(a, b, ["k"], "d", "s", "e", levels).collect()) == expected
    assert I.interval_join(a.where("false"), b, ["k"], "d", "s", "e").count() == 0


def test_interval_totals_are_those_of_the_pairs(spark):
    rng = random.Random(3)
    maybe = lambda n: None if rng.random() < 0.1 else n
    points = [(maybe(rng.choice("ab")), day(maybe(rng.randint(0, 40)))) for _ in range(90)]
    windows = [(maybe(i), maybe(rng.choice("ab")), day(maybe(s := rng.randint(-10, 50))), day(maybe(s + rng.randint(-3, 30)))) for i in range(120)]
    a, b = spark.createDataFrame(points, "k string, d date"), spark.createDataFrame(windows, "w int, k string, s date, e date")
    got = I.interval_totals(a, b, ["k"], "d", "s", "e", "n", {"total": "w"})
    pairs = I.interval_join(a, b, ["k"], "d", "s", "e").groupBy("k", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) != []


def test_pieces_of_windows_are_never_broadcast(spark):
    """A few windows that seem small have many pieces."""
    points = spark.createDataFrame([("t", day(n)) for n in range(50)], "k string, d date")
    windows = spark.createDataFrame([("t", day(0), None)], "k string, s date, e date")
    for df in (I.interval_join(points, windows, ["k"], "d", "s", "e"), I.interval_totals(points, windows, ["k"], "d", "s", "e", "n", {})):
        assert df.count() == 50
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_one_hot_key_is_spread(spark):
    """All rows have one key: no piece holds more than a share of either side."""
    rng = random.Random(2)
    points = spark.createDataFrame([("t", day(rng.randint(0, 999))) for _ in range(4000)], "k string, d date")
    windows = spark.createDataFrame([("t", day(s := rng.randint(0, 990)), day(s + 9)) for _ in range(3000)], "k string, s date, e date")
    plan = I.interval_join(points, windows, ["k"], "d", "s", "e")
    keys = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in keys and "_level" in keys
    first, last = I.day_number(F.col("s")), I.day_number(F.col("e"))
    shares = windows.select(F.explode(I.pieces(first, last, I.LEVELS)).alias("p")).groupBy("p").count()
    assert shares.agg(F.max("count")).first()[0] < 0.02 * 3000 * 6


def test_hmac(spark):
    rows = [(b"k" * n, m) for n in (0, 1, 31, 63, 64, 65, 200) for m in ("", "message", "Grüße 你好" * 30)] + [(bytes(range(256)), "x")]
    df = spark.createDataFrame(rows, "k binary, m string")
    for r in df.select("k", "m", S.hmac_sha256(F.col("k"), F.col("m")).alias("h"), S.hmac_sha256(F.lit(None).cast("binary"), F.col("m")).alias("none")).collect():
        assert r["h"] == hmac.new(bytes(r["k"]), r["m"].encode(), hashlib.sha256).hexdigest() and r["none"] is None
    plan = df.select(S.hmac_sha256(F.col("k"), F.col("m")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_signed_contexts(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    fields = ["tenant", "shops"]
    text = lambda *v: "".join(f"{'-' if x is None else len(str(x).encode())}:{'' if x is None else x}\n" for x in v)
    micros = lambda x: int(x.replace(tzinfo=datetime.UTC).timestamp() * 10**6)
    sign = lambda key, i, tenant, shops, a, b: hmac.new(key, text(i, tenant, shops, micros(a), micros(b)).encode(), hashlib.sha256).hexdigest()
    good = sign(b"s1", "k1", "t", "a,b", t(1), t(9))
    rows = [
        ("k1", "t", "a,b", t(1), t(9), good, "valid"), ("k1", "t", "a,b", t(1), t(9), good.upper(), "valid"), ("k1", "t2", "a,b", t(1), t(9), good, "bad_signature"), ("k2", "t", "a,b", t(1), t(9), good, "bad_signature"),
        ("k9", "t", "a,b", t(1), t(9), good, "unknown_key"), (None, "t", "a,b", t(1), t(9), good, "unknown_key"), ("k1", "t", "a,b", t(1), t(9), None, "bad_signature"),
        ("k1", "t", None, t(1), t(5), sign(b"s1", "k1", "t", None, t(1), t(5)), "expired"), ("k1", "t", "", t(6), t(9), sign(b"s1", "k1", "t", "", t(6), t(9)), "not_yet_valid"), ("k1", "t", None, t(6), t(9), sign(b"s1", "k1", "t", "", t(6), t(9)), "bad_signature"),
    ]
    contexts = spark.createDataFrame(rows, "key_id string, tenant string, shops string, issued_at timestamp, expires_at timestamp, signature string, expected string")
    contexts = contexts.withColumns({c: F.to_utc_timestamp(c, "UTC") for c in ("issued_at", "expires_at")})
    keys = spark.createDataFrame([("k1", b"s1"), ("k2", b"s2")], "key_id string, secret binary")
    out = S.verified_contexts(contexts, keys, fields, F.lit("2024-01-01 05:00:00").cast("timestamp")).collect()
    assert len(out) == len(rows) and all(r["state"] == r["expected"] for r in out)


def test_changes_and_revisions(spark):
    kinds = "tenant_id int, user_id int, role string, revision_of string"
    old = spark.createDataFrame([(1, 1, "a", "r1"), (1, 2, None, "r1"), (1, 3, "c", "r1"), (2, 4, "d", "r2"), (2, 5, "e", "r2")], kinds)
    new = spark.createDataFrame([(1, 1, "b", "r1"), (1, 2, None, "r1"), (2, 4, "x", "given"), (2, 6, "f", "r2")], kinds)
    got = {tuple(r) for r in C.changes(old, new, ["tenant_id", "user_id"], ["role"]).select("user_id", "op", F.concat_ws(",", "changed")).collect()}
    assert got == {(1, "update", "role"), (3, "delete", ""), (4, "update", "role"), (5, "delete", ""), (6, "insert", "")}
    watch = C.Watch("app_user", ("user_id",), ("role",), "app_user_changed", ("update",), "user_id", "revision_of")
    feed = watch.feed(old, new)
    assert [(r["tenant_id"], r["user_id"], r["reason"]) for r in feed.collect()] == [("1", "1", "app_user_changed")]
    users = spark.createDataFrame([(1, 1, "r1"), (1, 2, "r1"), (2, 4, "r2"), (3, 7, None)], "tenant_id int, user_id int, permission_revision string")
    acl = lambda rows: spark.createDataFrame(rows, "tenant_id int, acl_id int, level string")
    grants = C.Watch("acl", ("acl_id",), ("level",), "acl_changed")
    one = C.revised(users, [feed, grants.feed(acl([(2, 1, "x"), (2, 2, "y")]), acl([(2, 2, "z")]))])
    by = {r["user_id"]: r for r in one.collect()}
    assert by["1"]["revision"] != "r1" and by["2"]["revision"] == "r1" and by["4"]["revision"] not in ("r2", by["1"]["revision"]) and by["7"]["revision"] is None
    assert (by["4"]["tenant_changes"], by["1"]["own_changes"]) == (2, 1)
    again = C.revised(users.repartition(3), [grants.feed(acl([(2, 2, "y"), (2, 1, "x")]), acl([(2, 2, "z")])), feed])
    assert {(r["user_id"], r["revision"]) for r in again.collect()} == {(u, r["revision"]) for u, r in by.items()}
    runs = spark.createDataFrame([(1, 1, "r1"), (1, 2, "r1"), (3, 7, None), (9, 9, "r1")], "tenant_id int, user_id int, permission_revision string")
    assert {r["user_id"]: r["readable"] for r in C.readable(runs, one).collect()} == {"1": False, "2": True, "7": True, "9": False}


class Stop(Exception):
    pass


def test_a_stopped_run_is_taken_up_again(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    calls = []

    def compute(batch, fail_on=None):
        calls.append(batch.count())
        if len(calls) == fail_on:
            raise Stop("stopped")
        return batch.withColumn("twice", F.col("id") * 2)

    def run(place, fail_on=None, identity="x", ceiling=100):
        sink = R.Resumable(str(tmp_path / place), R.identity_of(model=identity), lambda b: compute(b, fail_on), lambda n: n, ceiling)
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"{place}-state")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run("whole")
    assert calls == [10] * 4
    calls.clear()
    with pytest.raises(Exception, match="stopped"):
        run("cut", fail_on=3)
    assert R.result(spark, str(tmp_path / "cut")).count() == 20
    run("cut")
    assert len(calls) == 3 + 2
    rows = lambda place: sorted((r["id"], r["twice"]) for r in R.result(spark, str(tmp_path / place)).collect())
    assert rows("cut") == rows("whole") == [(i, 2 * i) for i in range(40)]
    # A replay of a recorded batch writes nothing; other rules are named.
    sink = R.Resumable(str(tmp_path / "cut"), R.identity_of(model="x"), compute, lambda n: n, 100)
    calls.clear()
    ids = R.result(spark, str(tmp_path / "cut")).where("batch = 1").select("id")
    sink(ids, 1)
    assert calls == []
    for bad, name in (((ids.limit(3), 1), "batch_ids_mismatch"), ((ids, 9), "completed_batches_not_prefix")):
        with pytest.raises(R.ResumeError, match=name):
            sink(*bad)
    with pytest.raises(R.ResumeError, match="identity_mismatch"):
        R.Resumable(str(tmp_path / "cut"), R.identity_of(model="y"), compute, lambda n: n, 100)(ids, 1)
    with pytest.raises(R.ResumeError, match="budget_exceeded"):
        R.Resumable(str(tmp_path / "none"), "z", compute, lambda n: n, 5)(ids, 0)


def test_every_rule_of_records_is_named(spark):
    plan = R.planned_batches(spark.createDataFrame([(r, c) for r in range(1, 12) for c in range(5)], "run int, case long"), "run", "case", 2)
    assert [r["cases"] for r in plan.where("run = 1").orderBy("batch").collect()] == [2, 2, 1]
    hashes = {r["batch"]: r["ids_hash"] for r in plan.where("run = 1").collect()}
    good = lambda run, batches=(1, 2, 3): [(run, b, hashes[b], 10 * b, 10 * b) for b in batches]
    records = good(1) + good(2, (1, 3)) + [(3, 1, "?", 10, 10)] + [(4, 1, hashes[1], 10, 10), (4, 2, hashes[2], 5, 6)] + good(5) + good(6, (1,)) + good(7) + good(8, (1,)) + good(9, (1,))
    heads = [(1, "COMPLETE", 30, 30, None, None), (2, "RUNNING", 30, 30, None, None), (3, "RUNNING", 10, 10, None, None), (4, "RUNNING", 10, 10, None, None), (5, "RUNNING", 30, 31, None, None)]
    heads += [(6, "RUNNING", 15, 15, 2, 5), (7, "COMPLETE", 25, 25, 1, 0), (8, "RUNNING", 12, 12, 3, 5), (9, "FAILED", 10, 10, None, None), (10, "COMPLETE", 0, 0, None, None), (11, None, 0, 0, None, None)]
    out = R.record_issues(spark.createDataFrame(heads, "run int, status string, requests long, cost long, active_batch long, active_requests long"), spark.createDataFrame(records, "run int, batch long, ids_hash string, requests long, cost long"), plan)
    got = {}
    for r in out.collect():
        got.setdefault(r["run"], set()).add((r["batch"], r["issue"]))
    assert {k: v for k, v in got.items() if k != 11} == {
        2: {(3, "completed_batches_not_prefix")}, 3: {(1, "batch_ids_mismatch")}, 4: {(2, "batch_budget_invalid")},
        5: {(None, "cost_units_mismatch"), (None, "running_batch_count_invalid")}, 7: {(None, "request_count_mismatch"), (None, "active_batch_unexpected"), (None, "complete_budget_mismatch")},
        8: {(None, "active_batch_mismatch"), (None, "active_batch_budget_mismatch")}, 10: {(None, "complete_batch_count_invalid")},
    }
    assert (None, "status_invalid") in got[11]
