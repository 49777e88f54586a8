"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from millrace.streaming import events as E

SF = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def folder(spark, tmp_path):
    """The events in four files, in order of time."""
    rows = spark.read.parquet(SF).withColumn("n", F.ntile(4).over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("ts", "event_id")))
    for n in range(1, 5):
        rows.where(F.col("n") == n).drop("n").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return str(tmp_path / "events"), spark.read.parquet(SF).schema


def run(spark, df, mode, tmp_path, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    finally:
        query.stop()
    return spark.table(name)


def test_sequences_go_on_over_batches(spark, folder, tmp_path):
    got = run(spark, E.sequenced(E.read_stream(spark, *folder, max_files=1)), "append", tmp_path, "seq")
    rows = got.collect()
    assert len({(r["user_id"], r["seq"]) for r in rows}) == len(rows) == spark.read.parquet(SF).count()
    tops = {r["user_id"]: (r["n"], r["m"]) for r in got.groupBy("user_id").agg(F.count("seq").alias("n"), F.max("seq").alias("m")).collect()}
    assert all(n == m for n, m in tops.values())


def test_states_equal_the_batch_fold(spark, folder, tmp_path):
    batch = {r["execution"]: (r["state"], r["events"]) for r in E.fold_states(E.transitions(spark.read.parquet(SF).withColumn("ts", F.col("ts").cast("timestamp")))).collect()}
    stream = E.stateful_turns(E.transitions(E.read_stream(spark, *folder)))
    got = {}
    for r in run(spark, stream, "update", tmp_path, "turns").orderBy("events").collect():
        got[r["execution"]] = (r["state"], r["events"])
    assert got == batch


def test_repeats_and_windows(spark, folder, tmp_path):
    path, schema = folder
    twice = E.read_stream(spark, path, schema).unionByName(E.read_stream(spark, path, schema))
    assert run(spark, E.without_repeats(twice), "append", tmp_path, "once").count() == spark.read.parquet(SF).count()
    closed = {(r["start"], r["events"], r["errors"]) for r in run(spark, E.windowed_errors(E.read_stream(spark, path, schema)), "append", tmp_path, "windows").collect()}
    every = {tuple(r) for r in E.windowed_errors(spark.read.parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert closed and closed <= every and len(every - closed) < 10


def test_tail(spark):
    rows = spark.createDataFrame([("a", i, "done" if i == 4 else "delta") for i in range(1, 7)], "execution string, seq int, type string")
    assert [r["seq"] for r in E.tail(rows, 2).collect()] == [3, 4, 5, 6]
    assert [r["seq"] for r in E.tail(rows, 2, "done").collect()] == [3, 4]
