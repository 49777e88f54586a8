"""The event log as batches and streams: sequences, states, duplicates, rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event makes of an execution; others keep it going.
STATES = {"purchase": "DONE", "error": "FAILED", "logout": "CANCELLED"}
RUNNING = "EXECUTING"


def transitions(events: DataFrame) -> DataFrame:
    """execution (user and day), ts, event_id and to_state."""
    state = F.lit(RUNNING)
    for kind, to in STATES.items():
        state = F.when(F.col("event_type") == kind, to).otherwise(state)
    return events.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("execution"), "ts", "event_id", state.alias("to_state"))


def fold_states(rows: DataFrame) -> DataFrame:
    """execution, state and events: terminal states absorb, so the first of them in order counts."""
    first = F.min(F.when(F.col("to_state") != RUNNING, F.struct("ts", "event_id", "to_state")))
    return rows.groupBy("execution").agg(F.coalesce(first["to_state"], F.lit(RUNNING)).alias("state"), F.count(F.lit(1)).alias("events"))


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet event files as a stream; zone-less times become UTC instants."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_errors(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Errors in windows of a quarter of an hour that begin every five minutes; works on streams."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    out = out.groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w"))
    return out.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).select("w.start", "events", "errors")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once; as a stream the keys of a watermark's reach are remembered."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def sequenced(events: DataFrame) -> DataFrame:
    """user_id, event_id, seq: a stream's events numbered on in each execution, in order of time
    inside a micro-batch. State is one number for an execution."""

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], ignore_index=True)
        state.update((last + len(rows),))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "seq": range(last + 1, last + len(rows) + 1)})

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(
        number, "user_id long, event_id long, seq long", "last long", "append", GroupStateTimeout.NoTimeout
    )


def stateful_turns(rows: DataFrame) -> DataFrame:
    """execution, state, events: ``fold_states`` as a stream, a row whenever an execution changes.

    Events of an execution are expected in order of micro-batches; inside one they are sorted."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (RUNNING, 0)
        batch = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        ends = batch.loc[batch["to_state"] != RUNNING, "to_state"]
        if now == RUNNING and len(ends):
            now = ends.iloc[0]
        n += len(batch)
        state.update((now, n))
        yield pd.DataFrame({"execution": [key[0]], "state": [now], "events": [n]})

    return rows.groupBy("execution").applyInPandasWithState(
        fold, "execution string, state string, events long", "state string, events long", "update", GroupStateTimeout.NoTimeout
    )


def tail(events: DataFrame, last: int, terminal: str | None = None) -> DataFrame:
    """An execution's events after number ``last`` in order: what a client asks for that resumes.

    With ``terminal`` nothing that follows the first event of that kind."""
    out = events.where(F.col("seq") > last)
    if terminal:
        ends = events.where(F.col("type") == terminal).groupBy("execution").agg(F.min("seq").alias("_end"))
        out = out.join(ends, "execution", "left").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end"))).drop("_end")
    return out.orderBy("execution", "seq")
