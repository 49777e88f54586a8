"""Events of executions in the order of their numbers: early ones wait, repeats go, gaps are told.

An execution's events are numbered from 1. An event that comes early is held back until those before
it have come; one that came before is dropped; after the terminal event nothing counts. If a number
doesn't come within ``patience``, by event time against the watermark, a gap is reported and what
waits behind it goes on; what arrives of the gap later counts as a repeat. A batch has no time to
wait for, so there all that isn't in the table is a gap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RELEASED = "execution string, kind string, seq long, upto long, type string, data string"
#: In state: the next number, whether the terminal event was released, and what waits.
STATE = "next long, done boolean, seqs array<long>, types array<string>, datas array<string>, due array<timestamp>"


def numbered_events(df: DataFrame, execution: str, ts: str, seq: str, kind: str, data: str) -> DataFrame:
    """The columns that the functions here take: execution, ts, seq, type and data. Rows without an
    execution, a time or a number of 1 or more are left out."""
    out = df.select(F.col(execution).cast("string").alias("execution"), F.col(ts).cast("timestamp").alias("ts"), F.col(seq).cast("long").alias("seq"), F.col(kind).alias("type"), F.col(data).alias("data"))
    return out.where("execution IS NOT NULL AND ts IS NOT NULL AND seq >= 1")


def released(events: DataFrame, terminal: str = "completed") -> DataFrame:
    """execution, kind (event or gap), seq, upto, type and data of a finished table of events.

    Of rows that repeat a number the first by time, type and data counts; a gap has its first and
    last number. Numbers are aggregated before they meet in an execution's window."""
    first = events.groupBy("execution", "seq").agg(F.min(F.struct("ts", "type", "data")).alias("e")).select("execution", "seq", "e.type", "e.data")
    by = W.partitionBy("execution").orderBy("seq")
    rows = first.withColumn("_last", F.coalesce(F.lag("seq").over(by), F.lit(0))).withColumn("_ended", F.max(F.coalesce((F.col("type") == terminal).cast("int"), F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.where(F.coalesce("_ended", F.lit(0)) == 0)
    none = F.lit(None).cast("string")
    gaps = rows.where("seq > _last + 1").select("execution", F.lit("gap").alias("kind"), (F.col("_last") + 1).alias("seq"), (F.col("seq") - 1).alias("upto"), none.alias("type"), none.alias("data"))
    return rows.select("execution", F.lit("event").alias("kind"), "seq", F.col("seq").alias("upto"), "type", "data").unionByName(gaps)


class Line:
    """What an execution has released and what waits."""

    def __init__(self, terminal: str, patience: timedelta, state: tuple | None):
        self.terminal, self.patience = terminal, patience
        self.next, self.done, seqs, types, datas, due = state or (1, False, [], [], [], [])
        self.waiting = {s: (t, d, pd.Timestamp(u)) for s, t, d, u in zip(seqs, types, datas, due, strict=True)}

    def take(self, rows: pd.DataFrame) -> None:
        for r in rows.sort_values(["seq", "ts", "type", "data"], na_position="first").itertuples():
            if not self.done and r.seq >= self.next and r.seq not in self.waiting:
                self.waiting[r.seq] = (r.type, r.data, pd.Timestamp(r.ts) + self.patience)

    def out(self, now: pd.Timestamp | None) -> list[tuple]:
        """What can be released; with ``now`` also past gaps before events that have waited enough."""
        rows: list[tuple] = []
        while self.waiting and not self.done:
            if self.next not in self.waiting:
                first = min(self.waiting)
                if now is None or min(u for _, _, u in self.waiting.values()) > now:
                    break
                rows.append(("gap", self.next, first - 1, None, None))
                self.next = first
            kind, data, _ = self.waiting.pop(self.next)
            rows.append(("event", self.next, self.next, kind, data))
            self.next += 1
            self.done = kind == self.terminal
        if self.done:
            self.waiting = {}
        return rows

    @property
    def state(self) -> tuple:
        seqs = sorted(self.waiting)
        kinds, datas, due = ([self.waiting[s][k] for s in seqs] for k in range(3))
        return self.next, self.done, seqs, kinds, datas, [u.to_pydatetime() for u in due]


def milliseconds(interval: str) -> int:
    """An interval such as "10 minutes"."""
    found = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", interval)
    if not found:
        raise ValueError("an interval is a whole number of seconds, minutes, hours or days")
    return int(found[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[found[2]] * 1000


def released_stream(events: DataFrame, terminal: str = "completed", patience: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """``released`` of a stream, in append mode: each event once those before it are out, a gap once
    the watermark, ``late`` behind the newest event, has passed an event behind it by ``patience``.

    A timer per execution ends the wait, so a gap is told even if nothing more comes of it. State holds
    what waits and one number for the rest."""
    wait = timedelta(milliseconds=milliseconds(patience))

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line = Line(terminal, wait, state.get if state.exists else None)
        for rows in frames:
            line.take(rows)
        mark = state.getCurrentWatermarkMs()
        rows = line.out(pd.Timestamp(mark, unit="ms") if mark > 0 else None)
        state.update(line.state)
        if line.waiting:
            due = min(u for _, _, u in line.waiting.values())
            state.setTimeoutTimestamp(max(int(due.timestamp() * 1000), mark + 1))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["execution", "kind", "seq", "upto", "type", "data"])

    stream = events.withWatermark("ts", late)
    return stream.groupBy("execution").applyInPandasWithState(fold, RELEASED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
