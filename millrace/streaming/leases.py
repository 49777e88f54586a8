"""Leases on jobs as one machine: claims, renewals, expiry, fencing, retries, from a log of requests.

A request is accepted or refused by what came before it in its job: a claim if the job is pending and
due, or its lease has run out; renewals, completions and failures only from the worker that was
granted the present epoch, while its lease lasts. A claim raises the epoch, so a worker that lost its
lease can't write any more, although it doesn't know. The same fold serves batches, streams with timers,
and the check of a log that says what was granted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds of a lease, attempts of a job, and the base and most seconds before a retry.
LEASE_S, MOST_ATTEMPTS, BACKOFF_S, MOST_BACKOFF_S = 45, 5, 1, 60
ACTIONS = ("claim", "renew", "complete", "fail", "cancel")
OUT = "job string, ts timestamp, event_id long, worker string, action string, accepted boolean, reason string, epoch long, status string"
STATE = "status string, worker string, epoch long, until timestamp, due timestamp, failures int, told boolean, workers array<string>, epochs array<long>"


@dataclass(frozen=True)
class Terms:
    """How long a lease lasts and how often a job is tried."""

    lease: timedelta = timedelta(seconds=LEASE_S)
    attempts: int = MOST_ATTEMPTS
    backoff: timedelta = timedelta(seconds=BACKOFF_S)
    most_backoff: timedelta = timedelta(seconds=MOST_BACKOFF_S)

    def wait(self, failures: int) -> timedelta:
        """Doubled with each failure, up to the most."""
        return min(self.backoff * 2 ** min(failures - 1, 30), self.most_backoff)


class Job:
    """A job's state: pending, running, done, failed or cancelled; the worker and epoch of its lease
    and when that ends; when it may be claimed again; and the epoch that each worker last got."""

    def __init__(self, terms: Terms, state: tuple | None = None):
        self.terms = terms
        self.status, self.worker, self.epoch, self.until, self.due, self.failures, self.told, workers, epochs = state or ("pending", None, 0, None, None, 0, False, [], [])
        self.granted = dict(zip(workers, epochs, strict=True))

    @property
    def state(self) -> tuple:
        return self.status, self.worker, self.epoch, self.until, self.due, self.failures, self.told, list(self.granted), list(self.granted.values())

    def refusal(self, at: datetime, worker: str | None, action: str | None, epoch: int | None) -> str | None:
        """Why a request is refused; None if it isn't. ``epoch`` is what the worker presents."""
        if action not in ACTIONS or worker is None:
            return "unknown_request"
        if self.status in ("done", "failed", "cancelled"):
            return f"job_{self.status}"
        if action == "cancel":
            return None
        if action == "claim":
            if self.status == "running" and self.until > at:
                return "lease_held"
            return "not_due" if self.status == "pending" and self.due is not None and self.due > at else None
        if self.status != "running":
            return "not_running"
        if epoch is None:
            return "never_claimed"
        if worker != self.worker or epoch != self.epoch:
            return "fenced"
        return None if self.until > at else "lease_expired"

    def request(self, at: datetime, worker: str | None, action: str | None, epoch: int | None = None) -> str | None:
        """Applies a request and returns why it is refused, or None. Without ``epoch`` a worker
        presents the one it last got."""
        why = self.refusal(at, worker, action, self.granted.get(worker) if epoch is None else epoch)
        if why:
            return why
        if action == "claim":
            self.status, self.worker, self.epoch, self.told = "running", worker, self.epoch + 1, False
            self.granted[worker] = self.epoch
            self.until = at + self.terms.lease
        elif action == "renew":
            self.until = at + self.terms.lease
        elif action == "fail":
            self.failures += 1
            self.status = "pending" if self.failures < self.terms.attempts else "failed"
            self.due, self.worker, self.until = at + self.terms.wait(self.failures), None, None
        else:
            self.status, self.worker, self.until = "done" if action == "complete" else "cancelled", None, None
        return None

    def run_out(self, at: datetime) -> bool:
        """Whether the lease has ended by ``at`` and that wasn't told yet; tells it."""
        ended = self.status == "running" and self.until <= at and not self.told
        self.told |= ended
        return ended


def requests(df: DataFrame, job: str, ts: str, event_id: str, worker: str, action: str) -> DataFrame:
    """The columns that the functions here take. Rows without a job or a time are left out."""
    out = df.select(F.col(job).cast("string").alias("job"), F.col(ts).cast("timestamp").alias("ts"), F.col(event_id).cast("long").alias("event_id"), F.col(worker).cast("string").alias("worker"), F.col(action).alias("action"))
    return out.where("job IS NOT NULL AND ts IS NOT NULL")


def plain(x):  # noqa: ANN001, ANN201
    return None if x is None or x is pd.NaT or x != x else x


def fold(job: Job, rows: pd.DataFrame) -> list[tuple]:
    """What becomes of requests in order; leases that end before a request are told first."""
    out = []
    for r in rows.sort_values(["ts", "event_id"], na_position="first", kind="stable").itertuples():
        at, worker, action, event_id = r.ts.to_pydatetime(), plain(r.worker), plain(r.action), plain(r.event_id)
        if job.run_out(at):
            out.append((job.until, None, job.worker, "expire", True, None, job.epoch, job.status))
        why = job.request(at, worker, action)
        out.append((at, event_id, worker, action, why is None, why, job.epoch, job.status))
    return out


COLUMNS = [c.split()[0] for c in OUT.split(", ")]
KINDS = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string()]


def framed(job: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(job, *r) for r in rows], columns=COLUMNS)
    out["event_id"] = out["event_id"].astype("Int64")
    out["ts"] = pd.to_datetime(out["ts"])
    return out


def lease_log(log: DataFrame, terms: Terms | None = None) -> DataFrame:
    """job, ts, event_id, worker, action, accepted, reason, epoch and status of every request of a
    log, in its job's order of time and event_id, and a row ``expire`` where a lease ran out before
    the next request. A job's requests are an ordered fold: they meet in one task, row by row."""
    terms = terms or Terms()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_jobs(batches, terms):
            out = []
            for name, job, at, event_id, worker, action in rows:
                if job.run_out(at):
                    out.append((name, job.until, None, job.worker, "expire", True, None, job.epoch, job.status))
                why = job.request(at, worker, action)
                out.append((name, at, event_id, worker, action, why is None, why, job.epoch, job.status))
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(KINDS)], COLUMNS)

    return in_order(log, F.asc_nulls_first("event_id"), "worker", "action").mapInArrow(run, OUT)


def in_order(log: DataFrame, last: Column, *columns: str) -> DataFrame:
    """A log dealt by its jobs, each job's rows one after the other by time and ``last``."""
    return log.select("job", "ts", "event_id", *columns).repartition("job").sortWithinPartitions("job", "ts", last)


def by_jobs(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[Iterator[tuple]]:
    """For each batch its rows: the job's name, its machine, and the other columns. A job goes on from
    batch to batch, so none is held whole."""
    name, job = None, None
    for batch in batches:

        def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
            nonlocal name, job
            # Times are instants, without a zone in Python.
            at = batch.column(1).cast(pa.timestamp("us", "UTC")).cast(pa.int64()).cast(pa.timestamp("us"))
            others = (c.to_pylist() for c in batch.columns[2:])
            for key, *rest in zip(batch.column(0).to_pylist(), at.to_pylist(), *others, strict=True):
                if job is None or key != name:
                    name, job = key, Job(terms)
                yield key, job, *rest

        yield rows()


def lease_stream(log: DataFrame, terms: Terms | None = None, late: str = "0 seconds") -> DataFrame:
    """``lease_log`` of a stream, in append mode: requests wait for the watermark, so they are taken in
    order over micro-batches, and a timer tells that a lease ran out although nothing more comes."""
    terms = terms or Terms()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = state.get if state.exists else None
        job = Job(terms, tuple(saved[:9]) if saved else None)
        held = pd.DataFrame(list(zip(*saved[9:], strict=True)) if saved else [], columns=["ts", "event_id", "worker", "action"])
        more = [f[["ts", "event_id", "worker", "action"]] for f in frames]
        held = pd.concat([f for f in (held, *more) if len(f)]) if len(held) or any(map(len, more)) else held
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        due = held["ts"] < mark if len(held) else []
        rows = fold(job, held[due]) if len(held) else []
        rest = held[~due] if len(held) else held
        if job.run_out(mark.to_pydatetime()):
            rows.append((job.until, None, job.worker, "expire", True, None, job.epoch, job.status))
        waits = [t.to_pydatetime() for t in rest["ts"]]
        state.update((*job.state, waits, [plain(x) for x in rest["event_id"]], [plain(x) for x in rest["worker"]], [plain(x) for x in rest["action"]]))
        ends = [*waits, *([job.until] if job.status == "running" and not job.told else [])]
        if ends:
            first = int(pd.Timestamp(min(ends)).timestamp() * 1000) + 1
            state.setTimeoutTimestamp(max(first, state.getCurrentWatermarkMs() + 1))
        yield framed(key[0], rows)

    kinds = f"{STATE}, held_ts array<timestamp>, held_id array<long>, held_worker array<string>, held_action array<string>"
    return log.withWatermark("ts", late).groupBy("job").applyInPandasWithState(step, OUT, kinds, "append", GroupStateTimeout.EventTimeTimeout)


def lease_issues(log: DataFrame, terms: Terms | None = None) -> DataFrame:
    """job, event_id and issue of every row of a log (job, ts, event_id, worker, action, and the
    ``accepted`` and ``epoch`` it states) that doesn't follow from the rows before it:
    accepted_wrongly, refused_wrongly or epoch_wrong. Rows are judged by the state that the rules
    give, so that one fault isn't counted again in all that follow."""
    terms = terms or Terms()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_jobs(batches, terms):
            out: list[tuple] = []
            for name, job, at, event_id, worker, action, accepted, epoch in rows:
                why = job.request(at, worker, action)
                stated = bool(accepted)
                if stated != (why is None):
                    out.append((name, event_id, "accepted_wrongly" if stated else "refused_wrongly"))
                elif stated and epoch != job.epoch:
                    out.append((name, event_id, "epoch_wrong"))
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["job", "event_id", "issue"])

    return in_order(log, F.asc_nulls_last("event_id"), "worker", "action", "accepted", "epoch").mapInArrow(judge, "job string, event_id long, issue string")
