"""Work in batches that can be stopped and taken up again, writing nothing twice.

Each finished batch leaves a record: its number, a hash of its ids, a hash of its result, and the
costs so far. Records belong to one identity, a hash over what the run is made of; a rerun of another
identity is refused. Completed batches are a prefix of the plan and costs never fall, so what is left
to do follows from the records alone. ``Resumable`` is given to ``foreachBatch``; ``record_issues``
checks the records of any number of runs against their plans.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.store import exists

RECORD = "batch int, identity string, ids_hash string, rows_hash string, n_rows long, requests long, cost long"


class ResumeError(ValueError):
    """A rule of resuming is broken; the text is the rule's name."""


def identity_of(**parts: object) -> str:
    """The hash of what a run is made of: data, model, parameters."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def set_hash(df: DataFrame, columns: list[str]) -> tuple[int, str]:
    """The number of rows and a hash of them that doesn't depend on their order: sums, modulo 2^64
    and without overflow, of the four quarters of each row's SHA-256."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    quarters = [F.conv(F.substring(row, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)") for k in range(4)]
    n, *sums = df.agg(F.count(F.lit(1)), *[F.sum(q) for q in quarters]).first()
    return n, hashlib.sha256(":".join([str(n), *(str(int(s or 0) % (1 << 64)) for s in sums)]).encode()).hexdigest()


@dataclass
class Resumable:
    """A function for ``foreachBatch`` that computes, writes and records a micro-batch once.

    ``compute`` makes a batch's result; ``requests`` how many requests its number of rows takes;
    ``ceiling`` the most of a whole run. Results lie in ``path``/results by batch, and are overwritten
    until their record, the last thing written, is there."""

    path: str
    identity: str
    compute: Callable[[DataFrame], DataFrame]
    requests: Callable[[int], int]
    ceiling: int
    ids: list[str] = field(default_factory=lambda: ["id"])

    def records(self, spark: SparkSession) -> list[dict]:
        """Records in order; raises the first rule they break."""
        if not exists(spark, f"{self.path}/records"):
            return []
        found = [r.asDict() for r in spark.read.schema(RECORD).parquet(f"{self.path}/records").orderBy("batch").collect()]
        before = 0
        for k, r in enumerate(found):
            if r["identity"] != self.identity:
                raise ResumeError("identity_mismatch")
            if r["batch"] != k:
                raise ResumeError("completed_batches_not_prefix")
            if r["requests"] < before or r["cost"] != r["requests"]:
                raise ResumeError("batch_budget_invalid")
            before = r["requests"]
        return found

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = self.records(spark)
        n, ids_hash = set_hash(batch, self.ids)
        if number < len(done):
            # A batch that is replayed after a stop: its record stands, nothing is written.
            if done[number]["ids_hash"] != ids_hash:
                raise ResumeError("batch_ids_mismatch")
            return
        if number > len(done):
            raise ResumeError("completed_batches_not_prefix")
        spent = (done[-1]["requests"] if done else 0) + self.requests(n)
        if spent > self.ceiling:
            raise ResumeError("budget_exceeded")
        place = f"{self.path}/results/batch={number}"
        self.compute(batch).write.mode("overwrite").parquet(place)
        written = spark.read.parquet(place)
        rows, rows_hash = set_hash(written, sorted(written.columns))
        row = (self.identity, ids_hash, rows_hash, rows, spent, spent)
        spark.createDataFrame([row], RECORD.partition(", ")[2]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/records/batch={number}")


def result(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all recorded batches; a batch that was cut short has no record and doesn't count."""
    recorded = spark.read.schema(RECORD).parquet(f"{path}/records").select("batch")
    return spark.read.parquet(f"{path}/results").join(F.broadcast(recorded), "batch", "left_semi")


def planned_batches(cases: DataFrame, run: str, case: str, size: int) -> DataFrame:
    """run, batch (from 1), cases and ids_hash: each run's cases (whole numbers) in order, ``size`` to
    a batch. Ranks come from running counts over ranges of a thousand numbers, so that a long run
    isn't sorted in one task."""
    rows = cases.select(F.col(run).alias("run"), F.col(case).cast("long").alias("case"), F.floor(F.col(case) / 1000).alias("_cell"))
    cells = rows.groupBy("run", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = cells.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("run").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = rows.withColumn("_i", F.row_number().over(W.partitionBy("run", "_cell").orderBy("case")))
    number = inside.join(before, ["run", "_cell"]).select("run", "case", (F.floor((F.col("_before") + F.col("_i") - 1) / size) + 1).alias("batch"))
    listed = F.array_join(F.array_sort(F.collect_list("case")).cast("array<string>"), ",")
    return number.groupBy("run", "batch").agg(F.count(F.lit(1)).alias("cases"), F.sha2(listed, 256).alias("ids_hash"))


def record_issues(heads: DataFrame, records: DataFrame, plan: DataFrame) -> DataFrame:
    """run, batch (null for the run as a whole) and issue: every rule that stored records break.

    ``heads``: run, status, requests, cost, active_batch, active_requests. ``records``: run, batch,
    ids_hash, requests, cost, of completed batches. ``plan``: run, batch, ids_hash."""
    by = W.partitionBy("run").orderBy("batch")
    rows = records.join(plan.select("run", "batch", F.col("ids_hash").alias("planned")), ["run", "batch"], "left")
    rows = rows.withColumn("_i", F.row_number().over(by)).withColumn("_before", F.coalesce(F.max("requests").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def told(df: DataFrame, rules: dict[str, Column], batch: Column) -> DataFrame:
        broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items())))
        return df.select("run", batch.alias("batch"), F.explode(broken).alias("issue"))

    of_batches = told(rows, {
        "completed_batches_not_prefix": F.col("batch") != F.col("_i"),
        "batch_ids_mismatch": F.coalesce(F.col("ids_hash") != F.col("planned"), F.lit(True)),
        "batch_budget_invalid": (F.col("requests") < F.col("_before")) | (F.col("cost") != F.col("requests")),
    }, F.col("batch").cast("long"))
    done = records.groupBy("run").agg(F.count(F.lit(1)).alias("_done"), F.max("requests").alias("_spent"))
    whole = heads.join(done, "run", "left").join(plan.groupBy("run").agg(F.count(F.lit(1)).alias("_batches")), "run", "left").na.fill(0, ["_done", "_spent", "_batches"])
    status, active = F.col("status"), F.col("active_batch").isNotNull()
    of_runs = told(whole, {
        "status_invalid": ~status.isin("RUNNING", "FAILED", "COMPLETE"),
        "completed_batch_count_invalid": F.col("_done") > F.col("_batches"),
        "request_count_mismatch": F.col("requests") < F.col("_spent"),
        "cost_units_mismatch": F.col("cost") != F.col("requests"),
        "active_batch_unexpected": active & (status != "RUNNING"),
        "active_batch_mismatch": F.coalesce(active & (status == "RUNNING") & (F.col("active_batch") != F.col("_done") + 1), F.lit(False)),
        "active_batch_budget_mismatch": F.coalesce(active & (status == "RUNNING") & (F.col("requests") != F.col("_spent") + F.col("active_requests")), F.lit(False)),
        "running_budget_mismatch": (status == "RUNNING") & ~active & (F.col("requests") != F.col("_spent")),
        "running_batch_count_invalid": (status == "RUNNING") & (F.col("_done") == F.col("_batches")),
        "complete_batch_count_invalid": (status == "COMPLETE") & (F.col("_done") != F.col("_batches")),
        "complete_budget_mismatch": (status == "COMPLETE") & (F.col("requests") != F.col("_spent")),
    }, F.lit(None).cast("long"))
    return of_batches.unionByName(of_runs)
