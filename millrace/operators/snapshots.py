"""Mutations as pure functions from one snapshot to the next, since Parquet tables aren't updated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(now: DataFrame, new: DataFrame, key: str, add: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``now`` with their key; columns of ``add`` are summed."""
    values = [c for c in now.columns if c != key]
    fresh = new.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in values))
    both = now.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")

    def value(c: str) -> Column:
        if c in add:
            return F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))
        return F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))

    return both.select(key, *(value(c).alias(c) for c in values))


def insert_missing(now: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't there are added; others are ignored."""
    return now.unionByName(new.join(now.select(key), key, "left_anti"))


def replace_documents(chunks: DataFrame, new: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Chunks without those of replaced or removed documents, and the new ones."""
    gone = removed.select(key).unionByName(new.select(key)).distinct()
    return chunks.join(gone, key, "left_anti").unionByName(new)


def compare_and_set(now: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``now`` where ``column`` becomes the change's ``to`` if it was its ``expected``; ``outcome`` is
    applied, conflict or unchanged."""
    wanted = changes.select(F.col(key), F.col("expected").alias("_e"), F.col("to").alias("_t"), F.lit(True).alias("_c"))
    out = now.join(wanted, key, "left")
    same = F.col(column).eqNullSafe(F.col("_e"))
    outcome = F.when(F.col("_c").isNull(), "unchanged").when(same, "applied").otherwise("conflict")
    return out.withColumn("outcome", outcome).withColumn(column, F.when(F.col("outcome") == "applied", F.col("_t")).otherwise(F.col(column))).drop("_e", "_t", "_c")


def publish(versions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The versions after publishing, and an audit row for every decision.

    ``versions``: doc_id, version_no, state, content_hash. ``decisions``: doc_id, version_no,
    content_hash, action (publish, rollback or revoke), of which the last by ``seq`` counts for a
    document. An approved version of the same hash becomes active and the active one superseded; a
    rollback makes a superseded one active again; a revoked one stays revoked.
    """
    last = W.partitionBy("doc_id").orderBy(F.desc("seq"))
    d = decisions.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    d = d.select("doc_id", F.col("version_no").alias("_v"), F.col("content_hash").alias("_h"), "action", "seq")
    rows = versions.join(d, "doc_id", "left")
    own = F.col("version_no") == F.col("_v")
    same = F.col("content_hash") == F.col("_h")
    starts = own & same & (((F.col("action") == "publish") & (F.col("state") == "approved")) | ((F.col("action") == "rollback") & (F.col("state") == "superseded")))
    ends = own & (F.col("action") == "revoke") & (F.col("state") != "revoked")
    rows = rows.withColumn("_starts", F.coalesce(starts, F.lit(False))).withColumn("_ends", F.coalesce(ends, F.lit(False)))
    rows = rows.withColumn("_doc_starts", F.bool_or("_starts").over(W.partitionBy("doc_id")))
    state = (
        F.when(F.col("_starts"), "active")
        .when(F.col("_ends"), "revoked")
        .when(F.col("_doc_starts") & (F.col("state") == "active"), "superseded")
        .otherwise(F.col("state"))
    )
    after = rows.select("doc_id", "version_no", state.alias("state"), "content_hash")
    done = rows.groupBy("doc_id").agg(F.bool_or(F.col("_starts") | F.col("_ends")).alias("applied"))
    audit = d.join(done, "doc_id", "left").select("seq", "doc_id", F.col("_v").alias("version_no"), "action", F.coalesce("applied", F.lit(False)).alias("applied"))
    return after, audit


def import_status(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and status: IMPORTED without an old row, IDEMPOTENT if both hashes are equal, else UPDATED."""
    before = old.select(F.col(key), F.col("content_hash").alias("_c"), F.col("meta_hash").alias("_m"), F.lit(True).alias("_old"))
    same = F.col("content_hash").eqNullSafe(F.col("_c")) & F.col("meta_hash").eqNullSafe(F.col("_m"))
    status = F.when(F.col("_old").isNull(), "IMPORTED").when(same, "IDEMPOTENT").otherwise("UPDATED")
    return new.join(before, key, "left").select(key, status.alias("status"))


def submit_status(df: DataFrame, key: list[str], payload: str, order: list[str]) -> DataFrame:
    """Adds ``status`` to requests: new for the first of a key, then replay for the same payload and
    conflict for another."""
    line = W.partitionBy(*key).orderBy(*order)
    first = F.first(payload).over(line)
    status = F.when(F.row_number().over(line) == 1, "new").when(F.col(payload).eqNullSafe(first), "replay").otherwise("conflict")
    return df.withColumn("status", status)


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """``left`` with ``as_of_<value>``, the ``value`` of the last row of ``right`` of its key at or before its time, null
    without one; of equal times in ``right`` the largest value counts.

    One shuffle: both sides are lined up by key and time, and the last value is carried forward."""
    facts = right.groupBy(F.col(key).alias("_key"), F.col(right_time).alias("_at")).agg(F.max(value).alias("_v"))
    l = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_at"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    r = facts.select("_key", "_at", "_v", F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    line = W.partitionBy("_key").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_found", F.last("_v", ignorenulls=True).over(line)).where("_row is not null")
    return out.select("_row.*", F.col("_found").alias(f"as_of_{value}"))


def renew(asks: DataFrame, leases: DataFrame, key: str, length: Column) -> DataFrame:
    """``asks`` (key, ts, asked_epoch) with ``outcome`` against ``leases`` (key, epoch, since; one row a
    key): no_lease, fenced by another epoch, expired outside [since, since + length), or renewed."""
    out = asks.join(leases, key, "left")
    late = (F.col("ts") < F.col("since")) | (F.col("ts") >= F.col("since") + length)
    outcome = F.when(F.col("epoch").isNull(), "no_lease").when(F.col("epoch") != F.col("asked_epoch"), "fenced").when(late, "expired")
    return out.withColumn("outcome", outcome.otherwise("renewed"))


def upsert_owned(now: DataFrame, new: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows of ``new`` replace those of ``now`` with their key and owner, or are added; a row of another
    owner changes nothing and is a conflict. ``outcome``: unchanged, updated, conflict or inserted."""
    values = [c for c in now.columns if c != key]
    fresh = new.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in values))
    both = now.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")
    outcome = (
        F.when(F.col("_new").isNull(), "unchanged").when(F.col("_old").isNull(), "inserted")
        .when(F.col(owner).eqNullSafe(F.col(f"_{owner}")), "updated").otherwise("conflict")
    )
    both = both.withColumn("outcome", outcome)
    taken = F.col("outcome").isin("updated", "inserted")
    return both.select(key, *(F.when(taken, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values), "outcome")


def decide(versions: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """``versions`` (key, content_hash, state) after ``decisions`` (key, seen, decision; one row a key).

    Only what needs a review takes a decision, and only if the hash that the reviewer saw is still
    its own. ``outcome``: undecided, not_reviewable, stale or decided."""
    out = versions.join(decisions, key, "left")
    outcome = (
        F.when(F.col("decision").isNull(), "undecided").when(F.col("state") != "needs_review", "not_reviewable")
        .when(~F.col("seen").eqNullSafe(F.col("content_hash")), "stale").otherwise("decided")
    )
    out = out.withColumn("outcome", outcome)
    new = F.when(F.col("decision") == "approve", "approved").otherwise("rejected")
    return out.withColumn("state", F.when(F.col("outcome") == "decided", new).otherwise(F.col("state"))).drop("seen", "decision")
