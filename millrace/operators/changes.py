"""Changes between two states of a table, and permission revisions that follow from them.

What a database does by triggers is a fold here: the changes of all watched tables are one feed, and
each tenant or user that a change concerns gets a new revision. Revisions are hashes of the one before
and of the changes, so the same changes give the same revision wherever they are computed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, op (insert, delete or update) and changed, the names of the columns that differ (null
    differs from any value), of the rows that differ. Keys are unique and not null on either side."""
    side = lambda df, name: df.select(*keys, F.struct(*columns).alias(name))
    both = side(old, "_old").join(side(new, "_new"), keys, "full_outer")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in columns)))
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.size(differs) > 0, "update")
    none = F.array().cast("array<string>")
    return both.withColumn("op", op).where(F.col("op").isNotNull()).select(*keys, "op", F.when(F.col("op") == "update", differs).otherwise(none).alias("changed"))


@dataclass(frozen=True)
class Watch:
    """A table whose changes renew revisions: the columns and operations that count, the reason given,
    and the column of the one user concerned; of the whole tenant for None. ``given`` is a column
    that holds the user's revision itself: who changes it by hand gets no other."""

    name: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    reason: str
    ops: tuple[str, ...] = ("insert", "update", "delete")
    user: str | None = None
    given: str | None = None

    def feed(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """tenant_id, user_id (null for all of the tenant's), reason and subject of each change."""
        columns = [*self.columns, *([self.given] if self.given else [])]
        found = changes(old, new, ["tenant_id", *self.keys], columns).where(F.col("op").isin(*self.ops))
        counts = F.arrays_overlap("changed", F.array(*(F.lit(c) for c in self.columns))) if self.columns else F.lit(True)
        by_hand = F.array_contains("changed", self.given) if self.given else F.lit(False)
        found = found.where((F.col("op") != "update") | (counts & ~by_hand))
        user = F.col(self.user).cast("string") if self.user else F.lit(None).cast("string")
        subject = F.concat_ws("/", F.lit(self.name), *self.keys, "op")
        return found.select(F.col("tenant_id").cast("string").alias("tenant_id"), user.alias("user_id"), F.lit(self.reason).alias("reason"), subject.alias("subject"))


def digest(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """For each group the number of changes and a hash that doesn't depend on their order: sums of
    the parts of each subject's hash, so a tenant with any number of changes is pre-aggregated."""
    parts = [F.conv(F.substring(F.sha2("subject", 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{name}_changes"), *[F.sum(p).alias(f"_{k}") for k, p in enumerate(parts)])
    whole = F.concat_ws(":", f"{name}_changes", *(F.col(f"_{k}").cast("string") for k in range(4)))
    return sums.withColumn(name, F.sha2(whole, 256)).drop("_0", "_1", "_2", "_3")


def revised(users: DataFrame, feeds: list[DataFrame]) -> DataFrame:
    """``users`` (tenant_id, user_id, permission_revision) with revision, the one in force after the
    changes, tenant_changes and own_changes. Users that no change concerns keep theirs."""
    feed = reduce(DataFrame.unionByName, feeds)
    of_tenant = digest(feed.where("user_id IS NULL"), ["tenant_id"], "tenant")
    of_user = digest(feed.where("user_id IS NOT NULL"), ["tenant_id", "user_id"], "own")
    rows = users.withColumns({"tenant_id": F.col("tenant_id").cast("string"), "user_id": F.col("user_id").cast("string")})
    rows = rows.join(of_tenant, "tenant_id", "left").join(of_user, ["tenant_id", "user_id"], "left").na.fill(0, ["tenant_changes", "own_changes"])
    fresh = F.concat(F.lit("auth-"), F.substring(F.sha2(F.concat_ws("|", "permission_revision", "tenant", "own"), 256), 1, 24))
    touched = (F.col("tenant_changes") > 0) | (F.col("own_changes") > 0)
    return rows.withColumn("revision", F.when(touched, fresh).otherwise(F.col("permission_revision"))).drop("tenant", "own")


def readable(executions: DataFrame, users: DataFrame) -> DataFrame:
    """``executions`` (tenant_id, user_id, permission_revision) with readable: their user is there and
    their revision is the one in force; null equals null, as a user without one has never changed."""
    now = users.select("tenant_id", "user_id", F.col("revision").alias("_now"), F.lit(True).alias("_there"))
    rows = executions.withColumns({"tenant_id": F.col("tenant_id").cast("string"), "user_id": F.col("user_id").cast("string")}).join(now, ["tenant_id", "user_id"], "left")
    good: Column = F.coalesce("_there", F.lit(False)) & F.col("permission_revision").eqNullSafe(F.col("_now"))
    return rows.withColumn("readable", good).drop("_now", "_there")
