"""Who may see what: scopes, disclosure classes, date windows, access lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIVILEGED = ("admin", "owner")


#: Requests up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_REQUESTS = 50_000


@dataclass(frozen=True)
class Scope:
    """``documents`` None is any document, empty is none. Without ``on`` dates aren't looked at."""

    tenant: str
    shops: tuple[str, ...] = ()
    role: str = "viewer"
    shop: str | None = None
    on: str | None = None
    documents: tuple[int, ...] | None = None

    @property
    def empty(self) -> bool:
        return not self.tenant or not self.shops or (self.shop is not None and self.shop not in self.shops)


def in_window(on: Column, start: Column, end: Column) -> Column:
    """Half open: from ``start`` on and before ``end``; null ends are open."""
    return (start.isNull() | (start <= on)) & (end.isNull() | (on < end))


def date_state(on: Column, start: Column, end: Column) -> Column:
    """invalid, not_yet_effective, expired_or_revoked or active."""
    return (
        F.when(on.isNull() | (end <= start), "invalid")
        .when(on < start, "not_yet_effective")
        .when(on >= end, "expired_or_revoked")
        .otherwise("active")
    )


def visible_in_index(disclosure: Column, role: str) -> Column:
    """The index's rule: what isn't external, unclassified too, is for the privileged."""
    return (disclosure == "external_allowed") | F.lit(role in PRIVILEGED)


def eligible_by_policy(disclosure: Column, role: Column) -> Column:
    """The policy's rule: unclassified is for nobody, internal for the privileged."""
    return (disclosure == "external_allowed") | ((disclosure == "internal_only") & role.isin(*PRIVILEGED))


def in_scope(df: DataFrame, scope: Scope) -> DataFrame:
    """The rows that a scope lets see. Every condition reaches the scan as a filter."""
    if scope.empty:
        return df.where(F.lit(False))
    keep = (F.col("tenant_id") == scope.tenant) & F.col("shop_id").isin(*scope.shops)
    if scope.shop is not None:
        keep = keep & (F.col("shop_id") == scope.shop)
    if scope.documents is not None:
        keep = keep & F.col("doc_id").isin(*scope.documents)
    keep = keep & visible_in_index(F.col("disclosure_class"), scope.role)
    if scope.on is not None:
        keep = keep & in_window(F.lit(scope.on).cast("date"), F.col("effective_from"), F.col("effective_to"))
    return df.where(keep)


def assess(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, doc_id and status of every document for every request of its tenant.

    ``documents`` has a row per part of a document; a request has request_id, tenant_id, shop_id,
    role and on. The first of these holds: INVALID_POLICY, INVALID_BUSINESS_DATE, SCOPE_MISMATCH,
    NOT_YET_EFFECTIVE or EXPIRED_OR_REVOKED if no part is in force, ELIGIBLE if one may be seen,
    UNCLASSIFIED_BLOCKED, ACCESS_DENIED.
    """
    asked = requests.select("request_id", F.col("tenant_id"), F.col("shop_id").alias("_shop"), "role", "on")
    rows = documents.join(F.broadcast(asked) if asked.count() <= BROADCAST_REQUESTS else asked, "tenant_id")
    active = in_window(F.col("on"), F.col("effective_from"), F.col("effective_to"))
    bad = (F.col("effective_to") <= F.col("effective_from")) | ~F.col("disclosure_class").isin("external_allowed", "internal_only", "unclassified")
    states = rows.groupBy("request_id", "doc_id").agg(
        F.bool_or(F.coalesce(bad, F.lit(False))).alias("bad"),
        F.bool_or(F.col("on").isNull()).alias("undated"),
        F.bool_or(~F.col("shop_id").eqNullSafe(F.col("_shop"))).alias("other"),
        F.bool_or(active).alias("active"),
        F.bool_or(F.coalesce(F.col("on") < F.col("effective_from"), F.lit(False))).alias("future"),
        F.bool_or(active & eligible_by_policy(F.col("disclosure_class"), F.col("role"))).alias("seen"),
        F.bool_or(active & (F.col("disclosure_class") == "unclassified")).alias("unclassified"),
    )
    status = (
        F.when(F.col("bad"), "INVALID_POLICY")
        .when(F.col("undated"), "INVALID_BUSINESS_DATE")
        .when(F.col("other"), "SCOPE_MISMATCH")
        .when(~F.col("active") & F.col("future"), "NOT_YET_EFFECTIVE")
        .when(~F.col("active"), "EXPIRED_OR_REVOKED")
        .when(F.col("seen"), "ELIGIBLE")
        .when(F.col("unclassified"), "UNCLASSIFIED_BLOCKED")
        .otherwise("ACCESS_DENIED")
    )
    return states.select("request_id", "doc_id", status.alias("status"))


def through_gates(documents: DataFrame, access: DataFrame, levels: dict[str, str]) -> DataFrame:
    """The (principal, doc_id) pairs that pass every level; a null principal stands for everyone.

    ``access`` has level, resource, principal and granted; ``levels`` names the column of
    ``documents`` that holds a level's resource. A resource without any row at its level is open; one
    with rows is closed but to principals whom a row grants. Documents open at all levels are one row
    for everyone; of the others come only the explicit grants. Each level is one equi-join with its
    aggregated rows, so no correlation skips a query level.
    """
    out = documents
    for level, column in levels.items():
        granted = access.where(F.col("level") == level).groupBy(F.col("resource").alias("_resource"))
        granted = granted.agg(F.collect_set(F.when(F.col("granted"), F.col("principal"))).alias(f"_may_{level}"))
        out = out.join(granted, out[column].cast("string") == F.col("_resource"), "left").drop("_resource")
    # A gate is a set of principals; null is an open one.
    allowed, *gates = (F.col(f"_may_{level}") for level in levels)
    for gate in gates:
        allowed = F.when(gate.isNull(), allowed).when(allowed.isNull(), gate).otherwise(F.array_intersect(allowed, gate))
    return out.select("doc_id", allowed.alias("_may")).select(F.explode(F.when(F.col("_may").isNull(), F.array(F.lit(None))).otherwise(F.col("_may"))).alias("principal"), "doc_id")
