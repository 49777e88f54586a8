"""Which chunks may serve a case, and what of an answer they bear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.intervals import interval_join
from millrace.operators.scope import in_window

ROLES = ("owner", "admin", "operator", "viewer")


def valid_context(request_id: Column, tenant: Column, user: Column, revision: Column, enforced: Column, role: Column, shops: Column, shop: Column, all_shops: Column) -> Column:
    """Whether a request's authorization context holds together; null fields don't."""
    filled = lambda c: F.coalesce(c.cast("string") != "", F.lit(False))
    given = filled(request_id) & filled(tenant) & filled(user) & filled(revision) & F.coalesce(enforced, F.lit(False))
    own = F.coalesce(shop, F.lit("")) == ""
    own = own | F.coalesce(F.array_contains(shops, shop), F.lit(False))
    known = F.coalesce(role.isin(*ROLES), F.lit(False)) & (F.size(F.coalesce(shops, F.array().cast("array<string>"))) > 0)
    return given & known & own & (~F.coalesce(all_shops, F.lit(False)) | role.isin("owner", "admin"))


def eligible_chunks(cases: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks each case may use: in its tenant, shop and date at both levels, external only.

    ``cases``: case_id, tenant_id, shop_id, on. ``documents`` and ``chunks`` have doc_id, tenant_id,
    shop_id, effective_from and effective_to, chunks also disclosure_class."""
    docs = documents.select("doc_id", "tenant_id", "shop_id", "effective_from", "effective_to")
    docs = interval_join(cases, docs, ["tenant_id", "shop_id"], "on", "effective_from", "effective_to")
    own = chunks.where(F.col("disclosure_class") == "external_allowed")
    own = docs.select("case_id", "on", "doc_id", "tenant_id", "shop_id").join(own, ["doc_id", "tenant_id", "shop_id"])
    return own.where(in_window(F.col("on"), F.col("effective_from"), F.col("effective_to")))


def generation_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence that an answer may rest on: neither internal nor unclassified, external, eligible."""
    return evidence.where(~F.col("source_type").isin("internal", "unclassified") & (F.col("disclosure_class") == "external_allowed") & F.col("customer_eligible"))


def canonical(evidence: DataFrame, chunks: DataFrame, attributes: list[str]) -> DataFrame:
    """``evidence`` with ``canonical``: some chunk has all its attributes, null equal to null."""
    own = chunks.select(*(F.col(c).alias(f"chunk_{c}") for c in attributes)).distinct().withColumn("canonical", F.lit(True))
    on = [evidence[c].eqNullSafe(F.col(f"chunk_{c}")) for c in attributes]
    out = evidence.join(own, on, "left")
    return out.select(*evidence.columns, F.coalesce("canonical", F.lit(False)).alias("canonical"))


# Words that mark a refusal, and tags that do.
REFUSALS = ("拒绝", "撤销", "撤权", "不能继续", "无法", "不应")
REFUSAL_TAGS = ("unauthorized", "unanswerable", "revoked", "expired")


def refusal_expected(tags: Column, points: Column) -> Column:
    """By a tag, or a word in the expected points (an array of strings)."""
    tagged = F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*(F.lit(t) for t in REFUSAL_TAGS)))
    told = F.array_join(F.coalesce(points, F.array().cast("array<string>")), " ").rlike("|".join(REFUSALS))
    return tagged | told


def hit_and_coverage(cases: DataFrame) -> DataFrame:
    """Per case (expected, found: arrays of ids) hit and coverage; no expectation has none of both."""
    shared, n = F.size(F.array_intersect("expected", "found")), F.size(F.array_distinct("expected"))
    return cases.withColumn("hit", F.when(n > 0, shared > 0)).withColumn("coverage", F.when(n > 0, shared / n))


def composition(answers: DataFrame) -> DataFrame:
    """Signals of how expected points came into an answer, a row per expected point.

    ``answers``: answer_id, expected and generated (arrays of texts). Blank generated points don't
    count; a point is supported by another if that has half of its tokens or more."""
    rows = answers.withColumn("generated", F.filter("generated", lambda x: F.trim(x) != ""))
    rows = rows.withColumn("sets", F.transform("generated", X.tokens)).withColumn("whole", F.array_join("generated", "\n"))
    rows = rows.select("answer_id", "sets", "whole", F.posexplode("expected").alias("point", "text"))
    rows = rows.withColumn("own", X.tokens(F.col("text"))).withColumn("every", F.array_distinct(F.flatten("sets")))
    half = lambda s: (F.size("own") > 0) & (2 * F.size(F.array_intersect("own", s)) >= F.size("own"))
    rows = rows.withColumn("single", F.size(F.filter("sets", half))).withColumn("together", half(F.col("every")))
    a, b = X.script_profile(F.col("text")), X.script_profile(F.col("whole"))
    plain = a.isin("zh", "en") & b.isin("zh", "en")
    relation = (
        F.when(F.size("sets") == 0, "generated_missing").when(plain & (a == b), "same_script").when(plain, "opposite_script")
        .when((a == "mixed") & (b == "mixed"), "mixed").otherwise("unclassified")
    )
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), 0))
    own_marks, marks = (X.markers_in(F.col(c), X.MARKERS) for c in ("text", "whole"))
    own_kinds, kinds = (X.kinds_in(F.col(c), X.MARKERS) for c in ("text", "whole"))
    own_units, units = (X.kinds_in(F.col(c), X.UNITS) for c in ("text", "whole"))
    count = lambda c: F.size(c).cast("long")
    return rows.select(
        "answer_id", F.col("point").cast("long").alias("point"), count(F.filter("sets", half)).alias("single_matches"), "together",
        (F.col("together") & (F.col("single") == 0) & (F.size("sets") > 1)).alias("split_candidate"), relation.alias("language_relation"),
        count(own_marks).alias("qualifiers"), count(F.array_except(own_marks, marks)).alias("missing_qualifiers"),
        count(own_kinds).alias("qualifier_kinds"), count(F.array_except(own_kinds, kinds)).alias("missing_qualifier_kinds"),
        count(numbers(F.col("text"))).alias("numbers"), count(F.array_intersect(numbers(F.col("text")), numbers(F.col("whole")))).alias("matched_numbers"),
        count(own_units).alias("unit_kinds"), count(F.array_intersect(own_units, units)).alias("matched_unit_kinds"),
    )
