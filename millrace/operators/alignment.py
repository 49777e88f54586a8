"""Rules over nested artifacts as JSON text: corpora of documents with chunks, approved evidence.

Values are VARIANT, so a rule can tell a number from its text and a missing field from an empty one.
Maps and arrays are exploded level by level, each issue has the path of what it is about, and all of a
suite is rows: no artifact is read into a task as a whole beyond its own line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.integrity import Check

# Disclosure classes.
CLASSES = ("external_allowed", "internal_only", "unclassified")


def field(value: str, name: str) -> Column:
    return F.variant_get(F.col(value), f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """The kind of a JSON value: STRING, BIGINT, ARRAY, OBJECT and so on; null if it is missing, VOID
    for null."""
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def filled(value: Column) -> Column:
    """Whether a value is a text and not empty."""
    return F.coalesce((kind(value) == "STRING") & (F.try_variant_get(value, "$", "string") != ""), F.lit(False))


def text(value: Column) -> Column:
    """A text; null for any other value."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def absent(value: Column) -> Column:
    """Missing or null."""
    return F.coalesce(kind(value) == "VOID", F.lit(True))


def same(a: Column, b: Column) -> Column:
    """Equal as JSON; missing and null are the same."""
    shown = lambda v: F.when(~absent(v), F.to_json(v))
    return shown(a).eqNullSafe(shown(b))


def day(value: Column) -> Column:
    """The date of an ISO text; null for anything else."""
    iso = text(value)
    return F.when(iso.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(iso, "yyyy-MM-dd"))


def not_empty(value: Column, of: str) -> Column:
    """Whether a value is an OBJECT or ARRAY with something in it."""
    return F.coalesce((kind(value) == of) & ~F.to_json(value).isin("{}", "[]"), F.lit(False))


def exploded(df: DataFrame, value: str, names: tuple[str, str, str]) -> DataFrame:
    """A row for each entry of the object or array in column ``value``: its place from 0, its key and
    its value. Other values have none."""
    sql = "SELECT df.*, t.* FROM {df} AS df, LATERAL variant_explode(df." + value + ") AS t(" + ", ".join(names) + ")"
    return df.sparkSession.sql(sql, df=df)


def issues(df: DataFrame, path: Column, checks: list[Check]) -> DataFrame:
    """artifact_id, path and code of each check that a row fails."""
    codes = F.array_compact(F.array(*(F.when(F.coalesce(c.broken, F.lit(False)), F.lit(c.rule)) for c in checks)))
    return df.select("artifact_id", path.alias("path"), F.explode(codes).alias("code"))


def parsed(df: DataFrame) -> DataFrame:
    """Adds ``v``: the JSON object of column json, null for anything else, repeated keys too."""
    value = F.try_parse_json("json")
    return df.withColumn("v", F.when(kind(value) == "OBJECT", value))


def policy_checks(value: str, prefix: str) -> list[Check]:
    """Class, dates and their order, of a document or a chunk."""
    since, until = field(value, "effective_from"), field(value, "effective_to")
    known = F.coalesce(text(field(value, "disclosure_class")).isin(*CLASSES), F.lit(False))
    dated = lambda v: absent(v) | day(v).isNotNull()
    return [
        Check(f"{prefix}_disclosure_class_invalid", ~known), Check(f"{prefix}_date_invalid", ~(dated(since) & dated(until))),
        Check(f"{prefix}_date_range_invalid", F.coalesce(day(since) >= day(until), F.lit(False))),
    ]


def corpus_issues(corpus: DataFrame) -> DataFrame:
    """artifact_id, path and code of all that is wrong with corpora: artifact_id, line (from 1) and json,
    a document to a line.

    A document without an id, or whose id came on an earlier line, isn't judged any further; of equal
    chunk ids the first in order counts. Paths are a line, a document, document/chunk number or
    document/chunk number/field."""
    rows = parsed(corpus)
    line = F.col("line").cast("string")
    rows = rows.withColumn("id", F.when(filled(field("v", "document_id")), text(field("v", "document_id"))))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("artifact_id", "id").orderBy("line")))
    of_lines = issues(rows, line, [Check("json_input_invalid", F.col("v").isNull()), Check("corpus_document_id_invalid", F.col("v").isNotNull() & F.col("id").isNull())])
    repeated = rows.where("id IS NOT NULL AND nth > 1").select("artifact_id", F.col("id").alias("path"), F.lit("duplicate_corpus_document_id").alias("code"))
    docs = rows.where("id IS NOT NULL AND nth = 1").select("artifact_id", "line", "id", "v")
    of_docs = issues(docs, F.col("id"), [
        Check("corpus_scope_invalid", ~(filled(field("v", "tenant_id")) & filled(field("v", "shop_id")))), *policy_checks("v", "corpus_document"),
        Check("corpus_chunks_invalid", F.coalesce(kind(field("v", "chunks")) != "ARRAY", F.lit(True))),
    ])
    chunks = exploded(docs.withColumn("list", F.when(kind(field("v", "chunks")) == "ARRAY", field("v", "chunks"))), "list", ("pos", "key", "c"))
    path = F.concat_ws("/", "id", (F.col("pos") + 1).cast("string"))
    chunks = chunks.withColumn("path", path).withColumn("is_object", F.coalesce(kind(F.col("c")) == "OBJECT", F.lit(False)))
    not_objects = issues(chunks, F.col("path"), [Check("corpus_chunk_invalid", ~F.col("is_object"))])
    own = chunks.where("is_object").withColumn("chunk_id", F.when(filled(field("c", "chunk_id")), text(field("c", "chunk_id"))))
    own = own.withColumn("nth", F.row_number().over(W.partitionBy("artifact_id", "chunk_id").orderBy("line", "pos")))
    scope = same(field("c", "tenant_id"), field("v", "tenant_id")) & same(field("c", "shop_id"), field("v", "shop_id"))
    of_chunks = issues(own, F.col("path"), [
        Check("corpus_chunk_id_invalid", F.col("chunk_id").isNull()), Check("corpus_chunk_scope_mismatch", ~scope), *policy_checks("c", "corpus_chunk"),
        Check("corpus_chunk_source_position_invalid", ~not_empty(field("c", "source_position"), "OBJECT")),
    ])
    copies = own.where("chunk_id IS NOT NULL AND nth > 1").select("artifact_id", F.col("chunk_id").alias("path"), F.lit("duplicate_corpus_chunk_id").alias("code"))
    differing = [own.where(~same(field("c", n), field("v", n))).select("artifact_id", F.concat_ws("/", "path", F.lit(n)).alias("path"), F.lit("corpus_chunk_policy_mismatch").alias("code")) for n in ("disclosure_class", "effective_from", "effective_to")]
    return reduce(DataFrame.unionByName, [of_lines, repeated, of_docs, not_objects, of_chunks, copies, *differing])


def approved_issues(artifacts: DataFrame, case_ids: DataFrame) -> DataFrame:
    """artifact_id, path (null for the whole, a case, case/check, case/check/chunk) and code of what is wrong
    with approved alignments: artifact_id, json and corpus_sha256, the hash of the corpus at hand.
    ``case_ids``: artifact_id and case_id, the cases there are.

    Only artifacts with status APPROVED that have source_corpus_sha256 or case_evidence are judged; a
    missing map of evidence, or one of other cases than there are, ends the judgement of its artifact."""
    rows = parsed(artifacts).where(F.coalesce(text(field("v", "status")) == "APPROVED", F.lit(False)) & (field("v", "source_corpus_sha256").isNotNull() | field("v", "case_evidence").isNotNull()))
    none = F.lit(None).cast("string")
    is_map = F.coalesce(kind(field("v", "case_evidence")) == "OBJECT", F.lit(False))
    listed = lambda name, to: exploded(rows.where(is_map).select("artifact_id", F.when(kind(field("v", name)) == "OBJECT", field("v", name)).alias("m")), "m", ("pos", "case_id", to)).drop("m", "pos")
    evidence, mapping = listed("case_evidence", "checks"), listed("case_to_source_documents", "sources")
    sides = [d.select("artifact_id", "case_id", F.lit(k).alias("side")) for k, d in ((1, evidence), (2, mapping), (4, case_ids))]
    sets = reduce(DataFrame.unionByName, sides).groupBy("artifact_id", "case_id").agg(F.sum("side").alias("sides"))
    uneven = sets.groupBy("artifact_id").agg(F.max(F.col("sides") != 7).alias("uneven"))
    rows = rows.join(uneven, "artifact_id", "left").withColumn("uneven", F.coalesce("uneven", F.lit(False)) | F.coalesce(kind(field("v", "case_to_source_documents")) != "OBJECT", F.lit(True)))
    of_whole = issues(rows, none, [
        Check("approved_source_corpus_sha256_mismatch", ~text(field("v", "source_corpus_sha256")).eqNullSafe(F.col("corpus_sha256"))),
        Check("approved_case_evidence_missing", ~is_map), Check("approved_case_evidence_case_set_mismatch", is_map & F.col("uneven")),
    ])
    cases = evidence.join(rows.where("NOT uneven").select("artifact_id"), "artifact_id", "left_semi")
    of_cases = issues(cases, F.col("case_id"), [Check("approved_case_evidence_invalid", ~not_empty(F.col("checks"), "ARRAY"))])
    checks = exploded(cases.withColumn("list", F.when(kind(F.col("checks")) == "ARRAY", F.col("checks"))), "list", ("pos", "key", "e")).withColumn("path", F.concat_ws("/", "case_id", (F.col("pos") + 1).cast("string")))
    good = F.coalesce(kind(F.col("e")) == "OBJECT", F.lit(False)) & filled(field("e", "source_document_id"))
    checks = checks.withColumn("good", good).select("artifact_id", "path", "good", "e")
    of_checks = issues(checks, F.col("path"), [
        Check("approved_case_evidence_check_invalid", ~F.col("good")), Check("approved_case_evidence_chunks_missing", F.col("good") & ~not_empty(field("e", "evidence_chunks"), "ARRAY")),
    ])
    lists = checks.where("good").withColumn("list", F.when(kind(field("e", "evidence_chunks")) == "ARRAY", field("e", "evidence_chunks"))).withColumnRenamed("path", "above")
    chunks = exploded(lists, "list", ("pos", "key", "c")).withColumn("path", F.concat_ws("/", "above", (F.col("pos") + 1).cast("string")))
    is_object = F.coalesce(kind(F.col("c")) == "OBJECT", F.lit(False))
    of_chunks = issues(chunks, F.col("path"), [
        Check("approved_case_evidence_chunk_invalid", ~(is_object & filled(field("c", "chunk_id")))), Check("approved_case_evidence_position_invalid", ~not_empty(field("c", "source_position"), "OBJECT")),
    ])
    return reduce(DataFrame.unionByName, [of_whole, of_cases, of_checks, of_chunks])
