"""Parsed packages: chunks of elements, the hash of a dataset, and what keeps a package from review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import integrity as I
from millrace.sources.archives import parse_mixed

# Kinds of content, chunk rule, reasons of splits, formats, disclosure classes, the most tokens of a chunk.
CONTENT_TYPES = ("text", "heading", "table", "image", "list", "code")
CHUNK_RULE = "structured-v2"
SPLIT_REASONS = (*(f"{c}_boundary" for c in CONTENT_TYPES), "sentence_boundary", "hard_split", "element_boundary")
FORMATS = ("markdown", "csv", "docx")
CLASSES = ("external_allowed", "internal_only", "unclassified")
MOST_TOKENS = 1024


def canonical_json(**fields: Column) -> Column:
    """A JSON object with keys in order, no blanks, nulls kept and characters as they are."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def element_chunks(elements: DataFrame, max_chars: int = 700, overlap: int = 0, rule: str = CHUNK_RULE, position: tuple[str, ...] = ("first_line", "last_line")) -> DataFrame:
    """Chunks of parsed elements. No chunk spans two elements, and only long ones are cut.

    ``elements``: document_id, version_id, element_index, kind, text and the columns ``position``.
    Elements without text are left out; the others are the document's sections, numbered from 1. A
    chunk but the first of its section begins ``overlap`` characters earlier. Its hash is that of its
    canonical JSON, and its id begins with ``chunk-``.
    """
    own = ["document_id", "version_id"]
    rows = elements.where("text <> ''").withColumn("section_seq", F.row_number().over(W.partitionBy(*own).orderBy("element_index")))
    rows = rows.select(*own, "section_seq", "kind", *position, "text")
    rows = X.chunk_rows(rows, "text", max_chars, overlap).withColumnRenamed("chunk_index", "section_chunk_index")
    shown = F.when(F.col("kind") == "row", "table").otherwise(F.col("kind"))
    boundary = F.when(shown.isin(*CONTENT_TYPES), F.concat(shown, F.lit("_boundary"))).otherwise("element_boundary")
    rows = rows.withColumn("split_reason", F.when(F.col("split_reason") == "element_boundary", boundary).otherwise(F.col("split_reason")))
    rows = rows.withColumn("content_type", F.when(F.col("kind").isin(*CONTENT_TYPES), F.col("kind")).otherwise("text"))
    place = F.struct(*(F.col(c) for c in sorted([*position, "char_start", "char_end"])))
    whole = canonical_json(document_id=F.col("document_id"), version_id=F.col("version_id"), source_position=place, content=F.col("content"), content_type=F.col("content_type"), rule_version=F.lit(rule))
    rows = rows.withColumn("chunk_hash", F.sha2(whole, 256)).withColumn("chunk_id", F.concat(F.lit("chunk-"), F.substring("chunk_hash", 1, 20)))
    return rows.select(*own, "chunk_id", "section_seq", "section_chunk_index", "char_start", "char_end", "content", "content_type", "split_reason", "chunk_hash")


def dataset_hashes(packages: DataFrame, documents: DataFrame) -> DataFrame:
    """package_id and the hash over its manifest and, in order, its documents with their numbers of chunks.

    ``packages``: package_id, manifest_sha256. ``documents``: package_id, position, document_id,
    source_hash, chunks. A package has 100 documents at most, so that one row holds them."""
    row = F.struct("position", F.struct("chunks", "document_id", "source_hash").alias("d"))
    rows = documents.groupBy("package_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    rows = packages.select("package_id", "manifest_sha256").join(rows, "package_id", "left")
    none = F.array().cast("array<struct<chunks:bigint,document_id:string,source_hash:string>>")
    listed = F.coalesce(F.transform("rows", lambda x: x["d"]), none)
    return rows.select("package_id", F.sha2(canonical_json(manifest_sha256=F.col("manifest_sha256"), documents=listed), 256).alias("dataset_sha256"))


# The most documents, bytes and chunks of a package.
MOST_DOCUMENTS, MOST_BYTES, MOST_CHUNKS = 100, 8 << 20, 10_000


def package_parse(packages: DataFrame, files: DataFrame, documents: DataFrame, max_chars: int = 700, pipeline: str = "structured-v2") -> tuple[DataFrame, DataFrame]:
    """Parses packages whole or not at all: a row for each package, and the chunks of those that pass.

    ``packages``: package_id, manifest_sha256. ``files``: package_id, path, content (bytes).
    ``documents``: package_id, position, document_id, path, format, source_hash. The first frame has
    state (PARSED or FAILED), reason (the first rule that fails, in the order below), subject (the
    first document it fails for), documents, chunks and dataset_sha256, null unless parsed. A failed
    document fails its package. Limits are counted in the same pass as the work.
    """
    own = ["package_id", "document_id"]
    at = files.dropDuplicates(["package_id", "path"]).select("package_id", "path", "content", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("file_hash"))
    docs = documents.join(at, ["package_id", "path"], "left")
    # One id for a document of a package, so that parsers see one column.
    key = F.concat_ws("\u0001", F.col("package_id").cast("string"), "document_id")
    elements = parse_mixed(docs.withColumn("_key", key).where("content IS NOT NULL"), "_key", "format", "content")
    made = element_chunks(elements.where("kind <> 'error'").withColumn("version_id", F.lit(pipeline)), max_chars)
    counts = made.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    failed = elements.where("kind = 'error'").groupBy("document_id").agg(F.min("text").alias("error"))
    rows = docs.drop("content").withColumn("_key", key)
    rows = rows.join(counts.withColumnRenamed("document_id", "_key"), "_key", "left").join(failed.withColumnRenamed("document_id", "_key"), "_key", "left").na.fill(0, ["chunks"])
    reason = (
        F.when(F.col("bytes").isNull(), "file_missing").when(~F.coalesce(F.col("file_hash") == F.col("source_hash"), F.lit(False)), "source_hash_mismatch")
        .when(F.col("error").isNotNull(), "document_could_not_be_parsed").when(F.col("chunks") == 0, "document_has_no_chunks")
    )
    rows = rows.withColumn("reason", reason)
    whole = rows.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"), F.sum("bytes").alias("bytes"),
        F.min(F.when(F.col("reason").isNotNull(), F.struct("position", "document_id", "reason"))).alias("first"),
    )
    out = packages.join(whole, "package_id", "left").na.fill(0, ["documents", "chunks", "bytes"])
    why = (
        F.when(F.col("documents") == 0, "no_documents").when(F.col("documents") > MOST_DOCUMENTS, "too_many_documents").when(F.col("bytes") > MOST_BYTES, "too_many_bytes")
        .when(F.col("first").isNotNull(), F.col("first.reason")).when(F.col("chunks") > MOST_CHUNKS, "too_many_chunks")
    )
    out = out.withColumn("reason", why)
    # Only packages within the limits are hashed, so that one row holds their documents.
    good = out.where("reason IS NULL").select("package_id", "manifest_sha256")
    hashes = dataset_hashes(good, rows.join(good.select("package_id"), "package_id", "left_semi"))
    states = out.join(hashes, "package_id", "left").select(
        "package_id", F.when(F.col("reason").isNull(), "PARSED").otherwise("FAILED").alias("state"), "reason",
        F.when(F.col("reason") == F.col("first.reason"), F.col("first.document_id")).alias("subject"), "documents", "chunks", "dataset_sha256",
    )
    parts = F.split("document_id", "\u0001")
    chunks = made.withColumn("package_id", F.get(parts, 0)).withColumn("document_id", F.get(parts, 1))
    chunks = chunks.join(good.select(F.col("package_id").cast("string").alias("package_id")), "package_id", "left_semi")
    return states, chunks


def sha256_hex(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def package_issues(packages: DataFrame, files: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """rule and subject of all that keeps packages from review; subjects are packages, package/document
    or package/document/chunk.

    ``packages``: package_id, manifest_sha256 (queued), parsed_manifest_sha256, pipeline_version,
    dataset_sha256. ``files``: package_id, path, document_id, source_hash, content. ``documents``:
    package_id, position, document_id, path, source_hash, title, format, disclosure_class,
    external_allowed, effective_from, effective_to (texts). ``chunks``: package_id, document_id,
    chunk_index, section_seq, section_chunk_index, char_start, char_end, content, chunk_hash,
    token_count, content_type, split_reason, metadata (a map of texts). Null counts as missing.
    """
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    name = lambda *c: F.concat_ws("/", *c)
    counts = chunks.groupBy("package_id", "document_id").agg(F.count(F.lit(1)).alias("chunks"))
    docs = documents.join(counts, ["package_id", "document_id"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))

    whole = packages.withColumnRenamed("dataset_sha256", "stated").join(dataset_hashes(packages, docs), "package_id")
    whole = whole.join(files.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_files")), "package_id", "left")
    whole = whole.join(documents.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_documents")), "package_id", "left").na.fill(0, ["n_files", "n_documents"])
    manifest = sha256_hex(F.col("manifest_sha256")) & sha256_hex(F.col("parsed_manifest_sha256")) & same("manifest_sha256", "parsed_manifest_sha256")
    empty = (F.col("n_files") == 0) | (F.col("n_documents") == 0)
    by_package = I.row_issues(whole, "package_id", [
        I.Check("parse_manifest_binding_invalid", ~manifest),
        I.Check("parse_dataset_identity_invalid", blank(F.col("pipeline_version")) | ~sha256_hex(F.col("stated"))),
        I.Check("parse_empty_documents", empty),
        I.Check("parse_document_count_mismatch", ~empty & (F.col("n_files") != F.col("n_documents"))),
        I.Check("parse_dataset_hash_mismatch", sha256_hex(F.col("stated")) & (F.col("stated") != F.col("dataset_sha256"))),
    ])

    known = ~blank(F.col("path")) & ~blank(F.col("document_id")) & sha256_hex(F.col("source_hash"))
    by_file = I.row_issues(files.withColumn("subject", name("package_id", "document_id")), "subject", [
        I.Check("parse_file_identity_invalid", ~known), I.Check("parse_source_hash_mismatch", known & (F.sha2("content", 256) != F.col("source_hash"))),
    ])

    of_file = files.select("package_id", "path", F.col("document_id").alias("f_document"), F.col("source_hash").alias("f_hash")).dropDuplicates(["package_id", "path"])
    bound = docs.join(of_file, ["package_id", "path"], "left").withColumn("subject", name("package_id", "document_id"))
    named = ~blank(F.col("document_id")) & ~blank(F.col("path"))
    dates = [F.nullif(c, F.lit("")) for c in ("effective_from", "effective_to")]
    on = [F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(c, "yyyy-MM-dd")) for c in dates]
    window = (dates[0].isNull() | on[0].isNotNull()) & (dates[1].isNull() | on[1].isNotNull()) & F.coalesce(on[1] > on[0], F.lit(True))
    isin = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    good = ~blank(F.col("title")) & isin("format", FORMATS) & isin("disclosure_class", CLASSES) & ~F.coalesce("external_allowed", F.lit(False)) & window
    by_document = I.row_issues(bound, "subject", [
        I.Check("parse_document_identity_invalid", ~named),
        I.Check("parse_document_binding_invalid", named & ~(same("f_document", "document_id") & same("f_hash", "source_hash"))),
        I.Check("parse_document_metadata_invalid", ~good),
        I.Check("parse_empty_chunks", F.col("chunks") == 0),
    ])

    line = W.partitionBy("package_id", "document_id").orderBy("chunk_index")
    scope = bound.select("package_id", "document_id", *(F.col(c).alias(f"d_{c}") for c in ("tenant_id", "shop_id", "disclosure_class", "effective_from", "effective_to", "f_hash")))
    rows = chunks.withColumn("at", F.row_number().over(line) - 1).withColumn("s", F.lag("section_seq").over(line)).withColumn("k", F.lag("section_chunk_index").over(line))
    rows = rows.join(scope.dropDuplicates(["package_id", "document_id"]), ["package_id", "document_id"], "left")
    section, index = F.col("section_seq"), F.col("section_chunk_index")
    follows = F.when(F.col("at") == 0, (section == 1) & (index == 0)).when(section == F.col("s"), index == F.col("k") + 1).otherwise((section == F.col("s") + 1) & (index == 0))
    placed = F.coalesce((F.col("chunk_index") == F.col("at")) & (section >= 1) & (index >= 0) & follows, F.lit(False))
    length = F.coalesce((F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")) & (F.length("content") == F.col("char_end") - F.col("char_start")), F.lit(False))
    meta = lambda k: F.coalesce(F.element_at("metadata", F.lit(k)), F.lit(""))
    fields = {"tenant_id": "d_tenant_id", "shop_id": "d_shop_id", "source_hash": "d_f_hash", "disclosure_class": "d_disclosure_class", "effective_from": "d_effective_from", "effective_to": "d_effective_to"}
    bindings = [F.map_contains_key("metadata", k) & (meta(k) == F.coalesce(c, F.lit(""))) for k, c in fields.items()]
    own = bindings[0]
    for b in bindings[1:]:
        own = own & b
    described = F.coalesce(F.col("token_count").between(1, MOST_TOKENS), F.lit(False)) & F.col("metadata").isNotNull() & isin("content_type", CONTENT_TYPES) & isin("split_reason", SPLIT_REASONS)
    by_chunk = I.row_issues(rows.withColumn("subject", name("package_id", "document_id", "chunk_index")), "subject", [
        I.Check("parse_empty_chunk", ~F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False))),
        I.Check("parse_chunk_position_invalid", ~placed),
        I.Check("parse_chunk_source_invalid", ~length),
        I.Check("parse_chunk_hash_invalid", ~sha256_hex(F.col("chunk_hash"))),
        I.Check("parse_chunk_metadata_invalid", ~described),
        I.Check("parse_chunk_metadata_binding_invalid", F.col("metadata").isNotNull() & ~F.coalesce(own, F.lit(False))),
    ])
    repeats = [
        I.duplicate_issues(files, "parse_duplicate_file_path", ["package_id", "path"]),
        I.duplicate_issues(files, "parse_duplicate_file_document", ["package_id", "document_id"]),
        I.duplicate_issues(documents, "parse_duplicate_document", ["package_id", "document_id"]),
        I.duplicate_issues(documents, "parse_duplicate_path", ["package_id", "path"]),
        I.duplicate_issues(chunks.where(sha256_hex(F.col("chunk_hash"))), "parse_duplicate_chunk", ["package_id", "document_id", "chunk_hash"]),
    ]
    return I.suite([by_package, by_file, by_document, by_chunk, *repeats])
