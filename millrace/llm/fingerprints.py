"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Sketches of parts merge
by union, and what share of one text's shingles another has can be estimated from two sketches
however unequal the texts are, because the same shingle is kept in both or in neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import words

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
LOWEST = -(1 << 63)
#: Documents that stand side by side in a bucket, about; and the most buckets, a square.
BUCKET_ROWS, MOST_BUCKETS = 512, 141 * 141


def with_sketch(df: DataFrame, text_col: str, name: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Adds ``name``, the ascending kept hashes of the text's word shingles.

    A text of fewer words than a shingle has its whole sequence as the one shingle. A text of whose
    hashes none is below the fraction keeps its lowest, so that only texts without words (and null)
    have an empty sketch. Equal texts have equal sketches.
    """
    w, h = f"_{name}_w", f"_{name}_h"
    df = df.withColumn(w, words(F.col(text_col)))
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + k) for k in range(1, shingle))))
    df = df.withColumn(h, F.slice(hashes, F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.least(F.size(w), F.lit(1)))))
    kept = F.filter(h, lambda x: x < LOWEST + (1 << 64) // scale)
    df = df.withColumn(name, F.sort_array(F.array_distinct(kept)))
    lowest = F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(lowest)).drop(w, h)


def merge_sketches(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two parts together (shingles across the seam left out). What a part keeps only
    for want of a hash below the fraction stays if the other part has none either: the lowest."""
    both = F.sort_array(F.array_union(a, b))
    kept = F.filter(both, lambda x: x < LOWEST + (1 << 64) // scale)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """The share of ``a``'s shingles that ``b`` has too; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Shared shingles by all shingles of both; 1 for two empty sketches, 0 for one."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / F.greatest(every, F.lit(1)))


def printed(sketch: Column) -> Column:
    """A sketch as a string: 16 hex digits a hash, counted from the lowest possible one."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x.bitwiseXOR(F.lit(LOWEST)))), 16, "0")), "")


def beside_next(df: DataFrame, id_col: str, tie_col: str, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the next row in ascending order of ``id_col`` (null first), then
    ``tie_col``; after the last row comes the first.

    Ids are cut into buckets of about equally many rows, at most ``MOST_BUCKETS``, at approximate
    quantiles. A window in a bucket finds the next row; the first rows of a bucket also go to the
    bucket before, as its last. Each text is shuffled once. Rows with equal ids share a bucket, which
    its window spills.
    """
    n = df.select(id_col).where(F.col(id_col).isNotNull()).count()
    side = int(min(n // BUCKET_ROWS, MOST_BUCKETS) ** 0.5) + 1
    cuts = quantiles(df, id_col, side * side)
    # The bucket of an id: how many cuts are no larger, counted in two steps of ``side`` each.
    outer, own = F.lit(0), F.lit(0)
    if cuts:
        blocks = [cuts[k : k + side] for k in range(0, len(cuts), side)]
        below = F.filter(F.array(*(F.lit(b[0]) for b in blocks)), lambda x: x <= F.col(id_col))
        outer = F.size(below)
        inner = F.element_at(F.array(*(F.array(*(F.lit(x) for x in b)) for b in blocks)), F.greatest(outer, F.lit(1)))
        own = F.when(outer > 0, (outer - 1) * side + F.size(F.filter(inner, lambda x: x <= F.col(id_col)))).otherwise(0)
    bucket = F.when(F.col(id_col).isNull(), -1).otherwise(own).cast("long")
    firsts = df.groupBy(bucket.alias("_bucket")).agg(F.min(id_col).alias("_first"))
    line = W.orderBy("_bucket")
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_bucket").over(line), F.max("_bucket").over(W.partitionBy())))
    firsts = F.broadcast(firsts.select("_first", "_before"))  # MOST_BUCKETS rows and one at most
    rows = df.join(firsts, F.col(id_col).eqNullSafe(F.col("_first")), "left")
    own = F.struct(bucket.alias("b"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("_before").alias("b"), F.lit(1).alias("ghost"))
    places = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, ghost))
    rows = rows.withColumn("_at", F.explode(places)).select(*df.columns, F.col("_at.b").alias("_b"), F.col("_at.ghost").alias("_ghost"))
    order = W.partitionBy("_b").orderBy("_ghost", F.col(id_col).asc_nulls_first(), tie_col)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.where("_ghost = 0").drop("_b", "_ghost")


def quantiles(df: DataFrame, column: str, parts: int) -> list[int]:
    """Distinct ascending values that cut ``column`` into about ``parts`` parts of equally many rows."""
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    found = df.agg(F.percentile_approx(column, shares, 10 * parts)).first()[0]
    return sorted(set(found or []))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the document's fingerprint, that of its edited text, and likenesses.

    The edited text has the last half of the code points (rounded down) replaced by as many from
    the start of the next document, or all that it has. Null is the empty text. Rows with equal ids
    follow each other in the order of their texts. Of a single row the next is the row itself. An
    empty table gives an empty result; extra columns are left behind.
    """
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = with_sketch(base, "text", "sketch")
    rows = beside_next(base, "doc_id", "text", ["text", "sketch"])
    rows = rows.withColumn("n", F.length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("half")), F.substring("next_text", F.lit(1), F.col("half")))
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_containment"),
    )
