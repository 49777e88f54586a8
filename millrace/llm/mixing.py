"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents stand in a shuffled line (by a hash of their id) that is cut into blocks
of equally many words. A schedule of slots k = 0, 1, 2, ... maps the van der Corput point of k
through the sources' cumulative shares; the slot belongs to the source whose interval holds the
point, and slots are ranked per source. Slot number r of a source takes its block number r, and
begins the line anew when it is through. Because the points have low discrepancy, any prefix of
the schedule already has the wanted mixture, up to a few blocks.

Nothing is gathered: running sums are taken inside cells of some thousand rows and carried over
cells by a prefix sum over the cells' totals, so one hot source is spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import free_names, stored, words

CELL_ROWS = 4096
CHUNK_SLOTS = 65536
DIGITS = 40


@dataclass(frozen=True)
class Mix:
    """``docs``: a row per input row with doc_id, source, text_key, size, source_size, target and its place.
    ``sources``: a row per source. ``schedule``: a row per slot, in the order of ``slot``.
    ``pieces``: what each slot takes of which document: slot, epoch, sid, start, words."""

    docs: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame

    def taken(self, by_epoch: bool = False) -> DataFrame:
        """``docs`` with ``taken``, the words that the mix takes of each, 0 if none, and ``first_slot``,
        where in the schedule they begin, null if none.

        By epoch, a row per document and pass through its line in which something is taken."""
        key = ["sid", "start", *(["epoch"] if by_epoch else [])]
        sums = self.pieces.groupBy(*key).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).withColumnRenamed("sid", "sid_")
        sums = sums.withColumnRenamed("start", "start_")
        docs = self.docs
        on = (docs.sid == sums.sid_) & (docs.start == sums.start_) & (docs.size > 0)
        out = docs.join(sums, on, "inner" if by_epoch else "left").drop("sid_", "start_")
        return out.withColumn("taken", F.coalesce("taken", F.lit(0)))


def cycling_weights(rank: Column) -> Column:
    """5, 2, 1 and again from the start, by the 0-based rank of a source."""
    return F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (rank % 3 + 1).cast("int")).cast("long")


def fill_targets(sources: DataFrame, half_shares: int = 3, max_epochs: int = 2) -> DataFrame:
    """Adds ``target``: ``half_shares``/2 times all sizes dealt by ``weight``, none above
    ``max_epochs`` times its ``source_size``, and what is cut off dealt anew by weight.

    Sources in the order of cap per weight fill up first. With the first i filled, the rest share
    what is left; the first source whose share is within its cap ends the filling. One row per
    source, so the windows are small.
    """
    line = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left2 = half_shares * F.sum("source_size").over(everything) - 2 * F.coalesce(F.sum("cap").over(before), F.lit(0))
    out = (
        sources.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("left2", left2)
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("free", F.col("left2") * F.col("weight") <= 2 * F.col("cap") * F.col("open"))
    )
    place = F.struct((F.col("cap") / F.col("weight")).alias("p"), "sid", "left2", "open")
    out = out.withColumn("end", F.min(F.when(F.col("free"), place)).over(everything))
    share = (F.col("end.left2") * F.col("weight")).cast("double") / (2 * F.col("end.open")).cast("double")
    return out.withColumn("target", F.when(F.col("free"), share).otherwise(F.col("cap").cast("double"))).drop(
        "left2", "open", "free", "end"
    )


def numbered(df: DataFrame, group: list[str], cell: str, order: list[Column], name: str, value: Column) -> DataFrame:
    """``df`` with the running sum of ``value`` before each row, over ``group`` in the order of
    ``cell`` and then ``order``; sums inside a cell by a window, over cells by their totals."""
    sums = df.groupBy(*group, cell).agg(F.sum(value).alias("_s"))
    ahead = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, cell, F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*group, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.join(sums, [*group, cell])
    return out.withColumn(name, F.col("_before") + F.sum(value).over(inside) - value).drop("_before")


def mix(
    df: DataFrame,
    weight=cycling_weights,
    half_shares: int = 3,
    max_epochs: int = 2,
    block_words: int = 4096,
    min_blocks: int = 64,
    seed: str = "mix",
) -> Mix:
    """The mix of ``df`` (doc_id, text, source).

    Null texts and texts without words have size 0 and nothing is taken of them. Null is a source
    of its own, the last. Rows with equal ids stay rows of their own; among rows equal in id and
    text it is not defined which is which. An empty table gives empty frames. The result depends
    on the rows alone, not on their order or partitioning. Extra columns are left behind.
    """
    spark = df.sparkSession
    sized = df.select(
        F.col("doc_id"),
        F.col("source"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("h"),
    )
    sized = stored(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    totals = totals.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    sources = fill_targets(totals.withColumn("weight", weight(F.col("sid"))), half_shares, max_epochs)
    sources = sources.withColumn("want", F.round("target").cast("long"))
    n_blocks = F.greatest(F.ceil(F.col("source_size") / block_words), F.least(F.col("source_size"), F.lit(min_blocks)), F.lit(1))
    sources = sources.withColumn("block", F.greatest(F.ceil(F.col("source_size") / n_blocks), F.lit(1)).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    sources = sources.withColumn("slots", F.ceil(F.col("want") / F.col("block")).cast("long"))
    upto = W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    sources = sources.withColumn("hi", F.sum("slots").over(upto)).withColumn("lo", F.col("hi") - F.col("slots"))
    sources = stored(sources, "mix-sources")
    size = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.count(F.lit(1)).alias("n")).first()
    n_rows = sized.count()

    # The documents' places in their source's line.
    cells = max(1, -(-n_rows // CELL_ROWS))
    cell = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * cells / 2**32)
    meta = sources.select(F.col("source").alias("source_"), "sid", "source_size", "target", "want", "block", "blocks")
    docs = sized.join(meta, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("cell", cell)
    order = [F.col("h"), F.col("doc_id"), F.col("text_key")]
    docs = numbered(docs, ["sid"], "cell", order, "start", F.col("size")).drop("cell", "h")
    docs = stored(docs, "mix-docs")

    # The schedule. The first 2 ** k points are evenly spaced; with two of them or more to a wanted
    # slot every source finds all its slots among them, however few. What is over takes nothing.
    n_slots = 1 << (2 * size["slots"] - 1).bit_length() if size["slots"] else 0
    grid = 4 * max(size["n"], 1)
    digits = F.conv(F.reverse(F.lpad(F.bin("slot"), DIGITS, "0")), 2, 10).cast("long")
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("point", digits * max(size["slots"], 1) / 2**DIGITS)
    slots = slots.withColumn("g", F.floor(F.col("point") * grid / max(size["slots"], 1)))
    spans = sources.where("slots > 0").withColumn(
        "g",
        F.explode(F.sequence(F.floor(F.col("lo") * grid / max(size["slots"], 1)), F.floor(F.col("hi") * grid / max(size["slots"], 1)))),
    )
    spans = spans.select("g", "lo", "hi", "sid", "source_size", "want", "block", "blocks")
    slots = slots.join(spans, "g").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    slots = numbered(slots, ["sid"], "chunk", [F.col("slot")], "rank", F.lit(1))
    slots = slots.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")))
    slots = slots.withColumn("at", F.col("rank") % F.col("blocks"))
    length = F.least(F.col("block"), F.col("source_size") - F.col("at") * F.col("block"))
    emitted = F.col("epoch") * F.col("source_size") + F.col("at") * F.col("block")
    slots = slots.withColumn("take", F.least(length, F.col("want") - emitted)).where("take > 0")
    schedule = slots.select("slot", "sid", "rank", "epoch", "at", "take")

    # Blocks are dealt to slots; a document lies in the blocks that its words touch.
    parts = docs.where("size > 0").select(
        "sid", "start", "size", "block",
        F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))).alias("at"),
    )
    pieces = schedule.join(parts, ["sid", "at"])
    upper = F.least(F.col("start") + F.col("size"), F.col("at") * F.col("block") + F.col("take"))
    pieces = pieces.withColumn("words", upper - F.greatest(F.col("start"), F.col("at") * F.col("block")))
    pieces = pieces.where("words > 0").select("slot", "epoch", "sid", "start", "words")
    return Mix(docs, sources, schedule, pieces)


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word, the white space between words as it is."""
    gaps = F.split(text, r"[^\x20\x09-\x0D]+")
    kept = F.slice(words(text), F.lit(1), n)
    return F.array_join(F.transform(kept, lambda x, i: F.concat(F.get(gaps, i), x)), "")


def mixed_documents(df: DataFrame, slot_col: str | None = None, **parameters) -> DataFrame:
    """The mix as documents with the columns of ``df``: a row for each pass in which words of a
    document are taken, with the whole text or, where a source's target ends inside a document, the
    text up to its last word taken; ``n_chars`` follows the text if there is such a column.

    ``slot_col`` names a column for the slot at which the row's words begin: sorted by it, any
    beginning of the mix has the wanted weights. Documents of which the mix takes nothing are not in it.
    """
    plan = mix(df, **parameters)
    picks = plan.taken(by_epoch=True).select("doc_id", "text_key", "start", "sid", "size", "epoch", "taken", "first_slot")
    same = W.partitionBy("doc_id", "text_key")
    lines = picks.select("doc_id", "text_key", "sid", "start").distinct()
    lines = lines.withColumn("copy", F.row_number().over(same.orderBy("sid", "start")))
    picks = picks.join(lines.drop("doc_id", "text_key"), ["sid", "start"])
    key, n, *own = free_names(df, "text_key", "copy_number", "pick_id", "pick_key", "pick_copy", "pick_size", "pick_taken", "pick_slot")
    picks = picks.select(*(F.col(c).alias(o) for c, o in zip(("doc_id", "text_key", "copy", "size", "taken", "first_slot"), own, strict=True)))
    keyed = df.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    keyed = keyed.withColumn(n, F.row_number().over(W.partitionBy("doc_id", key).orderBy(F.col("source").asc_nulls_last())))
    doc_id, text_key, copy, size, taken, slot = own
    out = keyed.join(picks, keyed.doc_id.eqNullSafe(F.col(doc_id)) & (F.col(key) == F.col(text_key)) & (F.col(n) == F.col(copy)))
    text = F.when(F.col(taken) >= F.col(size), F.col("text")).otherwise(first_words(F.col("text"), F.col(taken).cast("int")))
    out = out.withColumn("text", text)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns, *([F.col(slot).alias(slot_col)] if slot_col else []))
