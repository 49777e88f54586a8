"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups.

A group (by default the rows with equal texts) goes whole into one shard. Packing has two levels,
so that no task sees all groups: buckets of groups pack themselves into bins of a small capacity,
and the bins, whose number is bounded, are packed into the shards. Both levels sort by size,
largest first, and put each item where it leaves the least room, found in a balanced tree over
the remaining capacities. The shard capacity is the least at which everything fits.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import crc32_bytes, stored

#: Bins that fill a shard: their capacity is total / (shards * BINS_PER_SHARD).
BINS_PER_SHARD = 256
#: Groups that one packing task takes.
BUCKET_ITEMS = 200_000
CELL_ROWS = 4096


class CapacityTree:
    """Remaining capacities in order: a B+ tree of two levels, whose leaves split at ``width``."""

    def __init__(self, width: int = 512):
        self.width, self.leaves, self.tops = width, [[]], []

    def add(self, room: int, name: int) -> None:
        k = min(bisect.bisect_left(self.tops, (room, name)), len(self.leaves) - 1)
        leaf = self.leaves[k]
        bisect.insort(leaf, (room, name))
        if len(leaf) > self.width:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.tops[k : k + 1] = [leaf[half - 1], leaf[-1]]
        elif k < len(self.tops):
            self.tops[k] = leaf[-1]
        else:
            self.tops.append(leaf[-1])

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the least room of ``need`` or more; None if there is none."""
        k = bisect.bisect_left(self.tops, (need, -1))
        if k == len(self.tops):
            return None
        leaf = self.leaves[k]
        found = leaf.pop(bisect.bisect_left(leaf, (need, -1)))
        if leaf:
            self.tops[k] = leaf[-1]
        else:
            del self.tops[k]
            if len(self.leaves) > 1:
                del self.leaves[k]
        return found


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each item. An item over ``capacity`` gets a bin of its own.

    Ties go by position, so equal input gives equal bins."""
    tree, bins, out = CapacityTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        room, name = found if found else (max(capacity, sizes[i]), bins)
        bins += found is None
        out[i] = name
        if room > sizes[i]:
            tree.add(room - sizes[i], name)
    return out


def pack(sizes: Sequence[int], shards: int) -> list[int]:
    """Shards 0 to ``shards`` - 1 for the items. An item above an even share of what is left has a
    shard of its own; the rest goes into the other shards at the least capacity that
    best-fit-decreasing needs no more of them for, searched by halving down to a ten-thousandth."""
    out, left = [0] * len(sizes), sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    alone = 0
    while alone < min(len(order), shards - 1) and sizes[order[alone]] * (shards - alone) > left:
        out[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest = order[alone:]
    for i, shard in zip(rest, least_capacity([sizes[i] for i in rest], shards - alone), strict=True):
        out[i] = alone + shard
    return out


def least_capacity(sizes: Sequence[int], shards: int) -> list[int]:
    """See ``pack``: the bins of the least capacity at which there are ``shards`` at most."""
    if not len(sizes):
        return []
    total = sum(sizes)
    low = max(-(-total // shards), max(sizes))
    high, best = 2 * low, None
    while best is None:
        got = best_fit_decreasing(sizes, high)
        if max(got) < shards:
            best = got
        else:
            low, high = high, 2 * high
    got = best_fit_decreasing(sizes, low)
    if max(got) < shards:
        return got
    while high - low > max(1, low // 10_000):
        mid = (low + high) // 2
        got = best_fit_decreasing(sizes, mid)
        if max(got) < shards:
            best, high = got, mid
        else:
            low = mid
    return best


def assign_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot, gapless from 0 per shard, and
    group_cut.

    Size is the text's UTF-8 bytes plus ``overhead``; null counts as the empty text. Rows with
    equal texts share a shard, unless their group alone is larger than an even share of the whole:
    no shard could hold it, so its rows are dealt into parts of about half a share, by a hash of id
    and copy, and ``group_cut`` is true for them. Slots follow bins, then cells
    of hashed ids, then ids; reruns agree, however the table is cut into partitions. Equal rows stay rows of their own. An empty table gives an empty
    result; with fewer groups than shards some shards stay empty.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        crc32_bytes(text).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    # Rows that repeat each other are told apart by a number, so that a rerun deals them alike.
    base = base.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("n"))
    base = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    base = stored(base, "shard-rows")
    total = base.agg(F.sum("size")).first()[0] or 0
    share, room = max(-(-total // shards), 1), max(total // (shards * BINS_PER_SHARD), 1)

    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"))
    large = groups.where(F.col("bytes") > share).select("key", F.ceil(F.col("bytes") * 2 / share).alias("parts"))
    # Fewer groups than shards are above an even share: a bounded broadcast.
    base = base.join(F.broadcast(large), "key", "left")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "copy"), F.col("parts")), F.lit(0))
    base = stored(base.withColumn("part", part).withColumn("group_cut", F.col("parts").isNotNull()).drop("parts"), "shard-parts")
    items = base.groupBy("key", "part").agg(F.sum("size").alias("bytes"))
    buckets = max(1, -(-base.count() // BUCKET_ITEMS))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)))

    def pack_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "part"], ignore_index=True)
        return rows[["key", "part", "bucket", "bytes"]].assign(bin=best_fit_decreasing(rows["bytes"].tolist(), room))

    schema = "key binary, part long, bucket long, bytes long, bin long"
    items = stored(items.groupBy("bucket").applyInPandas(pack_bucket, schema), "shard-items")

    # At most one bin of a bucket is less than half full: no more than 2 * shards * BINS_PER_SHARD
    # bins, and one for each bucket, come to the driver.
    bins = items.groupBy("bucket", "bin").agg(F.sum("bytes").alias("bytes")).orderBy("bucket", "bin").collect()
    placed = pack([b["bytes"] for b in bins], shards)
    where = [(b["bucket"], b["bin"], s) for b, s in zip(bins, placed, strict=True)]
    where = spark.createDataFrame(where, "bucket long, bin long, shard int")
    items = items.join(where, ["bucket", "bin"]).select("key", "part", "bucket", "bin", "shard")

    # Slots: rows are counted in cells of some thousand rows of a bin, cells are summed up per shard.
    rows = base.join(items, ["key", "part"]).select("doc_id", "size", "text_crc32", "copy", "group_cut", "shard", "bucket", "bin")
    counts = rows.groupBy("shard", "bucket", "bin").count()
    counts = counts.select("shard", "bucket", "bin", F.ceil(F.col("count") / CELL_ROWS).alias("cells"))
    rows = stored(
        rows.join(counts, ["shard", "bucket", "bin"]).withColumn("cell", F.pmod(F.xxhash64("doc_id", "copy"), F.col("cells"))).drop("cells"),
        "shard-cells",
    )
    cell = ["shard", "bucket", "bin", "cell"]
    ahead = W.partitionBy("shard").orderBy("bucket", "bin", "cell").rowsBetween(W.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).count().withColumn("before", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    inside = W.partitionBy(*cell).orderBy("doc_id", "size", "text_crc32", "copy")
    rows = rows.join(cells.drop("count"), cell)
    return rows.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.row_number().over(inside) - 1).cast("long").alias("slot"), "group_cut"
    )
