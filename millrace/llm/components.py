"""Connected components of a graph of 64-bit nodes, by alternating star operations.

A large star links each node's larger neighbours to its smallest one, a small star does so with the
smaller neighbours and the node itself; both keep the components, and in a number of rounds that
grows with the logarithm of the graph every component is a star around its smallest node. A node's
neighbours are only aggregated and joined, never gathered, so a hub may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, stored


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have a > b, as ``large_star`` returns them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def signature(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    mixed = F.xxhash64("a", "b")
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that it reaches, for every node of ``edges``
    (long columns a and b) that isn't the smallest itself. Loops, repeated and reversed edges do no
    harm; no edges give no rows."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = signature(now)
    while seen[0]:
        new = stored(small_star(large_star(now)), "edges")
        mark = signature(new)
        forget(now)
        now = new
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
