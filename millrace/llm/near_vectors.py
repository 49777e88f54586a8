"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with a cosine of t or more lie within eps = sqrt(2 - 2 t) of each other. A sample gives
the principal directions; vectors are sorted by class and by their cells, eps wide, in a grid on the
leading directions, and the sequence is cut into intervals. Pairs of intervals are joined
recursively: above, nodes of a tree over the sequence stand for all that is below them, and one
level after the other is a Spark join that drops pairs of which the boxes in the leading directions
are more than eps apart; below, a task halves two intervals until boxes rule the halves out or a few
vectors are left, whose cosines are computed. Two nodes within a ball that makes all their pairs
links are settled as a whole, at any level, so a dense group isn't paired vector by vector.

Equal vectors are joined as one point with a count. Links are counted where they are found and never
listed: a task adds up each vector's links and returns a forest that connects what its links connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import forget, stored
from millrace.llm.components import connected_components

#: Leading directions of the grid, vectors of the sample that gives them, vectors of an interval.
DIRECTIONS, SAMPLE, INTERVAL = 12, 4096, 4096
#: Vectors of a block whose cosines are all computed, and children of a node of the tree, as bits.
BLOCK, FAN_BITS = 128, 4
#: Bits of a node's number that count the intervals of one partition.
PIECE_BITS = 20
#: Distances are trusted this far.
SLACK = 1e-9


def sound(vector: Column) -> Column:
    """Whether a vector is there, of finite numbers, and not zero."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(True)))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """For each length of vector the orthonormal leading principal directions as columns."""
    out = {}
    for size in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == size], np.float64))
        out[size] = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:DIRECTIONS].T
    return out


def projected(x: np.ndarray, of: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates in the leading directions; without a sample of that length the first ones."""
    p = x @ of[x.shape[1]] if x.shape[1] in of else x[:, :DIRECTIONS]
    return np.pad(p, ((0, 0), (0, DIRECTIONS - p.shape[1])))


def unit_rows(vectors: list[np.ndarray], of: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, filled with zeros to the longest, and their coordinates."""
    sizes = np.array([len(v) for v in vectors])
    x, p = np.zeros((len(vectors), sizes.max())), np.empty((len(vectors), DIRECTIONS))
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        x[own, :size] = unit(np.stack([vectors[i] for i in own]))
        p[own] = projected(x[own, :size], of)
    return x, p


def as_arrays(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    at = at - at[0]
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


@dataclass
class Interval:
    """Vectors of the sequence, in order."""

    ids: np.ndarray
    copies: np.ndarray
    classes: np.ndarray
    x: np.ndarray
    p: np.ndarray
    bounds: dict[tuple[int, int], tuple] = field(default_factory=dict)

    def bound(self, a: int, b: int) -> tuple:
        """Box of the leading coordinates, ball around the first vector, whether all are of a class."""
        if (a, b) not in self.bounds:
            radius = math.sqrt(float(((self.x[a:b] - self.x[a]) ** 2).sum(1).max()))
            self.bounds[a, b] = (self.p[a:b].min(0), self.p[a:b].max(0), radius, (self.classes[a] == self.classes[b - 1]).all())
        return self.bounds[a, b]


class Roots:
    """Connected sets of rows: each row has the number of its set's first row."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        if not apart.any():
            return
        pairs, up = np.unique(np.stack([a[apart], b[apart]]), axis=1).T.tolist(), {}

        def top(i: int) -> int:
            while i in up:
                i = up[i]
            return i

        for i, j in pairs:
            i, j = top(i), top(j)
            if i != j:
                up[max(i, j)] = min(i, j)
        jump = np.arange(len(self.root))
        for i in up:
            jump[i] = top(i)
        self.root = jump[self.root]


def join_intervals(left: Interval, right: Interval | None, threshold: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, Roots]:
    """Counts of links for the rows of both, and what they connect; of one with itself for None."""
    alone = right is None
    right, eps = left if alone else right, math.sqrt(max(2 - 2 * threshold, 0))
    width = max(left.x.shape[1], right.x.shape[1])
    for side in (left, right):
        side.x = np.pad(side.x, ((0, 0), (0, width - side.x.shape[1])))
    n, roots = len(left.ids), Roots(len(left.ids) + (0 if alone else len(right.ids)))
    gain_a, gain_b = np.zeros(n, np.int64), np.zeros(len(right.ids), np.int64)
    shift = 0 if alone else n
    todo = [(0, n, 0, len(right.ids))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        same = alone and a0 == b0 and a1 == b1
        lo, hi, ra, one_a = left.bound(a0, a1)
        lo_b, hi_b, rb, one_b = right.bound(b0, b1)
        if tuple(left.classes[a1 - 1]) < tuple(right.classes[b0]) or tuple(right.classes[b1 - 1]) < tuple(left.classes[a0]):
            continue
        gap = np.maximum(0, np.maximum(lo - hi_b, lo_b - hi))
        if gap @ gap > eps * eps + SLACK:
            continue
        if one_a and one_b and math.dist(left.x[a0], right.x[b0]) + ra + rb < eps - SLACK:
            wa, wb = left.copies[a0:a1], right.copies[b0:b1]
            if same:
                gain_a[a0:a1] += wa.sum() - wa
            else:
                gain_a[a0:a1] += wb.sum()
                (gain_a if alone else gain_b)[b0:b1] += wa.sum()
            roots.union(np.arange(a0, a1), np.full(a1 - a0, shift + b0))
            roots.union(np.arange(shift + b0, shift + b1), np.full(b1 - b0, a0))
        elif max(a1 - a0, b1 - b0) <= block:
            hit = left.x[a0:a1] @ right.x[b0:b1].T >= threshold
            if not (one_a and one_b and (left.classes[a0] == right.classes[b0]).all()):
                hit &= (left.classes[a0:a1, None] == right.classes[None, b0:b1]).all(2)
            if same:
                np.fill_diagonal(hit, False)
            i, j = np.nonzero(hit)
            if len(i):
                gain_a[a0:a1] += hit @ right.copies[b0:b1]
                if not same:
                    (gain_a if alone else gain_b)[b0:b1] += left.copies[a0:a1] @ hit
                roots.union(i + a0, j + b0 + shift)
        elif same:
            mid = (a0 + a1) // 2
            todo += [(a0, mid, a0, mid), (a0, mid, mid, a1), (mid, a1, mid, a1)]
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            todo += [(a0, mid, b0, b1), (mid, a1, b0, b1)]
        else:
            mid = (b0 + b1) // 2
            todo += [(a0, a1, b0, mid), (a0, a1, mid, b1)]
    return gain_a, gain_b, roots


NODE = "node long, weight long, least long, first struct<label: long, size: int>, last struct<label: long, size: int>, low array<double>, high array<double>, centre array<double>, radius double"


def in_grid_order(points: DataFrame, of: dict[int, np.ndarray], eps: float, partitions: int) -> DataFrame:
    """Points with ``cells``, sorted by class, cells and id, each partition a stretch of the whole."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = unit_rows(as_arrays(batch.column("vector")), of)[1]
                cells = np.floor(p / max(eps, SLACK)).astype(np.int32)
                yield batch.append_column("cells", pa.FixedSizeListArray.from_arrays(cells.ravel(), DIRECTIONS).cast(pa.list_(pa.int32())))

    rows = points.select("label", "size", "id", "copies", "vector")
    rows = rows.mapInArrow(cells, "label long, size int, id long, copies long, vector array<double>, cells array<int>")
    order = ["label", "size", "cells", "id"]
    return rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def packed(rows: DataFrame, of: dict[int, np.ndarray], interval: int) -> DataFrame:
    """One row for each interval: bounds, and its vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        piece = 0

        def flush(some: pa.Table) -> pa.RecordBatch:
            nonlocal piece
            column = {c: some.column(c).combine_chunks() for c in some.column_names}
            labels, sizes = column["label"].to_numpy(), column["size"].to_numpy()
            x, p = unit_rows(as_arrays(column["vector"]), of)
            ids, copies = column["id"].to_numpy(), column["copies"].to_numpy()
            row = {
                "node": (int(column["part"][0].as_py()) << PIECE_BITS) + piece, "weight": int(copies.sum()), "least": int(ids.min()),
                "first": {"label": int(labels[0]), "size": int(sizes[0])}, "last": {"label": int(labels[-1]), "size": int(sizes[-1])},
                "low": p.min(0).tolist(), "high": p.max(0).tolist(), "centre": x[0].tolist(), "radius": math.sqrt(float(((x - x[0]) ** 2).sum(1).max())),
                "ids": ids.astype("<i8").tobytes(), "copies": copies.astype("<i8").tobytes(),
                "classes": np.stack([labels, sizes], 1).astype("<i8").tobytes(), "x": x.astype("<f8").tobytes(), "p": p.astype("<f8").tobytes(),
            }
            piece += 1
            return pa.RecordBatch.from_pylist([row], schema=kind)

        kinds = [("node", pa.int64()), ("weight", pa.int64()), ("least", pa.int64())]
        kinds += [(c, pa.struct([("label", pa.int64()), ("size", pa.int32())])) for c in ("first", "last")]
        kinds += [(c, pa.list_(pa.float64())) for c in ("low", "high", "centre")] + [("radius", pa.float64())]
        kind = pa.schema(kinds + [(c, pa.binary()) for c in ("ids", "copies", "classes", "x", "p")])
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= 2 * interval:
                table = pa.Table.from_batches(held)
                yield flush(table.slice(0, interval))
                held = table.slice(interval).to_batches()
        rest = pa.Table.from_batches(held) if held else None
        if rest is not None and rest.num_rows:
            half = -(-rest.num_rows // -(-rest.num_rows // interval))
            for at in range(0, rest.num_rows, half):
                yield flush(rest.slice(at, half))

    return rows.mapInArrow(run, f"{NODE}, ids binary, copies binary, classes binary, x binary, p binary")


def opened(row: dict) -> Interval:
    ids = np.frombuffer(row["ids"], "<i8")
    n = len(ids)
    return Interval(ids, np.frombuffer(row["copies"], "<i8"), np.frombuffer(row["classes"], "<i8").reshape(n, 2), np.frombuffer(row["x"], "<f8").reshape(n, -1), np.frombuffer(row["p"], "<f8").reshape(n, -1))


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def parents(nodes: DataFrame, bits: int) -> DataFrame:
    """The nodes above: what bounds their children bounds them."""
    up = nodes.withColumn("above", F.shiftright("node", bits))
    each = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(DIRECTIONS)]).alias(c)
    own = [F.sum("weight").alias("weight"), F.min("least").alias("least"), F.min("first").alias("first"), F.max("last").alias("last"), each(F.min, "low"), each(F.max, "high")]
    heads = up.groupBy("above").agg(*own, F.min_by("centre", "node").alias("centre"))
    # Of vectors of unequal length the distance is null; such a node is of several classes anyway.
    reach = up.select("above", F.col("centre").alias("c"), "radius").join(heads.select("above", "centre"), "above")
    reach = reach.groupBy("above").agg(F.max(distance("c", "centre") + F.col("radius")).alias("radius"))
    return heads.join(reach, "above").withColumnRenamed("above", "node").select(*nodes.columns)


def pairs_below(pairs: DataFrame, nodes: DataFrame, bits: int, eps: float) -> DataFrame:
    """The pairs of children of ``pairs`` that may hold links: a, b, what stands for them, and
    ``whole``, whether all their vectors link."""
    side = lambda s: nodes.select(F.shiftright("node", bits).alias(f"{s}_above"), *[F.col(c).alias(f"{s}_{c}") for c in nodes.columns])
    out = pairs.select(F.col("a").alias("a_above"), F.col("b").alias("b_above")).join(side("a"), "a_above").join(side("b"), "b_above")
    gaps = [F.greatest(F.lit(0.0), F.col("a_low")[k] - F.col("b_high")[k], F.col("b_low")[k] - F.col("a_high")[k]) for k in range(DIRECTIONS)]
    out = out.where((F.col("a_node") <= F.col("b_node")) & (F.col("a_last") >= F.col("b_first")) & (reduce(add, [g * g for g in gaps]) <= eps * eps + SLACK))
    one = (F.col("a_first") == F.col("a_last")) & (F.col("b_first") == F.col("b_last")) & (F.col("a_first") == F.col("b_first"))
    whole = one & (distance("a_centre", "b_centre") + F.col("a_radius") + F.col("b_radius") < eps - SLACK)
    return out.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_weight", "b_weight", "a_least", "b_least", F.coalesce(whole, F.lit(False)).alias("whole"))


FOUND = "id long, gain long, other long"


def found_in(interval: Interval, gain: np.ndarray, root_ids: np.ndarray) -> pa.Table:
    some = np.flatnonzero(gain)
    return pa.table({"id": interval.ids[some], "gain": gain[some], "other": root_ids[some]})


def links_of_pairs(intervals: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """id, gain and other: links of a point found in a pair of intervals, and one connected to it."""

    def run(table: pa.Table) -> pa.Table:
        sides = [opened(r) for r in sorted(table.to_pylist(), key=lambda r: r["node"])]
        left, right = sides[0], sides[1] if len(sides) > 1 else None
        gain_a, gain_b, roots = join_intervals(left, right, threshold)
        ids = left.ids if right is None else np.concatenate([left.ids, right.ids])
        of = ids[roots.root]
        out = [found_in(left, gain_a, of[: len(left.ids)])]
        return pa.concat_tables(out if right is None else [*out, found_in(right, gain_b, of[len(left.ids) :])])

    uses = pairs.select(F.col("a").alias("node"), "a", "b").unionByName(pairs.where("a <> b").select(F.col("b").alias("node"), "a", "b"))
    blobs = intervals.select("node", "ids", "copies", "classes", "x", "p")
    return blobs.join(uses, "node").groupBy("a", "b").applyInArrow(run, FOUND)


def links_of_wholes(intervals: DataFrame, wholes: DataFrame) -> DataFrame:
    """The same for pairs of nodes whose vectors all link; ``bits`` tells a node's level."""
    halves = wholes.select("bits", F.col("a").alias("above"), F.col("b_weight").alias("gain"), F.col("a_least").alias("least"), (F.col("a") == F.col("b")).cast("long").alias("own"))
    halves = halves.unionByName(wholes.where("a <> b").select("bits", F.col("b").alias("above"), F.col("a_weight").alias("gain"), F.col("b_least").alias("least"), F.lit(0).cast("long").alias("own")))
    each = halves.groupBy("bits", "above").agg(F.sum("gain").alias("gain"), F.max("own").alias("own"), F.first("least").alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, copies = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["copies"], "<i8")
                yield pa.record_batch({"id": ids, "gain": r["gain"] - r["own"] * copies, "other": np.full(len(ids), r["least"])})

    levels = [r[0] for r in wholes.select("bits").distinct().collect()]
    parts = [intervals.select("ids", "copies", F.shiftright("node", b).alias("above")).join(each.where(F.col("bits") == b), "above").select("ids", "copies", "gain", "own", "least") for b in levels]
    joined = wholes.where("a <> b").select(F.col("a_least").alias("id"), F.lit(0).cast("long").alias("gain"), F.col("b_least").alias("other"))
    return reduce(DataFrame.unionByName, [p.mapInArrow(run, FOUND) for p in parts], joined)


def near_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", class_col: str = "label", interval: int = INTERVAL) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows of its class with that cosine or more),
    component_id (the smallest vec_id that links lead to, its own included) and kept, whether that
    is its own.

    Rows without an id or a class, and vectors that are null, zero or of a component that is null or
    not finite, link with nothing; neither do vectors of unequal length. Rows that repeat each other
    are vectors of their own that link. An empty table gives an empty result; extra columns are left
    behind.
    """
    spark: SparkSession = df.sparkSession
    eps = math.sqrt(max(2 - 2 * threshold, 0))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(class_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("vector"))
    key = ["label", "size", "h1", "h2"]
    # 128 bits tell vectors from each other.
    keyed = rows.where(able).withColumns({"size": F.size("vector"), "h1": F.xxhash64(F.lit(1), "vector"), "h2": F.xxhash64(F.lit(2), "vector")})
    points = stored(keyed.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "points")
    n = points.count()
    sample = [r[0] for r in points.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").collect()]
    of, partitions = directions(sample), n // interval + 1
    intervals = stored(packed(in_grid_order(points, of, eps, partitions), of, interval), "intervals")

    levels = [(0, intervals.select("node", "weight", "least", "first", "last", "low", "high", "centre", "radius"))]
    bits = PIECE_BITS
    while True:
        levels.append((bits, parents(levels[-1][1], bits - levels[-1][0])))
        if partitions - 1 >> (bits - PIECE_BITS) == 0:
            break
        bits += FAN_BITS
    pairs = levels[-1][1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    passed, wholes = [], []
    for (above, _), (bits, nodes) in zip(levels[:0:-1], levels[-2::-1], strict=True):
        now = stored(pairs_below(pairs, nodes, above - bits, eps), "interval-pairs")
        passed.append(now)
        wholes.append(now.where("whole").withColumn("bits", F.lit(bits)))
        pairs = now.where("NOT whole")
    whole = reduce(DataFrame.unionByName, wholes)
    found = stored(links_of_pairs(intervals, pairs, threshold).unionByName(links_of_wholes(intervals, whole)), "links")
    edges = found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    components = connected_components(edges)
    gains = found.groupBy("id").agg(F.sum("gain").alias("gain"))
    settled = points.select(*key, "id", "copies").join(gains, "id", "left").join(components, F.col("id") == F.col("node"), "left")
    settled = settled.select(*key, (F.col("copies") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    settled = stored(settled, "settled")
    for table in (points, intervals, *passed, found):
        forget(table)
    linked = keyed.select("vec_id", *key).join(settled, key).select("vec_id", "n_links", "component_id")
    others = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
