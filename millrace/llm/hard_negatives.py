"""Hard-negative mining by a pivot table.

The inner product of an anchor q with a row x is a distance in disguise: with M the largest norm and
x' = (x, sqrt(M² - |x|²)), q' = (q, 0), the squared distance of q' and x' is |q|² + M² - 2 q·x. A few
pivots are chosen among a sample of rows; the pivot table stores each row's distances to them. By
the triangle inequality an anchor's distances to the pivots and the stored ones bracket every score:
a row can be left out if its bracket lies below what is already among the best, or outside the wanted
scores. Only rows that stay are scored, exactly, in whole numbers.

Rows are sorted by class, nearest pivot and distance to it, and packed into groups of blocks; a block
has the least and greatest distance to each pivot, so whole blocks are ruled out first. Anchors are
packed too and dealt to all groups of rows that may concern them: for positives those with a row of
their class, for negatives all. A task holds one group of rows and a bounded lot of anchors, keeps
each anchor's best, and a window picks the best of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import forget, stored

#: Rows of the sample, pivots chosen from it, rows of a block and of a group, anchors of a lot.
SAMPLE, PIVOTS, BLOCK, GROUP, LOT = 4096, 16, 1024, 8192, 1024
#: Sums of products beyond this aren't exact as doubles.
EXACT = 2.0**53
#: As a bound of wanted scores: none.
ANY = 2**63 - 1


@dataclass
class Space:
    """Pivots of the sample in the space of distances, and the largest squared norm."""

    pivots: np.ndarray
    pivot_norms: np.ndarray
    most: float

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of augmented rows to the pivots."""
        norms = (x * x).sum(1)
        lift, pivot_lift = np.sqrt(np.maximum(self.most - norms, 0)), np.sqrt(np.maximum(self.most - self.pivot_norms, 0))
        square = norms[:, None] + self.pivot_norms - 2 * self.products(x) + (lift[:, None] - pivot_lift) ** 2
        return np.sqrt(np.maximum(square, 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors, whose last coordinate is 0, to the pivots."""
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.most - 2 * self.products(q), 0))

    def products(self, x: np.ndarray) -> np.ndarray:
        width = min(x.shape[1], self.pivots.shape[1])
        return x[:, :width] @ self.pivots[:, :width].T

    def slack(self, q: np.ndarray) -> np.ndarray:
        """How far brackets of scores are widened, as distances are rounded."""
        return 1e-7 * ((q * q).sum(1) + self.most) + 1e-6


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample far from each other: each one furthest from those chosen before."""
    if not len(sample):
        return np.zeros((1, 1))
    chosen, near = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return sample[chosen]


def as_matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors as rows, filled with zeros to the longest."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(at)
    out = np.zeros((len(sizes), sizes.max(initial=1)))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], sizes)] = flat
    return out


def whole_rows(df: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, the vector as whole numbers and its squared norm; unfit rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(scale * batch.column("vector").flatten().to_numpy(zero_copy_only=False))
            at = batch.column("vector").offsets.to_numpy() - batch.column("vector").offsets[0].as_py()
            norms = np.diff(np.concatenate([[0.0], np.cumsum(flat * flat)])[at])
            vectors = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.float64()))
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), vectors, pa.array(norms)], ["vec_id", "label", "vector", "norm"])

    bad = F.exists("vector", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(True)))
    fit = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)))
    return fit.mapInArrow(run, "vec_id long, label long, vector array<double>, norm double")


def in_pivot_order(rows: DataFrame, space: Space, partitions: int) -> DataFrame:
    """Rows sorted by label, nearest pivot and distance to it; ``part`` numbers the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = space.of_rows(as_matrix(batch.column("vector")))
                yield batch.append_column("cell", pa.array(d.argmin(1), pa.int32())).append_column("near", pa.array(d.min(1)))

    order = ["label", "cell", "near", "vec_id"]
    rows = rows.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label long, vector array<double>, cell int, near double")
    return rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


PACKED = "part int, labels array<long>, ids binary, of binary, x binary, d binary"
WISH = "struct<tag: long, score: long, low: long, high: long>"


def packed(rows: DataFrame, space: Space, size: int, anchors: bool = False) -> DataFrame:
    """Rows of a partition in their order, ``size`` to a record: ids, labels, vectors and distances
    to the pivots as bytes. Those of anchors have their ``wishes`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def record(table: pa.Table) -> pa.RecordBatch:
            column = {c: table.column(c).combine_chunks() for c in table.column_names}
            x, labels = as_matrix(column["vector"]), column["label"].to_numpy().astype("<i8")
            d = space.of_anchors(x) if anchors else space.of_rows(x)
            out = {"part": column["part"][0].as_py(), "labels": np.unique(labels).tolist(), "ids": column["vec_id"].to_numpy().astype("<i8").tobytes(), "of": labels.tobytes(), "x": x.tobytes(), "d": d.tobytes()}
            if anchors:
                own = column["wishes"]
                place = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
                out["wishes"] = np.stack([place, *[own.flatten().field(c).to_numpy() for c in ("tag", "score", "low", "high")]], 1).astype("<i8").tobytes()
            return pa.RecordBatch.from_pylist([out], schema=kind)

        kind = pa.schema([("part", pa.int32()), ("labels", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ["ids", "of", "x", "d"] + ["wishes"] * anchors])
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield record(table.slice(0, size))
                held = table.slice(size).to_batches()
        if any(b.num_rows for b in held):
            yield record(pa.Table.from_batches(held))

    return rows.mapInArrow(run, PACKED + ", wishes binary" * anchors)


@dataclass
class Table:
    """Packed rows: whole-number vectors and their distances to the pivots."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    d: np.ndarray

    @classmethod
    def opened(cls, row: dict) -> Table:
        ids = np.frombuffer(row["ids"], "<i8")
        wide = [np.frombuffer(row[c], "<f8").reshape(len(ids), -1) for c in ("x", "d")]
        return cls(ids, np.frombuffer(row["of"], "<i8"), *wide)

    @property
    def peak(self) -> float:
        return float(np.abs(self.x).max(initial=0))


class Best:
    """The first ``count`` of (score, id), higher scores and then smaller ids first; what repeats
    both counts once."""

    def __init__(self, count: int):
        self.count, self.scores, self.ids = count, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def floor(self) -> float:
        return int(self.scores[-1]) if len(self.scores) == self.count else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (np.diff(scores) != 0) | (np.diff(ids) != 0)
        self.scores, self.ids = scores[new][: self.count], ids[new][: self.count]


def exact_scores(x: np.ndarray, q: np.ndarray, as_doubles: bool) -> np.ndarray:
    """Inner products of whole numbers: as doubles if all sums are exact, else as Python's."""
    width = min(x.shape[1], len(q))
    x, q = x[:, :width], q[:width]
    if as_doubles:
        return (x @ q).astype(np.int64)
    scores = [sum(int(a) * int(b) for a, b in zip(row, q.tolist(), strict=True)) for row in x.tolist()]
    if any(abs(s) >= 1 << 63 for s in scores):
        raise OverflowError("a score is beyond 64 bits")
    return np.array(scores, np.int64)


def search(rows: Table, anchors: Table, wishes: np.ndarray, space: Space, count: int, same_label: bool, seen: dict[str, int] | None = None) -> list[Best]:
    """The best of packed rows for each wish: the anchor's place, a tag, its score, and the lowest
    and highest score wanted. ``seen`` counts pairs of anchors and rows, and those scored."""
    out, seen = [Best(count) for _ in wishes], {} if seen is None else seen
    as_doubles = rows.peak * anchors.peak * max(rows.x.shape[1], 1) < EXACT
    slack, base = space.slack(anchors.x), (anchors.x**2).sum(1) + space.most
    starts = list(range(0, len(rows.ids), BLOCK))
    least, most = np.array([rows.d[s : s + BLOCK].min(0) for s in starts]), np.array([rows.d[s : s + BLOCK].max(0) for s in starts])
    own: dict[int, list[int]] = {}
    for k, a in enumerate(wishes[:, 0].tolist()):
        own.setdefault(a, []).append(k)
    for a, mine in own.items():
        d, low, high = anchors.d[a], min(int(wishes[k, 3]) for k in mine), max(int(wishes[k, 4]) for k in mine)
        low, high = -math.inf if low == -ANY else low, math.inf if high == ANY else high
        bracket = lambda near, far, a=a: ((base[a] - far * far) / 2 - slack[a], (base[a] - near * near) / 2 + slack[a])
        lower, upper = bracket(np.maximum(0, np.maximum(least - d, d - most)).max(1), (most + d).min(1))
        for b in np.argsort(-upper, kind="stable").tolist():
            part = slice(starts[b], starts[b] + BLOCK)
            seen["pairs"] = seen.get("pairs", 0) + len(rows.ids[part])
            floor = max(low, min(out[k].floor for k in mine))
            if upper[b] < floor or lower[b] > high:
                continue
            fits = ((rows.labels[part] == anchors.labels[a]) == same_label) & (rows.ids[part] != anchors.ids[a])
            low_row, high_row = bracket(np.abs(rows.d[part] - d).max(1), (rows.d[part] + d).min(1))
            stay = np.flatnonzero(fits & (high_row >= floor) & (low_row <= high))
            seen["scored"] = seen.get("scored", 0) + len(stay)
            if not len(stay):
                continue
            scores, ids = exact_scores(rows.x[part][stay], anchors.x[a], as_doubles), rows.ids[part][stay]
            for k in mine:
                take = (scores >= max(wishes[k, 3], out[k].floor)) & (scores <= wishes[k, 4])
                if take.any():
                    out[k].add(scores[take], ids[take])
    return out


FOUND = "anchor_id long, tag long, tag_score long, row_id long, score long"


def best_rows(groups: DataFrame, lots: DataFrame, deals: DataFrame, space: Space, count: int, same_label: bool) -> DataFrame:
    """For each wish the first ``count`` rows, with rank; ``deals`` (lot, part) says which packed
    anchors meet which group of rows."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(table_rows: pa.Table, table_lots: pa.Table) -> pa.Table:
        parts = []
        for r in table_lots.to_pylist():
            anchors, wishes = Table.opened(r), np.frombuffer(r["wishes"], "<i8").reshape(-1, 5)
            for some in table_rows.to_pylist():
                best = search(Table.opened(some), anchors, wishes, space, count, same_label)
                at = np.repeat(np.arange(len(wishes)), [len(b.ids) for b in best])
                parts.append([anchors.ids[wishes[at, 0]], wishes[at, 1], wishes[at, 2], *[np.concatenate([getattr(b, c) for b in best] or [at]) for c in ("ids", "scores")]])
        return pa.table({c: np.concatenate(v) if parts else np.empty(0, np.int64) for c, v in zip(names, zip(*parts, strict=True) if parts else [[]] * len(names), strict=True)})

    rows = groups.join(deals, "part").select("lot", "part", "ids", "of", "x", "d")
    dealt = lots.withColumnRenamed("part", "lot").join(deals, "lot").select("lot", "part", "ids", "of", "x", "d", "wishes")
    found = rows.groupBy("part", "lot").cogroup(dealt.groupBy("part", "lot")).applyInArrow(run, FOUND).distinct()
    first = W.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count)


def mine_hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor
    and each of its first ``positives`` rows of the same label the first ``negatives`` rows of other
    labels whose score is from ``percent[0]`` to ``percent[1]`` hundredths of the positive's. Anchors
    are the rows with ``is_anchor``, a condition on ``vec_id`` and ``label``.

    Components become floor(scale * x); a score is the inner product with the anchor. Higher scores
    come first, then smaller ids. Rows without an id, a label or a vector, and vectors with a
    component that is null or not finite, take no part; a shorter vector counts as filled with
    zeros. A row with the anchor's own id is no other row; rows that repeat both id and score count
    once; of rows with one anchor's id the first by label and vector is the anchor. A score beyond
    64 bits is an error. Empty tables give an empty result; extra columns are left behind.
    """
    spark: SparkSession = df.sparkSession
    cast = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = stored(whole_rows(cast, scale), "whole-vectors")
    n, most = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    pivots = choose_pivots(as_matrix(pa.array([r[0] for r in sample], pa.list_(pa.float64()))), PIVOTS)
    space = Space(pivots, (pivots**2).sum(1), most or 0.0)
    parts = n // GROUP + 1
    groups = stored(packed(in_pivot_order(rows, space, parts), space, GROUP), "pivot-table")

    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("first")).select("vec_id", "first.label", "first.vector")
    anchors = stored(anchors, "anchors")
    lots = anchors.count() // LOT + 1

    def packed_lots(wishes: DataFrame) -> DataFrame:
        dealt = wishes.repartitionByRange(lots, "label", "vec_id").sortWithinPartitions("label", "vec_id")
        return stored(packed(dealt.withColumn("part", F.spark_partition_id()), space, LOT, anchors=True), "anchor-lots")

    everything = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(0).cast("long").alias("score"), F.lit(-ANY).alias("low"), F.lit(ANY).alias("high")))
    first_lots = packed_lots(anchors.withColumn("wishes", everything))
    of_label = lambda d, name: d.select(F.col("part").alias(name), F.explode("labels").alias("label")).distinct()
    found = stored(best_rows(groups, first_lots, of_label(first_lots, "lot").join(of_label(groups, "part"), "label").select("lot", "part").distinct(), space, positives, True), "positives")

    low, high = F.ceil(F.col("score") * percent[0] / F.lit(100).cast("decimal(3,0)")), F.floor(F.col("score") * percent[1] / F.lit(100).cast("decimal(3,0)"))
    wishes = found.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("row_id").alias("tag"), "score", low.cast("long").alias("low"), high.cast("long").alias("high"))).alias("wishes"))
    second_lots = packed_lots(anchors.join(wishes, "vec_id"))
    all_parts = second_lots.select(F.col("part").alias("lot")).distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = stored(best_rows(groups, second_lots, all_parts, space, negatives, False), "negatives")
    for table in (rows, groups, anchors, first_lots, found, second_lots):
        forget(table)
    return out.select(
        "anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("row_id").alias("negative_id"), F.col("tag_score").alias("positive_score"), F.col("score").alias("negative_score")
    )
