"""An inverted-file index over vectors: lists of rows around centroids, searched a few lists at a time.

Centroids are fitted by spherical k-means on a bounded sample. Every row belongs to the list of its
nearest centroid, and lists are folders of a Parquet table, so that a search reads only the folders
that some query probes. Within them similarities are exact. A query that probes all lists has the
exact answer; ``probes_for`` finds how many lists reach a wanted recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import cosine
from millrace.operators.retrieval import BROADCAST_VALUES, ranked, unit

#: Rows of the sample that centroids are fitted on, most lists, rounds of k-means.
SAMPLE_ROWS, MOST_LISTS, ROUNDS = 20_000, 4096, 12
#: Rows of a list's file, about.
FILE_ROWS = 200_000
#: The list of rows that have no direction: zero vectors and those of another length.
LOOSE = -1


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; the first ones lie far apart, a centroid that loses its rows
    takes the row that is furthest from its own."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(lists, len(sample)):
        far = int(best.argmin())
        if best[far] >= 1 - 1e-12:
            break
        chosen.append(far)
        best = np.maximum(best, sample @ sample[far])
    centroids = sample[chosen]
    for _ in range(rounds):
        scores = sample @ centroids.T
        own = scores.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(scores.max(1), kind="stable")[: len(empty)]]
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        new = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
        if np.allclose(new, centroids, atol=1e-9):
            break
        centroids = new
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """A written index: its folder, centroids, and the columns of ids, vectors and scopes."""

    path: str
    centroids: np.ndarray
    id_col: str
    vector_col: str
    scope: tuple[str, ...]
    schema: str

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/lists")


def build_index(items: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scope: tuple[str, ...] = ()) -> VectorIndex:
    """Writes an index of ``items`` below ``path``, which must be new: their ids, unit vectors and
    ``scope`` columns, by list.

    ``lists`` is the square root of the number of rows unless it is given, ``MOST_LISTS`` at most.
    Rows without an id are left out. Rows are dealt to files by list and a hash, so a list that holds
    most rows is written by many tasks.
    """
    rows = items.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias(vector_col), *scope).where(F.col(id_col).isNotNull())
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector_col)), F.lit(0)).alias("width")).first()
    width = max(stats["width"], 0)
    picked = rows.where(F.size(vector_col) == width).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).select(vector_col).collect()
    sample = unit([r[0] for r in picked], width)
    centroids = fit_centroids(sample[(sample != 0).any(1)], min(lists or max(1, round(stats["n"] ** 0.5)), MOST_LISTS))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column(vector_col).to_pylist(), width)
            own = (x @ centroids.T).argmax(1) if len(centroids) and batch.num_rows else np.full(batch.num_rows, LOOSE)
            own = np.where((x != 0).any(1), own, LOOSE)
            vectors = pa.FixedSizeListArray.from_arrays(x.ravel(), width).cast(pa.list_(pa.float64())) if width else batch.column(vector_col)
            kept = [batch.column(c) for c in scope]
            yield pa.record_batch([batch.column(id_col), vectors, pa.array(own, pa.int32()), *kept], [id_col, vector_col, "list", *scope])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{id_col}` long", f"`{vector_col}` array<double>", "list int", *(f"`{c}` {kinds[c]}" for c in scope)])
    dealt = rows.mapInArrow(assign, schema).repartitionByRange(stats["n"] // FILE_ROWS + 1, "list", F.xxhash64(id_col))
    dealt.write.partitionBy("list").parquet(f"{path}/lists")
    return VectorIndex(path, centroids, id_col, vector_col, scope, schema)


def nearest_lists(centroids: np.ndarray, x: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]


def search_index(index: VectorIndex, queries: DataFrame, limit: int, probes: int | None = None, valid: tuple[str, str] | None = None, on: str | None = None) -> DataFrame:
    """query_id, the items' id, similarity and rank of the ``limit`` most similar items that each
    query finds in its ``probes`` nearest lists (all of them for None, and then also among rows
    without a direction), itself left out; similarities are rounded to 9 digits, equal ones by id.

    Only items whose scope columns equal the query's count; null equals nothing. ``valid`` names the
    scope columns of a half-open window, null for open, that must hold the query's ``on``. Queries of
    up to ``BROADCAST_VALUES`` values in all are held by every task, which keeps its own best; more
    are joined by list and scope.
    """
    spark, id_col, vector_col = queries.sparkSession, index.id_col, index.vector_col
    everything = probes is None or probes >= index.lists
    equal = tuple(c for c in index.scope if c not in (valid or ()))
    if valid and not (on and set(valid) <= set(index.scope)):
        raise ValueError("a window needs scope columns and the queries' date")
    own = [*equal, *([on] if on else [])]
    queries = queries.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias(vector_col), *own).where(F.col(id_col).isNotNull())
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector_col)), F.lit(0)).alias("width")).first()
    schema = f"query_id long, `{id_col}` long, similarity double"
    width = index.centroids.shape[1]
    count = index.lists if everything else probes
    items = index.rows(spark)
    if not size["n"]:
        return spark.createDataFrame([], schema + ", rank int")
    if size["n"] * max(size["width"], 1) > BROADCAST_VALUES:
        found = joined_by_list(index, items, queries, count, everything, equal, valid, on)
    else:
        rows = queries.orderBy(id_col).collect()
        ids, q = np.array([r[0] for r in rows], np.int64), unit([r[1] for r in rows], width)
        asked = nearest_lists(index.centroids, q, count)
        probed = [np.flatnonzero((asked == k).any(1)) for k in range(index.lists)]
        if everything:
            probed.append(np.arange(len(ids)))  # of LOOSE, the last
        wanted = sorted({k for k in range(index.lists) if len(probed[k])} | ({LOOSE} if everything else set()))
        scopes = [tuple(r[2 : 2 + len(equal)]) for r in rows]
        dates = [r[-1] if on else None for r in rows]

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = np.asarray(batch.column("list"))
                for k in np.unique(lists).tolist():
                    yield from best_of_list(batch.filter(pa.array(lists == k)), probed[k])

        def best_of_list(some: pa.RecordBatch, askers: np.ndarray) -> Iterator[pa.RecordBatch]:
            own_ids, x = np.asarray(some.column(id_col)), unit(some.column(vector_col).to_pylist(), width)
            groups: dict[tuple, list[int]] = {}
            for a in askers.tolist():
                groups.setdefault((scopes[a], dates[a]), []).append(a)
            for (scope, date), group in groups.items():
                fits = fitting(some, equal, scope, valid, date)
                if not fits.any():
                    continue
                here, there = own_ids[fits], x[fits]
                score = np.round(q[group] @ there.T, 9)
                score[ids[group][:, None] == here[None, :]] = -2
                order = np.argsort(here, kind="stable")
                top = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :limit]]
                value = np.take_along_axis(score, top, axis=1).ravel()
                good = value > -2
                yield pa.record_batch([pa.array(np.repeat(ids[group], top.shape[1])[good]), pa.array(here[top].ravel()[good]), pa.array(value[good])], ["query_id", id_col, "similarity"])

        found = items.where(F.col("list").isin(wanted)).mapInArrow(best, schema)
    return ranked(found, ["query_id"], [F.col("similarity").desc(), F.col(id_col)], limit)


def fitting(rows: pa.RecordBatch, equal: tuple[str, ...], scope: tuple, valid: tuple[str, str] | None, date) -> np.ndarray:  # noqa: ANN001
    """Which rows are in a query's scope and window."""
    out = np.ones(rows.num_rows, bool)
    for c, value in zip(equal, scope, strict=True):
        column = rows.column(c)
        out &= np.asarray(pc.equal(column, pa.scalar(value, column.type)).fill_null(False)) if value is not None else False
    if valid:
        if date is None:
            return np.zeros(rows.num_rows, bool)
        since, until = (rows.column(c) for c in valid)
        day = pa.scalar(date, since.type)
        out &= np.asarray(pc.less_equal(since, day).fill_null(True)) & np.asarray(pc.greater(until, day).fill_null(True))
    return out


def joined_by_list(index: VectorIndex, items: DataFrame, queries: DataFrame, count: int, everything: bool, equal: tuple[str, ...], valid: tuple[str, str] | None, on: str | None) -> DataFrame:
    """The large way: queries with each list they probe meet the list's rows by an equi-join."""
    centroids, id_col, vector_col = index.centroids, index.id_col, index.vector_col
    width = centroids.shape[1]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = nearest_lists(centroids, unit(batch.column(vector_col).to_pylist(), width), count)
            asked = [[*row, LOOSE] if everything else row for row in lists.tolist()]
            yield batch.append_column("lists", pa.array(asked, pa.list_(pa.int32())))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    asked = queries.mapInArrow(probe, f"{kinds}, lists array<int>").withColumn("list", F.explode("lists"))
    asked = asked.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("_q"), "list", *equal, *([F.col(on).alias("_on")] if on else []))
    pairs = asked.join(items, ["list", *equal]).where(F.col("query_id") != F.col(id_col))
    if valid:
        pairs = pairs.where(F.coalesce(F.col(valid[0]) <= F.col("_on"), F.lit(True)) & F.coalesce(F.col(valid[1]) > F.col("_on"), F.lit(True)) & F.col("_on").isNotNull())
    return pairs.select("query_id", id_col, F.round(cosine(F.col("_q"), F.col(vector_col)), 9).alias("similarity"))


def probes_for(index: VectorIndex, queries: DataFrame, limit: int, recall: float = 0.9, most: int = 64) -> int:
    """The fewest lists that reach ``recall`` of the exact answers over ``most`` of the queries (the
    first by a hash of the id): what rank, among a query's lists, each right answer's list has."""
    id_col, vector_col = index.id_col, index.vector_col
    some = queries.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col).cast("long")), id_col).limit(most)
    exact = search_index(index, some, limit).select("query_id", id_col)
    where = index.rows(queries.sparkSession).select(id_col, "list").join(F.broadcast(exact), id_col).select("query_id", "list").collect()
    vectors = {r[0]: r[1] for r in some.select(F.col(id_col).cast("long"), vector_col).collect()}
    if not where:
        return index.lists
    ids = sorted(vectors)
    order = nearest_lists(index.centroids, unit([vectors[i] for i in ids], index.centroids.shape[1]), index.lists)
    rank = {i: {k: r for r, k in enumerate(row)} for i, row in zip(ids, order.tolist(), strict=True)}
    ranks = np.sort([rank[i].get(k, index.lists) for i, k in where])
    return int(min(index.lists, ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1))


def embedding_issues(asked: DataFrame, got: DataFrame, id_col: str, dims: int) -> DataFrame:
    """id and issue of all that an answer to a request for embeddings lacks or has wrong.

    ``asked`` has ids, ``got`` ids, dense (numbers) and sparse (structs of token_id and weight). Rows are
    missing, unexpected or repeated; dense vectors have ``dims`` finite numbers; sparse ones have a
    weight or more, finite, under token ids that are zero or more and don't repeat. Null is wrong
    everywhere; an issue of a repeated row is told once."""
    counts = got.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    both = asked.select(id_col).distinct().withColumn("_asked", F.lit(True)).join(counts, id_col, "full_outer")
    rows = F.when(F.col("_n").isNull(), "missing_row").when(F.col("_asked").isNull(), "unexpected_row")
    of_rows = both.select(id_col, F.explode(F.array_compact(F.array(rows, F.when(F.col("_n") > 1, "repeated_row")))).alias("issue"))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    tokens, weights = F.transform("sparse", lambda s: s["token_id"]), F.transform("sparse", lambda s: s["weight"])
    rules = {
        "dense_dimensions": F.coalesce(F.size("dense"), F.lit(-1)) != dims, "dense_not_finite": F.exists("dense", lambda x: ~finite(x)), "sparse_missing": F.coalesce(F.size("sparse"), F.lit(-1)) < 1,
        "sparse_token_invalid": F.exists(tokens, lambda t: F.coalesce(t < 0, F.lit(True))), "sparse_token_repeated": F.size(F.array_distinct(tokens)) < F.size(tokens), "sparse_weight_invalid": F.exists(weights, lambda w: ~finite(w)),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return of_rows.unionByName(got.select(id_col, F.explode(found).alias("issue")).distinct())
