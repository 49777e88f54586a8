"""Lexical and vector retrieval of a bounded set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import tokens

#: Query tokens up to which their table is broadcast; beyond that it is joined by a shuffle.
BROADCAST_TOKENS = 500_000
#: Query vectors that meet items at once, and query values (with the best of each query) up to which they
#: are sent to tasks.
QUERY_BLOCK, BROADCAST_VALUES = 512, 4_000_000
#: Items times queries that a task counts at once.
CELLS = 1_000_000
#: Items that meet queries at once, and values of items that a task holds at once.
PACKED_ROWS, ITEM_VALUES = 4096, 4_000_000
#: No text has more parts.
LAST_PART = (1 << 32) - 1


def token_overlaps(queries: DataFrame, items: DataFrame, query_id: str, item_ids: list[str], text: str = "text") -> DataFrame:
    """query_id, item_ids, overlap and n_query: the number of tokens that a query and an item share,
    for those that share any.

    An inverted index in one pass: items' tokens meet the queries' ones by an equi-join, and counts
    are summed in the task that read the item before they are shuffled.
    """
    q = queries.select(query_id, tokens(F.col(text)).alias("_t")).withColumn("n_query", F.size("_t"))
    q = q.select(query_id, "n_query", F.explode("_t").alias("token"))
    q = F.broadcast(q) if q.count() <= BROADCAST_TOKENS else q
    words = items.select(*item_ids, F.explode(tokens(F.col(text))).alias("token"))
    return words.join(q, "token").groupBy(query_id, "n_query", *item_ids).agg(F.count(F.lit(1)).alias("overlap"))


def ranked(df: DataFrame, by: list[str], order: list, limit: int | None, name: str = "rank") -> DataFrame:
    """``df`` with its rank, from 1, and only ranks up to ``limit``."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out.where(F.col(name) <= limit) if limit else out


def best_overlaps(queries: DataFrame, items: DataFrame, query_id: str, item_ids: list[str], limit: int, text: str = "text", whole: bool = False) -> DataFrame:
    """query_id, n_query, item_ids, part, overlap and rank of the ``limit`` items that share most tokens
    with each query, equal ones by their ids; items that share none are left out. With ``whole`` also
    rows, rank null, of every item that has all tokens of a query.

    ``items`` have integer ids, unique together, and ``text``, a string or an array of strings, the
    parts: then the best part counts, the first of equal ones, and ``part`` is its place. Rows of null
    ids or texts are left out. Tasks hold the queries' tokens and give only their own best, so that a
    shuffle moves ``limit`` rows a query and task. Queries of more than ``BROADCAST_TOKENS`` tokens
    are joined by the tokens instead.
    """
    parted = isinstance(items.schema[text].dataType, T.ArrayType)
    q = queries.select(F.col(query_id).cast("long").alias(query_id), tokens(F.col(text)).alias("_t")).where((F.size("_t") > 0) & F.col(query_id).isNotNull())
    rows = items.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in [*item_ids, text])))
    rows = rows.select(*(F.col(c).cast("long").alias(c) for c in item_ids), (F.col(text) if parted else F.array(text)).alias("_parts"))
    keep = [query_id, "n_query", *item_ids, "part", "overlap"]
    if (q.agg(F.sum(F.size("_t"))).first()[0] or 0) > BROADCAST_TOKENS:
        parts = rows.select(*item_ids, F.posexplode("_parts").alias("part", "text"))
        found = token_overlaps(queries.where(F.col(query_id).isNotNull()), parts, query_id, [*item_ids, "part"], "text")
        found = ranked(found, [query_id, *item_ids], [F.col("overlap").desc(), "part"], 1, "_n").select(*keep)
        full = found
    else:
        asked = q.orderBy(query_id).collect()
        found = rows.select(*item_ids, F.transform("_parts", tokens).alias("_parts"))
        schema = ", ".join(f"{c} long" for c in keep) + ", _own boolean"
        found = found.mapInArrow(overlap_counter([(r[0], r[1]) for r in asked], item_ids, limit, whole, keep), schema)
        full, found = found.where("not _own").drop("_own"), found.where("_own").drop("_own")
    best = ranked(found, [query_id], [F.col("overlap").desc(), *item_ids], limit)
    return best.unionByName(full.where("overlap = n_query").withColumn("rank", F.lit(None).cast("int"))) if whole else best


def overlap_counter(asked: list[tuple[int, list[str]]], item_ids: list[str], limit: int, whole: bool, names: list[str]):  # noqa: ANN201
    """A function for ``mapInArrow`` that counts the tokens that items share with the queries ``asked``."""
    vocabulary = sorted({t for _, own in asked for t in own})
    place = {t: i for i, t in enumerate(vocabulary)}
    # Queries by token, as one array and where a token's part of it begins.
    holders: list[list[int]] = [[] for _ in vocabulary]
    for k, (_, own) in enumerate(asked):
        for t in own:
            holders[place[t]].append(k)
    degree = np.array([len(h) for h in holders], np.int64)
    first = np.concatenate([[0], np.cumsum(degree)])
    holder = np.array([k for h in holders for k in h], np.int64)
    ids, sizes = np.array([k for k, _ in asked], np.int64), np.array([len(t) for _, t in asked], np.int64)
    n, words = len(asked), pa.array(vocabulary, pa.string())

    def merge(best: list[np.ndarray] | None, more: list[np.ndarray]) -> list[np.ndarray]:
        """Columns query, overlap, part and ids: those of ``limit`` or less rank within their query."""
        both = more if best is None else [np.concatenate(c) for c in zip(best, more, strict=True)]
        order = np.lexsort((*reversed(both[3:]), -both[1], both[0]))
        both = [c[order] for c in both]
        starts = np.searchsorted(both[0], both[0], side="left")
        good = np.arange(len(both[0])) - starts < limit
        return [c[good] for c in both]

    def out(rows: list[np.ndarray], own: bool) -> pa.RecordBatch:
        k = rows[0]
        columns = [ids[k], sizes[k], *rows[3:], rows[2], rows[1]]
        return pa.record_batch([*map(pa.array, columns), pa.array(np.full(len(k), own))], [*names, "_own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches if n else ():
            for at in range(0, batch.num_rows, step := max(1, CELLS // n)):
                some = batch.slice(at, step)
                parts = some.column(len(item_ids))
                item = np.repeat(np.arange(some.num_rows), np.diff(parts.offsets.to_numpy()))
                begin = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1]) if len(item) else np.zeros(0, np.int64)
                number = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item)))) if len(item) else item
                lists = parts.flatten()
                token = lists.flatten()
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                code = pc.index_in(token, words).fill_null(-1).to_numpy().astype(np.int64)
                row, code = row[code >= 0], code[code >= 0]
                # Most overlap first, then the first part: one number to take the largest of.
                top = np.zeros((some.num_rows, n), np.int64)
                for low in range(0, len(lists), step):
                    mine = slice(*np.searchsorted(row, [low, low + step]))
                    times = degree[code[mine]]
                    at_holder = np.arange(times.sum()) + np.repeat(first[code[mine]] - np.cumsum(times) + times, times)
                    high = min(low + step, len(lists))
                    cell = np.repeat(row[mine] - low, times) * n + holder[at_holder]
                    count = np.bincount(cell, minlength=(high - low) * n).reshape(-1, n)
                    value = np.where(count > 0, (count << 32) + (LAST_PART - number[low:high, None]), 0)
                    begins = np.concatenate([[0], np.flatnonzero(np.diff(item[low:high])) + 1])
                    most = np.maximum.reduceat(value, begins, axis=0)
                    top[item[low:high][begins]] = np.maximum(top[item[low:high][begins]], most)
                i, k = np.nonzero(top)
                value = top[i, k]
                rows = [k, value >> 32, LAST_PART - (value & LAST_PART), *(some.column(c).to_numpy()[i] for c in range(len(item_ids)))]
                if whole:
                    every = rows[1] == sizes[k]
                    yield out([c[every] for c in rows], False)
                best = merge(best, rows)
        if best is not None:
            yield out(best, True)

    return run


def lexical_topk(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, limit: int = 5) -> DataFrame:
    """The items that share most of a query's tokens; equal scores by id."""
    if not 1 <= limit <= 5:
        raise ValueError("limit must be 1 to 5")
    found = best_overlaps(queries, items, query_id, [item_id], limit)
    return found.withColumn("score", F.col("overlap") / F.greatest(F.col("n_query"), F.lit(1)))


def with_adjacent(hits: DataFrame, chunks: DataFrame, group: list[str], position: str, query_id: str) -> DataFrame:
    """Hits and their neighbours, ranked anew.

    ``hits`` has query_id, rank, score and the chunk's ``group`` and ``position``; ``chunks`` are
    those in scope. A neighbour stands one position before or after in the same group, takes the
    hit's score, and is left out where it came before.
    """
    steps = F.array(F.struct(F.lit(0).alias("order"), F.lit(0).alias("step")), F.struct(F.lit(1).alias("order"), F.lit(-1).alias("step")), F.struct(F.lit(2).alias("order"), F.lit(1).alias("step")))
    wanted = hits.select(query_id, "score", F.col("rank").alias("_rank"), *group, F.col(position).alias("_at"), F.explode(steps).alias("_s"))
    wanted = wanted.select(query_id, "score", "_rank", *group, (F.col("_at") + F.col("_s.step")).alias(position), F.col("_s.order").alias("_order"))
    found = wanted.join(chunks.select(*group, position), [*group, position], "left_semi")
    first = ranked(found, [query_id, *group, position], ["_rank", "_order"], 1, "_n")
    return ranked(first, [query_id], ["_rank", "_order"], None).select(query_id, "rank", *group, position, "score")


class Best:
    """The ``limit`` most similar items of each of some queries among all that were shown, equal scores (to
    9 digits) by id; a query's own id is left out. What it holds doesn't grow with the items."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, limit: int):
        self.ids, self.q, self.limit = ids, q, limit
        # Below -1 there is no similarity, so these are free places.
        self.score, self.found = np.full((len(ids), limit), -2.0), np.zeros((len(ids), limit), np.int64)

    def show(self, own: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(self.ids), QUERY_BLOCK):
            for b in range(0, len(own), PACKED_ROWS):
                self.meet(slice(a, a + QUERY_BLOCK), own[b : b + PACKED_ROWS], vectors[b : b + PACKED_ROWS])

    def meet(self, some: slice, own: np.ndarray, vectors: np.ndarray) -> None:
        score = self.q[some] @ vectors.T
        score[self.ids[some, None] == own[None, :]] = -2
        # Rounding moves a score by less than this.
        floor = np.maximum(self.score[some, -1] - 1e-9, -1.5)
        near = score >= floor[:, None]
        if near.sum() > 4 * near.shape[0] * self.limit and near.shape[1] > self.limit:
            last = -np.partition(-score, self.limit - 1, axis=1)[:, self.limit - 1]
            near = score >= np.fmax(floor, last - 1e-9)[:, None]
        i, j = np.nonzero(near)
        if not len(i):
            return
        rows = np.unique(i)
        query = np.concatenate([np.repeat(rows, self.limit), i])
        value = np.concatenate([self.score[some][rows].reshape(-1), np.round(score[i, j], 9)])
        item = np.concatenate([self.found[some][rows].reshape(-1), own[j]])
        order = np.lexsort((item, -value, query))
        # A row had ``limit`` entries before, so it has as many now.
        take = order[np.searchsorted(query[order], rows)[:, None] + np.arange(self.limit)]
        self.score[some][rows], self.found[some][rows] = value[take], item[take]

    def batches(self, id_col: str) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), PACKED_ROWS):
            score = self.score[a : a + PACKED_ROWS].reshape(-1)
            good = score > -2
            columns = np.repeat(self.ids[a : a + PACKED_ROWS], self.limit), self.found[a : a + PACKED_ROWS].reshape(-1), score
            yield pa.record_batch([pa.array(c[good]) for c in columns], ["query_id", id_col, "similarity"])


def vector_topk(queries: DataFrame, items: DataFrame, limit: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id_col, similarity and rank of the ``limit`` most similar items of each query,
    itself left out; equal similarities (to 9 digits) by id.

    Queries of up to ``BROADCAST_VALUES`` values in all are held by every task, which keeps its own best of
    each, and a window picks the best of all. More queries are sent to parts of the items. Either way a task
    holds a bounded number of vectors, and of scores a block. Zero vectors and ones of another length than
    the longest query's have similarity 0; rows without an id are left out.
    """
    queries = queries.where(F.col(id_col).isNotNull())
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("width")).first()
    width = max(size["width"], 0)
    schema = f"query_id long, {id_col} long, similarity double"
    if not size["n"]:
        return items.sparkSession.createDataFrame([], schema + ", rank int")
    columns = [F.col(id_col).cast("long").alias(id_col), F.col(vector).cast("array<double>").alias(vector)]
    items = items.select(*columns).where(F.col(id_col).isNotNull())
    if size["n"] * max(width, 2 * limit) <= BROADCAST_VALUES:
        asked = queries.select(*columns).toArrow().combine_chunks()
        ids, q = asked.column(0).to_numpy().astype(np.int64), unit_rows(asked.column(1), width)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                found = found or Best(ids, q, limit)
                found.show(batch.column(0).to_numpy(), unit_rows(batch.column(1), width))
            if found:
                yield from found.batches(id_col)

        found = items.mapInArrow(best, schema)
    else:
        found = meet_in_parts(queries.select(*columns), items, limit, id_col, width)
    return ranked(found, ["query_id"], [F.col("similarity").desc(), F.col(id_col)], limit)


def meet_in_parts(queries: DataFrame, items: DataFrame, limit: int, id_col: str, width: int) -> DataFrame:
    """The queries' best of each part of the items. Items are dealt by their ids into parts of about
    ``ITEM_VALUES`` values, each part gets all queries after its items, and a task holds the items of one
    part and a batch of queries."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, own, vectors = None, [], None, None
        for batch in batches:
            at, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at[a] != part:
                    part, held, own, vectors = at[a], [], None, None
                some = batch.slice(a, b - a)
                ids, x = some.column(2).to_numpy(), unit_rows(some.column(3), width)
                if not asks[a]:
                    held.append((ids, x))
                    continue
                if held:
                    own, vectors = (np.concatenate(c) for c in zip(*held, strict=True))
                    held = []
                if own is not None:
                    found = Best(ids, x, limit)
                    found.show(own, vectors)
                    yield from found.batches(id_col)

    parts = -(-items.count() * max(width, 1) // ITEM_VALUES) or 1
    dealt = items.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("asks"), "*")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), "*")
    rows = dealt.unionByName(asked).repartition("part").sortWithinPartitions("part", "asks")
    return rows.mapInArrow(best, f"query_id long, {id_col} long, similarity double")


def unit_rows(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """``unit`` of an Arrow column of lists."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    out = np.zeros((len(vectors), width))
    good = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    values = pc.fill_null(vectors.filter(good).flatten().cast(pa.float64()), 0.0)
    out[good.to_numpy(zero_copy_only=False)] = values.to_numpy(zero_copy_only=False).reshape(-1, width) if width else 0.0
    return at_length_one(out)


def at_length_one(out: np.ndarray) -> np.ndarray:
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def unit(vectors: list, width: int) -> np.ndarray:
    """The vectors as rows of length one; those of another width are zero."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = np.array([0.0 if x is None else x for x in v], np.float64)
    return at_length_one(out)
