"""A stored inverted index: posting lists by shop, rewritten only where a shop's documents changed.

A shop's state has a fingerprint, a tree of hashes over its documents. Its postings lie in a folder
named after shop and fingerprint, and a manifest, a new one after each refresh, names the folders
that count. So postings are never changed in place: a refresh compares fingerprints, writes what is
new, then the manifest; one that was cut short leaves the old manifest in force, and its next run
writes the same folders again. Readers of an older manifest go on with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators.retrieval import BROADCAST_TOKENS, ranked
from millrace.sources.store import exists

#: Bytes of text of which a part of a shop holds the postings, about.
PART_BYTES = 32 << 20
#: Children of a node of a fingerprint's tree.
FAN = 1000


def shop_fingerprints(docs: DataFrame, shop: str, doc_id: str, text: str) -> DataFrame:
    """shop, documents and fingerprint: one hash over a shop's documents in order.

    Hashes are summed up as a tree over ranges of 1,000, a million and a thousand million ids, so that
    none of its nodes has more than 1,000 parts and a hot shop's rows meet in many tasks. Null texts
    count as empty ones; rows without an id or a shop are left out."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(shop).isNotNull())
    rows = rows.select(F.col(shop).alias("shop"), F.col(doc_id).cast("long").alias("at"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"), F.lit(1).alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: F.concat_ws(":", x["at"], x["h"])), "|")
    for _ in range(3):
        rows = rows.groupBy("shop", F.floor(F.col("at") / FAN).alias("above")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("above", "at")
    return rows.groupBy("shop").agg(F.sum("n").alias("documents"), F.sha2(joined, 256).alias("fingerprint"))


def manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The number of the manifest in force, 0 if there is none, and its rows: shop and fingerprint."""
    empty = spark.createDataFrame([], "shop string, fingerprint string")
    if not exists(spark, f"{path}/manifest"):
        return 0, empty
    rows = spark.read.schema("shop string, fingerprint string, version int").parquet(f"{path}/manifest")
    last = rows.agg(F.max("version")).first()[0] or 0
    return last, rows.where((F.col("version") == last) & F.col("shop").isNotNull()).drop("version") if last else empty


def posting_lists(docs: DataFrame) -> DataFrame:
    """shop, fingerprint, part, token and docs, the ids of the part's documents that have the token, of
    shop, fingerprint, doc_id and text. A shop is cut by a hash of the ids into parts of bounded size."""
    sizes = docs.groupBy("shop").agg((F.floor(F.sum(F.octet_length("text")) / PART_BYTES) + 1).alias("parts"))
    own = ["shop", "fingerprint", "part"]
    dealt = docs.join(sizes, "shop").select("shop", "fingerprint", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), "doc_id", "text")
    # Texts are shuffled once, by their parts; tokens, many times as many bytes, stay in the part's task.
    # An outer explode gets no filter that would cut each text into tokens again.
    words = dealt.repartition(*own).select(*own, "doc_id", F.explode_outer(tokens(F.col("text"))).alias("token")).where("token IS NOT NULL")
    lists = words.groupBy(*own, "token").agg(F.collect_set("doc_id").alias("docs"))
    return lists.withColumn("docs", F.array_sort("docs"))


def refresh_postings(docs: DataFrame, path: str, shop: str, doc_id: str, text: str = "text") -> DataFrame:
    """Brings the index at ``path`` up to date with ``docs`` and returns shop and action: kept, added,
    rewritten or dropped. Only texts of added and rewritten shops are cut into tokens.

    Rows without an id, a shop or a text have no postings; a shop with none but such rows is kept in
    the manifest. Rows that repeat an id add their tokens to it."""
    spark = docs.sparkSession
    version, known = manifest(spark, path)
    now = shop_fingerprints(docs, shop, doc_id, text).withColumn("shop", F.col("shop").cast("string"))
    both = now.select("shop", F.col("fingerprint").alias("new")).join(known.select("shop", F.col("fingerprint").alias("old")), "shop", "full_outer")
    action = F.when(F.col("new").isNull(), "dropped").when(F.col("old").isNull(), "added").when(F.col("new") == F.col("old"), "kept").otherwise("rewritten")
    # Shops are few beside documents, but written once: what follows reads this table.
    log = f"{path}/log/version={version + 1}"
    both.withColumn("action", action).write.mode("overwrite").parquet(log)
    states = spark.read.parquet(log)
    fresh = states.where(F.col("action").isin("added", "rewritten")).select("shop", F.col("new").alias("fingerprint"))
    if not fresh.isEmpty():
        changed = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(shop).cast("string").alias("shop"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        lists = posting_lists(changed.join(fresh, "shop"))
        # A part's lists lie together in order of tokens, so that a search skips most of a file.
        lists = lists.sortWithinPartitions("shop", "fingerprint", "part", "token")
        lists.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shop", "fingerprint").parquet(f"{path}/postings")
    live = states.where("new IS NOT NULL").select("shop", F.col("new").alias("fingerprint"))
    # A row of nulls makes a manifest of no shops one, too.
    live = live.unionByName(spark.createDataFrame([(None, None)], live.schema))
    live.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version + 1}")
    return states.select("shop", "action")


def postings(spark: SparkSession, path: str) -> DataFrame:
    """The posting lists in force."""
    _, live = manifest(spark, path)
    if not exists(spark, f"{path}/postings"):
        return spark.createDataFrame([], "part int, token string, docs array<long>, shop string, fingerprint string")
    rows = spark.read.schema("part int, token string, docs array<long>, shop string, fingerprint string").parquet(f"{path}/postings")
    return rows.join(live, ["shop", "fingerprint"], "left_semi")


def postings_topk(queries: DataFrame, path: str, query_id: str, limit: int = 5, text: str = "text", shops: list[str] | None = None) -> DataFrame:
    """query_id, n_query, doc_id, overlap, rank and score of the ``limit`` documents that share most of a
    query's tokens, equal ones by id: what ``lexical_topk`` finds in the documents themselves.

    Only lists of the queries' tokens, and with ``shops`` only their folders, are read. The lists of a
    part meet in one task, which counts and keeps each query's best; parts are of bounded size. More
    than ``BROADCAST_TOKENS`` tokens are joined instead."""
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).cast("long").alias(query_id), tokens(F.col(text)).alias("_t")).where(F.col(query_id).isNotNull() & (F.size("_t") > 0))
    lists = postings(spark, path)
    if shops is not None:
        lists = lists.where(F.col("shop").isin(shops))
    asked = q.select(query_id, F.size("_t").alias("n_query"), F.explode("_t").alias("token"))
    if asked.count() > BROADCAST_TOKENS:
        hits = lists.join(asked, "token").select(query_id, "n_query", F.explode("docs").alias("doc_id"))
        found = hits.groupBy(query_id, "n_query", "doc_id").agg(F.count(F.lit(1)).alias("overlap"))
    else:
        rows = asked.collect()
        sizes = {r[0]: r[1] for r in rows}
        ids = np.array(sorted(sizes), np.int64)
        place, holders = {i: k for k, i in enumerate(ids.tolist())}, {}
        for i, _, token in rows:
            holders.setdefault(token, []).append(place[i])
        n_query = np.array([sizes[i] for i in ids.tolist()], np.int64)

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = pa.array(sorted(holders), pa.string())
            for batch in batches:
                yield batch.filter(pc.is_in(batch.column("token"), words))

        def count(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            at = table.column("docs").combine_chunks()
            own, code = np.unique(at.flatten().to_numpy(), return_inverse=True)
            bounds = at.offsets.to_numpy()
            bounds = bounds - bounds[0]
            out: list[list[np.ndarray]] = [[], [], []]
            by_query: dict[int, list[int]] = {}
            for row, token in enumerate(table.column("token").to_pylist()):
                for k in holders[token]:
                    by_query.setdefault(k, []).append(row)
            for k, its in by_query.items():
                overlap = np.bincount(np.concatenate([code[bounds[r] : bounds[r + 1]] for r in its]), minlength=len(own))
                some = np.flatnonzero(overlap)
                best = some[np.lexsort((own[some], -overlap[some]))[:limit]]
                for column, value in zip(out, (np.full(len(best), k), own[best], overlap[best]), strict=True):
                    column.append(value)
            k, docs, overlap = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
            return pa.table({query_id: ids[k], "n_query": n_query[k], "doc_id": docs, "overlap": overlap.astype(np.int64)})

        if len(holders) <= 1000:
            lists = lists.where(F.col("token").isin(sorted(holders)))  # reaches the files' statistics
        lists = lists.select("shop", "part", "token", "docs").mapInArrow(known, "shop string, part int, token string, docs array<long>")
        found = lists.groupBy("shop", "part").applyInArrow(count, f"{query_id} long, n_query long, doc_id long, overlap long")
    # A document that is in several shops counts where it shares most.
    found = ranked(found, [query_id, "doc_id"], [F.col("overlap").desc()], 1, "_n").drop("_n")
    best = ranked(found, [query_id], [F.col("overlap").desc(), "doc_id"], limit)
    return best.withColumn("score", F.col("overlap") / F.col("n_query"))
