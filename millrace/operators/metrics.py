"""Ranking metrics over rows of (query, item, relevance, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedupe_rankings(df: DataFrame, query: str, item: str, relevance: str, rank: str, position: str) -> DataFrame:
    """One row per query and item: the most relevant, then the best ranked, then the first."""
    order = W.partitionBy(query, item).orderBy(F.col(relevance).desc(), F.col(rank).asc_nulls_last(), F.col(position))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def gain_of(relevance, gain: str):
    """exp: 2 ** relevance - 1; linear: the relevance itself."""
    if gain not in ("exp", "linear"):
        raise ValueError("gain is exp or linear")
    return F.pow(F.lit(2.0), relevance) - 1 if gain == "exp" else relevance.cast("double")


def query_metrics(df: DataFrame, query: str, relevance: str, rank: str, ks: tuple[int, ...] = (1, 5, 10), gain: str = "exp", floor: float = 0.0, k: int | None = None) -> DataFrame:
    """Per query: hit_<k>, the reciprocal rank of the first relevant item (0 without one) and ndcg.

    ``rank`` is dense from 1. ``k`` cuts the ranking for reciprocal rank and ndcg, ``floor`` is the
    least ideal gain (a query without relevant items has ndcg 0)."""
    own = W.partitionBy(query)
    rel = F.coalesce(F.col(relevance).cast("double"), F.lit(0.0))
    rows = df.withColumn("_rel", rel).withColumn("_ideal", F.row_number().over(own.orderBy(F.desc("_rel"), F.col(rank))))
    cut = lambda place, x: F.when(place <= k, x).otherwise(0.0) if k else x
    rows = rows.withColumn("_got", cut(F.col(rank), gain_of(F.col("_rel"), gain) / F.log2(F.col(rank) + 1)))
    rows = rows.withColumn("_best", cut(F.col("_ideal"), gain_of(F.col("_rel"), gain) / F.log2(F.col("_ideal") + 1)))
    first = F.min(F.when((F.col("_rel") > 0) & (F.col(rank) <= k if k else F.lit(True)), F.col(rank)))
    hits = [F.max(F.when((F.col("_rel") > 0) & (F.col(rank) <= n), 1).otherwise(0)).alias(f"hit_{n}") for n in ks]
    out = rows.groupBy(query).agg(*hits, F.coalesce(1 / first, F.lit(0.0)).alias("rr"), F.sum("_got").alias("_got"), F.sum("_best").alias("_best"))
    ideal = F.greatest(F.col("_best"), F.lit(floor))
    return out.withColumn("ndcg", F.when(ideal > 0, F.col("_got") / ideal).otherwise(0.0)).drop("_got", "_best")


def mean_metrics(per_query: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """The means over all queries, to six digits; null metrics and count 0 without any."""
    means = [F.round(F.avg(f"hit_{n}"), 6).alias(f"recall_{n}") for n in ks]
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *means, F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
