"""Rule suites: every rule gives rows (rule, subject) of what breaks it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A row check: ``broken`` true names the row; null counts as whole."""

    rule: str
    broken: Column


def row_issues(df: DataFrame, subject: str, checks: list[Check]) -> DataFrame:
    """All checks in one pass over ``df``."""
    found = F.array_compact(F.array(*(F.when(c.broken, F.lit(c.rule)) for c in checks)))
    return df.select(F.explode(found).alias("rule"), F.col(subject).cast("string").alias("subject"))


def duplicate_issues(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1")
    return twice.select(F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("subject"))


def orphan_issues(df: DataFrame, rule: str, key: str, parents: DataFrame, parent_key: str, subject: str) -> DataFrame:
    """Rows whose key no parent has; a null key is no orphan."""
    out = df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")
    return out.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def changed_issues(left: DataFrame, right: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """Keys that one side lacks, and columns in which both differ (null equals null)."""
    r = right.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_r"))
    both = left.withColumn("_l", F.lit(True)).join(r, F.col(key) == F.col("_k"), "full_outer")
    there = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    checks = [Check(f"{prefix}_missing_right", F.col("_r").isNull()), Check(f"{prefix}_missing_left", F.col("_l").isNull())]
    checks += [Check(f"{prefix}_{c}_changed", there & ~F.col(c).eqNullSafe(F.col(f"_{c}"))) for c in columns]
    return row_issues(both.withColumn("_s", F.coalesce(F.col(key), F.col("_k"))), "_s", checks)


def suite(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def readiness(issues: DataFrame, rules: list[str]) -> DataFrame:
    """Each rule with its number of issues, and whether it is ready: only without any."""
    spark = issues.sparkSession
    every = spark.createDataFrame([(r,) for r in rules], "rule string")
    counts = issues.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    out = every.join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("issues"))
    return out.withColumn("ready", F.col("issues") == 0)
