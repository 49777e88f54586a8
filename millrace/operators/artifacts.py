"""Content-addressed artifacts: rows, bundles on any file system that Spark reaches, verification."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import object_key


def artifact_rows(df: DataFrame, kinds: dict[str, str], tenant: str, shop: str, version: str) -> DataFrame:
    """A row per document and kind of artifact: object_key, kind, size, sha256 and content.

    ``kinds`` names the column that holds each kind's content, as text or bytes; null has no row."""
    made = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("binary").alias("content")) for kind, c in kinds.items()))
    rows = df.select(tenant, shop, version, F.explode(F.filter(made, lambda a: a["content"].isNotNull())).alias("a"))
    rows = rows.withColumn("sha256", F.sha2("a.content", 256))
    key = F.concat_ws("/", tenant, shop, version, "a.kind", "sha256")
    return rows.select(tenant, shop, version, key.alias("object_key"), F.col("a.kind").alias("kind"), F.octet_length("a.content").cast("long").alias("size"), "sha256", F.col("a.content").alias("content"))


def set_hash(rows: DataFrame, by: list[str]) -> DataFrame:
    """One hash for each bundle over its artifacts in order of kind, hash and size."""
    items = F.array_sort(F.collect_list(F.struct("kind", "sha256", "size")))
    line = F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["sha256"], x["size"])), "\n")
    return rows.groupBy(*by).agg(F.count("*").alias("artifacts"), F.sum("size").alias("bytes"), F.sha2(line, 256).alias("set_hash"))


def write_bundle(rows: DataFrame, root: str) -> None:
    """Artifacts and their manifest as tables below ``root``; an existing bundle is never changed.

    Spark's commit protocol makes each of the two whole or absent, and the manifest comes last."""
    rows.dropDuplicates(["object_key"]).write.mode("errorifexists").parquet(f"{root}/objects")
    rows.drop("content").dropDuplicates(["object_key"]).write.mode("errorifexists").parquet(f"{root}/manifest")


def verify_bundle(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """object_key and status of every object of either side: ok, missing, unlisted, wrong_size or
    wrong_hash; contents are hashed anew."""
    found = objects.select("object_key", F.octet_length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha"), F.lit(True).alias("_there"))
    both = manifest.select("object_key", "size", "sha256", F.lit(True).alias("_listed")).join(found, "object_key", "full_outer")
    status = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("_listed").isNull(), "unlisted").when(F.col("size") != F.col("_size"), "wrong_size")
        .when(F.col("sha256") != F.col("_sha"), "wrong_hash").otherwise("ok")
    )
    return both.select("object_key", status.alias("status"))


def public_addresses(df: DataFrame, column: str) -> DataFrame:
    """Adds ``blocked``: true unless the text is an address that is routable everywhere."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, blocked boolean"

    def routable(x: str | None) -> bool:
        try:
            return x is not None and ipaddress.ip_address(x).is_global
        except ValueError:
            return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocked = pa.array([not routable(x.as_py()) for x in batch.column(column)], pa.bool_())
            yield pa.record_batch([*batch.columns, blocked], [*batch.schema.names, "blocked"])

    return df.mapInArrow(run, schema)


def robots_allow(df: DataFrame, robots: str, agent: str, path: str) -> DataFrame:
    """Adds ``allowed``: whether no rule of ``robots`` bars ``path`` for ``agent``.

    Lines are folded in order: an agent line decides, by ``*`` or the whole name, whether the rules
    after it count, and a rule bars paths that begin with its value. Names and values are taken as
    they are, comments too; null or blank files and empty values bar nothing, a null path is allowed."""
    lines = F.transform(F.split(F.col(robots), "\r\n|[\r\n]"), lambda x: F.struct(F.lower(F.btrim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    start = F.struct(F.lit(False).alias("mine"), F.array().cast("array<string>").alias("barred"))

    def step(acc, x):
        mine = F.when(x["key"] == "user-agent", x["value"].isin("*", agent)).otherwise(acc["mine"])
        barred = F.when((x["key"] == "disallow") & acc["mine"] & (x["value"] != ""), F.array_append(acc["barred"], x["value"])).otherwise(acc["barred"])
        return F.struct(mine.alias("mine"), barred.alias("barred"))

    barred = F.aggregate(lines, start, step)["barred"]
    return df.withColumn("allowed", ~F.coalesce(F.exists(barred, lambda p: F.startswith(F.col(path), p)), F.lit(False)))


__all__ = ["artifact_rows", "object_key", "public_addresses", "robots_allow", "set_hash", "verify_bundle", "write_bundle"]
