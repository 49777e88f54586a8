"""What several operators share: words, the shared folder, bounded samples."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space between words: a blank, and the five control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each lengthened until no column of ``df`` has the name in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it. Where it is unset a temporary folder stands in
    on a local master, noted in the session so that it is one for the session; on a cluster, where
    executors would each write to a disk of their own, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here, and a
    lost executor costs a reread, not a recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote; only for tables that no returned frame reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def crc32_bytes(value: Column) -> Column:
    return F.crc32(value.cast("binary"))


#: Rows that one range of ``with_neighbours`` holds, about; and the most ranges.
RANGE_ROWS, MOST_RANGES = 20_000, 20_000


def with_neighbours(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``prev`` and ``next``: structs of ``columns`` of the rows before and after in ``order``.

    Rows are cut into sorted ranges of bounded size, however frequent a key is; windows work inside
    a range, and a table of each range's first and last row, ``MOST_RANGES`` rows at most, joins
    the ends. Null at either end of the whole. ``order`` should be unique, or ties are arbitrary.
    """
    ranges = min(df.count() // RANGE_ROWS + 1, MOST_RANGES)
    rows = stored(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside, own = W.partitionBy("_range").orderBy(*order), F.struct(*columns)
    out = rows.withColumn("prev", F.lag(own).over(inside)).withColumn("next", F.lead(own).over(inside))
    key = F.struct(*order)
    ends = rows.groupBy("_range").agg(F.min_by(own, key).alias("_first"), F.max_by(own, key).alias("_last"))
    over = W.orderBy("_range")
    ends = ends.select("_range", F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    out = out.join(F.broadcast(ends), "_range")
    out = out.withColumn("prev", F.coalesce("prev", "_before")).withColumn("next", F.coalesce("next", "_after"))
    return out.drop("_range", "_before", "_after")
