"""Places for tables that a job writes for itself or others."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share, ``spark.checkpoint.dir``. A
    local master without one gets a temporary folder; a cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on any file system that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
