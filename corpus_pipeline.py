"""The corpus pipeline: stages on documents, each written as Parquet and read by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame. All
but the last return the columns of documents. Learned boundaries, the graph over fingerprints, the
sorted suffixes and the schedule of the mix have no SQL form, so ``ORACLE_SQL`` is None and the
stages are tested against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, pieces, simhash, suffix_dedup, toxicity
from millrace.llm.common import shared_path

ORACLE_SQL: str | None = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; null and empty texts stay."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, lexicon)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of every group of near duplicates."""
    return simhash.keep_one_of_each(docs, shingle=5, radius=4)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the strings of 50 bytes that a document with a smaller id has."""
    return suffix_dedup.without_repeats(docs, length=50)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each pass in which a document's words are taken."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the pieces of its text, and the text decoded from them."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeated_strings),
    ("source_mixing", mixed),
    ("piece_encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        place = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
