"""Training-data pipeline: from raw documents to packed sequences.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and
returns a DataFrame. Its result is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import linejoin, minhash, mixing, packing, quality
from logstrata.llm.registry import vocabulary_path
from logstrata.scratch import forget, materialize, passing

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier place has, exactly or nearly; n_chars follows the text."""
    return linejoin.apply(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's weight draws them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in which sequence."""
    return packing.pack(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Tokenising and hashing stages are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; scratch tables and the results of earlier stages are deleted when nothing reads them any more."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with passing(spark) as scratch:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            scratch.pop()
        if written is not None:
            forget(written)
        written = docs
    return docs
