"""A bounded, deterministic sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """Rows never learned from: crc32 of the id as text leaves remainder 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn: Column | None = None) -> DataFrame:
    """(doc_id, y, text) of at most ``per_class`` labelled documents of either class, those of least hash.

    The ids are chosen from the labels alone; at most 2 * per_class rows, whatever
    the corpus, are broadcast to the scan of the documents.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    order = [F.xxhash64(F.lit(23), "doc_id"), "doc_id"]
    chosen = known.where("y = 1").orderBy(*order).limit(per_class).union(known.where("y = 0").orderBy(*order).limit(per_class))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id")
    # Rows that repeat an id would exceed the bound.
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
