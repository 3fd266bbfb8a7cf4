"""Several sources in one order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.scratch import materialize


def merged(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Records (ts, ord, text) of labelled sources; those without a time first, then by time, source and place.

    Every line of a text is prefixed with its source's label.
    """
    parts = [
        frame.select(F.lit(i).alias("source_index"), F.lit(label).alias("label"), "ts", F.col("ord").cast("long").alias("ord"), F.regexp_replace("text", r"(?m)^", f"[{label}] ").alias("text"))
        for i, (label, frame) in enumerate(sources)
    ]
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("ts").asc_nulls_first(), "source_index", "ord")


def in_order(events: DataFrame) -> DataFrame:
    """Events with a time first, by time and id."""
    return events.orderBy(F.col("ts").asc_nulls_last(), "event_id")


def positions(ordered: DataFrame) -> DataFrame:
    """An ordered frame's rows with their position from 0: sorted partitions are numbered where they lie and start where those before them end."""
    numbered = materialize(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.join(F.broadcast(counts.select("_part", before.alias("_start"))), "_part").withColumn("position", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def by_kind(rows: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Timeline entries (at string, kind, id): stated times first, as text, then kind, then id."""
    rank: Column = F.lit(len(ranks))
    for kind, place in ranks.items():
        rank = F.when(F.col("kind") == kind, place).otherwise(rank)
    return rows.withColumn("kind_rank", rank).orderBy(F.col("at").isNull(), "at", "kind_rank", "id")
