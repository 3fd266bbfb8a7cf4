"""Sets of row numbers as bits, so that rows are picked where they lie.

Numbers that ``monotonically_increasing_id`` gave are dense within a partition. A set
of them is a few 64-bit words a partition: one bit a row, at most, of the whole table.
The words are broadcast (a million rows take 125 KB), and rows that bring long texts
need no shuffle to meet the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.scratch import materialize

#: Bits of a row's place in its partition.
PLACE = 33


def marks_of(ids: DataFrame, label: str = "marks") -> DataFrame:
    """(part, words) of the numbers in the one column of ``ids``, written; they may repeat."""
    name = ids.columns[0]

    def words(table: pa.Table) -> pa.Table:
        own = table.column("id").to_numpy()
        place = own & ((1 << PLACE) - 1)
        bits = np.zeros((int(place.max()) // 64 + 1) * 64, np.uint8)
        bits[place] = 1
        held = np.packbits(bits, bitorder="little").view(np.int64)
        return pa.table({"part": pa.array([int(own[0]) >> PLACE]), "words": pa.array([held.tolist()], pa.list_(pa.int64()))})

    placed = ids.select(F.shiftright(F.col(name), PLACE).alias("part"), F.col(name).alias("id"))
    return materialize(placed.groupBy("part").applyInArrow(words, "part long, words array<long>"), label)


def with_mark(frame: DataFrame, marks: DataFrame, id_name: str, flag: str) -> DataFrame:
    """``frame`` and whether each row's number is in the set."""
    own = F.broadcast(marks.select(F.col("part").alias("_part"), F.col("words").alias("_words")))
    place = F.col(id_name).bitwiseAND(F.lit((1 << PLACE) - 1))
    word = F.get("_words", F.shiftright(place, 6).cast("int"))
    bit: Column = F.expr(f"shiftright(_word, cast({id_name} & 63 as int)) & 1")
    joined = frame.join(own, F.shiftright(F.col(id_name), PLACE) == F.col("_part"), "left")
    return joined.withColumn("_word", F.coalesce(word, F.lit(0).cast("long"))).withColumn(flag, bit == 1).drop("_part", "_words", "_word")


def picked(frame: DataFrame, marks: DataFrame, id_name: str = "id") -> DataFrame:
    """The rows whose numbers are in the set."""
    return with_mark(frame, marks, id_name, "_marked").where("_marked").drop("_marked")
