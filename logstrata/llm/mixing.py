"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``r = target / source_size`` copies. The
expected copies are prefix-summed in (size, hash of doc_id, place read) order, one random
offset per source is added, and a document is emitted once for every integer
boundary that its stretch crosses. Because partial sums never differ from their
expectation by a whole copy and sizes ascend, a source's taken words differ from
its target by less than two of its largest documents.

The ranks come from one range shuffle of (source, size, id) rows plus prefix sums
of per-partition counts, so a source of any share is spread over all partitions.

Defined results: null or empty text has size 0 (it is copied like any other
document of its source but adds no words); a null source is a source of its own,
ordered last; a source without words has target 0 and yields no copies; repeated
rows are sampled one by one; an empty table gives an empty result; all input
columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.scratch import materialize, width

from .rowmarks import marks_of, with_mark

_SP = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    trimmed = F.regexp_replace(text, f"^[{_SP}]+", "")
    return F.coalesce(F.length(F.regexp_replace(trimmed, f"[^{_SP}]+[{_SP}]*", "x")), F.lit(0)).cast("long")


def _levels(sources: DataFrame, cap: float) -> tuple[float, float]:
    """(total words, words per unit of weight) with every target at most ``cap`` sizes: capped sources are taken out until none is above."""
    total, weight = sources.agg(F.sum("_s"), F.sum("_w")).first()
    if not total:
        return 0.0, 0.0
    level, before = total / weight, -1.0
    while level > before:
        before = level
        over = F.col("_w") * F.lit(level) > F.col("_s") * F.lit(cap)
        fixed, rest = sources.agg(F.sum(F.when(over, F.col("_s") * F.lit(cap)).otherwise(F.lit(0.0))), F.sum(F.when(over, F.lit(0)).otherwise(F.col("_w")))).first()
        if not rest:
            return float(total), float("inf")
        level = max(level, (total - fixed) / rest)
    return float(total), float(level)


def _base(docs: DataFrame, seed: int, keep: tuple[str, ...]) -> DataFrame:
    """Every row once, written: ``_doc`` (its columns named in ``keep``), a number, source key, size and hash; words are counted here alone."""
    key = F.when(F.col("source").isNotNull(), F.concat(F.lit("0"), F.col("source"))).otherwise(F.lit("1"))
    rows = docs.select(F.struct(*keep).alias("_doc"), key.alias("_key"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_h"), F.monotonically_increasing_id().alias("_row"))
    return materialize(rows, "mixing-documents")


def _drawn(base: DataFrame, weights: tuple[int, ...], cap: float, seed: int) -> DataFrame:
    """_row, size, source_size, target, copies: one row per row of ``base``."""
    order = ["_key", "size", "_h", "_row"]
    placed = base.select(*order).repartitionByRange(max(width(base.sparkSession), 1), *order).sortWithinPartitions(*order)
    placed = materialize(placed.drop("_h").withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "mixing")
    return _with_copies(placed, weights, cap, seed)


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """One row per input row: ``_doc`` (the row's columns named in ``keep``), size, source_size, target, copies."""
    base = _base(docs, seed, keep)
    return base.select("_doc", "_row").join(_drawn(base, weights, cap, seed), "_row").drop("_row")


def _with_copies(placed: DataFrame, weights: tuple[int, ...], cap: float, seed: int) -> DataFrame:
    segments = materialize(placed.groupBy("_pid", "_key").agg(F.count("*").alias("_n"), F.sum("size").alias("_sum"), F.min("_at").alias("_first")), "mixing-segments")
    own = segments.groupBy("_key").agg(F.sum("_sum").alias("_s"), F.min("_pid").alias("_home"))
    # The rank of a source: sources that begin in earlier partitions, then its place in its own.
    homes = own.groupBy("_home").agg(F.count("*").alias("_m")).withColumn("_base", F.sum("_m").over(Window.orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = own.join(homes.select("_home", F.coalesce("_base", F.lit(0)).alias("_base")), "_home")
    rank = F.col("_base") + F.row_number().over(Window.partitionBy("_home").orderBy("_key")) - 1
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(ranked.select("_key", "_s", pick.alias("_w")), "mixing-sources")
    _, level = _levels(sources, cap)
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("_key")), 11) / F.lit(float(1 << 53))
    targets = sources.select("_key", F.col("_s").alias("source_size"), F.least(F.col("_w") * F.lit(level), F.col("_s") * F.lit(float(cap))).cast("double").alias("target"), offset.alias("_u"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = segments.select("_pid", "_key", "_first", before.alias("_before")).join(targets, "_key")
    # A (partition, source) pair holds no more rows than a partition, so this join has no hot key.
    joined = placed.join(offsets, ["_pid", "_key"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    index = F.col("_before") + F.col("_at") - F.col("_first")
    copies = F.floor((index + 1) * rate + F.col("_u")) - F.floor(index * rate + F.col("_u"))
    return joined.select("_row", "size", "source_size", "target", F.least(copies, F.lit(int(cap))).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix: every row of ``docs`` as many times as it was drawn, with its own columns."""
    base = _base(docs, seed, ("*",))
    drawn = materialize(_drawn(base, weights, cap, seed).where("copies > 0").select("_row", "copies"), "mixing-copies")
    # The number of copies goes to the rows bit by bit, so no text is moved.
    rows, copies = base.select("_doc", "_row"), F.lit(0)
    for k in range(int(cap).bit_length()):
        marks = marks_of(drawn.where(F.col("copies").bitwiseAND(F.lit(1 << k)) != 0).select("_row"), "mixing-marks")
        rows = with_mark(rows, marks, "_row", f"_bit{k}")
        copies = copies + F.when(F.col(f"_bit{k}"), F.lit(1 << k)).otherwise(F.lit(0))
    return rows.select("_doc", F.explode(F.array_repeat(F.lit(1), copies))).select("_doc.*")
