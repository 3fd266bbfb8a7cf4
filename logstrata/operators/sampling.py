"""Bounded samples in source order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.scratch import with_rank

# Most records and characters of a sample, and the defaults.
MAX_RECORDS, MAX_CHARS, RECORDS, CHARS = 100, 20_000, 10, 8000


def head_tail(ranked: DataFrame, total: int, count: int) -> DataFrame:
    """The first half of ``count`` (the larger one) and the last."""
    front = -(-count // 2)
    return ranked.where((F.col("rank") < front) | (F.col("rank") >= total - count // 2))


def positions(total: int, count: int) -> list[int]:
    """Evenly spaced positions from the first to the last."""
    if count >= total:
        return list(range(total))
    return [0] if count == 1 else sorted({i * (total - 1) // (count - 1) for i in range(count)})


def uniform(ranked: DataFrame, total: int, count: int) -> DataFrame:
    return ranked.where(F.col("rank").isin(*positions(total, count)))


def char_budget(sample: DataFrame, order: str, chars: int) -> DataFrame:
    """Records until ``chars`` are used up: the one that crosses is clipped, those after it are withheld.

    ``sample`` has at most MAX_RECORDS rows, so one window over it is bounded.
    """
    before = F.coalesce(F.sum(F.length("text")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = sample.withColumn("_left", F.lit(chars) - before).withColumn("_size", F.length("text"))
    state = F.when(F.col("_left") <= 0, "withheld").when(F.col("_size") > F.col("_left"), "clipped").otherwise("whole")
    shown = F.when(F.col("_left") > 0, F.expr("substring(text, 1, cast(_left as int))"))
    omitted = F.col("_size") - F.coalesce(F.length(shown), F.lit(0))
    return left.withColumns({"state": state, "shown": shown, "omitted_chars": omitted.cast("long")}).drop("_left", "_size")


def sample(records: DataFrame, order: list[Column], strategy: str = "head-tail", count: int = RECORDS, chars: int = CHARS) -> DataFrame:
    """At most ``count`` records and ``chars`` characters, with what was left out."""
    if not 1 <= count <= MAX_RECORDS or not 1 <= chars <= MAX_CHARS or strategy not in ("head-tail", "uniform"):
        raise ValueError("a sample is head-tail or uniform, of at most 100 records and 20000 characters")
    ranked = with_rank(records, order)
    total = ranked.count()
    picked = head_tail(ranked, total, count) if strategy == "head-tail" else uniform(ranked, total, count)
    return char_budget(picked, "rank", chars)
