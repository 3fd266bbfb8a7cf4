"""Review state of knowledge: votes decide a status, time and review decide whether it may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: cases that must support a candidate at least.
MIN_CASES = 2


def status(votes: DataFrame, min_cases: int = MIN_CASES, allowed: int = 0) -> DataFrame:
    """Per candidate (votes: candidate, supports): contradicted beyond what is allowed, verified with enough support, else proposed."""
    counted = votes.groupBy("candidate").agg(F.count_if("supports").alias("support"), F.count_if(~F.col("supports")).alias("against"))
    state = F.when(F.col("against") > allowed, "contradicted").when(F.col("support") >= max(min_cases, MIN_CASES), "verified").otherwise("proposed")
    return counted.withColumn("status", state)


def validity(superseded: Column, promoted: Column, reviewed: Column, expires: Column, stale_from: Column, now: Column) -> Column:
    """The first reason not to use a candidate, else ``current``."""
    ladder = F.when(superseded, "superseded").when(~promoted, "not_promoted").when(~reviewed, "not_reviewed")
    return ladder.when(now >= expires, "expired").when(now >= stale_from, "stale").otherwise("current")


def usable(state: Column) -> Column:
    return state == "current"


def lineage(candidates: DataFrame) -> DataFrame:
    """(candidate, supersedes, superseded_by) by a self join."""
    older = candidates.select(F.col("supersedes").alias("candidate"), F.col("candidate").alias("superseded_by")).where("candidate is not null")
    return candidates.select("candidate", "supersedes").join(older, "candidate", "left")
