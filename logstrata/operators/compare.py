"""Differences and references between sets of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions import text as T


def changes(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer comparison: added, removed, changed (with the fields that differ) or same."""
    old = left.select(*keys, F.struct(*fields).alias("_old"))
    new = right.select(*keys, F.struct(*fields).alias("_new"))
    differing = F.array_compact(F.array(*[F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.lit(f)) for f in fields]))
    joined = old.join(new, keys, "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size(differing) > 0, "changed").otherwise("same")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    return joined.select(*keys, kind.alias("change"), F.when(both, F.array_join(differing, ",")).otherwise("").alias("fields"))


def transitions(left: DataFrame, right: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Entities on both sides whose status differs."""
    old, new = left.select(*keys, F.col(status).alias("was")), right.select(*keys, F.col(status).alias("now"))
    return old.join(new, keys).where(~F.col("was").eqNullSafe(F.col("now")))


def without(rows: DataFrame, others: DataFrame, on: Column | list[str]) -> DataFrame:
    """Rows that refer to nothing in ``others``."""
    return rows.join(others, on, "left_anti")


def having(rows: DataFrame, others: DataFrame, on: Column | list[str]) -> DataFrame:
    return rows.join(others, on, "left_semi")


def link_changes(left: DataFrame, right: DataFrame, source: str, target: str) -> DataFrame:
    """Links on either side: added, removed or kept."""
    old = left.select(source, target).distinct().withColumn("_old", F.lit(True))
    new = right.select(source, target).distinct().withColumn("_new", F.lit(True))
    joined = old.join(new, [source, target], "full_outer")
    return joined.select(source, target, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept").alias("change"))


def run_evidence(events: DataFrame, digests: DataFrame) -> DataFrame:
    """Events (event_id, source, first, last) with the URI that their source's digest (source, sha256) gives; without one they are not citable."""
    uri = T.evidence_uri(F.col("sha256"), F.col("first"), F.col("last"))
    return events.join(digests, "source", "left").select("event_id", "source", F.when(F.col("sha256").isNotNull(), uri).alias("uri"), F.col("sha256").isNotNull().alias("citable"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, size, sha256) before and after a run: same, modified, removed or added."""
    old, new = before.select("path", F.struct("size", "sha256").alias("_old")), after.select("path", F.struct("size", "sha256").alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("modified")
    return old.join(new, "path", "full_outer").select("path", state.alias("state"))


def ordered_union(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys, each where it came first."""
    return rows.groupBy(key).agg(F.min(order).alias("position"))


def verify_files(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest entries (path, size, sha256) against files: ok, modified or missing."""
    found = actual.select(_plain_path(F.col("path")).alias("_path"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    state = F.when(F.col("_sha").isNull(), "missing").when((F.col("_sha") == F.col("sha256")) & (F.col("_size") == F.col("size")), "ok").otherwise("modified")
    return listed.join(found, _plain_path(F.col("path")) == F.col("_path"), "left").select(*listed.columns, state.alias("state"))


def _plain_path(path: Column) -> Column:
    """Local paths are written with one slash or three after the scheme."""
    return F.regexp_replace(path, "^file:/+", "/")
