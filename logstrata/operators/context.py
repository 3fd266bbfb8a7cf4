"""Evidence pointers and the lines around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.functions.text import evidence_uri

# Most pointers of a result, and of an answer to an agent.
MAX_POINTERS, AGENT_POINTERS = 100, 30


def pointers(hits: DataFrame, digest: Column, limit: int = MAX_POINTERS) -> DataFrame:
    """The first hits in file order as evidence URIs."""
    found = hits.withColumn("uri", evidence_uri(digest, F.col("start_line"), F.col("end_line")))
    return found.orderBy("source_id", "start_line").limit(max(1, min(limit, MAX_POINTERS)))


def parse_uri(uri: Column) -> Column:
    """(digest, first, last) of a citable URI, else null."""
    pattern = r"^evidence://sha256/([0-9a-f]{64})#L([1-9]\d*)(?:-L([1-9]\d*))?$"
    first = F.regexp_extract(uri, pattern, 2).try_cast("long")
    last = F.coalesce(F.nullif(F.regexp_extract(uri, pattern, 3), F.lit("")).try_cast("long"), first)
    return F.when(uri.rlike(pattern) & (last >= first), F.struct(F.regexp_extract(uri, pattern, 1).alias("digest"), first.alias("first"), last.alias("last")))


def windows(marks: DataFrame, before: int, after: int) -> DataFrame:
    """Marks (source_id, start_line, end_line) as windows; overlapping or adjacent ones of a source become one."""
    spans = marks.select("source_id", F.greatest(F.lit(1), F.col("start_line") - before).cast("long").alias("lo"), (F.col("end_line") + after).cast("long").alias("hi"))
    in_order = Window.partitionBy("source_id").orderBy("lo", "hi")
    reach = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("_new", (reach.isNull() | (reach + 1 < F.col("lo"))).cast("int"))
    island = begun.withColumn("island", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("source_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("marks"))


def expand(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """The lines of windows, each rendered with its number; windows of a source are disjoint, so their line numbers join one to one."""
    wanted = spans.select("source_id", "island", F.explode(F.sequence("lo", "hi")).alias("line_no"))
    return lines.join(wanted, ["source_id", "line_no"]).select("source_id", "island", "line_no", F.concat(F.col("line_no").cast("string"), F.lit(": "), "line").alias("rendered"))


def within_budget(expanded: DataFrame, chars: int) -> DataFrame:
    """Rendered lines of each source's windows until ``chars`` (numbers included) are used up."""
    used = F.sum(F.length("rendered")).over(Window.partitionBy("source_id").orderBy("island", "line_no").rowsBetween(Window.unboundedPreceding, 0))
    return expanded.withColumn("_used", used).where(F.col("_used") <= chars).drop("_used")


def lookup(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Requested refs (whole URIs or their ``#L`` part) with the pointer found, or none."""
    keys = known.select("uri", F.explode(F.array("uri", F.concat(F.lit("#"), F.substring_index("uri", "#", -1)))).alias("ref"), "source_id", "start_line", "end_line")
    return refs.dropDuplicates(["ref"]).join(keys, "ref", "left").withColumn("missing", F.col("uri").isNull())


def without_repeats(rows: DataFrame, label: str, partition: list[str], order: list[Column]) -> DataFrame:
    """A label only where it differs from the one shown last."""
    previous = F.last(F.when(F.col(label) != "", F.col(label)), ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("shown_label", F.when(F.col(label) == previous, F.lit("")).otherwise(F.col(label)))
