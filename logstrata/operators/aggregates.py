"""Counts and overviews of records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.functions import text as T

# Bounds of the overviews.
VALUE_MIN_COUNT, VALUES, POOL, TOKENS, SAMPLES_OF_A_KIND = 10, 5, 200, 10, 3
MAX_TEMPLATES, MAX_SAMPLES, MAX_MINUTES, MAX_LEVELS, TEMPLATE_CHARS = 500, 20, 60, 32, 500


def time_range(records: DataFrame, *by: str) -> DataFrame:
    """Records, those without a time, first and last time, share with a time."""
    return records.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_if(F.col("ts").isNull()).alias("unparsed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.count("ts") / F.count("*"), 6).alias("coverage")
    )


def minute_histogram(records: DataFrame, order: Column, limit: int | None = None) -> DataFrame:
    """Records per minute, most first; equal counts by first appearance."""
    counted = records.where("ts is not null").groupBy(T.minute(F.col("ts")).alias("minute")).agg(F.count("*").alias("records"), F.min(order).alias("first_seen"))
    ordered = counted.orderBy(F.desc("records"), "first_seen")
    return ordered.limit(limit) if limit else ordered


def level_histogram(records: DataFrame, level: Column) -> DataFrame:
    """Records per severity, most first, at most MAX_LEVELS."""
    return records.select(level.alias("level")).where("level is not null").groupBy("level").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "level").limit(MAX_LEVELS)


def top_terms(records: DataFrame, order: Column, exclude: tuple[str, ...] = (), min_count: int = 3, limit: int = 20, header: str | None = None, token: str = T.TOKEN) -> DataFrame:
    """Tokens by the number of records that hold them; equal counts by first appearance. Only the first 3 * limit are looked at."""
    found = records.select(order.alias("_order"), F.posexplode(T.tokens(F.col("text"), header, token)).alias("_pos", "token"))
    if exclude:
        found = found.where(~F.col("token").isin(*exclude))
    counted = found.groupBy("token").agg(F.count("*").alias("records"), F.min(F.struct("_order", "_pos")).alias("_first"))
    best = counted.orderBy(F.desc("records"), "_first").limit(3 * limit)
    return best.where(F.col("records") >= min_count).orderBy(F.desc("records"), "_first").limit(limit).select("token", "records")


def unmatched_samples(scoped: DataFrame, order: Column, top_token: str | None) -> DataFrame:
    """(kind, text): of the first POOL unmatched records, up to three that hold the top token and three of least SHA-256 among the rest."""
    pool = scoped.where(~F.col("matched")).select(order.alias("_order"), F.substring("text", 1, T.SAMPLE_CHARS).alias("text")).orderBy("_order").limit(POOL)
    pool = pool.withColumn("_has", F.coalesce(F.col("text").contains(top_token), F.lit(False)) if top_token else F.lit(False))
    # At most POOL rows are ranked here.
    placed = pool.withColumn("_rank", F.row_number().over(Window.partitionBy("_has").orderBy("_order")))
    frequent = F.col("_has") & (F.col("_rank") <= SAMPLES_OF_A_KIND)
    marked = placed.withColumn("kind", F.when(frequent, "high_freq").otherwise("random"))
    by_hash = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "random", F.sha2("text", 256)), "_order")
    return marked.withColumn("position", F.row_number().over(by_hash).cast("long")).where(F.col("position") <= SAMPLES_OF_A_KIND).select("kind", "position", "text")


def usage(hits: DataFrame, column: str, name: str) -> DataFrame:
    """Records per element of an array column."""
    return hits.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("records"))


def fold(hits: DataFrame, order: Column, normalizers: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Hits by template: count, terms, first time, and a sample.

    The sample is the first record's text, or that of the first later record
    which holds its own term.
    """
    keyed = hits.select(T.template(F.col("text"), normalizers).alias("template"), order.alias("_order"), "text", "term", "ts")
    own = F.col("term").isNotNull() & F.col("text").contains(F.col("term"))
    first = keyed.groupBy("template").agg(
        F.count("*").alias("records"),
        F.sort_array(F.collect_set("term")).alias("matched_terms"),
        F.min_by("ts", "_order").alias("first_seen"),
        F.min("_order").alias("_first"),
        F.min_by("text", "_order").alias("_sample"),
    )
    # The first record itself may hold its term; the one that replaces it must come later.
    later = keyed.join(first.select("template", "_first"), "template").where(own & (F.col("_order") > F.col("_first"))).groupBy("template").agg(F.min_by("text", "_order").alias("_better"))
    out = first.join(later, "template", "left")
    sample = F.substring(F.coalesce("_better", "_sample"), 1, T.SAMPLE_CHARS)
    return out.select("template", "records", "matched_terms", sample.alias("sample"), "first_seen", F.col("_first").alias("first_order"))


def fold_quality(templates: DataFrame) -> DataFrame:
    """How much folding gains: templates, folded records, singletons, share of records folded."""
    folded = F.sum(F.when(F.col("records") > 1, F.col("records")).otherwise(0))
    total = F.sum("records")
    return templates.agg(F.count("*").alias("templates"), folded.alias("folded_records"), F.count_if(F.col("records") == 1).alias("singletons"), F.round(folded / total, 4).alias("fold_ratio"))


def value_distribution(hits: DataFrame, order: Column, least: int = VALUE_MIN_COUNT, limit: int = VALUES) -> DataFrame:
    """Per frequent template and tag the most frequent raw values; equal counts by first appearance."""
    keyed = hits.select(T.template(F.col("text")).alias("template"), order.alias("_order"), T.values(F.col("text")).alias("_values"))
    often = keyed.groupBy("template").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("template")
    each = keyed.join(often, "template", "left_semi").select("template", "_order", F.posexplode("_values").alias("_pos", "_value"))
    counted = each.groupBy("template", F.col("_value.tag").alias("tag"), F.col("_value.value").alias("value")).agg(F.count("*").alias("n"), F.min(F.struct("_order", "_pos")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("template", "tag").orderBy(F.desc("n"), "_first"))
    return counted.withColumn("position", place.cast("long")).where(F.col("position") <= limit).select("template", "tag", "position", "value", "n")


def survey_templates(records: DataFrame, order: Column, limit: int = 20, normalizers: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The most frequent templates exactly, equal counts by template."""
    keyed = records.select(T.template(F.col("text"), normalizers).alias("template"), order.alias("_order"), "ts", "text")
    counted = keyed.groupBy("template").agg(F.count("*").alias("records"), F.min("_order").alias("first_order"), F.min_by("ts", "_order").alias("first_seen"), F.min_by(F.substring(F.trim("text"), 1, T.SAMPLE_CHARS), "_order").alias("sample"))
    best = counted.orderBy(F.desc("records"), "template").limit(min(limit, MAX_TEMPLATES))
    return best.withColumn("template", F.substring("template", 1, TEMPLATE_CHARS))


def template_samples(records: DataFrame, order: Column, templates: DataFrame, most: int = 3, normalizers: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(template, position, order, ts, sample): the first records of each of the few ``templates``; a limit per group is kept before rows are shuffled."""
    keyed = records.select(T.template(F.col("text"), normalizers).alias("template"), order.alias("order"), "ts", F.substring(F.trim("text"), 1, T.SAMPLE_CHARS).alias("sample"))
    few = keyed.join(F.broadcast(templates.select("template").limit(MAX_TEMPLATES)), "template", "left_semi")
    place = F.row_number().over(Window.partitionBy("template").orderBy("order"))
    return few.withColumn("position", place.cast("long")).where(F.col("position") <= min(most, MAX_SAMPLES)).select("template", "position", "order", "ts", "sample")


class SpaceSaving:
    """At most ``capacity`` counters; a new key takes over the least one, its count and the error that brings."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.errors, self.since, self.evicted = max(1, capacity), {}, {}, {}, 0
        self.heap: list[tuple[int, int, str]] = []
        self.clock = 0

    def _least(self) -> str:
        """The key of least count, the oldest of several; outdated entries of the heap are passed over."""
        while True:
            count, since, key = heappop(self.heap)
            if self.counts.get(key) == count and self.since[key] == since:
                return key

    def add(self, key: str) -> None:
        if key not in self.counts:
            start = 0
            if len(self.counts) >= self.capacity:
                victim = self._least()
                start = self.counts.pop(victim)
                self.errors.pop(victim)
                self.since.pop(victim)
                self.evicted += 1
            self.counts[key], self.errors[key], self.since[key] = start, start, self.clock
            self.clock += 1
        self.counts[key] += 1
        heappush(self.heap, (self.counts[key], self.since[key], key))
        if len(self.heap) > 8 * self.capacity + 64:
            self.heap = [(n, self.since[k], k) for k, n in self.counts.items()]
            heapify(self.heap)

    def rows(self) -> Iterator[tuple[str, int, int, int]]:
        """(key, count, least it can be, error), most first."""
        for key in sorted(self.counts, key=lambda k: (-self.counts[k], k)):
            yield key, self.counts[key], self.counts[key] - self.errors[key], self.errors[key]


def survey_sketch(records: DataFrame, order: str, capacity: int = MAX_TEMPLATES) -> DataFrame:
    """Bounded counts of templates per source, in the source's order: the sketch depends on it."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        sketch = SpaceSaving(capacity)
        for key in frame.sort_values(order)["template"]:
            sketch.add(key)
        rows = list(sketch.rows())
        out = pd.DataFrame(rows, columns=["template", "records", "count_lower_bound", "count_error"])
        out.insert(0, "source_id", str(frame["source_id"].iloc[0]))
        return out.assign(approximate=sketch.evicted > 0)

    keyed = records.select(F.col("source_id").cast("string").alias("source_id"), order, T.template(F.col("text")).alias("template"))
    return keyed.groupBy("source_id").applyInPandas(count, "source_id string, template string, records long, count_lower_bound long, count_error long, approximate boolean")


def probe(lines: DataFrame, sample: int = 1000) -> DataFrame:
    """Per source: lines, the 99th percentile of line length and JSON-like lines among the first ``sample``."""
    head = F.col("line_no") <= sample
    lengths = F.array_sort(F.collect_list(F.when(head, F.length("line"))))
    stripped = F.trim("line")
    objects = F.count_if(head & stripped.startswith("{") & stripped.endswith("}"))
    out = lines.groupBy("source_id").agg(F.count("*").alias("lines"), lengths.alias("_l"), objects.alias("json_like"))
    index = F.least(F.size("_l"), (F.floor(F.size("_l") * 0.99) + 1).cast("int"))
    return out.select("source_id", "lines", F.element_at("_l", index).alias("p99_length"), "json_like")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
