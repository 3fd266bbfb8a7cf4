"""Filtering of records: scopes first, then the match, with provenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions import text as T
from logstrata.functions import times
from logstrata.functions.patterns import Component, Matcher, combine, vocabulary_hits


def in_lines(first: int | None = None, last: int | None = None) -> Column:
    """Records that overlap a range of lines."""
    out = F.lit(True)
    if first is not None:
        out = out & (F.col("end_line") >= first)
    if last is not None:
        out = out & (F.col("start_line") <= last)
    return out


def tail(records: DataFrame, lines: int) -> DataFrame:
    """Records that overlap the last ``lines`` lines of their source."""
    ends = records.groupBy("source_id").agg(F.max("end_line").alias("_last"))
    return records.join(ends, "source_id").where(F.col("end_line") >= F.col("_last") - lines + 1).drop("_last")


def in_time(since: datetime | None = None, until: datetime | None = None) -> Column:
    """Within both ends, inclusive; a record without a time always stays."""
    if since is not None and until is not None and since > until:
        raise times.TimeError("the window ends before it begins")
    inside = F.lit(True)
    if since is not None:
        inside = inside & (F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        inside = inside & (F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    return F.col("ts").isNull() | inside


def last(records: DataFrame, span: str) -> DataFrame:
    """Records of the last ``span`` before the last time that a source states (last by line, not by time)."""
    seconds = times.duration(span).total_seconds()
    anchor = records.where("ts is not null").groupBy("source_id").agg(F.max_by("ts", "start_line").alias("_anchor"))
    lower = F.col("_anchor") - F.make_dt_interval(secs=F.lit(seconds))
    return records.join(anchor, "source_id", "left").where(F.col("ts").isNull() | ((F.col("ts") >= lower) & (F.col("ts") <= F.col("_anchor")))).drop("_anchor")


def reference_time(records: DataFrame) -> DataFrame:
    """(source_id, reference): the first time stated in file order."""
    return records.where("ts is not null").groupBy("source_id").agg(F.min_by("ts", "start_line").alias("reference"))


def of_process(pid: str) -> Column:
    """``[pid]`` in the record's first line, or the field pid."""
    head = F.get(F.split("text", "\n"), 0)
    return F.coalesce(head.contains(f"[{pid}]"), F.lit(False)) | F.coalesce(F.col("fields")["pid"] == pid, F.lit(False))


def match(records: DataFrame, matcher: Matcher) -> DataFrame:
    """All records with ``matched``, the first term, all terms, matched_by and hit_lines."""
    text = F.col("text")
    if many := matcher.vocabulary():
        hits = records.withColumn("_hits", vocabulary_hits(text, many))
        found = hits.withColumns({"matched": F.size("_hits.terms") > 0, "term": F.col("_hits.first"), "terms": F.col("_hits.terms")}).drop("_hits")
    else:
        found = records.withColumns({"matched": matcher.matched(text), "term": matcher.first(text), "terms": matcher.all(text)})
    return found.withColumns({"matched_by": F.when(F.col("matched"), matcher.matched_by(text)), "hit_lines": F.when(F.col("term").isNotNull(), T.hit_lines(text, F.col("start_line"), F.col("term")))})


def filter_text(
    records: DataFrame,
    pattern: str,
    components: tuple[Component, ...] = (),
    *,
    since: datetime | None = None,
    until: datetime | None = None,
    span: str | None = None,
    first_line: int | None = None,
    last_line: int | None = None,
    tail_lines: int | None = None,
    pid: str | None = None,
) -> DataFrame:
    """Scoped records with their match; one plan for any number of sources."""
    scoped = records.where(in_lines(first_line, last_line))
    if tail_lines is not None:
        scoped = tail(scoped, tail_lines)
    if span is not None:
        scoped = last(scoped, span)
    scoped = scoped.where(in_time(since, until))
    if pid is not None:
        scoped = scoped.where(of_process(pid))
    return match(scoped, Matcher(pattern, components))


def hits(scoped: DataFrame, max_chars: int | None = None) -> DataFrame:
    found = scoped.where("matched").drop("matched")
    return found.withColumn("text", T.clip(F.col("text"), max_chars)) if max_chars else found


def summary(scoped: DataFrame) -> DataFrame:
    """Per source: scoped and matched records, those without a time, the ratio that did not match, and warnings."""
    total, matched = F.count("*"), F.count_if("matched")
    out = scoped.groupBy("source_id").agg(total.alias("scoped_records"), matched.alias("matched_records"), F.count_if(F.col("ts").isNull()).alias("without_time"))
    ratio = F.round((F.col("scoped_records") - F.col("matched_records")) / F.col("scoped_records"), 4)
    return out.withColumn("unmatched_ratio", ratio).withColumn("warnings", warnings(F.col("matched_records"), F.col("unmatched_ratio")))


def warnings(matched: Column, ratio: Column) -> Column:
    """Signs of a pattern that finds nothing, too much, or too little of what is there."""
    return F.array_compact(F.array(F.when(matched == 0, "no hits"), F.when(matched > 200, "many hits"), F.when(ratio > 0.9, "mostly unmatched")))


def presets(*groups: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """Named (pattern, tag); later groups win, an empty pattern is an error."""
    out = {k: v for g in groups for k, v in g.items()}
    for name, (pattern, _) in out.items():
        if not pattern.strip():
            raise ValueError(f"preset {name!r} has no pattern")
    return out


def resolve(pattern: str | None, preset: str | None, known: dict[str, tuple[str, str]]) -> tuple[str, tuple[Component, ...]]:
    """A pattern and a preset, either or both, with the provenance of each part."""
    parts = []
    if pattern:
        parts.append(Component("grep", pattern, "grep"))
    if preset:
        parts.append(Component(f"preset:{preset}", known[preset][0], "preset"))
    return combine(*[p.pattern for p in parts]), tuple(parts)
