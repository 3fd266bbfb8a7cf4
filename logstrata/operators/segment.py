"""Records from lines.

A record is (source_id, rec_no from 1, start_line, end_line, text, ts, fields).
Rules that begin a record at certain lines are running sums over a source's
lines; only brace continuation needs state and runs as a grouped function.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.functions import times
from logstrata.functions.patterns import check, group_names, java_group, to_java
from logstrata.functions.text import TOKEN

# Key names tried in order, and the share of lines that makes a source JSON lines.
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "datetime", "eventTime")
LEVEL_KEYS = ("level", "lvl", "severity")
MESSAGE_KEYS = ("msg", "message", "content", "text")
MESSAGE_CHARS, DETECT_LINES, DETECT_SHARE = 200, 200, 0.5
JSON_LAYOUTS = ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S")


def no_fields() -> Column:
    return F.lit(None).cast("map<string,string>")


#: Lines of a source that are counted in one task; a source of any length is as many tasks as it has such runs.
RUN = 1 << 16


def running(rows: DataFrame, value: Column, line: str, name: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` in each source's order of ``line``: summed within runs of lines, each starting where the runs before it end."""
    marked = rows.withColumn("_run", F.floor((F.col(line) - 1) / RUN))
    totals = marked.groupBy("source_id", "_run").agg(F.sum(value).alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy("source_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("source_id", "_run", before.alias("_start"))
    within = F.sum(value).over(Window.partitionBy("source_id", "_run").orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_within", within).join(starts, ["source_id", "_run"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_run", "_within", "_start")


def _number(records: DataFrame) -> DataFrame:
    numbered = running(records, F.lit(1), "start_line", "rec_no")
    return numbered.select("source_id", F.col("rec_no").cast("long").alias("rec_no"), "start_line", "end_line", "text", "ts", "fields")


def _plain() -> list[Column]:
    return [F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("text"), F.lit(None).cast("timestamp_ntz").alias("ts"), no_fields().alias("fields")]


def by_line(lines: DataFrame) -> DataFrame:
    """Every line, blank ones too; its number is the record's, so nothing is shuffled."""
    return lines.select("source_id", F.col("line_no").alias("rec_no"), *_plain())


def _grouped(lines: DataFrame, group: str) -> DataFrame:
    """Lines of a group as one text, in order."""
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    grouped = lines.groupBy("source_id", group).agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))
    return grouped.withColumns({"ts": F.lit(None).cast("timestamp_ntz"), "fields": no_fields()})


def by_paragraph(lines: DataFrame) -> DataFrame:
    """Blank lines separate records and belong to none."""
    blank = F.trim(F.regexp_replace("line", r"\s", " ")) == ""
    marked = running(lines, blank.cast("int"), "line_no", "_group").where(~blank)
    return _number(_grouped(marked, "_group"))


def by_window(lines: DataFrame, size: int = 50) -> DataFrame:
    """Records of ``size`` lines."""
    grouped = _grouped(lines.withColumn("_group", F.floor((F.col("line_no") - 1) / size)), "_group")
    return grouped.select("source_id", (F.col("_group") + 1).cast("long").alias("rec_no"), "start_line", "end_line", "text", "ts", "fields")


def _anchored(pattern: str, ignore_case: bool = False) -> str:
    java = to_java(check(pattern))
    return f"{'(?i)' if ignore_case else ''}^(?:{java})"


def by_separator(lines: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """A line whose start matches begins a record; lines before the first form one of their own."""
    begins = F.col("line").rlike(_anchored(pattern, ignore_case))
    return _number(_grouped(running(lines, begins.cast("int"), "line_no", "_group"), "_group"))


def by_json(lines: DataFrame, time_field: str | None = None, level_field: str | None = None, message_field: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped, other lines kept with ``parse_error``.

    The first key that is present decides, even if its value is null.
    """
    kept = lines.where(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    body = F.trim("line")
    is_object = F.is_variant_null(F.try_parse_json(body)).isNotNull() & body.startswith("{")
    present = F.when(is_object, F.json_object_keys(body))

    def first(keys: tuple[str, ...]) -> tuple[Column, Column]:
        """(raw JSON value, whether it is text) of the first key present."""
        value, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
        for key in reversed(keys):
            raw = F.try_variant_get(F.try_parse_json(body), _path(key), "string")
            value = F.when(F.array_contains(present, key), raw).otherwise(value)
            kind = F.when(F.array_contains(present, key), F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), _path(key), "variant"))).otherwise(kind)
        return value, kind

    when, kind = first((time_field,) if time_field else TIME_KEYS)
    level, _ = first((level_field,) if level_field else LEVEL_KEYS)
    message, _ = first((message_field,) if message_field else MESSAGE_KEYS)
    numeric = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    ts = F.when(kind == "STRING", F.coalesce(times.iso(when), times.parse(when, JSON_LAYOUTS))).when(numeric, times.epoch(when.try_cast("double")))
    bad_time = when.isNotNull() & ts.isNull()
    parts = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(~F.coalesce(is_object, F.lit(False)), F.struct(F.lit("parse_error").alias("k"), F.lit("not a JSON object").alias("v"))),
                F.when(~F.coalesce(is_object, F.lit(False)), F.struct(F.lit("raw_fallback").alias("k"), F.lit("true").alias("v"))),
                F.when(bad_time, F.struct(F.lit("timestamp_parse_error").alias("k"), F.substring(when, 1, 160).alias("v"))),
                F.when(level.isNotNull(), F.struct(F.lit("level").alias("k"), level.alias("v"))),
                F.when(message.isNotNull(), F.struct(F.lit("msg").alias("k"), F.substring(message, 1, MESSAGE_CHARS).alias("v"))),
            )
        )
    )
    found = kept.select("source_id", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("text"), ts.alias("ts"), parts.alias("fields"))
    return _number(found)


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


@dataclass(frozen=True)
class Format:
    """A declared layout: where records start, how their time reads, what continues them."""

    start: str
    layouts: tuple[str, ...] = ()
    multiline: bool = True
    unclosed_start: bool = False
    max_lines: int = 200
    header_strip: str | None = None
    token: str | None = None
    normalizers: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Hooks:
    """What a layout says about its records' texts: the header of each line, what a token is, tags of its own."""

    header: str | None = None
    token: str = TOKEN
    normalizers: tuple[tuple[str, str], ...] = ()


def hooks(spec: Any) -> Hooks:
    """The hooks of an inline description; names and lists of layouts have none."""
    if not isinstance(spec, dict):
        return Hooks()
    rules = tuple((to_java(check(p)), tag) for p, tag in spec.get("normalizers") or ())
    return Hooks(to_java(check(spec["header_strip"])) if spec.get("header_strip") else None, to_java(check(spec["token"])) if spec.get("token") else TOKEN, rules)


def balance(text: str, stack: str = "") -> str:
    """Openers that are still open, innermost last; closers that close nothing are passed over."""
    pairs = {")": "(", "]": "[", "}": "{"}
    for ch in re.findall(r"[()\[\]{}]", text):
        if ch in pairs.values():
            stack += ch
        elif stack.endswith(pairs[ch]):
            stack = stack[:-1]
    return stack


def by_format(lines: DataFrame, layout: Format) -> DataFrame:
    """Records that ``start`` begins; named groups become fields, the group ``ts`` the time."""
    start = _anchored(layout.start)
    begins = F.col("line").rlike(start)
    if layout.unclosed_start:
        marked = lines.withColumn("_begins", begins).groupBy("source_id").applyInPandas(lambda frame: _continued(frame, layout.max_lines), "source_id string, line_no long, line string, _begins boolean, _group long")
    elif layout.multiline:
        marked = running(lines, begins.cast("long"), "line_no", "_group")
    else:
        marked = lines.withColumn("_group", F.col("line_no"))
    grouped = _grouped(marked, "_group")
    first = F.get(F.split("text", "\n"), 0)
    names = group_names(layout.start)
    hit = first.rlike(start)
    entries = []
    for name in names:
        value = F.regexp_extract(first, start, _group_index(layout.start, name))
        entries.append(F.struct(F.lit(name).alias("k"), value.alias("v")))
    others = [e for e, n in zip(entries, names, strict=True) if n != "ts"]
    fields = F.when(hit, F.map_from_entries(F.array(*others))) if others else no_fields()
    ts = F.lit(None).cast("timestamp_ntz")
    if "ts" in names and layout.layouts:
        ts = F.when(hit, times.parse(F.regexp_extract(first, start, _group_index(layout.start, "ts")), layout.layouts))
    return _number(grouped.withColumns({"ts": ts, "fields": fields}))


def _group_index(pattern: str, name: str) -> int:
    return re.compile(pattern).groupindex[name]


def _continued(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """A start line within an open bracket of the record before continues it, up to ``most`` lines."""
    frame = frame.sort_values("line_no").reset_index(drop=True)
    group, size, stack, groups = 0, 0, "", []
    for line, begins in zip(frame["line"], frame["_begins"], strict=True):
        if begins and not (stack and size < most):
            group, size, stack = group + 1, 0, ""
        groups.append(group)
        size, stack = size + 1, balance(line, stack)
    return frame.assign(_group=groups, source_id=frame["source_id"].astype(str))


Builder = Callable[[DataFrame, dict[str, Any]], DataFrame]
_BUILDERS: dict[str, Builder] = {
    "rawtext": lambda lines, spec: {"line": by_line, "paragraph": by_paragraph, "window": lambda x: by_window(x, int(spec.get("size", 50)))}[spec.get("mode", "line")](lines),
    "separator": lambda lines, spec: by_separator(lines, spec["pattern"], "i" in spec.get("flags", "")),
    "jsonline": lambda lines, spec: by_json(lines, spec.get("time_field"), spec.get("level_field"), spec.get("msg_field")),
    "format": lambda lines, spec: by_format(lines, Format(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items() if k not in ("type", "name")})),
}
# Other names of the kinds.
_ALIASES = {"text": "rawtext", "raw": "rawtext", "json": "jsonline", "jsonl": "jsonline", "regex": "separator"}


def register(name: str, builder: Builder) -> None:
    _BUILDERS[name] = builder


def segment(lines: DataFrame, spec: str | dict[str, Any] = "rawtext") -> DataFrame:
    """Records by a kind's name or an inline description."""
    options = {"type": spec} if isinstance(spec, str) else dict(spec)
    kind = options.get("type", "format" if "start" in options else "rawtext")
    kind = _ALIASES.get(kind, kind)
    if kind not in _BUILDERS:
        raise ValueError(f"no segmenter {kind!r}")
    return _BUILDERS[kind](lines, options)


def detect(lines: DataFrame) -> DataFrame:
    """(source_id, kind): JSON lines where at least half of the first lines are objects, else rawtext."""
    head = lines.where((F.trim("line") != "") & (F.col("line_no") <= DETECT_LINES))
    looks = F.try_parse_json(F.trim("line")).isNotNull() & F.trim("line").startswith("{")
    return head.groupBy("source_id").agg(F.when(F.avg(looks.cast("double")) >= DETECT_SHARE, "jsonline").otherwise("rawtext").alias("kind"))


__all__ = ["Format", "balance", "by_format", "by_json", "by_line", "by_paragraph", "by_separator", "by_window", "detect", "java_group", "register", "segment"]
