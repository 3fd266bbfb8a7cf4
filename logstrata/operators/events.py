"""Events from hits, and assertions over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logstrata.functions import text as T
from logstrata.functions.patterns import PatternError, check, to_java

# How many ids an assertion lists.
LISTED = 20
COLUMNS = ["event_id", "ts", "category", "name", "source", "label", "attributes", "raw_ref", "parents", "transformations", "text"]


def project(hits: DataFrame, source: Column) -> DataFrame:
    """One event per hit."""
    name = F.coalesce("term", F.lit("pattern_match"))
    label = T.label(F.col("text"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    found = hits.select(
        T.event_id(stamp, F.lit("log_match"), name, source, F.col("start_line"), F.col("end_line")).alias("event_id"),
        F.col("ts"),
        F.lit("log_match").alias("category"),
        name.alias("name"),
        source.alias("source"),
        label.alias("label"),
        F.map_from_arrays(F.array(F.lit("terms"), F.lit("matched_by")), F.array(F.concat_ws(",", "terms"), F.concat_ws(",", "matched_by"))).alias("attributes"),
        F.struct(source.alias("source_path"), "start_line", "end_line").alias("raw_ref"),
        F.array().cast("array<string>").alias("parents"),
        F.array().cast("array<string>").alias("transformations"),
        F.col("text"),
    )
    return found


def transform(events: DataFrame, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build`` makes of the events (rows with a ``parent`` id), with the lineage extended."""
    made = build(events)
    parents = events.select(F.col("event_id").alias("parent"), F.col("parents").alias("_p"), F.col("transformations").alias("_t"), F.col("raw_ref").alias("_r"))
    joined = made.drop("parents", "transformations", "raw_ref").join(parents, "parent")
    return joined.withColumns({"parents": F.array_append("_p", F.col("parent")), "transformations": F.array_append("_t", F.lit(name)), "raw_ref": F.col("_r")}).select(*COLUMNS)


def regex_hit(text: Column, pattern: str) -> Column:
    """Regular expression search; a pattern that is refused is taken literally."""
    try:
        return F.coalesce(text.rlike(to_java(check(pattern))), F.lit(False))
    except PatternError:
        return F.coalesce(text.contains(pattern), F.lit(False))


def event_matches(rule: str | dict[str, Any]) -> Column:
    """A string searches category, name, label and text; a mapping is a conjunction over fields and attributes."""
    searched = T.search_text(F.col("category"), F.col("name"), F.col("label"), F.col("text"))
    if isinstance(rule, str):
        return regex_hit(searched, rule)
    parts = []
    for key, wanted in rule.items():
        column = searched if key == "match" else F.col("attributes")[key.removeprefix("attributes.")] if key.startswith("attributes.") else F.col(key)
        options = wanted if isinstance(wanted, list) else [wanted]
        parts.append(reduce(lambda a, b: a | b, [regex_hit(column, str(o)) for o in options]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def counts(events: DataFrame, rules: dict[str, Column], by: Iterable[str] = ()) -> DataFrame:
    """How many events satisfy each rule, all in one aggregation."""
    return events.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in rules.items()])


def verdict(rules: list[dict[str, Any]], found: dict[str, int]) -> dict[str, Any]:
    """Rules over counts: ``contains`` and ``count`` with exact, min and max, ``absent``; the package needs all required ones."""
    rows = []
    for rule in rules:
        kind, n = rule["type"], found[rule["id"]]
        if kind == "absent":
            good = n == 0
        elif kind in ("contains", "count", "sequence", "before"):
            low = rule.get("exact", rule.get("min", 1 if kind != "count" or "max" not in rule else 0))
            high = rule.get("exact", rule.get("max"))
            good = n >= low and (high is None or n <= high)
        else:
            raise ValueError(f"no assertion of type {kind!r}")
        rows.append({"id": rule["id"], "satisfied": good, "count": n, "required": rule.get("required", True)})
    missing = [r["id"] for r in rows if r["required"] and not r["satisfied"]]
    return {"satisfied": not missing, "missing": missing, "rules": rows}


def occurrences(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(to_java(check(pattern)))), F.lit(0))


def sequence(events: DataFrame, steps: list[Column], key: list[str], within: float | None = None) -> DataFrame:
    """Per key, the first start from which the steps follow one another, each at its earliest place after the one before.

    Right to left, each step's earliest completion from here on is one running
    minimum over the key's order; no group is gathered.
    """
    here = F.struct("ts", "event_id")
    after = Window.partitionBy(*key).orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    rows = events.where("ts is not null").select(*key, "ts", "event_id", *[s.alias(f"_s{i}") for i, s in enumerate(steps)])
    # chain: (this step, then the rest's end) of the earliest matching event after the row.
    end = F.col("ts")
    for i in range(len(steps) - 1, 0, -1):
        found = F.struct(F.col("ts").alias("t"), F.col("event_id").alias("e"), end.alias("end")) if i == len(steps) - 1 else F.struct(F.col("ts").alias("t"), F.col("event_id").alias("e"), F.col(f"_c{i + 1}.end").alias("end"))
        usable = F.col(f"_s{i}") if i == len(steps) - 1 else F.col(f"_s{i}") & F.col(f"_c{i + 1}").isNotNull()
        rows = rows.withColumn(f"_c{i}", F.min(F.when(usable, found)).over(after))
    last = F.col("_c1.end") if len(steps) > 1 else F.col("ts")
    starts = rows.where(F.col("_s0") & last.isNotNull()).select(*key, "ts", "event_id", last.alias("end_ts"))
    elapsed = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000
    starts = starts.withColumn("elapsed", elapsed)
    if within is not None:
        starts = starts.where((F.col("elapsed") >= 0) & (F.col("elapsed") <= within))
    return starts.groupBy(*key).agg(F.min(F.struct("ts", "event_id", "end_ts", "elapsed")).alias("_m")).select(*key, F.col("_m.ts").alias("start_ts"), F.col("_m.event_id").alias("start_id"), F.col("_m.end_ts").alias("end_ts"), F.col("_m.elapsed").alias("elapsed_sec"))


def behaviour(events: list[dict[str, Any]], steps: list[dict[str, Any]]) -> dict[str, Any]:
    """Steps over a bounded, ordered list of events with a cursor; ``within`` counts from the step matched before.

    A step that comes too late fails but moves the cursor on all the same.
    """
    cursor, previous, rows = 0, None, []
    for step in steps:
        want, found = step["match"], None
        for i in range(cursor, len(events)):
            event = events[i]
            plain = all(event.get(k) == want[k] for k in ("name", "category") if k in want)
            labelled = "label" not in want or want["label"] in (event.get("label") or "")
            if plain and labelled and all((event.get("attributes") or {}).get(k) == v for k, v in want.get("attributes", {}).items()):
                found = i
                break
        late = found is not None and previous is not None and "within" in step and not 0 <= (events[found]["ts"] - previous).total_seconds() <= step["within"]
        rows.append({"step": step.get("id"), "matched": found is not None and not late, "event": events[found].get("event_id") if found is not None else None})
        if found is not None:
            cursor, previous = found + 1, events[found]["ts"]
    return {"satisfied": all(r["matched"] for r in rows), "steps": rows}
