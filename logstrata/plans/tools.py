"""The verbs that people and agents call, each returning one result envelope.

A result says how the operation went (ok, no_match, partial, error), what it means
for a question (outcome), and points to evidence. Data stays in Spark; only
bounded parts, by the limits named here, come to the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions import text as T
from logstrata.functions import times
from logstrata.functions.patterns import PatternError, from_terms
from logstrata.operators import aggregates, compare, context, filters, sampling, segment
from logstrata.scratch import materialize
from logstrata.sources import lines as L
from logstrata.sources.registry import build_source

from . import probe as P
from .layouts import segmented

# Most characters of an agent's answer and of a line in it.
AGENT_CHARS, LINE_CHARS = 12_000, 1024


def envelope(operation: str, status: str, outcome: str = "not_assessed", **parts: Any) -> dict[str, Any]:
    return {"schema_version": 1, "operation": operation, "status": status, "outcome": outcome, "evidence": [], "coverage": {}, "warnings": [], "next_queries": [], "data": {}} | parts


def _source(spark: SparkSession, path: str, segmenter: str | dict[str, Any], glob: str, recursive: bool) -> tuple[DataFrame, DataFrame, Any]:
    lines = L.freeze(build_source(spark, {"type": "file", "path": path, "glob": glob, "recursive": recursive}))
    records, kind = segmented(lines, segmenter)
    return lines, records, kind


#: Lines that are digested together before the digests are.
RUN = 4096


def _digests(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Digest per source over its numbered lines, so that archive members have one too: of runs of lines first, then of their digests in order."""
    part = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    runs = lines.groupBy("source_id", F.floor((F.col("line_no") - 1) / RUN).alias("_run")).agg(F.sha2(F.array_join(F.transform(part, lambda p: p["line"]), "\n"), 256).alias("_digest"))
    digests = F.sort_array(F.collect_list(F.struct("_run", "_digest")))
    return runs.groupBy("source_id").agg(F.sha2(F.array_join(F.transform(digests, lambda p: p["_digest"]), "\n"), 256).alias("sha256"))


def _moments(records: DataFrame, since: str | None, until: str | None) -> tuple[datetime | None, datetime | None]:
    if since is None and until is None:
        return None, None
    first = records.where("ts is not null").agg(F.min("ts")).first()[0] or datetime(1970, 1, 1)
    return (times.moment(since, first) if since else None), (times.moment(until, first) if until else None)


def probe(spark: SparkSession, path: str, *, glob: str = "*", recursive: bool = False, segmenter: str = "auto") -> dict[str, Any]:
    """Size, kind, time range and line statistics per source."""
    lines, records, kind = _source(spark, path, segmenter, glob, recursive)
    stats = aggregates.probe(lines).join(aggregates.time_range(records, "source_id"), "source_id").join(_digests(spark, lines), "source_id")
    rows = [r.asDict() for r in stats.orderBy("source_id").limit(context.MAX_POINTERS).collect()]
    total = lines.select("source_id").distinct().count()
    return envelope("probe", "partial" if total > len(rows) else "ok", coverage={"sources": total, "shown": len(rows)}, data={"sources": rows, "segmenter": kind})


def search(spark: SparkSession, path: str, query: str, *, regex: bool = False, segmenter: str | dict[str, Any] = "auto", span: str | None = None, since: str | None = None, until: str | None = None, fold: bool = False, max_evidence: int = context.AGENT_POINTERS, max_line_chars: int = LINE_CHARS, glob: str = "*", recursive: bool = False) -> dict[str, Any]:
    """Records that match; the first of them as evidence. Nothing found is not proof of absence."""
    try:
        pattern = query if regex else from_terms([query])
        lines, records, kind = _source(spark, path, segmenter, glob, recursive)
        after, before = _moments(records, since, until)
        scoped = filters.filter_text(records, pattern, since=after, until=before, span=span)
    except (PatternError, times.TimeError, L.SourceError) as error:
        return envelope("search", "error", warnings=[str(error)])
    counts = filters.summary(scoped).agg(F.sum("scoped_records").alias("scoped"), F.sum("matched_records").alias("matched")).first()
    matched = int(counts["matched"] or 0)
    if not matched:
        tokens = [r["token"] for r in aggregates.top_terms(scoped, F.col("start_line"), min_count=1, limit=5, header=segment.hooks(kind).header, token=segment.hooks(kind).token).collect()]
        return envelope("search", "no_match", "unknown", coverage={"scoped_records": int(counts["scoped"] or 0)}, next_queries=tokens, data={"segmenter": kind})
    hits = filters.hits(scoped, max_line_chars).join(_digests(spark, lines), "source_id")
    shown = context.pointers(hits, F.col("sha256"), max_evidence)
    evidence = [r.asDict() for r in shown.select("uri", "source_id", "start_line", "end_line", "term", "text").collect()]
    data: dict[str, Any] = {"matched_records": matched, "segmenter": kind}
    if fold:
        folded = aggregates.fold(filters.hits(scoped), F.col("start_line"), segment.hooks(kind).normalizers).orderBy(F.desc("records"), "first_order").limit(20)
        data["templates"] = [r.asDict() for r in folded.collect()]
    status = "partial" if matched > len(evidence) else "ok"
    return fit(envelope("search", status, "supported", evidence=evidence, coverage={"scoped_records": int(counts["scoped"]), "matched_records": matched}, data=data))


def survey(spark: SparkSession, path: str, *, segmenter: str | dict[str, Any] = "auto", since: str | None = None, until: str | None = None, max_templates: int = 20, samples: int = 3, glob: str = "*", recursive: bool = False) -> dict[str, Any]:
    """Time coverage, severities, busiest minutes and commonest templates."""
    _, records, kind = _source(spark, path, segmenter, glob, recursive)
    after, before = _moments(records, since, until)
    scoped = records.where(filters.in_time(after, before))
    order = F.col("start_line")
    fields = [F.col("fields")[k] for k in segment.LEVEL_KEYS]
    rules = segment.hooks(kind).normalizers
    templates = materialize(aggregates.survey_templates(scoped, order, max_templates, rules), "survey")
    shown: dict[str, list[dict[str, Any]]] = {}
    for row in aggregates.template_samples(scoped, order, templates, samples, rules).orderBy("template", "position").collect():
        shown.setdefault(row["template"], []).append({"line": row["order"], "ts": row["ts"], "text": row["sample"]})
    data = {
        "range": aggregates.time_range(scoped).first().asDict(),
        "whole_range": aggregates.time_range(records).first().asDict(),
        "levels": [r.asDict() for r in aggregates.level_histogram(scoped, T.level(F.col("text"), *fields)).collect()],
        "minutes": [r.asDict() for r in aggregates.minute_histogram(scoped, order, aggregates.MAX_MINUTES).collect()],
        "templates": [r.asDict() | {"samples": shown.get(r["template"], [])} for r in templates.orderBy(F.desc("records"), "template").collect()],
        "segmenter": kind,
    }
    return envelope("survey", "ok", data=data)


def probe_format(spark: SparkSession, path: str) -> dict[str, Any]:
    lines = build_source(spark, {"type": "file", "path": path})
    return envelope("probe_format", "ok", data={k: asdict(r) for k, r in P.probe(lines).items()})


def sample(spark: SparkSession, path: str, *, strategy: str = "head-tail", count: int = sampling.RECORDS, max_chars: int = sampling.CHARS, segmenter: str | dict[str, Any] = "auto") -> dict[str, Any]:
    _, records, kind = _source(spark, path, segmenter, "*", False)
    picked = sampling.sample(records.select("source_id", "start_line", "end_line", "text"), [F.col("source_id"), F.col("start_line")], strategy, count, max_chars)
    rows = [r.asDict() for r in picked.orderBy("rank").collect()]
    left = {s: sum(r["state"] == s for r in rows) for s in ("whole", "clipped", "withheld")}
    return envelope("sample", "ok", coverage=left | {"omitted_chars": sum(r["omitted_chars"] for r in rows)}, data={"records": rows, "segmenter": kind})


peek = sample


def expand(spark: SparkSession, path: str, start_line: int, *, end_line: int | None = None, before: int = 3, after: int = 3, expected_sha256: str | None = None, max_chars: int = 20_000) -> dict[str, Any]:
    """The lines around a place; a source that changed since is refused."""
    lines = build_source(spark, {"type": "file", "path": path})
    if expected_sha256 and _digests(spark, lines).first()["sha256"] != expected_sha256:
        return envelope("expand", "error", warnings=["the source has changed"])
    if start_line < 1 or lines.where(F.col("line_no") >= start_line).isEmpty():
        return envelope("expand", "error", warnings=["no such line"])
    marks = lines.where(F.col("line_no") == start_line).select("source_id", F.col("line_no").alias("start_line"), F.lit(end_line or start_line).cast("long").alias("end_line"))
    shown = context.within_budget(context.expand(lines, context.windows(marks, before, after)), max_chars)
    return envelope("expand", "ok", data={"lines": [r["rendered"] for r in shown.orderBy("line_no").collect()]})


def expand_many(spark: SparkSession, result: dict[str, Any], path: str, refs: list[str], *, before: int = 3, after: int = 3, max_chars: int = 20_000) -> dict[str, Any]:
    """The lines around several pieces of a stored result's evidence; windows that touch are read once."""
    known = spark.createDataFrame([(e["uri"], e["source_id"], e["start_line"], e["end_line"]) for e in result["evidence"]], "uri string, source_id string, start_line long, end_line long")
    found = context.lookup(spark.createDataFrame([(r,) for r in refs], "ref string"), known)
    lines = build_source(spark, {"type": "file", "path": path})
    shown = context.within_budget(context.expand(lines, context.windows(found.where("not missing"), before, after)), max_chars)
    missing = [r["ref"] for r in found.where("missing").orderBy("ref").collect()]
    rows = [[r["source_id"], r["rendered"]] for r in shown.orderBy("source_id", "island", "line_no").collect()]
    return envelope("expand_many", "partial" if missing else "ok", data={"columns": ["source_id", "line"], "rows": rows, "missing": missing})


def verify(spark: SparkSession, manifest: dict[str, Any]) -> dict[str, Any]:
    """Listed files against what is there."""
    listed = spark.createDataFrame([(f["path"], f["size"], f["sha256"]) for f in manifest["files"]], "path string, size long, sha256 string")
    present = []
    for entry in manifest["files"]:
        try:
            present += L.resolve_paths(spark, entry["path"])
        except L.SourceError:
            continue
    actual = L.digests(spark, present) if present else listed.limit(0)
    states = compare.verify_files(listed, actual)
    rows = [r.asDict() for r in states.orderBy("path").collect()]
    good = all(r["state"] == "ok" for r in rows)
    return envelope("verify", "ok" if good else "error", "supported" if good else "contradicted", data={"files": rows})


def file_entry(path: str) -> dict[str, Any]:
    """A manifest entry of a local file."""
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as file:
        data = file.read()
    return {"path": path, "size": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def fit(result: dict[str, Any], chars: int = AGENT_CHARS) -> dict[str, Any]:
    """Evidence is dropped from the end until the answer fits; it is never cut within."""
    from logstrata.sources.sinks import canonical

    while result["evidence"] and len(canonical([{k: str(v) for k, v in e.items()} for e in result["evidence"]])) > chars:
        result["evidence"].pop()
        result["status"] = "partial"
    return result
