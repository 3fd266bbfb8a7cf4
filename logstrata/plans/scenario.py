"""Scenarios: a checked document that becomes one plan over all its sources."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterable
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions import times
from logstrata.functions.patterns import Component, combine
from logstrata.operators import events as E
from logstrata.operators import filters
from logstrata.sources import lines as L
from logstrata.sources.registry import build_source, is_live, preprocess, with_charset
from logstrata.sources.sinks import write_events, write_json

from .layouts import segmented
from .runtime import Runtime
from .tools import envelope, file_entry

VERSION = 2
# The parts of a document and the fields of each.
FIELDS = {"schema_version", "name", "description", "source", "sources", "parse", "filter", "events", "assert", "actions", "analysis", "output"}
_SOURCE = {"type", "path", "glob", "recursive", "limit", "policy", "encoding", "preprocess", "label"}
_LIVE = {"type", "cmd", "output_path", "duration", "limit", "policy", "encoding", "preprocess", "label"}
_FILTER = {"grep", "preset", "scenario", "tag", "snapshot", "pid", "tail_lines", "line_from", "line_to", "last", "since", "until", "fold"}
_PARTS = {"filter": _FILTER | {"stages"}, "assert": {"scope", "ignore_case", "rules"}, "events": {"transforms"}, "output": {"run_dir", "reports", "pinned"}, "parse": {"segmenter"}}
_ACTION = {"name", "run", "required", "timeout", "outputs"}
SCOPES, POLICIES = ("aggregate", "per_source", "both"), ("all", "best_effort")
KINDS = ("contains", "count", "absent", "sequence", "before")
#: Share of lines that look like record starts and are not, from which on a run says so; lines looked at.
MISSED, LOOKED_AT = 0.2, 200
_STAMP = r"^(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"


class ScenarioError(ValueError):
    """A document that can't be run."""


def load(path: str) -> dict[str, Any]:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise ScenarioError("YAML needs a reader that is not installed") from error
        return yaml.safe_load(text)
    return json.loads(text)


def _known(part: str, given: Any, allowed: set[str]) -> None:
    if not isinstance(given, dict):
        raise ScenarioError(f"{part} must be an object")
    if unknown := sorted(set(given) - allowed):
        raise ScenarioError(f"unknown fields in {part}: {unknown}")


def sources_of(spec: dict[str, Any]) -> list[dict[str, Any]]:
    return spec.get("sources") or [spec["source"]]


def stages_of(spec: dict[str, Any]) -> list[dict[str, Any]]:
    """The filter's stages, each with the settings that it does not set itself taken from the filter."""
    whole = spec["filter"]
    base = {k: v for k, v in whole.items() if k != "stages"}
    return [base | stage for stage in whole.get("stages") or [{}]]


def rules_of(spec: dict[str, Any]) -> list[dict[str, Any]]:
    rules = (spec.get("assert") or {}).get("rules") or []
    return [rule | {"id": str(rule.get("name") or f"{rule['type']}-{i}")} for i, rule in enumerate(rules, 1)]


def validate(spec: dict[str, Any], runtime: Runtime = Runtime()) -> dict[str, Any]:
    """Known fields only, a name, sources, a filter, and rules of known kinds."""
    if not isinstance(spec, dict) or spec.get("schema_version") != VERSION:
        raise ScenarioError(f"schema_version must be {VERSION}")
    _known("the scenario", spec, FIELDS)
    if not str(spec.get("name") or "").strip() or not (spec.get("source") or spec.get("sources")):
        raise ScenarioError("a scenario needs a name and a source")
    for source in sources_of(spec):
        _known("source", source, _LIVE if is_live(source) else _SOURCE)
        if is_live(source):
            command = source.get("cmd")
            if not isinstance(command, list) or not command or not all(isinstance(c, str) and c for c in command):
                raise ScenarioError("a live source needs a list of arguments as cmd")
        elif not str(source.get("path") or "").strip():
            raise ScenarioError("a source needs a path")
        if source.get("policy", "all") not in POLICIES:
            raise ScenarioError(f"source policy is one of {POLICIES}")
    for part, allowed in _PARTS.items():
        if part in spec:
            _known(part, spec[part], allowed)
    if not isinstance(spec.get("filter"), dict):
        raise ScenarioError("a scenario needs a filter")
    for stage in spec["filter"].get("stages") or []:
        _known("a stage", stage, _FILTER | {"name"})
    for stage in stages_of(spec):
        if not any(stage.get(k) for k in ("grep", "preset", "scenario")):
            raise ScenarioError("a filter needs grep, preset or stages that have them")
        if stage.get("preset"):
            try:
                runtime.preset(stage["preset"])
            except ValueError as error:
                raise ScenarioError(str(error)) from error
        if stage.get("scenario") and runtime.resolver is None:
            raise ScenarioError("filter.scenario needs a resolver")
    asserts = spec.get("assert") or {}
    if asserts.get("scope", "aggregate") not in SCOPES:
        raise ScenarioError(f"assert.scope is one of {SCOPES}")
    for i, rule in enumerate(asserts.get("rules") or []):
        if not isinstance(rule, dict) or rule.get("type") not in (*KINDS, *runtime.assertions):
            raise ScenarioError(f"assertion {i} has no known type")
    for i, action in enumerate(spec.get("actions") or []):
        _known(f"action {i}", action, _ACTION)
        if not isinstance(action.get("run"), list) or not action["run"] or float(action.get("timeout", 300)) <= 0:
            raise ScenarioError(f"action {i} needs a list of arguments and a time limit above 0")
    return spec


def _granted(spec: dict[str, Any], runtime: Runtime) -> None:
    if any(map(is_live, sources_of(spec))) and not runtime.allow_live:
        raise ScenarioError("this runtime does not allow live sources")
    if spec.get("actions") and not runtime.allow_actions:
        raise ScenarioError("this runtime does not allow actions")


def explain(spec: dict[str, Any], runtime: Runtime = Runtime()) -> list[str]:
    """What a run would do, in order; names that the runtime does not know are errors."""
    validate(spec, runtime)
    steps = [f"read {s.get('type', 'file')} {s.get('path', s.get('cmd'))}" for s in sources_of(spec)]
    steps += [f"preprocess {p['action']}" for s in sources_of(spec) for p in s.get("preprocess") or []]
    steps.append(f"segment {((spec.get('parse') or {}).get('segmenter')) or 'auto'}")
    for stage in stages_of(spec):
        scope = ", ".join(f"{k} {stage[k]}" for k in ("since", "until", "last", "line_from", "line_to", "tail_lines", "pid") if stage.get(k) is not None)
        steps.append(f"filter {_pattern(stage, runtime)[0]}" + f" ({scope})" * bool(scope))
    steps += [f"assert {r['type']} {r['id']}" for r in rules_of(spec)]
    return steps + [f"run {a['run'][0]}" for a in spec.get("actions") or []] + [f"report {r}" for r in (spec.get("output") or {}).get("reports") or []]


def _pattern(stage: dict[str, Any], runtime: Runtime) -> tuple[str, tuple[Component, ...]]:
    parts = [Component(i, p, kind) for i, p, kind in (("grep", stage.get("grep"), "grep"), (f"preset:{stage.get('preset')}", runtime.preset(stage["preset"]) if stage.get("preset") else None, "preset")) if p]
    if stage.get("scenario"):
        # What a resolver answers takes the place of the other parts.
        parts = [Component(f"scenario:{stage['scenario']}", runtime.resolver(stage["scenario"]), "resolver")]
    return combine(*[p.pattern for p in parts]), tuple(parts)


def _moments(records: DataFrame, stage: dict[str, Any]) -> tuple[datetime | None, datetime | None]:
    since, until = stage.get("since"), stage.get("until")
    if since is None and until is None:
        return None, None
    first = records.where("ts is not null").agg(F.min_by("ts", F.struct("source_id", "start_line"))).first()[0] or datetime(1970, 1, 1)
    return (times.moment(since, first) if since else None), (times.moment(until, first) if until else None)


def filtered(records: DataFrame, stage: dict[str, Any], runtime: Runtime = Runtime()) -> DataFrame:
    """The records of a stage's scope with their match."""
    pattern, parts = _pattern(stage, runtime)
    since, until = _moments(records, stage)
    return filters.filter_text(records, pattern, parts, since=since, until=until, span=stage.get("last"), first_line=stage.get("line_from"), last_line=stage.get("line_to"), tail_lines=stage.get("tail_lines"), pid=stage.get("pid"))


def _match(rule: Any, ignore_case: bool) -> Any:
    if isinstance(rule, dict):
        return {k: [_match(v, ignore_case) for v in (value if isinstance(value, list) else [value])] for k, value in rule.items()}
    return f"(?i){rule}" if ignore_case else rule


def counted(found: DataFrame, rules: list[dict[str, Any]], by: Iterable[str] = (), ignore_case: bool = False, runtime: Runtime = Runtime()) -> list[dict[str, Any]]:
    """Per group of events the number that each rule's bounds are held against: counting rules in one aggregation, sequences one plan each."""
    by = list(by)
    columns = {}
    for i, rule in enumerate(rules):
        if rule["type"] == "contains":
            columns[str(i)] = F.sum(E.occurrences(F.coalesce("text", F.lit("")), _match(rule.get("match", rule.get("pattern", "")), ignore_case)))
        elif rule["type"] in ("count", "absent"):
            columns[str(i)] = F.count_if(E.event_matches(_match(rule.get("event", rule.get("match")), ignore_case)))
    grouped = found.groupBy(*by).agg(F.count("*").alias("_events"), *[c.alias(n) for n, c in columns.items()])
    rows = {tuple(r[b] for b in by): r.asDict() for r in grouped.toLocalIterator()}
    for i, rule in enumerate(rules):
        if rule["type"] in ("sequence", "before"):
            steps = rule.get("events") or rule.get("sequence") or rule.get("steps") or [rule.get("first"), rule.get("then")]
            within = times.duration(str(rule["within"])).total_seconds() if rule.get("within") is not None else None
            keyed = found if by else found.withColumn("_all", F.lit(1))
            hits = E.sequence(keyed, [E.event_matches(_match(s, ignore_case)) for s in steps], by or ["_all"], within)
            for row in rows.values():
                row[str(i)] = 0
            for hit in hits.toLocalIterator():
                rows[tuple(hit[b] for b in by)][str(i)] = 1
        elif rule["type"] in runtime.assertions:
            for key, row in rows.items():
                own = found
                for name, value in zip(by, key, strict=True):
                    own = own.where(F.col(name).eqNullSafe(F.lit(value)))
                row[str(i)] = runtime.assertions[rule["type"]](rule, own)
    return [{"group": dict(zip(by, key, strict=True)), "counts": {rules[i]["id"]: int(row.get(str(i)) or 0) for i in range(len(rules))}} for key, row in rows.items()]


def _judged(found: DataFrame, spec: dict[str, Any], names: list[str], runtime: Runtime) -> dict[str, Any]:
    """Assertions over all events, over each source's, or both."""
    asserts, rules = spec.get("assert") or {}, rules_of(spec)
    scope, ignore_case = asserts.get("scope", "aggregate"), bool(asserts.get("ignore_case", False))
    # A type that the runtime adds is held against bounds like a count.
    plain = [r | {"type": "count"} if r["type"] in runtime.assertions else r for r in rules]
    out: dict[str, Any] = {"satisfied": True, "missing": [], "rules": []}
    if scope in ("aggregate", "both"):
        out = E.verdict(plain, counted(found, rules, (), ignore_case, runtime)[0]["counts"])
    if scope in ("per_source", "both"):
        seen = {g["group"]["source"]: g["counts"] for g in counted(found, rules, ["source"], ignore_case, runtime)}
        each = [{"source": n} | E.verdict(plain, seen.get(n, {r["id"]: 0 for r in rules})) for n in names]
        out = out | {"per_source": each, "satisfied": out["satisfied"] and bool(each) and all(e["satisfied"] for e in each), "missing": sorted({*out["missing"], *(m for e in each for m in e["missing"])})}
    return out | {"scope": scope}


def self_check(lines: DataFrame, start: str) -> list[str]:
    """A warning if many of the first lines look like record starts and the rule does not know them."""
    head = lines.where(F.col("line_no") <= LOOKED_AT)
    looks = F.col("line").rlike(_STAMP)
    row = head.agg(F.count_if(looks).alias("like"), F.count_if(looks & ~E.regex_hit(F.col("line"), start)).alias("missed")).first()
    if row["missed"] and row["missed"] / row["like"] >= MISSED:
        return [f"{row['missed']} of {row['like']} lines that look like record starts are not taken as such"]
    return []


def act(actions: list[dict[str, Any]], folder: str, base: str = ".") -> list[dict[str, Any]]:
    """Commands without a shell; each must end well and make exactly the files that it declares."""
    out = []
    for i, action in enumerate(actions, 1):
        name = str(action.get("name") or f"action-{i}")
        own = Path(folder) / f"{i:02d}_{re.sub(r'[^A-Za-z0-9_.-]+', '_', name)}"
        own.mkdir(parents=True, exist_ok=True)
        entry: dict[str, Any] = {"name": name, "run": action["run"], "required": action.get("required", True), "error": None}
        with (own / "stdout.log").open("wb") as said, (own / "stderr.log").open("wb") as complained:
            try:
                done = subprocess.run(action["run"], stdout=said, stderr=complained, cwd=base, env=os.environ | {"LOGSTRATA_OUTPUT_DIR": str(own)}, timeout=float(action.get("timeout", 300)), check=False)
                entry["returncode"] = done.returncode
            except subprocess.TimeoutExpired:
                entry |= {"returncode": 124, "error": "time limit"}
            except OSError as error:
                entry |= {"returncode": -1, "error": str(error)}
        declared = {Path(o) for o in action.get("outputs") or []}
        made = {p.relative_to(own) for p in own.rglob("*") if p.is_file() and not p.is_symlink()} - {Path("stdout.log"), Path("stderr.log")}
        if any(o.is_absolute() or ".." in o.parts for o in declared):
            entry["error"] = "an output outside the action's folder"
        elif declared != made:
            entry["error"] = f"missing {sorted(map(str, declared - made))}, undeclared {sorted(map(str, made - declared))}"
        out.append(entry | {"outputs": sorted(map(str, made)), "satisfied": entry["returncode"] == 0 and entry["error"] is None})
    return out


def run(spark: SparkSession, spec: dict[str, Any], output: str | None = None, runtime: Runtime = Runtime()) -> dict[str, Any]:
    """Frozen sources, records, stages (each over the same records), events, assertions, actions, reports, manifest."""
    validate(spec, runtime)
    _granted(spec, runtime)
    rules, sources = rules_of(spec), sources_of(spec)
    frames, failed = [], []
    for source in sources:
        try:
            plain, steps = with_charset(source)
            frames.append(L.freeze(preprocess(build_source(spark, plain, allow_live=runtime.allow_live), steps)))
        except Exception as error:  # a source that fails is reported, and decides the verdict
            failed.append({"source": source.get("path"), "error": str(error)})
    if not frames or (failed and any(s.get("policy", "all") == "all" for s in sources)):
        return envelope("run", "error", data={"verdict": "incomplete", "failed_sources": failed})
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    asked = (spec.get("parse") or {}).get("segmenter") or "auto"
    records, kind = segmented(lines, asked)
    warnings = self_check(lines, asked["start"]) if isinstance(asked, dict) and "start" in asked else []
    stages = []
    for i, stage in enumerate(stages_of(spec), 1):
        scoped = filtered(records, stage, runtime)
        counts = filters.summary(scoped).agg(F.sum("scoped_records").alias("scoped"), F.sum("matched_records").alias("matched")).first()
        total, matched = int(counts["scoped"] or 0), int(counts["matched"] or 0)
        stages.append({"stage": stage.get("name") or f"stage-{i}", "tag": stage.get("tag"), "scoped_records": total, "matched_records": matched})
        ratio = F.lit((total - matched) / total if total else 0.0)
        warnings += [f"{stages[-1]['stage']}: {w}" for w in spark.range(1).select(filters.warnings(F.lit(matched), ratio)).first()[0]]
    found = E.project(filters.hits(scoped), F.col("source_id").cast("string"))
    names = sorted(str(r[0]) for r in lines.select("source_id").distinct().toLocalIterator())
    judged = _judged(found, spec, names, runtime)
    if not any(r.get("required", True) for r in rules):
        warnings.append("no required assertions")
    actions = act(spec.get("actions") or [], f"{output or '.'}/actions") if spec.get("actions") else []
    good = judged["satisfied"] and all(a["satisfied"] for a in actions if a["required"])
    verdict = "passed" if good else "failed"
    data = {"verdict": verdict, "assertions": judged, "failed_sources": failed, "scoped_records": stages[-1]["scoped_records"], "matched_records": stages[-1]["matched_records"], "stages": stages, "segmenter": kind, "actions": actions}
    if output:
        write_events(found, f"{output}/events")
        write_json(f"{output}/scenario.json", spec)
        wanted = (spec.get("output") or {}).get("reports") or []
        kinds = {"markdown": report} | dict(runtime.outputters)
        written = []
        for i, name in enumerate(wanted or ["markdown"]):
            kind_name = name.get("type") if isinstance(name, dict) else name
            if kind_name not in kinds:
                raise ScenarioError(f"no report of type {kind_name!r}")
            target = "report.md" if kind_name == "markdown" else f"report-{i + 1}-{re.sub(r'[^A-Za-z0-9_-]+', '_', kind_name)}.txt"
            Path(output, target).write_text(kinds[kind_name](spec["name"], data), encoding="utf-8")
            written.append(target)
        write_json(f"{output}/manifest.json", {"schema_version": 2, "name": spec["name"], "verdict": verdict, "files": [file_entry(f"{output}/{n}") for n in ("scenario.json", *written)]})
    outcome = "not_assessed" if not rules else "supported" if judged["satisfied"] else "contradicted"
    return envelope("run", "ok", outcome, warnings=warnings, data=data)


def report(name: str, data: dict[str, Any]) -> str:
    rows = "\n".join(f"| {r['id']} | {'yes' if r['satisfied'] else 'no'} | {r['count']} |" for r in data["assertions"]["rules"])
    return f"# {name}\n\nVerdict: {data['verdict']}. {data['matched_records']} of {data['scoped_records']} records matched.\n\n| rule | satisfied | count |\n| --- | --- | --- |\n{rows}\n"
