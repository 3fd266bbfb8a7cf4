"""Investigations: a small document of hypotheses and evidence, and relational views of it.

The document is state of one person's work, bounded by its limits, and lives on
the driver; changes replace it atomically under a lock. ``tables`` gives its parts
as DataFrames, and summary, timeline and comparison are joins over those.
"""

from __future__ import annotations

import copy
import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.operators import compare, timeline
from logstrata.sources.sinks import canonical, locked, write_json

# Vocabularies and bounds of the document.
OUTCOMES = ("supported", "contradicted", "unknown", "not_assessed")
STOPS = ("completed", "resolved", "evidence_exhausted", "budget_exhausted", "budget_reached", "authorization_required", "new_authorization_needed", "input_missing", "blocked", "aborted")
LIMITS = ("max_operations", "max_bytes", "max_lines", "max_evidence", "max_chars", "max_seconds", "max_hypotheses")
KINDS = {"observation": 0, "hypothesis": 1, "test": 2, "execution": 3, "finding": 4, "candidate": 5, "stop": 6}
CACHE_ENTRIES, CACHE_ENTRY_BYTES, CACHE_BYTES = 100, 512 << 10, 4 << 20
ENTITIES = ("observations", "hypotheses", "tests", "executions", "findings", "candidates")


class InvestigationError(ValueError):
    """A change that the document's rules forbid."""


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds")


def create(problem: str, scope: dict[str, Any] | None = None, budget: dict[str, int] | None = None, by: str = "user") -> dict[str, Any]:
    if unknown := set(budget or {}) - set(LIMITS):
        raise InvestigationError(f"no budget limits {sorted(unknown)}")
    return {"schema_version": 1, "id": uuid.uuid4().hex, "revision": 1, "status": "open", "created_at": _now(), "created_by": by, "problem": problem, "scope": scope or {}, "budget": budget or {}, "usage": {}, "reserved": {}, "stop": None, **{e: [] for e in ENTITIES}}


def _add(state: dict[str, Any], kind: str, entry: dict[str, Any]) -> str:
    if state["status"] != "open":
        raise InvestigationError("the investigation is closed")
    entry = {"id": uuid.uuid4().hex, "at": _now()} | entry
    state[kind].append(entry)
    state["revision"] += 1
    return entry["id"]


def _one(state: dict[str, Any], kind: str, name: str) -> dict[str, Any]:
    for entry in state[kind]:
        if entry["id"] == name:
            return entry
    raise InvestigationError(f"no {kind} {name}")


def add_observation(state: dict[str, Any], text: str, evidence: list[str] | None = None) -> str:
    return _add(state, "observations", {"text": text, "evidence": evidence or []})


def add_hypothesis(state: dict[str, Any], claim: str) -> str:
    limit = state["budget"].get("max_hypotheses")
    if limit is not None and len(state["hypotheses"]) >= limit:
        raise InvestigationError("no more hypotheses within the budget")
    return _add(state, "hypotheses", {"claim": claim, "status": "open"})


def add_test(state: dict[str, Any], hypothesis: str, plan: str) -> str:
    if _one(state, "hypotheses", hypothesis)["status"] != "open":
        raise InvestigationError("the hypothesis is settled")
    return _add(state, "tests", {"hypothesis": hypothesis, "plan": plan})


def record_execution(state: dict[str, Any], operation: str, status: str, test: str | None = None, evidence: list[str] | None = None, flags: dict[str, bool] | None = None, usage: dict[str, int] | None = None) -> str:
    hypothesis = _one(state, "tests", test)["hypothesis"] if test else None
    for key, amount in (usage or {}).items():
        state["usage"][key] = state["usage"].get(key, 0) + amount
    return _add(state, "executions", {"operation": operation, "status": status, "test": test, "hypothesis": hypothesis, "evidence": evidence or [], "flags": flags or {}})


def attach_result(state: dict[str, Any], result: dict[str, Any], test: str | None = None) -> str:
    """A tool's result envelope as an execution: its evidence by URI, and what its coverage leaves open as flags."""
    coverage = result.get("coverage") or {}
    flags = {"partial": result["status"] == "partial", "no_match": result["status"] == "no_match", "omitted": bool(coverage.get("omitted") or coverage.get("withheld")), "warned": bool(result.get("warnings"))}
    evidence = [e["uri"] for e in result.get("evidence") or [] if e.get("uri")]
    return record_execution(state, result["operation"], result["status"], test, evidence, flags)


def recording_metrics(runs: DataFrame) -> DataFrame:
    """How much executions (operation, status, evidence, flags) record: runs, clean ones, pieces of evidence, and limits stated."""
    stated = F.size(F.filter(F.map_values("flags"), lambda x: x))
    return runs.groupBy("operation").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("clean"), F.sum(F.greatest(F.size("evidence"), F.lit(0))).alias("evidence"), F.sum(F.greatest(stated, F.lit(0))).alias("limits"))


def add_finding(state: dict[str, Any], hypothesis: str, outcome: str, tests: list[str], evidence: list[str]) -> str:
    """Settles a hypothesis: by tests, and with evidence if it is supported or contradicted."""
    if outcome not in OUTCOMES or not tests:
        raise InvestigationError("a finding needs an outcome and a test")
    if outcome in ("supported", "contradicted") and not evidence:
        raise InvestigationError("that outcome needs evidence")
    for test in tests:
        if _one(state, "tests", test)["hypothesis"] != hypothesis:
            raise InvestigationError("a test of another hypothesis")
    target = _one(state, "hypotheses", hypothesis)
    if target["status"] != "open":
        raise InvestigationError("the hypothesis is settled")
    name = _add(state, "findings", {"hypothesis": hypothesis, "outcome": outcome, "tests": tests, "evidence": evidence})
    target["status"] = outcome
    return name


def propose_candidate(state: dict[str, Any], finding: str, statement: str) -> str:
    """Knowledge from a supported finding; the same proposal again changes nothing."""
    if _one(state, "findings", finding)["outcome"] != "supported":
        raise InvestigationError("only supported findings become knowledge")
    for entry in state["candidates"]:
        if entry["finding"] == finding and entry["statement"] == statement:
            return entry["id"]
    return _add(state, "candidates", {"finding": finding, "statement": statement, "conflicts": [e["id"] for e in state["candidates"] if e["finding"] == finding]})


def stop(state: dict[str, Any], kind: str, detail: str = "") -> None:
    if kind not in STOPS:
        raise InvestigationError(f"no way to stop {kind!r}")
    state |= {"status": "stopped", "stop": {"kind": kind, "detail": detail[:1024], "at": _now()}, "revision": state["revision"] + 1}


def reserve(state: dict[str, Any], wanted: dict[str, int]) -> str:
    """Take part of the budget before work begins; what is in flight counts. A refusal with nothing in flight ends the investigation."""
    for key, amount in wanted.items():
        limit = state["budget"].get(f"max_{key}")
        used = state["usage"].get(key, 0) + sum(r.get(key, 0) for r in state["reserved"].values())
        if limit is not None and used + amount > limit:
            if not state["reserved"]:
                stop(state, "budget_reached", key)
            raise InvestigationError(f"no budget left for {key}")
    name = uuid.uuid4().hex
    state["reserved"][name] = dict(wanted)
    return name


def settle(state: dict[str, Any], name: str, used: dict[str, int] | None) -> None:
    """Give a reservation back, with what was used of it."""
    state["reserved"].pop(name)
    for key, amount in (used or {}).items():
        state["usage"][key] = state["usage"].get(key, 0) + amount


def validate(state: dict[str, Any]) -> dict[str, Any]:
    """Ids are unique, vocabularies hold, every reference leads somewhere; reverse links are completed."""
    ids = [e["id"] for kind in ENTITIES for e in state[kind]]
    if len(ids) != len(set(ids)):
        raise InvestigationError("an id occurs twice")
    for kind, key, target in (("tests", "hypothesis", "hypotheses"), ("executions", "test", "tests"), ("findings", "hypothesis", "hypotheses"), ("candidates", "finding", "findings")):
        for entry in state[kind]:
            if entry.get(key) is not None:
                _one(state, target, entry[key])
    if any(f["outcome"] not in OUTCOMES for f in state["findings"]):
        raise InvestigationError("an unknown outcome")
    out = copy.deepcopy(state)
    for hypothesis in out["hypotheses"]:
        hypothesis["tests"] = [t["id"] for t in out["tests"] if t["hypothesis"] == hypothesis["id"]]
    return out


@contextmanager
def opened(path: str | Path) -> Iterator[dict[str, Any]]:
    """The document under its lock; written back if the block ends well."""
    with locked(path):
        state = json.loads(Path(path).read_text(encoding="utf-8"))
        yield state
        write_json(path, validate(state))


_TABLES = {
    "observations": "id string, at string, text string, evidence array<string>",
    "hypotheses": "id string, at string, claim string, status string",
    "tests": "id string, at string, hypothesis string, plan string",
    "executions": "id string, at string, operation string, status string, test string, hypothesis string, evidence array<string>, flags map<string,boolean>",
    "findings": "id string, at string, hypothesis string, outcome string, tests array<string>, evidence array<string>",
    "candidates": "id string, at string, finding string, statement string, conflicts array<string>",
}


def tables(spark: SparkSession, state: dict[str, Any]) -> dict[str, DataFrame]:
    out = {}
    for name, schema in _TABLES.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        out[name] = spark.createDataFrame([tuple(e.get(c) for c in columns) for e in state[name]], schema)
    return out


def gaps(parts: dict[str, DataFrame]) -> DataFrame:
    """(gap, id): hypotheses without tests, tests never run, open hypotheses with clean evidence, runs that say little."""
    hypotheses, tests, runs, findings = (parts[k] for k in ("hypotheses", "tests", "executions", "findings"))
    clean = runs.where((F.col("status") == "ok") & (F.size("evidence") > 0)).select(F.col("hypothesis"))
    still = hypotheses.where("status = 'open'")
    ready = compare.having(still, clean, still["id"] == clean["hypothesis"])
    found = [
        ("unresolved_hypotheses", still),
        ("untested_hypotheses", compare.without(hypotheses, tests, hypotheses["id"] == tests["hypothesis"])),
        ("untested_tests", compare.without(tests, runs, tests["id"] == runs["test"])),
        ("execution_gaps", runs.where("status <> 'ok'")),
        ("finding_gaps", compare.without(ready, findings, ready["id"] == findings["hypothesis"])),
        ("coverage_gaps", runs.where(F.exists(F.map_values(F.coalesce("flags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>")))), lambda x: x))),
    ]
    out = None
    for name, frame in found:
        rows = frame.select(F.lit(name).alias("gap"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def entries(parts: dict[str, DataFrame]) -> DataFrame:
    """Everything that happened, in order: stated times as text, then kind, then id."""
    rows = None
    for name, kind in (("observations", "observation"), ("hypotheses", "hypothesis"), ("tests", "test"), ("executions", "execution"), ("findings", "finding"), ("candidates", "candidate")):
        part = parts[name].select(F.lit(kind).alias("kind"), "id", "at")
        rows = part if rows is None else rows.unionByName(part)
    return timeline.by_kind(rows, KINDS)


def differences(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """(entity, id, change, fields) between two states."""
    out = None
    for name, schema in _TABLES.items():
        fields = [c.split()[0] for c in schema.split(", ") if c.split()[0] != "id"]
        flat = [p.select("id", *[F.to_json(f).alias(f) if "map" in dict(p.dtypes)[f] or "array" in dict(p.dtypes)[f] else F.col(f) for f in fields]) for p in (left[name], right[name])]
        rows = compare.changes(flat[0], flat[1], ["id"], fields).where("change <> 'same'").withColumn("entity", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


class Cache:
    """Results of deterministic reads, by request and source; bounded, checked by hash, oldest out first."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def _load(self) -> list[dict[str, Any]]:
        return json.loads(self.path.read_text(encoding="utf-8"))["entries"] if self.path.exists() else []

    @staticmethod
    def key(operation: str, request: dict[str, Any], source: str) -> str:
        return hashlib.sha256(canonical([operation, request, source]).encode()).hexdigest()

    def get(self, key: str) -> Any:
        for entry in self._load():
            if entry["key"] == key and hashlib.sha256(canonical(entry["result"]).encode()).hexdigest() == entry["sha256"]:
                return entry["result"]
        return None

    def put(self, operation: str, key: str, result: Any) -> bool:
        text = canonical(result)
        if operation not in ("probe", "search") or len(text.encode()) > CACHE_ENTRY_BYTES:
            return False
        with locked(self.path):
            kept = [e for e in self._load() if e["key"] != key] + [{"key": key, "sha256": hashlib.sha256(text.encode()).hexdigest(), "result": result}]
            while len(kept) > CACHE_ENTRIES or len(canonical(kept).encode()) > CACHE_BYTES:
                kept.pop(0)
            write_json(self.path, {"schema_version": 1, "entries": kept})
        return True
