"""A store of reviewed knowledge: candidates, votes, promotion, and the files that depend on them."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from logstrata.sources.sinks import locked, write_json

from .governance import MIN_CASES

# Most revalidations kept, and the store's version.
HISTORY, VERSION = 32, 2


class KnowledgeError(ValueError):
    """A step that the review rules forbid."""


def _time(raw: str | None) -> datetime | None:
    if raw is None:
        return None
    found = datetime.fromisoformat(raw)
    return found if found.tzinfo else found.replace(tzinfo=UTC)


class Store:
    """One JSON document; every change is checked, counted and written at once."""

    def __init__(self, path: str | Path, min_cases: int = MIN_CASES, allow_contradictions: bool = False):
        self.path, self.min_cases, self.lenient = Path(path), max(MIN_CASES, min_cases), allow_contradictions

    def load(self) -> dict[str, Any]:
        if not self.path.exists():
            return {"schema_version": VERSION, "revision": 0, "candidates": [], "targets": {}}
        return migrate(json.loads(self.path.read_text(encoding="utf-8")))

    def _save(self, state: dict[str, Any]) -> None:
        state["revision"] += 1
        write_json(self.path, state)

    @staticmethod
    def _one(state: dict[str, Any], name: str) -> dict[str, Any]:
        for candidate in state["candidates"]:
            if candidate["id"] == name:
                return candidate
        raise KnowledgeError(f"no candidate {name}")

    def propose(self, statement: str, evidence: list[str], author: str, supersedes: str | None = None) -> str:
        with locked(self.path):
            state = self.load()
            version = 1
            if supersedes:
                old = self._one(state, supersedes)
                version = old["version"] + 1
                if not old["promoted"]:
                    old["status"] = "superseded"
            name = uuid.uuid4().hex
            state["candidates"].append({"id": name, "statement": statement, "evidence": evidence, "author": author, "version": version, "supersedes": supersedes, "superseded_by": None, "status": "proposed", "promoted": None, "votes": [], "validity": {"expires_at": None, "stale_after": None, "history": []}})
            if supersedes and not old["promoted"]:
                old["superseded_by"] = name
            self._save(state)
        return name

    def verify(self, name: str, case: str, supports: bool, evidence: list[str]) -> str:
        """One vote a case, none after promotion; returns the status that follows."""
        with locked(self.path):
            state = self.load()
            candidate = self._one(state, name)
            if candidate["promoted"] or any(v["case"] == case for v in candidate["votes"]):
                raise KnowledgeError("promoted already, or a case that has voted")
            candidate["votes"].append({"case": case, "supports": supports, "evidence": evidence})
            candidate["status"] = self._status(candidate)
            self._save(state)
            return candidate["status"]

    def _status(self, candidate: dict[str, Any]) -> str:
        support = sum(v["supports"] for v in candidate["votes"])
        if support < len(candidate["votes"]) and not self.lenient:
            return "contradicted"
        return "verified" if support >= self.min_cases else "proposed"

    def promote(self, name: str, reviewer: str, target: str | None = None, expires_at: str | None = None, stale_after: str | None = None) -> None:
        """By someone other than the author, with evidence, onto an unchanged target."""
        with locked(self.path):
            state = self.load()
            candidate = self._one(state, name)
            if candidate["status"] != "verified" or reviewer == candidate["author"] or not candidate["evidence"]:
                raise KnowledgeError("promotion needs a verified candidate with evidence and another reviewer")
            if target and self._target(state, target) not in ("ok", "unmanaged"):
                raise KnowledgeError(f"the target {target} was changed")
            candidate["promoted"] = {"by": reviewer, "at": datetime.now(UTC).isoformat(), "target": target}
            candidate["validity"] |= {"expires_at": expires_at, "stale_after": stale_after}
            if candidate["supersedes"]:
                old = self._one(state, candidate["supersedes"])
                old |= {"status": "superseded", "superseded_by": name}
            self._save(state)

    def revalidate(self, name: str, reviewer: str, note: str, expires_at: str | None = None) -> None:
        with locked(self.path):
            state = self.load()
            candidate = self._one(state, name)
            if not candidate["promoted"] or reviewer in (candidate["author"], candidate["promoted"]["by"]):
                raise KnowledgeError("needs a promoted candidate and an independent reviewer")
            validity = candidate["validity"]
            validity["history"] = [*validity["history"], {"by": reviewer, "at": datetime.now(UTC).isoformat(), "note": note}][-HISTORY:]
            validity["expires_at"] = expires_at or validity["expires_at"]
            self._save(state)

    def validity(self, name: str, now: datetime) -> str:
        candidate = self._one(self.load(), name)
        limits = candidate["validity"]
        if candidate["status"] == "superseded":
            return "superseded"
        if not candidate["promoted"]:
            return "not_promoted"
        if not candidate["promoted"].get("by"):
            return "not_reviewed"
        if (expires := _time(limits["expires_at"])) and now >= expires:
            return "expired"
        if (stale := _time(limits["stale_after"])) and now >= stale:
            return "stale"
        return "current"

    def candidates(self, status: str | None = None) -> list[dict[str, Any]]:
        return [c for c in self.load()["candidates"] if status is None or c["status"] == status]

    def register_target(self, name: str, path: str) -> None:
        with locked(self.path):
            state = self.load()
            state["targets"][name] = {"path": str(Path(path).resolve()), "sha256": hashlib.sha256(Path(path).read_bytes()).hexdigest()}
            self._save(state)

    def _target(self, state: dict[str, Any], name: str, path: str | None = None) -> str:
        known = state["targets"].get(name)
        if known is None:
            return "unmanaged"
        if path is not None and str(Path(path).resolve()) != known["path"]:
            return "path_mismatch"
        file = Path(known["path"])
        if not file.exists():
            return "missing"
        return "ok" if hashlib.sha256(file.read_bytes()).hexdigest() == known["sha256"] else "modified"

    def check_target(self, name: str, path: str | None = None) -> str:
        return self._target(self.load(), name, path)


def migrate(state: dict[str, Any]) -> dict[str, Any]:
    """Stores of version 1 had no validity and no targets."""
    if state.get("schema_version") == 1:
        for candidate in state["candidates"]:
            candidate.setdefault("validity", {"expires_at": None, "stale_after": None, "history": []})
        state = state | {"schema_version": VERSION, "targets": state.get("targets", {})}
    if state.get("schema_version") != VERSION:
        raise KnowledgeError(f"no reader for version {state.get('schema_version')!r}")
    return state
