"""Views of result envelopes for readers with little room: the same evidence, fewer characters."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from logstrata.sources.sinks import canonical

# Characters of a metadata text, of a label in a brief view, markers of the text frame, names that mean the same.
BOUND, LABEL = 256, 80
HEAD, RESULT, SOURCE, COVERAGE, EVIDENCE, CONTEXT, END_CONTEXT, WARNING, ERROR = "@TCF 1", "@R", "@SRC", "@COV", "@E", "@CTX", "@ENDCTX", "@WARN", "@ERR"
SAME = {"scanned_lines": "lines_scanned", "scanned_records": "records_scanned", "records_scoped": "scoped_records", "lines_scoped": "scoped_lines"}
COLUMNS = ("uri", "start_line", "end_line", "term", "text")


def bounded(metadata: Mapping[str, Any], chars: int = BOUND) -> dict[str, Any]:
    """Texts of at most ``chars`` characters; a shortened one is marked ``<key>_truncated``."""
    out: dict[str, Any] = {}
    for key, value in metadata.items():
        long = isinstance(value, str) and len(value) > chars
        out[key] = value[:chars] if long else value
        if long:
            out[f"{key}_truncated"] = True
    return out


def scope_text(scope: Mapping[str, Any]) -> str | None:
    """The scope of a filter in one line: spans, times, lines and process, in this order."""
    parts = [f"{shown}={scope[key]}" for key, shown in (("last", "last"), ("since", "time_from"), ("until", "time_to"), ("tail_lines", "tail")) if scope.get(key) is not None]
    if scope.get("line_from") is not None or scope.get("line_to") is not None:
        parts.append(f"lines={scope.get('line_from') or 1}-{scope.get('line_to') or 'end'}")
    if scope.get("pid") is not None:
        parts.append(f"pid={scope['pid']}")
    return ",".join(parts) or None


def coverage_of(coverage: Mapping[str, Any]) -> dict[str, Any]:
    """Coverage with one name for each thing; the first stated counts."""
    out: dict[str, Any] = {}
    for key, value in coverage.items():
        out.setdefault(SAME.get(key, key), value)
    return out


def light(result: Mapping[str, Any]) -> dict[str, Any]:
    """Without parts that say nothing and what only stored runs need."""
    out = {k: v for k, v in result.items() if v or k not in ("hypotheses", "verification", "artifacts", "data", "next_queries", "warnings")}
    data = {k: v for k, v in (result.get("data") or {}).items() if k not in ("run_id", "manifest_path", "manifest_sha256", "input_lineage")}
    return {k: v for k, v in out.items() if k != "data"} | ({"data": data} if data else {})


def brief(result: Mapping[str, Any]) -> dict[str, Any]:
    """A survey without the texts of its samples; other results as they are."""
    if result.get("operation") != "survey":
        return dict(result)
    data = {k: v for k, v in result["data"].items() if k not in ("work_input", "snapshot_path")} | {"brief": True}
    data["templates"] = [{k: v for k, v in t.items() if k not in ("sample", "samples")} for t in data.get("templates", [])]
    evidence = [{k: v[:LABEL] if k == "label" else v for k, v in e.items() if k != "text"} for e in result.get("evidence", [])]
    return dict(result) | {"data": data, "evidence": evidence, "coverage": coverage_of(result.get("coverage", {}))}


def compact(result: Mapping[str, Any], chars: int | None = None, columns: tuple[str, ...] = COLUMNS) -> dict[str, Any]:
    """Evidence as columns and rows, a source or term that all share said once, then rows from the end left out until ``chars`` suffice."""
    entries = list(result.get("evidence") or [])
    coverage, shared = coverage_of(result.get("coverage") or {}), {}
    sources = {e.get("source_id") for e in entries}
    if len(sources) == 1:
        shared["source_id"] = sources.pop()
    used = [c for c in (*(() if "source_id" in shared or not entries else ("source_id",)), *columns) if any(e.get(c) is not None for e in entries)]
    rows = [[e.get(c) for c in used] for e in entries]
    if "term" in used:
        rows, hoisted = without_repeats(rows, used.index("term"))
        shared |= {"term": hoisted} if hoisted is not None else {}
    out = light(result) | {"coverage": coverage, "evidence": {"columns": used, "rows": rows}, "view": "compact"}
    if shared:
        out["shared"] = shared
    total = len(rows)
    while chars is not None and rows and len(canonical(_plain(out))) > chars:
        # Rows go in halves while far over, then singly.
        size = len(canonical(_plain(out)))
        keep = max(0, min(len(rows) - 1, len(rows) * chars // size))
        rows = rows[:keep]
        out = out | {"evidence": {"columns": used, "rows": rows}, "status": "partial", "coverage": coverage | {"shown": keep, "omitted": total - keep}}
    return out


def _plain(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def without_repeats(rows: list[list[Any]], at: int) -> tuple[list[list[Any]], Any]:
    """(rows whose value at ``at`` is blank where it repeats the one shown last, the value if all share it)."""
    values = {row[at] for row in rows if row[at]}
    if len(values) == 1:
        return [[*row[:at], "", *row[at + 1 :]] for row in rows], values.pop()
    out, shown = [], None
    for row in rows:
        again = bool(row[at]) and row[at] == shown
        shown = row[at] or shown
        out.append([*row[:at], "", *row[at + 1 :]] if again else row)
    return out, None


def cell(value: Any) -> str:
    """A value on one line without tabs."""
    return "" if value is None else str(value).replace("\t", " ").replace("\r", " ").replace("\n", " ")


def frame(result: Mapping[str, Any]) -> str:
    """A compact view as lines of text: a head, coverage, a table of evidence, contexts, warnings."""
    out = [f"{HEAD} {result.get('operation', 'unknown')} status={result.get('status', 'error')} outcome={result.get('outcome', 'unknown')}"]
    data = result.get("data") or {}
    if data.get("result_id"):
        out.append(f"{RESULT} {data['result_id']}")
    if (result.get("shared") or {}).get("source_id"):
        out.append(f"{SOURCE} {cell(result['shared']['source_id'])}")
    scalars = [f"{k}={cell(v)}" for k, v in sorted((result.get("coverage") or {}).items()) if not isinstance(v, (list, dict))]
    if scalars:
        out.append(f"{COVERAGE} {' '.join(scalars)}")
    table = result.get("evidence") or {}
    if isinstance(table, Mapping) and table.get("columns"):
        out.append(f"{EVIDENCE} " + "\t".join(map(cell, table["columns"])))
        out += ["\t".join(map(cell, row)) for row in table["rows"]]
    for context in result.get("contexts") or []:
        first, last = (context.get("lines") or ["", ""])[:2]
        out += [f"{CONTEXT} {cell(context.get('id'))} {first}-{last} truncated={context.get('truncated', False)}", *str(context.get("text") or "").splitlines(), END_CONTEXT]
    out += [f"{WARNING} {cell(w)}" for w in result.get("warnings") or []]
    return "\n".join(out + ([f"{ERROR} {cell(result['error']['message'])}"] if (result.get("error") or {}).get("message") else []))


def transport(capabilities: Mapping[str, Any]) -> dict[str, Any]:
    """How to send results to a reader by what it declares: text frames if it reads them, columns if it takes structured data, else whole JSON."""
    limit = capabilities.get("max_chars")
    kind = "frame" if capabilities.get("text_frame") else "compact" if capabilities.get("structured", True) else "json"
    return {"view": kind, "max_chars": int(limit) if limit else None}


def render(result: Mapping[str, Any], capabilities: Mapping[str, Any]) -> str:
    """A result in the form and size that a reader declares."""
    how = transport(capabilities)
    if how["view"] == "json":
        return canonical(_plain(dict(result)))
    small = compact(result, how["max_chars"])
    return frame(small) if how["view"] == "frame" else canonical(_plain(small))
