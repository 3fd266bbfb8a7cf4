"""Results as files: JSON lines for programs, headed text for people, atomic documents for state."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER_END = "# ---"


def write_records(hits: DataFrame, path: str) -> None:
    """All hits with their metadata."""
    hits.write.json(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """Hits of literal terms only."""
    hits.where("term is not null").select("source_id", "term", "terms", "matched_by", "start_line", "end_line", "hit_lines").write.json(path)


def write_templates(templates: DataFrame, path: str, hits: int, threshold: int) -> bool:
    """Folded templates, most records first, if there are at least ``threshold`` hits; whether they were written."""
    if not threshold or hits < threshold:
        return False
    templates.orderBy(F.desc("records"), "first_order").write.json(path)
    return True


def write_events(events: DataFrame, path: str) -> None:
    """Events without their raw text."""
    events.drop("text").write.json(path)


def write_text(hits: DataFrame, path: str, header: dict[str, Any]) -> None:
    """Texts in order, and a header document beside them."""
    hits.repartitionByRange("source_id", "start_line").sortWithinPartitions("source_id", "start_line").select("text").write.text(path)
    hits.sparkSession.createDataFrame([(f"# {k}: {v}",) for k, v in header.items()] + [(HEADER_END,)], "value string").coalesce(1).write.text(f"{path}.header")


def strip_header(lines: DataFrame) -> DataFrame:
    """Lines after a header's end; all lines where there is none."""
    ends = lines.where(F.col("line") == HEADER_END).groupBy("source_id").agg(F.min("line_no").alias("_end"))
    return lines.join(ends, "source_id", "left").where(F.col("_end").isNull() | (F.col("line_no") > F.col("_end"))).drop("_end")


def append_history(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def write_json(path: str | Path, document: Any) -> None:
    """Replace a document at once; readers see the old or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            json.dump(document, file, ensure_ascii=False, indent=2, sort_keys=True)
            file.flush()
            os.fsync(file.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


@contextmanager
def locked(path: str | Path) -> Iterator[None]:
    """One writer at a time, across processes."""
    lock = Path(f"{path}.lock")
    lock.parent.mkdir(parents=True, exist_ok=True)
    with lock.open("w") as file:
        fcntl.flock(file, fcntl.LOCK_EX)
        yield


def canonical(document: Any) -> str:
    return json.dumps(document, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


class Ledger:
    """Results stored under the digest of their content; only successful searches are taken."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def put(self, result: dict[str, Any]) -> str | None:
        if result.get("operation") != "search" or result.get("status") != "ok":
            return None
        name = hashlib.sha256(canonical(result).encode()).hexdigest()
        write_json(self.root / name[:2] / f"{name}.json", result)
        return name

    def get(self, name: str) -> dict[str, Any]:
        document = json.loads((self.root / name[:2] / f"{name}.json").read_text(encoding="utf-8"))
        if hashlib.sha256(canonical(document).encode()).hexdigest() != name:
            raise ValueError(f"result {name} was changed")
        return document


def layout(defaults: dict[str, Any], *overrides: dict[str, Any]) -> dict[str, Any]:
    """Output folders: later settings win, key by key."""
    out = dict(defaults)
    for more in overrides:
        for key, value in more.items():
            out[key] = layout(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
