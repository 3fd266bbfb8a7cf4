"""Readers of what runs have written, with declared schemas; unknown versions are refused."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "records": "source_id string, rec_no long, start_line long, end_line long, text string, ts timestamp_ntz, fields map<string,string>, term string, terms array<string>, matched_by array<string>, hit_lines array<long>",
    "hits": "source_id string, term string, terms array<string>, matched_by array<string>, start_line long, end_line long, hit_lines array<long>",
    "events": "event_id string, ts timestamp_ntz, category string, name string, source string, label string, attributes map<string,string>, raw_ref struct<source_path:string,start_line:long,end_line:long>, parents array<string>, transformations array<string>",
    "templates": "template string, records long, matched_terms array<string>, sample string, first_seen timestamp_ntz, first_order long",
    "history": "at string, operation string, status string, pattern string",
}
#: Document kinds and the versions of them that are read.
VERSIONS = {"manifest": {2}, "investigation": {1}, "knowledge": {1}, "result": {1}}


class ArtifactError(ValueError):
    """A file that is not what it is read as."""


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Rows of JSON lines of a kind; a line that is no such row is an error, not a null."""
    if kind not in SCHEMAS:
        raise ArtifactError(f"no artifact of kind {kind!r}")
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)


def read_document(kind: str, path: str | Path) -> dict[str, Any]:
    """A JSON document of a kind and a version that is known."""
    try:
        document = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise ArtifactError(str(error)) from error
    if kind not in VERSIONS or not isinstance(document, dict) or document.get("schema_version") not in VERSIONS[kind]:
        raise ArtifactError(f"{path} is no {kind} of a known version")
    return document
