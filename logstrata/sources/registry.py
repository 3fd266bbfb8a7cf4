"""Named source kinds, preprocessing steps, and a catalogue of stored segments."""

from __future__ import annotations

import base64
import subprocess
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.patterns import Matcher

from . import archives
from .lines import SourceError, lines_of, read_large, read_lines, resolve_paths

#: Bytes from which a file is read by splits and not as one row.
LARGE = 64 << 20
Provider = Callable[[SparkSession, dict[str, Any]], DataFrame]
_PROVIDERS: dict[str, Provider] = {}
Step = Callable[[DataFrame, dict[str, Any]], DataFrame]
_STEPS: dict[str, Step] = {}


def register_provider(*names: str) -> Callable[[Provider], Provider]:
    def add(provider: Provider) -> Provider:
        for name in names:
            _PROVIDERS[name.lower()] = provider
        return provider

    return add


def names_of_providers() -> list[str]:
    return list(_PROVIDERS)


def is_live(spec: dict[str, Any]) -> bool:
    """Whether a source runs a command."""
    return str(spec.get("type", "file")).lower() in ("live", "command", "cmd")


def build_source(spark: SparkSession, spec: dict[str, Any], allow_live: bool = False) -> DataFrame:
    """Lines of the source that ``spec['type']`` names; a command runs only if the caller allows it, whatever the document says."""
    kind = str(spec.get("type", "file")).lower()
    if kind not in _PROVIDERS:
        raise SourceError(f"no source of type {kind!r}")
    if is_live(spec) and not allow_live:
        raise SourceError("live sources need leave from the program that runs them")
    return _PROVIDERS[kind](spark, spec)


@register_provider("file", "static", "path", "dir")
def _files(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    paths = resolve_paths(spark, spec["path"], spec.get("glob", "*"), bool(spec.get("recursive", False)))
    heads = {p: head_of(spark, p) for p in paths}
    packed = [p for p, (head, _) in heads.items() if archives.is_archive(head)]
    encoding = spec.get("encoding", "utf-8")
    splittable = encoding.lower().replace("-", "") == "utf8"
    large = [p for p, (_, size) in heads.items() if size >= LARGE and splittable and p not in set(packed)]
    plain = [p for p in paths if p not in {*packed, *large}]
    frames = [read_lines(spark, plain, encoding)] if plain else []
    if large:
        frames.append(read_large(spark, large))
    if packed:
        frames.append(_archive_lines(spark, packed))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def head_of(spark: SparkSession, path: str, size: int = 512) -> tuple[bytes, int]:
    """(first bytes, length) of a file in any store that Spark reads; nothing else of it is read."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    length = fs.getFileStatus(place).getLen()
    held = spark.sparkContext._gateway.new_array(jvm.byte, min(size, int(length)))
    stream = fs.open(place)
    try:
        stream.readFully(0, held)
    finally:
        stream.close()
    return base64.b64decode(jvm.java.util.Base64.getEncoder().encodeToString(held)), int(length)


@register_provider("archive")
def _archive(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    return _archive_lines(spark, resolve_paths(spark, spec["path"]))


def _archive_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = archives.read_members(spark, paths)
    return lines_of(found.select(F.concat_ws("!", "archive", "member").alias("source_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")), "source_id", "text")


@register_provider("live", "command", "cmd")
def _live(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    path = capture(spec["cmd"], spec["output_path"], float(spec.get("duration", 30)))
    return read_lines(spark, f"file://{path}")


def capture(command: list[str], output: str, seconds: float, grace: float = 3.0) -> str:
    """Run an argument list for a while, its output to a file, then stop it and freeze the file."""
    target = Path(output).resolve()
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("wb") as file:
        process = subprocess.Popen([str(c) for c in command], stdout=file, stderr=subprocess.STDOUT)
        until = time.monotonic() + seconds
        while process.poll() is None and time.monotonic() < until:
            time.sleep(0.05)
        if process.poll() is None:
            process.terminate()
            try:
                process.wait(grace)
            except subprocess.TimeoutExpired:
                process.kill()
                process.wait()
    frozen = target.with_name(f"sealed_{target.name}")
    frozen.write_bytes(target.read_bytes())
    return str(frozen)


def register_step(name: str) -> Callable[[Step], Step]:
    def add(step: Step) -> Step:
        _STEPS[name] = step
        return step

    return add


def preprocess(lines: DataFrame, steps: list[dict[str, Any]]) -> DataFrame:
    """Steps in order, each ``{"action": name, ...}``."""
    for spec in steps:
        if spec.get("action") not in _STEPS:
            raise SourceError(f"no preprocessing action {spec.get('action')!r}")
        lines = lines.transform(lambda frame, s=spec: _STEPS[s["action"]](frame, s))
    return lines


@register_step("grep")
def _grep(lines: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Keep (or with ``invert`` drop) lines that match."""
    hit = Matcher(spec["pattern"]).matched(F.col("line"))
    return lines.where(~hit if spec.get("invert") else hit)


@register_step("charset")
def _charset(lines: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Charsets are settled where bytes are read; see ``with_charset``."""
    raise SourceError("charset must be the first step of a file source")


def with_charset(spec: dict[str, Any]) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """(source, other steps): a leading charset step becomes the encoding that the source's bytes are decoded by."""
    steps = list(spec.get("preprocess") or [])
    if steps and steps[0].get("action") == "charset":
        return spec | {"encoding": steps[0].get("from", "ISO-8859-1")}, steps[1:]
    return spec, steps


def append_segment(catalogue: DataFrame, segment: dict[str, Any]) -> DataFrame:
    """The catalogue (start, end, path, bytes, lines) with another segment; a taken path gets a number."""
    path, taken, n = segment["path"], {r["path"] for r in catalogue.where(F.col("path").startswith(segment["path"].rsplit(".", 1)[0])).select("path").toLocalIterator()}, 1
    while path in taken:
        stem, dot, suffix = segment["path"].rpartition(".")
        path, n = (f"{stem}_{n}{dot}{suffix}" if dot else f"{segment['path']}_{n}"), n + 1
    return catalogue.unionByName(catalogue.sparkSession.createDataFrame([segment | {"path": path}], catalogue.schema))


def segments_between(catalogue: DataFrame, since: Any, until: Any) -> DataFrame:
    """Segments that overlap a time range, in order of start."""
    return catalogue.where((F.col("start") <= F.lit(until)) & (F.col("end") >= F.lit(since))).orderBy("start", "path")
