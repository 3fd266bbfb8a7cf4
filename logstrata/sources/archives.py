"""Members of zip and tar archives as rows, under limits that stop hostile files."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Limits:
    members: int = 10_000
    total_bytes: int = 2 << 30
    member_bytes: int = 512 << 20
    ratio: int = 1000


class ArchiveError(ValueError):
    """An archive that is refused."""


def _safe(name: str, seen: set[str]) -> str:
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or name.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
        raise ArchiveError(f"unsafe member name {name!r}")
    clean = "/".join(parts)
    if clean in seen:
        raise ArchiveError(f"member {clean!r} occurs twice")
    seen.add(clean)
    return clean


def members(content: bytes, limits: Limits = Limits()) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the files in an archive; its kind is told from its content."""
    seen: set[str] = set()
    total = 0

    def admit(name: str, size: int) -> str:
        nonlocal total
        total += size
        if len(seen) >= limits.members or size > limits.member_bytes or total > limits.total_bytes or total > limits.ratio * max(len(content), 1):
            raise ArchiveError(f"member {name!r} is beyond the limits")
        return _safe(name, seen)

    def read(file: io.IOBase, size: int, name: str) -> bytes:
        data = file.read(size + 1)
        if len(data) > size:
            raise ArchiveError(f"member {name!r} is larger than it says")
        return data

    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                if info.external_attr >> 16 & 0o170000 == 0o120000:
                    raise ArchiveError(f"link {info.filename!r}")
                if not info.is_dir():
                    name = admit(info.filename, info.file_size)
                    with archive.open(info) as file:
                        yield name, read(file, info.file_size, name)
        return
    try:
        archive = tarfile.open(fileobj=io.BytesIO(content))
    except tarfile.TarError as error:
        raise ArchiveError("neither zip nor tar") from error
    with archive:
        for entry in archive:
            if entry.isdir():
                continue
            if not entry.isfile():
                raise ArchiveError(f"{entry.name!r} is no plain file")
            name = admit(entry.name, entry.size)
            yield name, read(archive.extractfile(entry), entry.size, name)


def is_archive(head: bytes) -> bool:
    """By content, not by name: zip, gzip or tar marks."""
    return head[:4] in (b"PK\x03\x04", b"PK\x05\x06") or head[:2] == b"\x1f\x8b" or head[257:262] == b"ustar"


def read_members(spark: SparkSession, paths: list[str] | str, limits: Limits = Limits()) -> DataFrame:
    """(archive, member, content); each archive is unpacked by the task that read it."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for name, data in members(bytes(content), limits):
                    yield pd.DataFrame({"archive": [path], "member": [name], "content": [data]})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(unpack, "archive string, member string, content binary")
