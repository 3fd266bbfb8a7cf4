"""Text sources as numbered lines.

``lines`` rows are (source_id, line_no from 1, line). Files are listed through
Spark's file system, so any store that Spark reads will do. Undecodable bytes
become U+FFFD; ``\\n``, ``\\r\\n`` and ``\\r`` end lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.text import LINE_BREAK
from logstrata.scratch import materialize


class SourceError(ValueError):
    """A source that can't be resolved."""


def resolve_paths(spark: SparkSession, raw: str, glob: str = "*", recursive: bool = False) -> list[str]:
    """The sorted files behind a file, folder or wildcard path; none is an error."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(raw)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = jvm.org.apache.hadoop.fs.GlobFilter(glob)
    found: list[str] = []

    def visit(status: object, top: bool) -> None:
        if status.isFile():
            if top or pattern.accept(status.getPath()):
                found.append(status.getPath().toString())
        elif top or recursive:
            for child in fs.listStatus(status.getPath()):
                visit(child, False)

    statuses = fs.globStatus(path)
    for status in statuses or []:
        visit(status, True)
    if not found:
        raise SourceError(f"no files at {raw}")
    return sorted(found)


def split_lines(text: Column) -> Column:
    """Lines of a whole text; a break at the very end does not begin another line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines_of(frame: DataFrame, source: str, text: str) -> DataFrame:
    """Numbered lines of a table's text column."""
    parts = split_lines(F.col(text))
    return frame.select(F.col(source).alias("source_id"), F.posexplode(parts).alias("_pos", "line")).select("source_id", (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def read_lines(spark: SparkSession, paths: list[str] | str, encoding: str = "utf-8") -> DataFrame:
    """Numbered lines of files that a task can hold; see ``read_large`` for others."""
    raw = spark.read.format("binaryFile").load(paths)
    text = F.make_valid_utf8(F.col("content").cast("string")) if encoding.lower().replace("-", "") == "utf8" else F.decode("content", encoding)
    return lines_of(raw.select(F.col("path").alias("source_id"), text.alias("text")), "source_id", "text")


def read_large(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Numbered lines of files of any size: every split is numbered by itself and starts where the splits before it end."""
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.make_valid_utf8("value").alias("line")
    )
    numbered = materialize(raw, "lines")
    from pyspark.sql import Window

    counts = numbered.groupBy("source_id", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source_id", "_block", "_first", before.alias("_before"))
    joined = numbered.join(starts, ["source_id", "_block"])
    return joined.select("source_id", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")


def count_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source_id").agg(F.count("*").alias("lines"))


def digests(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, size, sha256) of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """One digest of a folder: its relative names and file digests in order of name."""
    name = F.expr("substring(path, locate(:root, path) + length(:root) + 1)".replace(":root", "'" + root.rstrip("/").replace("'", "''") + "'"))
    listed = files.select(name.alias("name"), "size", "sha256")
    entries = F.sort_array(F.collect_list(F.struct("name", "sha256")))
    joined = F.array_join(F.transform(entries, lambda e: F.concat(e["name"], F.lit("\u0000"), e["sha256"], F.lit("\u0000"))), "")
    return listed.agg(F.sum("size").alias("size"), F.sha2(joined, 256).alias("sha256"))


def freeze(lines: DataFrame, label: str = "snapshot") -> DataFrame:
    """An immutable copy that later steps read."""
    return materialize(lines, label)


def is_stable(name: str) -> bool:
    """Sources that need no snapshot: sealed or pulled files and archives' folders."""
    parts = name.rstrip("/").split("/")
    return parts[-1].startswith(("sealed_", "pulled_")) or ".archive" in parts
