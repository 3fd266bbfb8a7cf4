"""Scratch tables below the cluster's shared folder, and ranks without a single task.

Iterative operators cut their lineage here: a stage is written as Parquet below
``spark.checkpoint.dir`` and read back, so that a lost executor costs a re-read
of the file and never a recomputation of the whole chain.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
#: Seconds between two requests for a collection on the driver.
COLLECT_EVERY = 0.5
_collected = [0.0]
#: Folders of applications without the setting.
_own: dict[str, str] = {}
#: Folders written within each open ``passing``.
_passing: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder is set only where the session names none and has one machine."""
    root = spark.conf.get(_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {_CONF} to a folder that all executors share")
        # The setting can't be changed once a session runs, so the folder is kept here.
        root = _own.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='logstrata-')}"
        _own[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` once and read it back: later plans start at the file."""
    spark = frame.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _passing:
        made.append(path)
    # Shuffle files of written stages go when the driver's collector meets their handles, which it does not right after the writing.
    if time.monotonic() - _collected[0] >= COLLECT_EVERY:
        spark._jvm.System.gc()
        _collected[0] = time.monotonic()
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _plain(path: str) -> str:
    return path.removeprefix("file:").lstrip("/")


def forget(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            if _plain(folder).startswith(_plain(scratch_root(spark))):
                _delete(spark, folder)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables written within go at the end, but for those whose folders are taken off the list."""
    made: list[str] = []
    _passing.append(made)
    try:
        yield made
    finally:
        _passing.remove(made)
        for folder in made:
            _delete(spark, folder)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(frame: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``frame`` with its 0-based position in a total order.

    A window over everything would sort in one task. Instead rows are range-
    partitioned and numbered per partition, and each partition starts where the
    counts of those before it end: one number a partition meets in one place.
    """
    parts = width(frame.sparkSession)
    sorted_ = frame.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = materialize(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    return numbered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
