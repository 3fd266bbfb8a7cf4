"""Growing sources: watermarked counts, and sealed segments from micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_counts(rows: DataFrame, width: str, by: list[str], time: str = "ts", late: str | None = None) -> DataFrame:
    """Rows per tumbling window; on a stream, ``late`` is how long a window waits."""
    if late is not None:
        rows = rows.withWatermark(time, late)
    counted = rows.where(F.col(time).isNotNull()).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("records"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "records")


def sessions(rows: DataFrame, gap: str, by: list[str], time: str = "ts", late: str | None = None) -> DataFrame:
    """Runs of rows no further apart than ``gap``."""
    if late is not None:
        rows = rows.withWatermark(time, late)
    counted = rows.where(F.col(time).isNotNull()).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("records"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "records")


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files as they appear in a folder."""
    return spark.readStream.format("text").load(folder).select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("line"))


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Let a query run for a while, then let it finish what has arrived and stop it; whether it ended by itself."""
    ended = query.awaitTermination(max(1, int(seconds)))
    if not ended:
        query.processAllAvailable()
        query.stop()
    return bool(ended)


def top_templates(stream: DataFrame, folder: str, checkpoint: str, capacity: int = 500) -> StreamingQuery:
    """Bounded counts of the stream's templates (column ``template``): every micro-batch is merged into the counters before it.

    A template that has no counter may have been dropped with at most the least
    count kept, so it starts there, and that is its error. A batch writes its own
    version of the counters from the one before, so a retried batch changes nothing.
    """
    schema = "template string, records long, count_error long"

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        older = spark.read.schema(schema).parquet(f"{folder}/counters_{number - 1}") if number else spark.createDataFrame([], schema)
        kept, floor = older.agg(F.count("*"), F.min("records")).first()
        floor = floor if kept >= capacity else 0
        fresh = batch.groupBy("template").agg(F.count("*").alias("n"))
        both = older.join(fresh, "template", "full_outer")
        merged = both.select("template", (F.coalesce("records", F.lit(floor)) + F.coalesce("n", F.lit(0))).alias("records"), F.coalesce("count_error", F.lit(floor)).cast("long").alias("count_error"))
        merged.orderBy(F.desc("records"), "template").limit(capacity).write.mode("overwrite").parquet(f"{folder}/counters_{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seal(stream: DataFrame, folder: str, checkpoint: str, register: Callable[[int, str, int], None] | None = None) -> StreamingQuery:
    """Every micro-batch becomes a sealed segment, written once whatever is retried; then the query stops."""

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/sealed_{number}"
        batch.write.mode("overwrite").parquet(path)
        if register is not None:
            register(number, path, batch.sparkSession.read.parquet(path).count())

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
