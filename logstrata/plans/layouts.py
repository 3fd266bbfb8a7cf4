"""Records of many sources, each by its own layout."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.operators import segment
from logstrata.scratch import materialize

from . import probe as P


def kind_of(report: P.Report) -> str:
    """The segmenter that a report recommends, as JSON: a name or an inline description."""
    return json.dumps(report.config if report.config else "jsonline" if report.recommended == "jsonline" else "rawtext", sort_keys=True)


def detected(lines: DataFrame) -> DataFrame:
    """(source_id, kind) of every source with any text."""
    kind = F.udf(lambda text: kind_of(P.read_report(text)))
    return P.reports(lines).select("source_id", kind("report").alias("kind"))


def segmented(lines: DataFrame, segmenter: str | dict[str, Any] = "auto") -> tuple[DataFrame, Any]:
    """(records, what they were segmented by): with ``auto`` every source by its own layout.

    Sources of one layout share a plan; the layouts, not the sources, are listed on the driver.
    """
    if segmenter != "auto":
        return segment.segment(lines, segmenter), segmenter
    found = materialize(detected(lines), "layouts")
    kinds = sorted(r["kind"] for r in found.select("kind").distinct().toLocalIterator())
    if not kinds:
        return segment.segment(lines, "rawtext"), "rawtext"
    if len(kinds) == 1:
        kind = json.loads(kinds[0])
        return segment.segment(lines, kind), kind
    named = lines.join(found.withColumnRenamed("source_id", "_source"), F.col("source_id").cast("string") == F.col("_source"), "left").drop("_source")
    frames = [segment.segment(named.where(F.coalesce("kind", F.lit('"rawtext"')) == kind).drop("kind"), json.loads(kind)) for kind in sorted({*kinds, '"rawtext"'})]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out, [json.loads(k) for k in kinds]
