from __future__ import annotations

import random

from pyspark.sql import functions as F

from logstrata.llm import rowmarks


def test_marks_pick_exactly_the_rows_named(spark):
    frame = spark.range(1000).repartition(4).select(F.monotonically_increasing_id().alias("id")).cache()
    ids = [r.id for r in frame.collect()]
    some = set(random.Random(3).sample(ids, 300)) | {max(ids), min(ids)}
    marks = rowmarks.marks_of(spark.createDataFrame([(i,) for i in [*some, *some]], "id long"))
    flagged = {r.id: r.flag for r in rowmarks.with_mark(frame, marks, "id", "flag").collect()}
    assert flagged == {i: i in some for i in ids}
    assert {r.id for r in rowmarks.picked(frame, marks).collect()} == some


def test_an_empty_set_marks_nothing(spark):
    marks = rowmarks.marks_of(spark.createDataFrame([], "id long"))
    assert not any(r.flag for r in rowmarks.with_mark(spark.range(5), marks, "id", "flag").collect())
