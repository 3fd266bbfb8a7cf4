from __future__ import annotations

from logstrata.llm import mixing


def test_mix_moves_no_text(spark, make_docs):
    docs = make_docs([(i, "some words " * (i % 7 + 1)) for i in range(200)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        drawn = {r.doc_id: r.copies for r in mixing.plan(docs).select("_doc.doc_id", "copies").collect()}
        mixed = mixing.mix(docs)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        found = [r.doc_id for r in mixed.select("doc_id").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(found) == sorted(i for i, n in drawn.items() for _ in range(n)) and len(set(drawn.values())) > 1
