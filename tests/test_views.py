"""Views, artifacts, command line and streams."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logstrata import cli
from logstrata.operators import aggregates, compare, filters, segment
from logstrata.plans import investigation, tools, views
from logstrata.sources import artifacts, sinks
from logstrata.sources.lines import lines_of
from logstrata.streaming import live


def result_of(n, **parts):
    evidence = [{"uri": f"evidence://sha256/{'0' * 64}#L{i}", "source_id": "s", "start_line": i, "end_line": i, "term": "ERROR", "text": f"line {i}\twith a tab"} for i in range(1, n + 1)]
    return tools.envelope("search", "ok", "supported", evidence=evidence, coverage={"scanned_lines": 9, "lines_scanned": 9}) | parts


def test_compact_views_fit_and_say_what_is_left_out():
    whole = views.compact(result_of(40))
    assert whole["shared"] == {"source_id": "s", "term": "ERROR"} and len(whole["evidence"]["rows"]) == 40 and whole["coverage"] == {"lines_scanned": 9}
    small = views.compact(result_of(40), 2000)
    assert small["status"] == "partial" and len(json.dumps(small)) < 2400 and small["coverage"]["shown"] + small["coverage"]["omitted"] == 40
    text = views.frame(small)
    assert text.startswith("@TCF 1 search status=partial outcome=supported") and "@SRC s" in text and "with a tab" in text
    assert all(line.count("\t") == 4 for line in text.splitlines() if line.startswith("evidence://"))
    assert views.render(result_of(1), {"text_frame": True}).startswith("@TCF 1") and json.loads(views.render(result_of(1), {}))["view"] == "compact"
    assert json.loads(views.render(result_of(1), {"structured": False}))["operation"] == "search"


def test_labels_are_shown_where_they_change():
    rows = [["a", 1], ["a", 2], ["b", 3], ["", 4], ["b", 5]]
    assert views.without_repeats(rows, 0) == ([["a", 1], ["", 2], ["b", 3], ["", 4], ["", 5]], None)
    assert views.without_repeats([["a"], ["a"]], 0) == ([[""], [""]], "a")


def test_scopes_and_metadata():
    assert views.scope_text({"last": "5m", "line_to": 9, "pid": "7"}) == "last=5m,lines=1-9,pid=7" and views.scope_text({}) is None
    assert views.bounded({"a": "x" * 300, "b": 1}) == {"a": "x" * 256, "a_truncated": True, "b": 1}
    survey = tools.envelope("survey", "ok", data={"templates": [{"template": "t", "sample": "long"}], "range": {}})
    assert views.brief(survey)["data"]["templates"] == [{"template": "t"}] and "evidence" in views.light(survey)


def test_artifacts_come_back(spark, tmp_path):
    lines = lines_of(spark.createDataFrame([("s", "ERROR 1 here\nfine\nERROR 2 here")], "source_id string, text string"), "source_id", "text")
    hits = filters.hits(filters.filter_text(segment.segment(lines, "rawtext"), "ERROR"))
    sinks.write_records(hits, f"{tmp_path}/records")
    sinks.write_hits(hits, f"{tmp_path}/hits")
    folded = aggregates.fold(hits, F.col("start_line"))
    assert not sinks.write_templates(folded, f"{tmp_path}/none", 2, 5) and sinks.write_templates(folded, f"{tmp_path}/templates", 2, 2)
    assert sorted(r.text for r in artifacts.read(spark, "records", f"{tmp_path}/records").collect()) == ["ERROR 1 here", "ERROR 2 here"]
    assert [r.start_line for r in artifacts.read(spark, "hits", f"{tmp_path}/hits").orderBy("start_line").collect()] == [1, 3]
    assert [(r.template, r.records) for r in artifacts.read(spark, "templates", f"{tmp_path}/templates").collect()] == [("ERROR <NUM> here", 2)]
    (tmp_path / "m.json").write_text('{"schema_version": 2}')
    assert artifacts.read_document("manifest", tmp_path / "m.json") == {"schema_version": 2}
    for kind in ("investigation", "nothing"):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.read_document(kind, tmp_path / "m.json")


def test_files_of_a_run(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, size long, sha256 string")
    states = compare.unchanged(files([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")]), files([("a", 1, "x"), ("b", 1, "y"), ("d", 1, "x")]))
    assert {r.path: r.state for r in states.collect()} == {"a": "same", "b": "modified", "c": "removed", "d": "added"}


def test_results_become_executions():
    state = investigation.create("why")
    name = investigation.attach_result(state, result_of(2, status="partial"))
    entry = next(e for e in state["executions"] if e["id"] == name)
    assert len(entry["evidence"]) == 2 and entry["flags"]["partial"] and not entry["flags"]["no_match"]


def test_core_verbs(spark, tmp_path, capsys):
    (tmp_path / "app.log").write_text("".join(f"2024-01-02 03:04:{i:02d} {'ERROR' if i % 5 == 0 else 'INFO'} {i}\n" for i in range(20)))
    log = f"file://{tmp_path}/app.log"

    def said(*argv):
        cli.main(list(argv))
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    found = said("filter", log, "ERROR", "--since", "03:04:05", "--output", f"{tmp_path}/out")
    assert found["sources"][0]["matched_records"] == 3 and found["scope"] == "time_from=03:04:05"
    assert artifacts.read(spark, "hits", f"{tmp_path}/out/hits").count() == 3
    assert said("segment", log)["records"] == 20 and said("source", log)["total"] == 1 and "file" in said("plugin")["sources"]


def test_streamed_counters_bound_the_truth(spark, tmp_path):
    rng = random.Random(3)
    true = Counter()
    for batch in range(4):
        words = [f"t{min(rng.randrange(40), rng.randrange(40))}" for _ in range(400)]
        true.update(words)
        (tmp_path / f"in{batch}.txt").write_text("\n".join(words))
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(f"file://{tmp_path}/in*.txt").select(F.col("value").alias("template"))
    query = live.top_templates(stream, f"file://{tmp_path}/counters", f"file://{tmp_path}/checkpoint", 15)
    assert live.run_for(query, 120)
    rows = spark.read.parquet(f"file://{tmp_path}/counters/counters_3").collect()
    assert len(rows) == 15 and all(r.records - r.count_error <= true[r.template] <= r.records for r in rows)
    assert {k for k, _ in true.most_common(3)} <= {r.template for r in rows}


def test_sketch_equals_its_definition():
    rng = random.Random(8)
    sketch, counts, since, clock = aggregates.SpaceSaving(7), {}, {}, 0
    for _ in range(3000):
        key = f"k{min(rng.randrange(30), rng.randrange(30))}"
        if key not in counts:
            start = 0
            if len(counts) >= 7:
                victim = min(counts, key=lambda k: (counts[k], since[k]))
                start = counts.pop(victim)
            counts[key], since[key], clock = start, clock, clock + 1
        counts[key] += 1
        sketch.add(key)
        assert sketch.counts == counts
