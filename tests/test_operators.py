from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logstrata.operators import aggregates, compare, context, events, filters, sampling, segment
from logstrata.operators.timeline import merged
from logstrata.scratch import with_rank
from logstrata.sources.lines import lines_of


@pytest.fixture(scope="module")
def as_lines(spark):
    def make(*texts):
        return lines_of(spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "id string, text string"), "id", "text")

    return make


def rows(records, *columns):
    return [tuple(r) for r in records.orderBy("source_id", "rec_no").select(*columns).collect()]


def test_lines(as_lines):
    got = [(r.line_no, r.line) for r in as_lines("a\r\nb\rc\n\nd\n").orderBy("line_no").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c"), (4, ""), (5, "d")]
    assert as_lines("", None).count() == 0


def test_paragraphs_windows_separators(as_lines):
    lines = as_lines("\na\nb\n\n \nc\n")
    assert rows(segment.by_paragraph(lines), "start_line", "end_line", "text") == [(2, 3, "a\nb"), (6, 6, "c")]
    assert rows(segment.by_window(as_lines("1\n2\n3\n4\n5"), 2), "rec_no", "text") == [(1, "1\n2"), (2, "3\n4"), (3, "5")]
    assert rows(segment.by_separator(as_lines("head\n> x\ny\n> z"), ">"), "start_line", "text") == [(1, "head"), (2, "> x\ny"), (4, "> z")]


def test_json_lines(as_lines):
    lines = as_lines('{"ts": "2024-01-02T03:04:05Z", "level": "INFO", "msg": "hi"}\n\n[1]\nnot json\n{"ts": null, "time": "2024-01-01 00:00:00"}\n{"time": 1700000000, "severity": 3}\n{"timestamp": 1700000000000}\n{"ts": true}\n{"ts": "soon"}')
    got = rows(segment.by_json(lines), "start_line", "ts", "fields")
    assert [g[0] for g in got] == [1, 3, 4, 5, 6, 7, 8, 9]
    assert got[0][1] == datetime(2024, 1, 2, 3, 4, 5) and got[0][2] == {"level": "INFO", "msg": "hi"}
    assert "parse_error" in got[1][2] and "raw_fallback" in got[2][2]
    assert got[3][1] is None and "timestamp_parse_error" not in got[3][2]
    assert got[4][1] == got[5][1] == datetime(2023, 11, 14, 22, 13, 20) and got[4][2]["level"] == "3"
    assert all("timestamp_parse_error" in g[2] for g in got[6:])


def test_declared_format(as_lines):
    layout = segment.Format(r"(?P<ts>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (?P<lvl>[A-Z]+)", ("%Y-%m-%d %H:%M:%S",))
    lines = as_lines("junk\n2024-01-02 03:04:05 INFO start\n  more\n2024-01-02 03:04:06 WARN end")
    got = rows(segment.by_format(lines, layout), "start_line", "end_line", "ts", "fields")
    assert got == [(1, 1, None, None), (2, 3, datetime(2024, 1, 2, 3, 4, 5), {"lvl": "INFO"}), (4, 4, datetime(2024, 1, 2, 3, 4, 6), {"lvl": "WARN"})]


def test_open_brackets_continue(as_lines):
    layout = segment.Format("> ", unclosed_start=True, max_lines=3)
    assert rows(segment.by_format(as_lines("> a {\n> b\n}\n> c\n> d (\n> e\n> f\n> g"), layout), "start_line", "end_line") == [(1, 3), (4, 4), (5, 7), (8, 8)]
    assert segment.balance("a(b[c)") == "(["


def test_detection(as_lines):
    got = {r.source_id: r.kind for r in segment.detect(as_lines('{"a":1}\n{"b":2}\nx', "plain\ntext")).collect()}
    assert got == {"s0": "jsonline", "s1": "rawtext"}


def timed(spark):
    data = [("s", i, i, i, f"line {i}", datetime(2024, 1, 1, 0, 0, t) if t is not None else None, None) for i, t in ((1, 10), (2, None), (3, 50), (4, 20))]
    return spark.createDataFrame(data, "source_id string, rec_no long, start_line long, end_line long, text string, ts timestamp_ntz, fields map<string,string>")


def test_time_scopes_keep_what_has_no_time(spark):
    records = timed(spark)
    got = [r.rec_no for r in records.where(filters.in_time(datetime(2024, 1, 1, 0, 0, 20), datetime(2024, 1, 1, 0, 0, 50))).orderBy("rec_no").collect()]
    assert got == [2, 3, 4]
    # The last time by line is 20 s, not the largest.
    assert [r.rec_no for r in filters.last(records, "10s").orderBy("rec_no").collect()] == [1, 2, 4]
    with pytest.raises(ValueError):
        filters.in_time(datetime(2024, 1, 2), datetime(2024, 1, 1))


def test_filter_with_provenance(as_lines):
    records = segment.by_window(as_lines("alpha\nbeta token\nidiot token", "gamma"), 10)
    scoped = filters.filter_text(records, "idiot|token")
    hit = filters.hits(scoped).first()
    assert (hit.term, hit.terms, hit.hit_lines) == ("token", ["idiot", "token"], [2, 3])
    summary = {r.source_id: (r.matched_records, r.warnings) for r in filters.summary(scoped).collect()}
    assert summary == {"s0": (1, []), "s1": (0, ["no hits", "mostly unmatched"])}


def test_clip_counts_what_it_cuts(spark):
    from logstrata.functions.text import clip

    got = [r[0] for r in spark.createDataFrame([("abcdefghijk",), ("abc",)], "t string").select(clip(F.col("t"), 5)).collect()]
    assert got == ["abcde …[+6 chars]", "abc"]


def test_samples(spark):
    assert sampling.positions(7, 4) == [0, 2, 4, 6] and sampling.positions(3, 9) == [0, 1, 2] and sampling.positions(5, 1) == [0]
    frame = spark.createDataFrame([(i, f"line-{i}") for i in range(1, 8)], "n long, text string")
    ranked = with_rank(frame, [F.col("n")])
    assert sorted(r.n for r in sampling.head_tail(ranked, 7, 4).collect()) == [1, 2, 6, 7]
    assert sorted(r.n for r in sampling.uniform(ranked, 7, 4).collect()) == [1, 3, 5, 7]
    short = spark.createDataFrame([(0, "hello world"), (1, "goodbye")], "rank long, text string")
    got = [(r.state, r.shown, r.omitted_chars) for r in sampling.char_budget(short, "rank", 5).orderBy("rank").collect()]
    assert got == [("clipped", "hello", 6), ("withheld", None, 7)]
    with pytest.raises(ValueError):
        sampling.sample(frame, [F.col("n")], "random")


def test_ranks_of_large_tables(spark):
    frame = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("k"), "id")
    ranked = with_rank(frame, [F.col("k"), F.col("id")]).collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: (r.k, r.id))] == list(range(5000))


def test_space_saving():
    sketch = aggregates.SpaceSaving(1)
    for key in ("a", "b", "c"):
        sketch.add(key)
    assert list(sketch.rows()) == [("c", 3, 1, 2)]


def test_fold_prefers_a_later_sample_with_its_term(spark):
    hits = spark.createDataFrame([(1, "took 1 ms", "took", None), (2, "took 2 ms", "took", None), (3, "other", None, None)], "o long, text string, term string, ts timestamp_ntz")
    got = {r.template: (r.records, r.matched_terms, r.sample) for r in aggregates.fold(hits, F.col("o")).collect()}
    assert got == {"took <NUM> ms": (2, ["took"], "took 2 ms"), "other": (1, [], "other")}


def test_windows_merge_when_they_touch(spark):
    marks = spark.createDataFrame([("s", 1, 1), ("s", 4, 4), ("s", 9, 10), ("t", 2, 2)], "source_id string, start_line long, end_line long")
    got = [(r.source_id, r.lo, r.hi, r.marks) for r in context.windows(marks, 1, 1).orderBy("source_id", "lo").collect()]
    assert got == [("s", 1, 5, 2), ("s", 8, 11, 1), ("t", 1, 3, 1)]


def test_lookup_reports_missing(spark):
    known = spark.createDataFrame([("evidence://sha256/x#L1", "s", 1, 1)], "uri string, source_id string, start_line long, end_line long")
    refs = spark.createDataFrame([("#L1",), ("#L2",), ("#L1",)], "ref string")
    assert {r.ref: r.missing for r in context.lookup(refs, known).collect()} == {"#L1": False, "#L2": True}


def test_merged_timeline(spark):
    a = spark.createDataFrame([(datetime(2024, 1, 2), 1, "x\ny"), (None, 2, "z")], "ts timestamp_ntz, ord long, text string")
    b = spark.createDataFrame([(datetime(2024, 1, 1), 1, "w")], "ts timestamp_ntz, ord long, text string")
    assert [r.text for r in merged([("A", a), ("B", b)]).collect()] == ["[A] z", "[B] w", "[A] x\n[A] y"]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id long, v string")
    assert {r.id: (r.change, r.fields) for r in compare.changes(old, new, ["id"], ["v"]).collect()} == {1: ("removed", ""), 2: ("changed", "v"), 3: ("same", ""), 4: ("added", "")}


def test_sequences_are_greedy(spark):
    data = [(u, i, datetime(2024, 1, 1, 0, m), k) for u, i, m, k in ((1, 1, 0, "a"), (1, 2, 5, "b"), (1, 3, 6, "a"), (1, 4, 7, "b"), (1, 5, 8, "c"), (2, 1, 0, "b"), (2, 2, 1, "a"))]
    frame = spark.createDataFrame(data, "user long, event_id long, ts timestamp_ntz, kind string")
    steps = [F.col("kind") == k for k in "abc"]
    full = events.sequence(frame, steps, ["user"]).collect()
    assert [(r.user, r.start_id, r.elapsed_sec) for r in full] == [(1, 1, 480.0)]
    # Within three minutes only the second start does.
    assert [(r.user, r.start_id) for r in events.sequence(frame, steps, ["user"], 180).collect()] == [(1, 3)]


def test_verdicts():
    rules = [{"id": "x", "type": "count", "min": 2}, {"id": "y", "type": "absent"}, {"id": "z", "type": "contains", "required": False}]
    assert events.verdict(rules, {"x": 2, "y": 0, "z": 0}) | {"rules": None} == {"satisfied": True, "missing": [], "rules": None}
    assert events.verdict(rules, {"x": 1, "y": 3, "z": 0})["missing"] == ["x", "y"]
    assert events.verdict([], {})["satisfied"]
    with pytest.raises(ValueError):
        events.verdict([{"id": "x", "type": "magic"}], {"x": 0})


def test_behaviour_moves_past_late_steps():
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    seen = [{"event_id": "1", "name": "a", "ts": at(0)}, {"event_id": "2", "name": "b", "ts": at(30)}, {"event_id": "3", "name": "c", "ts": at(31)}]
    out = events.behaviour(seen, [{"match": {"name": "a"}}, {"match": {"name": "b"}, "within": 5}, {"match": {"name": "c"}, "within": 5}])
    assert [s["matched"] for s in out["steps"]] == [True, False, True] and not out["satisfied"]


def test_records_of_a_source_of_many_runs(spark, monkeypatch):
    """Records go on across the borders of runs, and no window gathers a source."""
    monkeypatch.setattr(segment, "RUN", 7)
    text = "\n".join("head" if i % 11 == 3 else "" if i % 13 == 0 else f"line {i}" for i in range(200))
    lines = lines_of(spark.createDataFrame([("a", text), ("b", "x\nhead\ny")], "source_id string, text string"), "source_id", "text")
    separated = [(r.source_id, r.rec_no, r.start_line, r.end_line) for r in segment.by_separator(lines, "head").orderBy("source_id", "rec_no").collect()]
    heads = [i + 1 for i in range(200) if i % 11 == 3]
    ends = [h - 1 for h in heads] + [200]
    assert separated == [("a", n, a, b) for n, (a, b) in enumerate(zip([1, *heads], ends, strict=True), 1)] + [("b", 1, 1, 1), ("b", 2, 2, 3)]
    paragraphs = segment.by_paragraph(lines).where("source_id = 'a'").orderBy("rec_no").collect()
    assert [p.rec_no for p in paragraphs] == list(range(1, len(paragraphs) + 1)) and "\n".join(p.text for p in paragraphs).split("\n") == [x for x in text.split("\n") if x]
