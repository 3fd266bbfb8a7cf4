from __future__ import annotations

import io
import json
import sys
import tarfile
import zipfile
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logstrata.plans import investigation as I
from logstrata.plans import knowledge, probe, scenario, tools
from logstrata.plans.runtime import Runtime
from logstrata.sources import archives, lines, registry, sinks
from logstrata.streaming import live

LAYOUTS = (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S,%f", "%b %d %H:%M:%S", "%d/%b/%Y:%H:%M:%S %z", "%a %b %d %H:%M:%S %Y",
    "%m-%d %H:%M:%S.%f", "%y%m%d %H%M%S", "%Y%m%d-%H:%M:%S:%f", "%y/%m/%d %H:%M:%S", "%H:%M:%S", "%d.%m.%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S",
)
TIMES = [datetime(2021, 3, 4, 5, 6, 7, 123456, tzinfo=UTC) + timedelta(days=k, hours=7 * k, microseconds=1001 * k) for k in range(30)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_are_induced(layout):
    lines = [f"{t.strftime(layout)} {('INFO', 'WARN')[t.day % 2]} unit {t.day} went on" for t in TIMES]
    report = probe.probe_lines([x for line in lines for x in (line, "  and a line that belongs to it")])
    assert report.recommended == "format" and report.confidence == 1.0 and report.layouts == (layout,)
    assert report.level["index"] == 0 and report.config["layouts"] == [layout]


def test_places_lower_confidence():
    stamp = "%d/%b/%Y:%H:%M:%S %z"
    bracket = probe.probe_lines([f"10.0.0.{t.day} [{t.strftime(stamp)}] served" for t in TIMES])
    assert bracket.recommended == "format" and bracket.confidence == 0.95 and "prefix" in bracket.start
    middle = probe.probe_lines([f"unit {t.strftime(LAYOUTS[0])} INFO x" for t in TIMES])
    assert middle.confidence < 0.9 and middle.config is None and "the time stands within the line" in middle.issues
    assert probe.probe_lines(['{"a": 1}'] * 3).recommended == "jsonline" and probe.probe_lines(["", " "]).recommended == "rawtext"
    assert probe.probe_lines(["no time", "at 25:61:61 none", "123456 654321"]).recommended == "rawtext"
    late = probe.probe_lines(["a heading"] + [t.strftime(LAYOUTS[0]) for t in TIMES])
    assert late.coverage == round(30 / 31, 4) and "lines before the first record" in late.issues


def test_every_source_has_its_own_report(spark):
    rows = [(f"s{k}", n, (t.strftime(LAYOUTS[k % 3]) + " x") if k % 4 else f'{{"k": {n}}}') for k in range(1200) for n, t in enumerate(TIMES[:3], 1)]
    found = probe.probe(spark.createDataFrame(rows, "source_id string, line_no long, line string").repartition(7))
    assert len(found) == 1200 and found["s4"].recommended == "jsonline" and found["s5"].layouts == (LAYOUTS[2],)


@pytest.fixture()
def log(tmp_path):
    path = tmp_path / "app.log"
    path.write_text("".join(f"2024-01-02 03:04:{i:02d} {'ERROR' if i % 5 == 0 else 'INFO'} request {i} from 10.0.0.{i}\n" for i in range(20)), encoding="utf-8")
    return f"file://{path}"


def test_search_expand_verify(spark, log):
    found = tools.search(spark, log, "ERROR")
    assert found["status"] == "ok" and found["data"]["matched_records"] == 4 and len(found["evidence"]) == 4
    assert tools.search(spark, log, "ERROR", since="03:04:06", until="03:04:10")["data"]["matched_records"] == 1
    assert tools.search(spark, log, "ERROR", span="6s")["data"]["matched_records"] == 1
    none = tools.search(spark, log, "absent")
    assert none["status"] == "no_match" and none["outcome"] == "unknown" and none["next_queries"]
    assert tools.search(spark, log, "(a+)+", regex=True)["status"] == "error"
    line = found["evidence"][1]["start_line"]
    shown = tools.expand(spark, log, line, before=1, after=1)["data"]["lines"]
    assert len(shown) == 3 and shown[1].startswith("6: 2024-01-02 03:04:05 ERROR")
    assert tools.expand(spark, log, 99)["status"] == "error" and tools.expand(spark, log, 1, expected_sha256="0" * 64)["status"] == "error"
    many = tools.expand_many(spark, found, log, [found["evidence"][0]["uri"], "#L1", "#L77"], before=0, after=1)
    assert many["data"]["missing"] == ["#L77"] and len(many["data"]["rows"]) == 2
    entry = tools.file_entry(log)
    assert tools.verify(spark, {"files": [entry]})["status"] == "ok"
    assert tools.verify(spark, {"files": [entry | {"sha256": "0"}, entry | {"path": log + ".gone"}]})["outcome"] == "contradicted"


def test_overviews(spark, log):
    out = tools.survey(spark, log)["data"]
    assert out["range"]["records"] == 20 and out["levels"] == [{"level": "INFO", "records": 16}, {"level": "ERROR", "records": 4}]
    assert out["templates"][0]["template"] == "<TS> INFO request <NUM> from <IP>" and [s["line"] for s in out["templates"][0]["samples"]] == [2, 3, 4]
    late = tools.survey(spark, log, since="03:04:10")["data"]
    assert late["range"]["records"] == 10 and late["whole_range"]["records"] == 20
    assert tools.probe(spark, log)["data"]["sources"][0]["lines"] == 20
    assert len(tools.sample(spark, log, strategy="uniform", count=4)["data"]["records"]) == 4
    assert next(iter(tools.probe_format(spark, log)["data"].values()))["recommended"] == "format"


def spec_of(log, rules=(), **parts):
    return {"schema_version": 2, "name": "errors", "source": {"path": log}, "filter": {"grep": "ERROR"}, "assert": {"rules": list(rules)}} | parts


def test_hooks_of_a_layout(spark, log):
    """A layout's header, token rule and tags take effect in folds and terms."""
    layout = {"type": "format", "start": r"^(?P<ts>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", "layouts": ["%Y-%m-%d %H:%M:%S"], "header_strip": r"\S+ \S+ \w+ ", "token": r"[a-z]{5,}", "normalizers": [[r"request \d+", "<REQ>"]]}
    folded = tools.search(spark, log, "ERROR", segmenter=layout, fold=True)
    assert [t["template"] for t in folded["data"]["templates"]] == ["<TS> ERROR <REQ> from <IP>"]
    assert tools.search(spark, log, "absent", segmenter=layout)["next_queries"] == ["request"]
    assert tools.survey(spark, log, segmenter=layout)["data"]["templates"][0]["template"] == "<TS> INFO <REQ> from <IP>"


def test_scenarios(spark, log, tmp_path):
    rules = [{"type": "count", "match": "ERROR", "exact": 4}, {"type": "absent", "match": "FATAL"}, {"type": "contains", "match": "request"}, {"type": "sequence", "events": ["request 5", "request 10"], "within": "5s"}]
    spec = spec_of(log, rules)
    out = scenario.run(spark, spec, str(tmp_path / "out"))
    assert out["data"]["verdict"] == "passed" and out["outcome"] == "supported" and out["data"]["segmenter"]["type"] == "format"
    assert json.loads((tmp_path / "out/manifest.json").read_text())["verdict"] == "passed" and "passed" in (tmp_path / "out/report.md").read_text()
    assert scenario.run(spark, spec_of(log, [{"type": "absent", "match": "ERROR"}]))["data"]["verdict"] == "failed"
    assert scenario.run(spark, spec_of(log, [{"type": "before", "first": "request 10", "then": "request 5"}]))["data"]["verdict"] == "failed"
    assert scenario.run(spark, spec_of(log + ".none"))["status"] == "error"
    assert scenario.run(spark, spec_of(log))["outcome"] == "not_assessed"
    assert scenario.explain(spec)[0].startswith("read file")
    for bad in (spec | {"extra": 1}, spec | {"schema_version": 1}, spec_of(log, [{"type": "x"}]), {"schema_version": 2}, spec | {"filter": {"preset": "unknown"}}, spec | {"filter": {}}, spec | {"filter": {"grep": "x", "sincee": "1"}}):
        with pytest.raises(scenario.ScenarioError):
            scenario.validate(bad)


def test_scenario_scopes_stages_and_presets(spark, log):
    runtime = Runtime(presets={"warm": ("INFO", "tag")}, assertions={"few": lambda rule, events: events.limit(3).count()})
    scoped = scenario.run(spark, spec_of(log, filter={"grep": "request", "since": "03:04:15"}))["data"]
    assert scoped["scoped_records"] == scoped["matched_records"] == 5
    assert scenario.run(spark, spec_of(log, filter={"grep": "request", "until": "2024-01-02 03:04:03", "line_from": 2}))["data"]["matched_records"] == 3
    staged = scenario.run(spark, spec_of(log, [{"type": "few", "max": 3}], filter={"last": "9s", "stages": [{"name": "a", "preset": "warm"}, {"grep": "ERROR", "preset": "warm"}]}), runtime=runtime)["data"]
    assert [s["matched_records"] for s in staged["stages"]] == [8, 10] and staged["verdict"] == "passed"
    with pytest.raises(scenario.ScenarioError):
        scenario.run(spark, spec_of(log, filter={"preset": "cold"}), runtime=runtime)


def test_scenario_assertions_of_each_source(spark, tmp_path):
    for name, layout, word in (("a", LAYOUTS[0], "ERROR"), ("b", LAYOUTS[4], "ERROR"), ("c", LAYOUTS[7], "fine")):
        (tmp_path / f"{name}.log").write_text("".join(f"{t.strftime(layout)} {word} {t.day}\n  more\n" for t in TIMES[:12]), encoding="utf-8")
    rules = [{"name": "some", "type": "count", "match": "error", "min": 1}]
    out = {scope: scenario.run(spark, spec_of(f"file://{tmp_path}", rules, **{"assert": {"scope": scope, "ignore_case": True, "rules": rules}}))["data"] for scope in scenario.SCOPES}
    assert [out[s]["verdict"] for s in ("aggregate", "per_source", "both")] == ["passed", "failed", "failed"]
    assert [r["satisfied"] for r in out["both"]["assertions"]["per_source"]] == [True, True, False]
    # Every source was cut by its own layout.
    assert out["aggregate"]["scoped_records"] == 36 and len(out["aggregate"]["segmenter"]) == 3
    assert tools.search(spark, f"file://{tmp_path}", "ERROR")["data"]["matched_records"] == 24


def test_only_the_runtime_gives_leave(spark, log, tmp_path):
    live = {"type": "live", "cmd": [sys.executable, "-c", "print('ERROR here')"], "output_path": str(tmp_path / "said")}
    with pytest.raises(scenario.ScenarioError):
        scenario.run(spark, spec_of(log, source=live))
    assert scenario.run(spark, spec_of(log, source=live), runtime=Runtime(allow_live=True))["data"]["matched_records"] == 1
    write = {"name": "note", "run": [sys.executable, "-c", "import os; open(os.environ['LOGSTRATA_OUTPUT_DIR'] + '/x', 'w')"]}
    with pytest.raises(scenario.ScenarioError):
        scenario.run(spark, spec_of(log, actions=[write]))
    allowed = Runtime(allow_actions=True)
    runs = [scenario.run(spark, spec_of(log, actions=[write | more]), str(tmp_path / f"o{i}"), allowed)["data"] for i, more in enumerate(({"outputs": ["x"]}, {}, {"outputs": ["x", "y"]}))]
    assert [r["verdict"] for r in runs] == ["passed", "failed", "failed"]


def test_format_self_check(spark, log):
    wrong = {"type": "format", "start": r"^(?P<ts>\d{4}/\d{2}/\d{2})"}
    out = scenario.run(spark, spec_of(log, parse={"segmenter": wrong}))
    assert any("20 of 20" in w for w in out["warnings"])


def test_charset_and_large_files(spark, tmp_path, monkeypatch):
    (tmp_path / "latin.log").write_bytes("na\xefve ERROR\n".encode("latin-1"))
    source = {"path": f"file://{tmp_path}/latin.log", "preprocess": [{"action": "charset", "from": "ISO-8859-1"}]}
    assert scenario.run(spark, spec_of("", filter={"grep": "na\xefve"}, source=source))["data"]["matched_records"] == 1
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(5000)), encoding="utf-8")
    monkeypatch.setattr(registry, "LARGE", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = registry.build_source(spark, {"path": f"file://{tmp_path}/big.log"})
        assert found.rdd.getNumPartitions() > 1
        assert sorted((r.line_no, r.line) for r in found.collect()) == [(i + 1, f"line {i}") for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_files_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"{i} {'x' * 80}\n" for i in range(1, 4001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = lines.read_large(spark, f"file://{path}")
        assert got.where(F.col("line_no") != F.split("line", " ")[0].cast("long")).count() == 0 and got.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _zip(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in entries:
            archive.writestr(name, data)
    return buffer.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "logs.bin").write_bytes(_zip([("a/x.log", b"one\ntwo"), ("y.log", b"three")]))
    got = registry.build_source(spark, {"type": "archive", "path": f"file://{tmp_path}/logs.bin"})
    assert sorted(r.line for r in got.collect()) == ["one", "three", "two"]
    for entries in ([("../x", b"")], [("/x", b"")], [("a", b"1"), ("./a", b"2")], [("a", b"0" * 5_000_000)]):
        with pytest.raises(archives.ArchiveError):
            list(archives.members(_zip(entries)))
    with pytest.raises(archives.ArchiveError):
        list(archives.members(_zip([("a", b"1"), ("b", b"2")]), archives.Limits(members=1)))
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        archive.addfile(link)
    with pytest.raises(archives.ArchiveError):
        list(archives.members(buffer.getvalue()))


def test_sources_and_steps(spark, tmp_path):
    for name, text in (("a.log", "keep 1\ndrop"), ("b.txt", "keep 2"), ("sub/c.log", "keep 3")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = registry.build_source(spark, {"type": "dir", "path": f"file://{tmp_path}", "glob": "*.log", "recursive": True})
    kept = registry.preprocess(got, [{"action": "grep", "pattern": "keep"}])
    assert sorted(r.line for r in kept.collect()) == ["keep 1", "keep 3"]
    with pytest.raises(lines.SourceError):
        registry.build_source(spark, {"type": "nothing"})
    with pytest.raises(lines.SourceError):
        lines.resolve_paths(spark, f"file://{tmp_path}/none*")
    with pytest.raises(lines.SourceError):
        registry.build_source(spark, {"type": "live", "cmd": ["true"], "output_path": str(tmp_path / "o")})
    live_lines = registry.build_source(spark, {"type": "live", "cmd": [sys.executable, "-c", "print('hi')"], "output_path": str(tmp_path / "o")}, allow_live=True)
    assert [r.line for r in live_lines.collect()] == ["hi"]


def test_segment_catalogue(spark):
    schema = "start timestamp_ntz, end timestamp_ntz, path string, bytes long, lines long"
    first = {"start": datetime(2024, 1, 1), "end": datetime(2024, 1, 2), "path": "s.log", "bytes": 1, "lines": 1}
    catalogue = registry.append_segment(spark.createDataFrame([first], schema), first | {"start": datetime(2024, 1, 5), "end": datetime(2024, 1, 6)})
    assert sorted(r.path for r in catalogue.collect()) == ["s.log", "s_1.log"]
    assert [r.path for r in registry.segments_between(catalogue, datetime(2024, 1, 4), datetime(2024, 1, 9)).collect()] == ["s_1.log"]


def test_ledger_and_layout(tmp_path):
    ledger = sinks.Ledger(tmp_path)
    name = ledger.put({"operation": "search", "status": "ok", "evidence": []})
    assert ledger.get(name)["status"] == "ok" and ledger.put({"operation": "search", "status": "no_match"}) is None
    file = next(Path(tmp_path).rglob(f"{name}.json"))
    file.write_text(file.read_text().replace("ok", "no"))
    with pytest.raises(ValueError):
        ledger.get(name)
    assert sinks.layout({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_investigation(spark, tmp_path):
    state = I.create("why", budget={"max_operations": 2})
    h, g = I.add_hypothesis(state, "disk"), I.add_hypothesis(state, "net")
    t, u = I.add_test(state, h, "look"), I.add_test(state, h, "look again")
    I.record_execution(state, "search", "ok", t, ["evidence://sha256/x#L1"], {"truncated": True})
    I.record_execution(state, "search", "error")
    got = {(r.gap, r.id) for r in I.gaps(I.tables(spark, state)).collect()}
    assert {("unresolved_hypotheses", h), ("untested_hypotheses", g), ("untested_tests", u), ("finding_gaps", h)} <= got and ("untested_tests", t) not in got
    before = I.tables(spark, json.loads(json.dumps(state)))
    with pytest.raises(I.InvestigationError):
        I.add_finding(state, h, "supported", [t], [])
    finding = I.add_finding(state, h, "supported", [t], ["e"])
    with pytest.raises(I.InvestigationError):
        I.add_test(state, h, "late")
    first = I.propose_candidate(state, finding, "disks fail")
    assert I.propose_candidate(state, finding, "disks fail") == first
    assert I.validate(state)["hypotheses"][0]["tests"] == [t, u]
    kinds = {(r.entity, r.change) for r in I.differences(before, I.tables(spark, state)).collect()}
    assert kinds == {("hypotheses", "changed"), ("findings", "added"), ("candidates", "added")}
    assert [r.kind for r in I.entries(I.tables(spark, state)).collect()][0] == "hypothesis"
    name = I.reserve(state, {"operations": 2})
    with pytest.raises(I.InvestigationError):
        I.reserve(state, {"operations": 1})
    assert state["status"] == "open"
    I.settle(state, name, {"operations": 2})
    with pytest.raises(I.InvestigationError):
        I.reserve(state, {"operations": 1})
    assert state["status"] == "stopped" and state["stop"]["kind"] == "budget_reached"
    state["tests"][0]["hypothesis"] = "gone"
    with pytest.raises(I.InvestigationError):
        I.validate(state)


def test_cache(tmp_path):
    cache = I.Cache(tmp_path / "c.json")
    key = cache.key("search", {"q": 1}, "digest")
    assert cache.put("search", key, {"hits": 3}) and cache.get(key) == {"hits": 3}
    assert not cache.put("survey", key, {}) and not cache.put("search", "k", "x" * (600 << 10))
    (tmp_path / "c.json").write_text((tmp_path / "c.json").read_text().replace('"hits": 3', '"hits": 4'))
    assert cache.get(key) is None


def test_knowledge(tmp_path):
    store = knowledge.Store(tmp_path / "k.json")
    name = store.propose("s", ["e"], "ann")
    assert store.verify(name, "c1", True, ["e"]) == "proposed" and store.verify(name, "c2", True, ["e"]) == "verified"
    with pytest.raises(knowledge.KnowledgeError):
        store.verify(name, "c2", False, [])
    with pytest.raises(knowledge.KnowledgeError):
        store.promote(name, "ann")
    store.promote(name, "bob", expires_at="2030-01-01T00:00:00+00:00", stale_after="2029-01-01")
    at = lambda y: datetime(y, 6, 1, tzinfo=UTC)
    assert [store.validity(name, at(y)) for y in (2028, 2029, 2030)] == ["current", "stale", "expired"]
    newer = store.propose("t", ["e"], "ann", supersedes=name)
    assert store.validity(name, at(2028)) == "current" and store.validity(newer, at(2028)) == "not_promoted"
    for case in ("c3", "c4"):
        store.verify(newer, case, True, ["e"])
    store.promote(newer, "bob")
    assert store.validity(name, at(2028)) == "superseded" and [c["id"] for c in store.candidates("verified")] == [newer]
    contradicted = store.propose("u", ["e"], "ann")
    assert store.verify(contradicted, "c1", False, []) == "contradicted"
    target = tmp_path / "t.txt"
    target.write_text("x")
    store.register_target("t", str(target))
    assert store.check_target("t") == "ok" and store.check_target("none") == "unmanaged"
    target.write_text("y")
    assert store.check_target("t") == "modified" and store.check_target("t", str(tmp_path / "z")) == "path_mismatch"
    assert knowledge.migrate({"schema_version": 1, "candidates": [{}]})["schema_version"] == 2


def test_live_tail_is_sealed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("one\ntwo\n")
    sealed = []
    for _ in range(2):
        live.seal(live.tail(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state", lambda n, p, c: sealed.append((n, c))).awaitTermination()
    assert sealed == [(0, 2)]


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "a") for m in (0, 1, 59)] + [(None, "a")], "ts timestamp_ntz, k string")
    assert [(r.start.minute, r.records) for r in live.window_counts(rows, "30 minutes", ["k"]).orderBy("start").collect()] == [(0, 2), (30, 1)]
    assert [r.records for r in live.sessions(rows, "10 minutes", ["k"]).orderBy("start").collect()] == [2, 1]
