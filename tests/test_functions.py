from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logstrata.functions import patterns as P
from logstrata.functions import text as T
from logstrata.functions import times


@pytest.mark.parametrize(("pattern", "words"), [("a|b", ["a", "b"]), ("(?:a|b)|(?:c|d)", ["a", "b", "c", "d"]), (r"a\|b|c", ["a|b", "c"]), ("I |x", ["I", "x"]), (r"a\.b", ["a.b"]), ("a|", None), ("(a)", None), ("x.y", None), (r"\d", None), ("(?:a|)|b", None), ("(?:a|b)c", None), ("", None)])
def test_literal_vocabularies(pattern, words):
    assert P.literals(pattern) == words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab.|(*\\ 日", min_size=1, max_size=5).filter(lambda s: s.strip()), min_size=1, max_size=4))
def test_terms_survive_escaping(terms):
    assert P.literals(P.from_terms(terms)) == P.unique(terms)


@pytest.mark.parametrize("pattern", ["(a+)+", "(a|ab)*", r"(?:(a)\1)*", "(?:x+y)*", "a" * 5000, "(", "a{200000}", "(" * 70 + "a" + ")" * 70])
def test_unsafe_patterns_are_refused(pattern):
    with pytest.raises(P.PatternError):
        P.check(pattern)


@pytest.mark.parametrize("pattern", ["(a|b)*", "a{1,3}b*", r"\d+(?:\.\d+)?", "[a-z]+@[a-z]+", r"(\w+)\s\1", "(?P<ts>\\d+) x"])
def test_common_patterns_pass(pattern):
    assert P.check(pattern) == pattern


def test_first_term_ends_first(spark):
    terms = ["ab", "abc", "bc", "c", "日本"]
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc日本 ") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", P.first_term(F.col("text"), terms).alias("term"), P.terms_in(F.col("text"), terms).alias("terms")).collect()
    for r in got:
        ends = [(r.text.find(t) + len(t), -len(t), t) for t in terms if t in r.text]
        assert r.term == (min(ends)[2] if ends else None)
        assert r.terms == sorted(t for t in terms if t in r.text)


def test_literals_equal_the_regex(spark):
    frame = spark.createDataFrame([("ERROR x",), ("warn",), (None,), ("日志 error",)], "text string")
    for pattern in ("ERROR|日志", "error", "E.*R"):
        matcher = P.Matcher(pattern)
        got = [r[0] for r in frame.select(matcher.matched(F.col("text"))).collect()]
        plain = [r[0] for r in frame.select(F.coalesce(F.col("text").rlike(P.to_java(pattern)), F.lit(False))).collect()]
        assert got == plain


def test_components_name_their_hits(spark):
    parts = (P.Component("a", "err|fail"), P.Component("b", r"\d{3}"), P.Component("off", "x", effective=False))
    got = spark.createDataFrame([("err 404",), ("x only",)], "text string").select(P.Matcher(".*", parts).matched_by(F.col("text"))).collect()
    assert [r[0] for r in got] == [["a", "b"], ["pattern"]]


@pytest.mark.parametrize(("raw", "seconds"), [("60", 60), ("60s", 60), ("1.5 m", 90), ("2h", 7200), ("3 HOURS", 10800)])
def test_durations(raw, seconds):
    assert times.duration(raw) == timedelta(seconds=seconds)


def test_moments():
    reference = datetime(2026, 7, 25, 1, 2, 3)
    assert times.moment("18:42", reference) == datetime(2026, 7, 25, 18, 42)
    assert times.moment("2026-07-25T18:42:00+08:00", reference) == datetime(2026, 7, 25, 10, 42)
    assert times.moment("2026-07-25 18:42:00Z", reference) == datetime(2026, 7, 25, 18, 42)
    for bad in ("", "soon", "25:00", "5x"):
        with pytest.raises(times.TimeError):
            times.moment(bad, reference)
    with pytest.raises(times.TimeError):
        times.duration("5 days")


def test_timestamps_without_a_year(spark):
    frame = spark.createDataFrame([("Jul  1 10:00:00",), ("03-17 16:13:38.811",), ("nonsense",)], "t string")
    got = [r[0] for r in frame.select(times.parse(F.col("t"), ("%b %d %H:%M:%S", "%m-%d %H:%M:%S.%f"))).collect()]
    assert got == [datetime(1900, 7, 1, 10), datetime(1900, 3, 17, 16, 13, 38, 811000), None]


def test_templates_and_values(spark):
    text = "2024-01-02 03:04:05.678 from 10.0.0.1 id 0xdeadbeef took 12.5 ms  12345678"
    row = spark.createDataFrame([(text,)], "t string").select(T.template(F.col("t")).alias("k"), T.values(F.col("t")).alias("v")).first()
    assert row.k == "<TS> from <IP> id <HEX> took <NUM> ms <HEX>"
    assert [(v.tag, v.value) for v in row.v] == [("<IP>", "10.0.0.1"), ("<HEX>", "0xdeadbeef"), ("<HEX>", "12345678"), ("<TS>", "2024-01-02 03:04:05.678"), ("<NUM>", "12.5")]


def test_levels_and_labels(spark):
    frame = spark.createDataFrame([("x warning y", None), ("no level", "err"), ("ERR: disk", ""), ("quiet", None)], "t string, f string")
    assert [r[0] for r in frame.select(T.level(F.col("t"), F.col("f"))).collect()] == ["WARN", "ERROR", "ERROR", None]
    label = spark.createDataFrame([("\n  first  \nsecond",)], "t string").select(T.label(F.col("t"))).first()[0]
    assert label == "first"


def test_uris(spark):
    from logstrata.operators.context import parse_uri

    digest = "a" * 64
    uris = [f"evidence://sha256/{digest}#L3", f"evidence://sha256/{digest}#L3-L9", f"evidence://sha256/{digest}#L9-L3", "evidence://x#L1"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in uris], "u string").select(parse_uri(F.col("u"))).collect()]
    assert [(g.first, g.last) if g else None for g in got] == [(3, 3), (3, 9), None, None]
    assert list(itertools.islice(uris, 1)) == [spark.range(1).select(T.evidence_uri(F.lit(digest), F.lit(3), F.lit(3))).first()[0]]
