"""Brute-force versions of the text operators on a small corpus."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logstrata.llm import editprint, graph, leaders, linejoin, minhash, mixing, substring, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in list(parent)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té Z", max_size=30)), max_size=8))
def test_words_of_any_texts(texts):
    data, offsets = textkit.texts(pa.array(texts, pa.string()))
    start, end, h, first = textkit.words(data, offsets)
    seen = {}
    for i, text in enumerate(texts):
        expected = WORD.findall(text or "")
        spans = list(range(int(first[i]), int(first[i + 1])))
        assert [bytes(data[start[j] : end[j]]).decode() for j in spans] == expected
        for word, j in zip(expected, spans, strict=True):
            assert seen.setdefault(word, h[j]) == h[j]
    assert len(set(seen.values())) == len(seen)


def test_words_longer_than_a_chunk():
    texts = ["x" * (textkit.CHUNK + 5) + " y", "z " * textkit.CHUNK]
    data, offsets = textkit.texts(pa.array(texts))
    _, _, h, first = textkit.words(data, offsets)
    assert list(np.diff(first)) == [2, textkit.CHUNK] and len(set(h.tolist())) == 3


def kept_words(rows):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - 12) if d is not None and least[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup_against_all_windows(make_docs, corpus, monkeypatch):
    expected = kept_words(corpus)
    assert sum(r[2] for r in expected) > 200
    found = sorted((tuple(r) for r in substring.repeats(make_docs(corpus, clash=True)).collect()), key=repr)
    assert found == expected


def test_substring_dedup_of_nothing(make_docs):
    assert substring.repeats(make_docs([])).collect() == []
    only = substring.repeats(make_docs([(1, None), (2, "")])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in only) == [(1, 0, 0), (2, 0, 0)]


def shingle_set(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_minhash_groups_against_all_pairs(make_docs, corpus):
    sets = [(d, shingle_set(t)) for d, t in corpus]
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    part = components(links)
    assert len(links) > 20
    expected = sorted(((d, len(s), None if d is None else part.get(d, d), d is None or part.get(d, d) == d) for d, s in sets), key=repr)
    found = sorted((tuple(r) for r in minhash.groups(make_docs(corpus, clash=True)).collect()), key=repr)
    assert found == expected


def test_minhash_dedup_keeps_one_of_each_group(make_docs, corpus):
    docs = make_docs(corpus, clash=True)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {r.doc_id: r.component_id for r in minhash.groups(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted({c for c in groups.values() if c is not None})
    assert minhash.groups(make_docs([])).collect() == []


def test_minhash_dedup_of_repeated_and_null_ids(make_docs):
    words = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(words), " ".join(["new", *words[1:]]), " ".join(reversed(words))
    rows = [(1, a), (5, other), (5, near), (5, other), (None, a), (None, a), (7, None), (8, "")]
    marked = minhash.groups(make_docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in marked) == [(0, True), (0, True), (1, True), (5, False), (5, True), (5, True), (7, True), (8, True)]
    kept = sorted(((r.doc_id, r.text) for r in minhash.deduplicate(make_docs(rows)).collect()), key=repr)
    assert kept == sorted([(1, a), (5, other), (None, a), (None, a), (7, None), (8, "")], key=repr)


def test_minhash_recall_at_the_threshold():
    """Of sets at similarity 0.75 exactly at most one pair in a thousand shares no table."""
    rng = np.random.default_rng(6)
    pairs = [(x[:70], np.concatenate([x[:60], x[70:80]])) for x in rng.integers(1, 1 << 62, (6000, 80)).astype(np.uint64)]
    pairs = [(x, y) for x, y in pairs if 100 * len(np.intersect1d(x, y)) == 75 * len(np.union1d(x, y))]
    assert len(pairs) > 5900
    left, right = (minhash.half_keys([p[k] for p in pairs], minhash.HALVES, minhash.ROWS) for k in (0, 1))
    same = left == right
    met = same[:, : minhash.HALVES].any(axis=1) & same[:, minhash.HALVES :].any(axis=1)
    assert (~met).sum() <= 6


def test_odd_sketches_never_refute_a_link():
    rng = np.random.default_rng(3)
    sets, blobs = [], []
    for size in (1, 2, 5, 31, 33, 64, 65, 300, 1000):
        base = rng.integers(1, 1 << 62, size).astype(np.uint64)
        for k in range(6):
            sets.append(np.unique(np.concatenate([base[: max(1, size - k * size // 20)], rng.integers(1, 1 << 62, k * size // 25).astype(np.uint64)])))
    blobs = [bytes(8 * minhash.HALVES) + b for b in minhash.sketches(sets)]
    i, j = np.triu_indices(len(sets), 1)
    close = minhash.maybe_alike(75, minhash.HALVES)(blobs, None)(i, j)
    true = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert ((true >= 0.75) <= (close >= true - 1e-12)).all() and (close[true < 0.5] < 0).mean() > 0.9


def test_lost_leader_links_are_found(make_docs):
    """Copies whose edits add up: neighbours are alike, the ends are not."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for step in range(12):
        for k in range(4):
            words[(step * 9 + k) % 120] = f"new{step}x{k}"
        rows.append((step, " ".join(words)))
    sets = dict((d, shingle_set(t)) for d, t in rows)
    assert 100 * len(sets[0] & sets[11]) < 75 * len(sets[0] | sets[11])
    part = components([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    found = {r.doc_id: r.component_id for r in minhash.groups(make_docs(rows)).collect()}
    assert found == {d: part.get(d, d) for d in sets}


def test_shared_keys_of_long_and_short_runs(spark):
    """Runs of one, of two and over several batches of 10 000 entries."""
    rng = np.random.default_rng(3)
    entries = [(7, i) for i in range(25_000)] + [(-4, 5), (-4, 3)] + [(int(k), int(i)) for k, i in zip(rng.integers(100, 3000, 2000), rng.permutation(2000), strict=True)]
    keys = spark.createDataFrame(pa.table({"key": [k for k, _ in entries], "id": [i for _, i in entries]}))
    members = defaultdict(list)
    for k, i in entries:
        members[k].append(i)
    expected = sorted((k, i, min(own)) for k, own in members.items() if len(own) > 1 for i in own)
    assert sorted(tuple(r) for r in leaders.shared_keys(keys).collect()) == expected
    assert leaders.shared_keys(keys.where("key = 1")).collect() == []


def test_only_keys_that_left_candidates_out_go_on(spark, monkeypatch):
    """One key of many members, whose pairs take two rounds, and many keys of two."""
    monkeypatch.setattr(leaders, "MOST", 4)
    members = [(1, i) for i in range(12)] + [(100 + 20 * i + k, x) for i in range(12) for k in range(5) for x in (i, 50 + k)]
    keys, ids = spark.createDataFrame(members, "key long, id long"), sorted({i for _, i in members})
    payloads = spark.createDataFrame([(i, i.to_bytes(8, "little")) for i in ids], "id long, payload binary")
    sent = []
    blocks = leaders._blocks
    monkeypatch.setattr(leaders, "_blocks", lambda m, *rest: (sent.append(sorted({r.key for r in m.collect()})), blocks(m, *rest))[1])

    def near(blobs, _keys):
        own = np.array([int.from_bytes(b, "little") for b in blobs])
        return lambda i, j: np.where((own[i] < 12) & (own[j] < 12), 1.0 / (1 + np.abs(own[i] - own[j])), -1.0)

    tried = []

    def verify(pairs):
        found = [(r.a, r.b) for r in pairs.collect()]
        tried.extend((min(x), max(x)) for x in found)
        return spark.createDataFrame([x for x in found if sum(x) == 11 and max(x) > 9], "a long, b long")

    found = {r.node: r.component for r in leaders.joined_components(keys, payloads, near, verify).collect()}
    assert found == {0: 0, 11: 0, 1: 1, 10: 1}
    assert {(i, j) for i in range(12) for j in range(i + 1, 12)} - {(0, 1), (0, 10), (1, 11), (10, 11)} <= set(tried)
    assert len(sent) >= 2 and sent[1:] == [[1]] * (len(sent) - 1)


def test_fingerprints_alone_are_not_sent(make_docs, spark, monkeypatch):
    """Only rows whose fingerprint is repeated or linked are joined to groups."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(900)) for _ in range(40)]
    rows = list(enumerate([*texts, texts[0], texts[1][:-1] + "#", None, ""]))
    seen = {}
    real = editprint._components

    def noted(prints, least):
        groups, alone = real(prints, least)
        seen["sent"], seen["alone"] = groups.count(), sum(bin(w & (1 << 64) - 1).count("1") for r in alone.collect() for w in r.words)
        return groups, alone

    monkeypatch.setattr(editprint, "_components", noted)
    found = {r.doc_id: r.component_id for r in editprint.near_groups(make_docs(rows)).collect()}
    assert found == {**{d: d for d in range(40)}, 40: 0, 41: 1, 42: 42, 43: 42}
    assert seen == {"sent": 3, "alone": 38}


@pytest.mark.parametrize("few", [0, 40, 1 << 20])
def test_components_of_chains_and_stars(spark, few):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 300) if k % 60] + [(5000, 5000 + k) for k in range(200)] + [(rng.randrange(10**6, 10**6 + 300), rng.randrange(10**6, 10**6 + 300)) for _ in range(200)] + [(7, 7), (-5, 3)]
    part = components([p for p in links if p[0] != p[1]])
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "x long, y long"), few).collect()}
    assert found == part
    assert graph.components(spark.createDataFrame([], "x long, y long"), few).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12), st.integers(0, 4))
def test_banded_distance(a, b, most):
    assert linejoin.within(a, b, most) == (edits(a, b) <= most)


def line_rows():
    base = "the quick brown fox jumps over the lazy dog and runs away from all of it and then some more of it"
    lines = [base, base.replace("quick", "quack"), base + "!", base[2:], base.upper(), "short", "short", "shore", " ", "", base.replace("lazy", "l") + "xx"]
    chain = [base + " one" + "z" * k for k in range(0, 9, 2)]
    middle = "a line of forty-nine characters, and not one more"
    odd = [middle, middle.replace("forty", "farty"), middle[:39], middle[:38] + "x", "x" * 100, "x" * 101, "x" * 104, base * 80, base * 80 + "y" * 90, base * 80 + "z" * 300]
    return [(1, "\n".join(lines[:4])), (2, "\n".join(lines[4:])), (3, None), (4, ""), (5, "\n".join(chain)), (6, "\n".join(lines[:2])), (6, "\n".join(lines[:2])), (7, "\n".join(odd)), (None, base + "\nalone in its document, with nothing like it anywhere else at all")]


def allowed(a, b, per_edit):
    return min(len(a), len(b)) // per_edit


def expected_lines(rows, per_edit=linejoin.PER_EDIT):
    lines = [((d if d is not None else 1 << 62, i, k), d, t) for i, (d, text) in enumerate(rows) if text is not None for k, t in enumerate(text.split("\n"))]
    texts = sorted({t for _, _, t in lines if WORD.search(t)})
    part = components([(a, b) for a in texts for b in texts if a < b and abs(len(a) - len(b)) <= allowed(a, b, per_edit) and edits(a, b) <= allowed(a, b, per_edit)])
    first = {}
    for place, _, t in lines:
        if WORD.search(t):
            c = part.get(t, t)
            first[c] = min(place, first.get(c, place))
    return [(d, place[2], len(t), first[part.get(t, t)][:3] == place if WORD.search(t) else True) for place, d, t in lines]


def test_line_classes_against_all_pairs(make_docs):
    rows = line_rows()
    found = linejoin.classes(make_docs(rows, clash=True)).collect()
    got = sorted(((r.doc_id, r.line_no, r.n_chars, r.kept) for r in found), key=repr)
    assert got == sorted(expected_lines(rows), key=repr)
    assert {(r.first_doc, r.first_line) for r in found if r.n_chars >= 50 and r.doc_id in (1, 6)} == {(1, 0)}
    # Five lines, each two edits from the one before, are one class.
    assert {(r.first_doc, r.first_line) for r in found if r.doc_id == 5} == {(5, 0)}


def test_line_dedup_returns_documents(make_docs):
    rows = line_rows()
    docs = make_docs(rows, clash=True)
    out = linejoin.apply(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = defaultdict(list)
    for r in out.collect():
        texts[r.doc_id].append(r.text)
    assert texts[1] == [rows[0][1].split("\n")[0]] and texts[3] == [None] and texts[4] == [""] and texts[6] == ["", ""]
    assert texts[None] == ["alone in its document, with nothing like it anywhere else at all"]
    assert linejoin.classes(make_docs([])).collect() == []


def changed(rng, a, most):
    """``a`` with at most ``most`` edits, evenly spread, which leaves the shortest equal stretches."""
    b = list(a)
    for k in range(most):
        at = min(len(b) - 1, (2 * k + 1) * len(a) // (2 * most))
        match rng.randrange(3):
            case 0:
                b[at] = rng.choice("xyz")
            case 1:
                b.insert(at, rng.choice("xyz"))
            case _:
                b.pop(at)
    return "".join(b)


@pytest.mark.parametrize("per_edit,gram", [(40, 20), (20, 14), (10, 5)])
def test_near_lines_share_an_index_key(per_edit, gram):
    """Of two lines as far apart as allowed one probes a segment of the other, at like places and lengths."""
    rng = random.Random(3)
    pairs = []
    for n in range(300):
        a = "".join(rng.choice("abcde ") for _ in range(rng.choice([per_edit, per_edit + 1, 2 * per_edit - 1, 2 * per_edit, 5 * per_edit, 9 * per_edit + 3, 33 * per_edit, rng.randint(per_edit, 20 * per_edit)])))
        b = changed(rng, a, rng.randint(0, len(a) // per_edit))
        if min(len(a), len(b)) >= per_edit and edits_within(a, b, allowed(a, b, per_edit)):
            pairs.append((a, b))
    found = defaultdict(list)
    for line, key, place, length, indexed in linejoin.keys_of([t for p in pairs for t in p], per_edit, gram):
        for row in zip(line.tolist(), key.tolist(), place.tolist(), length.tolist(), indexed.tolist(), strict=True):
            found[row[0]].append(row[1:])
    assert len(pairs) > 200
    kinds = linejoin.classes_of(per_edit, gram)
    for n, t in enumerate(t for p in pairs for t in p):
        kind = np.searchsorted(kinds.first, len(t), "right") - 1
        assert len(found[n]) <= 2 * len(t) and all(place * kinds.quantum[max(kind - 1, 0)] < len(t) for _, place, _, _ in found[n])
    for k in range(len(pairs)):
        x, y = found[2 * k], found[2 * k + 1]
        assert any(u[0] == v[0] and abs(u[1] - v[1]) <= 1 and abs(u[2] - v[2]) <= 1 and (u[3] or v[3]) for u in x for v in y)
        assert all(p < 1024 and n < 32 for _, p, n, _ in x + y) or gram < 20


def edits_within(a, b, most):
    return abs(len(a) - len(b)) <= most and linejoin.within(a, b, most)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", min_size=1, max_size=90), st.lists(st.tuples(st.integers(0, 89), st.sampled_from("dir")), max_size=9), st.integers(1, 31)), min_size=1, max_size=5))
def test_banded_words_against_the_table(cases):
    x, y, most = [], [], []
    for a, changes, k in cases:
        b = list(a)
        for at, kind in changes:
            b[at : at + (kind != "i")] = [] if kind == "d" else ["c"]
        a, b = sorted((a, "".join(b)), key=len, reverse=True)
        if len(a) - len(b) <= k:
            x.append(a)
            y.append(b)
            most.append(k)
    codes = [[np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in side] for side in (x, y)]
    got = linejoin.banded(*codes, np.array(most, np.int64)).tolist()
    assert got == [edits(a, b) <= k for a, b, k in zip(x, y, most, strict=True)]


@pytest.mark.parametrize("words", [2, 4])
def test_wide_bands_against_the_bits_of_whole_lines(words):
    rng = random.Random(words)
    x, y, most = [], [], []
    while len(x) < 60:
        k = rng.randint(16 * words, 32 * words - 1)
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(200, 900)))
        b = changed(rng, a, max(1, min(len(a) // 3, k + rng.randint(-12, 12))))
        a, b = sorted((a, b), key=len, reverse=True)
        if len(a) - len(b) <= k:
            x.append(a)
            y.append(b)
            most.append(k)
    codes = [[np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in side] for side in (x, y)]
    got = (linejoin._wide_distances(*codes, np.array(most), words) <= np.array(most)).tolist()
    assert got == [linejoin.within(a, b, k) for a, b, k in zip(x, y, most, strict=True)] and 5 < sum(got) < 55


def test_groups_as_wholes_against_all_pairs():
    """Copies of copies with word-long edits, near and far, joined in place."""
    rng = random.Random(21)
    base = "".join(rng.choice(["th", "er", "on", "an", "ing", " ", ", "]) for _ in range(260))[:520]
    lines = [base]
    for _ in range(150):
        b = list(rng.choice(lines))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b) - 9)
            b[at : at + rng.randint(0, 8)] = rng.choice(["", "new", "x", "another"])
        lines.append("".join(b))
    lines = sorted({*lines, "short line", "y" * 70, "y" * 71, *[base * 9 + "z" * k for k in (0, 60, 90, 400)]})
    rng.shuffle(lines)
    per = linejoin.PER_EDIT
    wanted = components([(a, b) for a in lines for b in lines if a < b and edits_within(a, b, allowed(a, b, per))])
    parts = leaders.Parts(np.arange(2 * len(lines)))
    both = [t.encode() for t in lines] * 2
    found = list(linejoin.joining(per)(both, parts, np.array([0, len(lines)])))
    assert all(((i < len(lines)) == (j < len(lines))).all() for i, j in found)
    links = [((lines * 2)[a], (lines * 2)[b]) for i, j in found for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert components(links) == wanted and len(set(wanted.values())) > 1 and all(edits_within(a, b, allowed(a, b, per)) for a, b in links) and len(links) < 2 * len(lines)


def test_line_threshold_grows_with_length(make_docs):
    """Near copies with several edits, at and just over the threshold, against all pairs; short, empty and very long lines among them."""
    rng = random.Random(11)
    syllables = ["th", "er", "on", "an", "ing", "re", "tion", " ", ", ", "é", "𝒳"]
    texts = ["", "x", "xy"]
    for i in range(27):
        size = (39, 40, 49, 79, 80, 121, 280, 335, 1700)[i % 9]
        a = "".join(rng.choice(syllables) for _ in range(size))[:size]
        texts.append(a)
        for more in (0, 0, 1):
            most = size // 40 + more
            texts.append(changed(rng, a, most if more else rng.randint(0, most)))
    texts = sorted({t for t in texts if "\n" not in t})
    per = linejoin.PER_EDIT
    linked = [(a, b) for a in texts for b in texts if a < b and edits_within(a, b, allowed(a, b, per))]
    part = components(linked)
    assert len(linked) > 20
    rows = [(i, t) for i, t in enumerate(texts)]
    first = {}
    for i, t in rows:
        first.setdefault(part.get(t, t), i)
    found = {r.doc_id: (r.first_doc, r.kept) for r in linejoin.classes(make_docs(rows)).collect()}
    assert found == {i: (first[part.get(t, t)], first[part.get(t, t)] == i) for i, t in rows}


@pytest.mark.parametrize("whole", [0, 1 << 14])
def test_a_common_gram_keeps_its_links(make_docs, monkeypatch, whole):
    """Many lines with one passage, some of them near copies: common keys go round the buckets and lose nothing."""
    monkeypatch.setattr(leaders, "WHOLE", whole)
    monkeypatch.setattr(linejoin, "COMMON", 3)
    monkeypatch.setattr(leaders, "BLOCK", 16)
    rng = random.Random(5)
    passage = "a passage that is very common in all of these lines indeed"
    texts = []
    for i in range(60):
        own = "".join(rng.choice("abcdefgh ") for _ in range(70))
        texts += [own[:35] + passage + own[35:]] if i % 3 else [own + passage, changed(rng, own + passage, 2)]
    part = components([(a, b) for a in texts for b in texts if a < b and edits_within(a, b, allowed(a, b, linejoin.PER_EDIT))])
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(part.get(t, t), i)
    found = {r.doc_id: r.first_doc for r in linejoin.classes(make_docs(list(enumerate(texts)))).collect()}
    assert found == {i: first[part.get(t, t)] for i, t in enumerate(texts)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", min_size=60, max_size=90), st.lists(st.tuples(st.integers(0, 59), st.sampled_from("dir")), max_size=12), st.integers(0, 12))
def test_distance_of_long_lines(a, changes, most):
    b = list(a)
    for at, kind in changes:
        b[at : at + (kind != "i")] = [] if kind == "d" else ["c"]
    b = "".join(b) + "b" * max(0, 60 - len(b))
    assert linejoin.within(a, b, most) == (edits(a, b) <= most)


def test_mixing_meets_targets(make_docs, corpus):
    rows = corpus + [(1000 + i, "word " * (i % 40)) for i in range(300)]
    docs = make_docs(rows, clash=True)
    found = mixing.plan(docs).select("_doc.doc_id", "_doc.source", "size", "source_size", "target", "copies").collect()
    sizes = defaultdict(int)
    for (_, t), s in zip(rows, [None if i % 7 == 3 else f"src{i % 3}" for i in range(len(rows))], strict=True):
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in order}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    again = mixing.plan(docs).select("_doc.doc_id", "copies").collect()
    assert sorted(map(repr, again)) == sorted(repr(type(again[0])(doc_id=r.doc_id, copies=r.copies)) for r in found)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found)


def test_copies_against_plain_prefix_sums(make_docs, corpus):
    docs = make_docs(corpus + [(1000 + i, "word " * (i % 40)) for i in range(300)] + [(7, "again and again")] * 9)
    base = mixing._base(docs, 17, ("doc_id", "source"))
    found = {r._row: r for r in mixing._drawn(base, (1, 2, 3), 3.0, 17).collect()}
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(17), F.lit("offset"), F.col("_key")), 11) / F.lit(float(1 << 53))
    by_source = defaultdict(list)
    for r in base.withColumn("_u", offset).collect():
        by_source[r._key].append(r)
    for own in by_source.values():
        for k, r in enumerate(sorted(own, key=lambda r: (r.size, r._h, r._row))):
            rate = found[r._row].target / found[r._row].source_size if found[r._row].source_size else 0.0
            assert found[r._row].copies == min(3, math.floor((k + 1) * rate + r._u) - math.floor(k * rate + r._u))
    assert len(found) == sum(map(len, by_source.values()))


def test_mixing_of_nothing(make_docs):
    assert mixing.mix(make_docs([])).collect() == []
    assert mixing.plan(make_docs([(1, None), (2, "")])).select("size", "target", "copies").collect() == [(0, 0.0, 0), (0, 0.0, 0)]


def test_fingerprints_of_neighbours(make_docs, corpus):
    rows = [r for r in corpus if r[0] is not None]
    found = editprint.compare_neighbours(make_docs(rows, clash=True)).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    texts = {d: t or "" for d, t in rows}
    ordered = sorted(texts, reverse=True)
    prints = {}
    for i, d in enumerate(ordered):
        t, following = texts[d], texts[ordered[(i + 1) % len(ordered)]]
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        last = by_id[d][-1] if len(by_id[d]) == 1 else None
        assert all(r.n_chars == len(t) and r.fingerprint == editprint.fingerprint(t) for r in by_id[d])
        assert prints.setdefault(t, by_id[d][0].fingerprint) == by_id[d][0].fingerprint
        if last:
            assert last.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert last.edited_fingerprint == editprint.fingerprint(edited)
            if len(t) > 200 and texts[d] != following:
                assert last.near_edited > 0.5 > last.near_next or following[:50] == t[:50]
    assert editprint.compare_neighbours(make_docs([])).collect() == []
    alone = editprint.compare_neighbours(make_docs([(5, "abcdef")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0


def plain_walk(text, w):
    """Every step of a walk with the character emitted there, from the table of bits alone."""
    bits = (textkit.mix64(np.arange(editprint.PERIOD * editprint.CLASSES, dtype=np.uint64) + editprint._SEED + np.uint64(w << 32)) >> np.uint64(40)) & np.uint64(1)
    bits = bits.reshape(editprint.PERIOD, editprint.CLASSES)
    out, step = [], 0
    for c in text:
        kind = int(textkit.mix64(np.array([ord(c)], np.uint64) + editprint._SEED)[0] % editprint.CLASSES)
        while True:
            out.append(c)
            step += 1
            if bits[(step - 1) % editprint.PERIOD, kind]:
                break
    return out


def plain_samples(text):
    out = []
    for w in range(editprint.WALKS):
        steps = plain_walk(text, w)
        if not steps:
            out.append(np.zeros(editprint.SAMPLES, np.uint8))
            continue
        at = editprint._positions.of(np.array([len(steps)]))[0]
        out.append(editprint._bits(np.array([ord(steps[p]) for p in at], np.uint32), at))
    return np.concatenate(out)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abcé𝒳 \n", max_size=60), min_size=1, max_size=8), st.sampled_from([2, 48]))
def test_walks_against_plain_ones(texts, few):
    old = editprint.FEW
    editprint.FEW = few
    try:
        found = editprint.fingerprints(texts)
    finally:
        editprint.FEW = old
    assert [r.tobytes() for r in found] == [editprint.packed(plain_samples(t)[None])[0].tobytes() for t in texts]


def test_likeness_follows_edit_distance():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))

    def near(k):
        b = list(text)
        for _ in range(k):
            b[rng.randrange(len(b))] = "z"
        x, y = editprint.fingerprints([text, "".join(b)])
        return float(editprint.likenesses(x[None], y[None])[0])

    assert near(0) == 1.0 and near(1) > near(60) > near(1500)


def lightly_edited(rng, text, share):
    out = []
    for c in text:
        r = rng.random()
        out.append("" if r < share / 3 else rng.choice("etaoin ") + c if r < 2 * share / 3 else rng.choice("etaoin ") if r < share else c)
    return "".join(out)


@pytest.mark.parametrize("size,share", [(1500, 0.01), (6000, 0.005)])
def test_recall_of_lightly_edited_texts(size, share):
    """Of copies with one percent (half a percent) of their characters inserted, deleted or replaced, nine in ten agree in a band and are alike enough."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["th", "er", "on", "an", "ing", "re", "tion", " ", "e", "a", ". "]) for _ in range(size))[:size] for _ in range(120)]
    x, y = editprint.fingerprints(texts), editprint.fingerprints([lightly_edited(rng, t, share) for t in texts])
    wide = editprint.BAND // 2
    same = (x == y).reshape(len(x), editprint.WALKS, -1)[:, :, : editprint.SAMPLES // editprint.BAND * wide]
    banded = same.reshape(len(x), editprint.WALKS, -1, wide).all(axis=3).any(axis=(1, 2))
    assert (banded & (editprint.likenesses(x, y) >= editprint.LEAST)).mean() >= 0.9
    assert (editprint.likenesses(x[1:], x[:-1]) >= editprint.LEAST).sum() == 0


def test_fingerprint_groups(make_docs):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(1500)) for _ in range(6)]
    edited = ["".join("#" if rng.random() < 0.01 else c for c in t) for t in texts]
    rows = list(enumerate([*texts, *edited])) + [(50, None), (51, ""), (None, texts[0]), (None, "alone in the world")]
    found = sorted(((r.doc_id, r.component_id) for r in editprint.near_groups(make_docs(rows)).collect()), key=repr)
    # An edited text may be missed; unlike ones are never joined.
    assert all(c in (d, d % 6) for d, c in found if d is not None and d < 12) and sum(c == d % 6 for d, c in found if d is not None and 6 <= d < 12) >= 5
    assert (50, 50) in found and (51, 50) in found and (None, 0) in found and (None, None) in found
