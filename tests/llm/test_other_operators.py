"""Packing, chat, classifiers and embeddings against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logstrata.llm import capfilter, chat, packing, quality, toxicity
from logstrata.llm.registry import vocabulary_path
from logstrata.llm.tokens import Encoder


@pytest.fixture(scope="module")
def full():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_tokenizers(text):
    tool, whole = _tools()
    text = text.encode("utf-8", "ignore").decode()
    assert tool.ids([text.encode()])[0] == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _tools(cache=[]):  # noqa: B006
    if not cache:
        from tokenizers import Tokenizer

        cache.append((Encoder(vocabulary_path()), Tokenizer.from_file(vocabulary_path())))
    return cache[0]


def test_ids_of_awkward_texts():
    tool, whole = _tools()
    for text in ("a<|endoftext|>b <|startoftext|>", "İΣ ς ﬁ \x1c z\x85w é ²½ Ⅷ 日本", "'S 'LL don't I'VE 12a3 _x_", "ÀÖ×÷ßÿ ŠžŽ € 🙂", "!" * 300, "ab" * 500):
        assert tool.ids([text.encode()])[0] == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_covers_every_piece(make_docs, corpus, full):
    docs = make_docs(corpus, clash=True)
    capacity = 256
    found = packing.pack(docs, vocabulary_path(), capacity, group=24).collect()
    expected = []
    for d, t in corpus:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((d, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(expected, key=repr)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    # Small groups and rounds need a little more than all pieces packed at once; one group needs no more.
    once = packing.best_fit(sorted((r.length for r in found), reverse=True), capacity)[2]
    assert len(sequences) <= once + 3
    assert packing.pack(docs, vocabulary_path(), capacity).select("sequence_id").distinct().count() <= once
    assert packing.pack(make_docs([]), vocabulary_path()).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_bounds_and_best_fit(sizes):
    """The bound never exceeds the true least number, found by trying everything."""
    capacity = 12

    def least(items, bins=()):
        if not items:
            return len(bins)
        best = len(bins) + len(items)
        for i, room in enumerate(bins):
            if room >= items[0] and room not in bins[:i]:
                best = min(best, least(items[1:], bins[:i] + (room - items[0],) + bins[i + 1 :]))
        return min(best, least(items[1:], (*bins, capacity - items[0])))

    true = least(sorted(sizes, reverse=True))
    assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= true
    where, offset, bins = packing.best_fit(sorted(sizes, reverse=True), capacity)
    assert bins >= true and all(sum(s for s, w in zip(sorted(sizes, reverse=True), where, strict=True) if w == b) <= capacity for b in range(bins))


def test_rounds_close_gaps(spark):
    """Groups of one kind of piece waste room until they exchange."""
    rows = [(i, 0, 0, 600 if i % 2 else 1448, 0, i) for i in range(400)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, _row long")
    packed = packing.pack_pieces(cut, 2048, group=16)
    assert packed.select("sequence_id").distinct().count() <= 206


TURNS = "conv_id long, turn long, role string, text string, extra string"


def test_chat_round_trip(spark):
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 1, "assistant", tricky, None), (1, 0, "user", "a\\b <| c\n", "x"), (2, 0, "system", None, None), (2, 1, "user", "hi", None), (2, 2, "assistant", "é🙂\\n", None),
        (3, 0, "assistant", "first", None), (4, 0, None, None, None), (4, None, "us\ner", "\\<\\|", None), (None, 0, "user", "q", None), (5, 0, "user", "q", None), (5, 0, "user", "q", None),
    ]
    found = {r.conv_id: r for r in chat.read_back(chat.segments(spark.createDataFrame(rows, TURNS))).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        groups[conv].append((turn is None, turn or 0, role or "", text or ""))
    assert set(found) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        r = found[conv]
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert found[1].valid and found[2].valid and not found[3].valid and not found[5].valid and not found[None].valid
    segments = chat.segments(spark.createDataFrame(rows, TURNS)).where("conv_id = 1").collect()
    assert "".join(r.text for r in segments).count("<|im_start|>") == 2 and [r.loss for r in segments] == [False, False, False, False, True, False]
    assert chat.read_back(chat.segments(spark.createDataFrame([], TURNS))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>aimn_\n", max_size=25))
def test_escapes_are_reversible(text):
    template = chat.Template()
    shown = template.escape(text)
    assert template.unescape(shown) == text and "<|im" not in shown
    assert template.unescape_role(template.escape_role(text)) == text and "\n" not in template.escape_role(text)


def _labelled():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(15, 60))]
        good, toxic = rng.random() < 0.6, rng.random() < 0.4
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "NASTY,", "vile."])
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words for _ in range(6)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return rows + [(900, None), (901, ""), (902, "x" * 300_000)], labels


def test_quality_on_held_out_rows(spark, make_docs):
    rows, labels = _labelled()
    table = spark.createDataFrame([*labels, (903, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.scores(make_docs(rows, clash=True), table).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in found.items())
    held = [(found[d].predicted, q) for d, q, _ in labels if found[d].held_out]
    assert len(held) > 80 and sum(p == q for p, q in held) / len(held) > 0.97
    flipped = spark.createDataFrame([(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, t) for d, q, t in labels], table.schema)
    again = {r.doc_id: r.score for r in quality.scores(make_docs(rows), flipped).collect()}
    assert all(again[d] == pytest.approx(r.score, abs=1e-5) for d, r in found.items())
    docs = make_docs(rows, clash=True)
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in found.items() if r.predicted}


def test_vote_against_plain_neighbours():
    """Every cosine by itself, the nearest sorted out one by one, each vote weighed."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["good", "Bad!", "x9", "plain", "word", "MORE", "words", "again"], 30)) for _ in range(80)] + ["", "lonely"]
    rates = quality.term_rates(pa.array(texts), 64).astype(np.float64)
    basis = np.linalg.qr(rng.standard_normal((128, 9)))[0]
    vectors = rng.standard_normal((50, 9))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality.Model(np.linspace(1, 2, 128), basis, vectors, (np.arange(50) % 3 == 0).astype(float), 0.4)
    found = quality.vote(rates, model, 7)
    for rate, score in zip(rates, found, strict=True):
        latent = (rate * model.weights) @ basis
        size = np.sqrt((latent**2).sum())
        if size < 1e-12:
            assert score == 0.4
            continue
        near = sorted(((float(sum(a * b for a, b in zip(latent / size, v, strict=True))), y) for v, y in zip(vectors, model.labels, strict=True)), reverse=True)[:7]
        votes = [(max(c, 0), y) for c, y in near]
        assert score == pytest.approx(sum(c * y for c, y in votes) / sum(c for c, _ in votes))


def test_severity_against_plain_sums():
    known = np.unique(toxicity.feature_ids(pa.array(["bad words fool fools"]))[0])
    model = toxicity.Model(known, np.linspace(-1, 2, len(known)), np.array([0.1, 0.7, 2.0]))
    texts = ["bad", "a fool among fools", "", None, "BAD bad bad words " * 400, "nothing here"]
    found = toxicity.severities(pa.array([t or "" for t in texts]), model)
    for t, row in zip(texts, found, strict=True):
        own = set(toxicity.feature_ids(pa.array([t or ""]))[0].tolist())
        linear = sum(float(model.weights[np.searchsorted(model.words, w)]) for w in own if w in set(model.words.tolist()))
        assert row == pytest.approx([1 / (1 + np.exp(t_k - linear)) for t_k in model.thresholds])


def test_a_hot_conversation_and_long_turns(spark):
    """One conversation with most turns, very long texts, rows out of order."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(6000)] + [(2, 0, "user", "x<|" * 100_000), (2, 1, "assistant", None), (None, None, None, None)]
    random.Random(2).shuffle(rows)
    found = {r.conv_id: r for r in chat.read_back(chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert found[1].n_turns == 6000 and found[1].valid and found[1].loss_chars == sum(len(f"turn {k}") for k in range(1, 6000, 2))
    assert found[2].n_turns == 2 and found[2].loss_chars == 0 and found[None].n_turns == 1


def test_quality_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.scores(make_docs([(1, "a b"), (2, None)]), none).collect()} == {0.5}
    assert quality.scores(make_docs([]), none).collect() == []


@pytest.mark.parametrize("texts", [["Word %d, or two." % i for i in range(10_000)], ["Some words of text %d! " % i * 90 for i in range(3_000)], [None, "", "One " * 500_000]])
def test_scoring_holds_a_bounded_part_of_a_batch(texts):
    model = quality.Model(np.ones(2 * quality.TERMS, np.float32), np.eye(2 * quality.TERMS, 8, dtype=np.float32), np.eye(6, 8, dtype=np.float32), np.arange(6) % 2 * 1.0, 0.4)
    rows = pa.array([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays([rows[:2], rows]).slice(2)], ["_doc"])
    some = [*range(5), *range(len(texts) - 3, len(texts))]
    expected = quality.vote(quality.term_rates(pa.array([texts[i % len(texts)] or "" for i in some])), model)
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(quality.scored(iter([batch]), model))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.column("_doc").combine_chunks().field("doc_id").to_pylist() == list(range(len(texts)))
    assert found.column("score").to_numpy()[[i % len(texts) for i in some]] == pytest.approx(expected, abs=1e-5)
    assert peak < 72 << 20


def test_toxicity_finds_planted_words(spark, make_docs):
    rows, labels = _labelled()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.scores(make_docs(rows, clash=True), table).collect()}
    assert all(found[d].predicted == t for d, _, t in labels)
    assert all(found[d].predicted == 0 for d in (900, 901, 902))
    assert all(0 <= r.expected_severity <= toxicity.GRADES and r.grade >= r.predicted for r in found.values())
    assert toxicity.scores(make_docs([]), table).collect() == []
    none = spark.createDataFrame([], table.schema)
    assert {r.predicted for r in toxicity.scores(make_docs(rows[:5]), none).collect()} == {0}


def test_ordinal_thresholds_ascend():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 12)) < 0.3).astype(float)
    strength = x[:, :4].sum(axis=1)
    grade = np.clip(strength, 0, 3).astype(int)
    w, t = toxicity.fit_ordinal(x, grade, 3)
    assert (np.diff(t) >= 0).all() and w[:4].min() > np.abs(w[4:]).max()
    expected = toxicity._sigmoid((x @ w)[:, None] - t).sum(axis=1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.95


def _vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    n = len(rows)
    for k in range(120):
        rows.append((n + k, (base[k % 10] + rng.standard_normal(16) * 0.15 * (k % 3)).tolist()))
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15), (505, [float("inf")] + [1.0] * 15), (506, [1.0] * 8), (507, [2.0] * 8), (508, [3.0]), (509, [1e-30] * 8), (0, base[0].tolist()), (None, base[3].tolist())]
    return rows


def test_embedding_groups_against_all_pairs(spark):
    rows = _vectors()
    table = spark.createDataFrame([(i, v, None, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, id long")
    found = capfilter.near_groups(table, block=16).collect()
    good = {}
    for k, (_, v) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v] if v else [], np.float32).astype(np.float64)
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            good[k] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    parent = {k: k for k in range(len(rows))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = defaultdict(int)
    for a, b in links:
        parent[root(a)] = root(b)
        count[a] += 1
        count[b] += 1
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least[root(k)], i if i is not None else 1 << 60)
    expected = [(i, count[k], least[root(k)]) for k, (i, _) in enumerate(rows)]
    assert sorted(map(repr, ((r.vec_id, r.n_links, r.component_id) for r in found))) == sorted(map(repr, expected))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert capfilter.near_groups(table.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1_000, 50_000, 1_000_000])
def test_cap_filters_recall_at_the_threshold(size):
    """Of pairs at just the threshold few share no filter, whatever the number of vectors; far pairs seldom share one."""
    rng = np.random.default_rng(4)
    dim, n = 64, 1500
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, dim))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y
    words, height = capfilter.plan(size, dim, 0.95)
    a, b = capfilter._passed(x, words, height), capfilter._passed(y, words, height)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) > 0.99
    assert np.mean([len(p) for p in a]) < 110
    # A thousand vectors are few enough that most meet.
    assert size == 1_000 or np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a[1:], b[:-1], strict=True)]) < 0.15


def test_list_decoding_finds_exactly_the_filters_passed():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 9))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, one, two = capfilter._code(9, 12, 1)
    turned = x @ rotation
    product = turned[:, :5] @ one.T
    plain = product[:, :, None] + (turned[:, 5:] @ two.T)[:, None, :] >= 0.4
    who, passed = capfilter.decode(x, 12, 0.4, 1)
    assert sorted(zip(who.tolist(), passed.tolist(), strict=True)) == [(int(k), int(i * 12 + j)) for k, i, j in zip(*np.nonzero(plain), strict=True)]
