"""The pipeline's stages against plain versions, and what it leaves behind."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_text_operators import components, expected_lines, shingle_set

import corpus_pipeline
from logstrata.llm import mixing, quality
from logstrata.llm.registry import vocabulary_path
from logstrata.scratch import scratch_root

pytest.importorskip("public_tokenizers")


def _corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    shared, base = line(30), [line(14) for _ in range(8)]
    rows, labels = [], []
    for i in range(90):
        good = i % 4 != 0
        if good:
            text = "\n".join([line(rng.randint(8, 30)) for _ in range(rng.randint(2, 5))] + [shared] * (i % 9 == 1))
            if i % 10 == 3:
                text = "\n".join(base[: 4 + i % 4]) + "\n" + line(3)
        else:
            text = "\n".join("BUY NOW!!! $$$ CLICK 123 " * rng.randint(2, 9) for _ in range(2))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(200, None, None, None, None), (201, "", "en", None, 0), (202, line(9) * 900, "en", "s1", 5)]
    return rows, labels


def test_stages_against_plain_versions(spark, tmp_path):
    rows, labels = _corpus()
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]
    results, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        results.append(now.collect())
        assert name == "best_fit_packing" or now.columns == docs.columns
    good, deduped, kept, mixed, packed = results
    predicted = {r.doc_id: r.predicted for r in quality.scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {r.doc_id for r in good} == {d for d, p in predicted.items() if p} and sum(predicted[d] == q for d, q, _ in labels) >= 88
    # Line dedup: the order of rows decides nothing here, ids are distinct.
    plain = defaultdict(list)
    ordered = sorted((r.doc_id, r.text) for r in good if r.text is not None)
    for (doc, text), own in zip(ordered, _lines_by_row(ordered), strict=True):
        plain[doc] = "\n".join(line for line, stays in zip(text.split("\n"), own, strict=True) if stays)
    assert {r.doc_id: r.text for r in deduped} == {r.doc_id: plain[r.doc_id] if r.text is not None else None for r in good}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in deduped)
    sets = {r.doc_id: shingle_set(r.text) for r in deduped}
    part = components([(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert sorted(r.doc_id for r in kept) == sorted(d for d in sets if part.get(d, d) == d)
    drawn = {r.doc_id: r.copies for r in mixing.plan(spark.read.parquet(f"{folder}/minhash_near_dedup")).select("_doc.doc_id", "copies").collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({d: c for d, c in drawn.items() if c})
    _check_packing(mixed, packed)


def _lines_by_row(ordered):
    """For every text which of its lines stay, by the brute-force classes."""
    flags = defaultdict(dict)
    for doc, line_no, _, stays in expected_lines(ordered):
        flags[doc][line_no] = stays
    return [[flags[doc][k] for k in range(len(text.split("\n")))] for doc, text in ordered]


def _check_packing(mixed, packed):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary_path())
    wanted = Counter()
    for r in mixed:
        n = len(full.encode(r.text or "", add_special_tokens=False).ids) + 1
        for piece, start in enumerate(range(0, n, 2048)):
            wanted[(r.doc_id, piece, start, min(2048, n - start))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in packed) == wanted
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_leaves_only_its_result(spark, tmp_path):
    rows, labels = _corpus()
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    shared = Path(scratch_root(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    out = corpus_pipeline.run(spark, folder)
    assert out.where(F.col("length") > 0).count() > 50
    assert [p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before] == ["stage-best_fit_packing"]
