"""Toxicity grades by cumulative-link ordinal regression.

P(grade >= k) is the logistic function of w.x - t_k: one weight vector for all
thresholds t_1 <= t_2 <= ..., over sparse features: which words and word beginnings,
letters only and ASCII-lower-cased, a text contains. The expected severity is
the sum of those probabilities.

Labels may hold ordered grades. Labels that only say whether a text is toxic are
graded by a stated proxy: the evidence that a binary model, fitted without the row
itself (``FOLDS`` parts in turn), finds in a toxic row; thirds of that order are grades
1, 2 and 3. The model is fitted on at most ``PER_CLASS`` labelled rows of either class.
Every feature whose frequency differs between the classes by more than ``LEAST_Z``
standard errors takes part, however many there are. Whole texts are scored where they lie.

Defined results: a null or empty text has no words and gets the severity of the
thresholds alone; without labelled rows of both classes severity is 0 and nothing
is predicted toxic; equal texts get equal scores; rows that repeat a doc_id are scored
one by one, and labels that repeat for an id are averaged; a very long text is scored
in whole; a probability of just one half counts as toxic; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .textkit import batches, mix64, texts, words

PER_CLASS, GRADES, FOLDS = 2048, 3, 3
#: Bytes of the word beginnings that are features beside the words: inflected forms share them.
HEADS = (3, 4, 5)
#: Standard errors between the classes, and documents of the sample, that a feature needs.
LEAST_Z, LEAST_DOCS = 5.0, 4
_U = np.uint64


class Model(NamedTuple):
    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _letters() -> np.ndarray:
    """ASCII letters in lower case and all bytes over 127; the rest become spaces."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_LETTERS = _letters()


def feature_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and word beginnings of all texts, first feature of each text)."""
    data, offsets = texts(column)
    data = _LETTERS[data]
    columns = []
    for head in (None, *HEADS):
        _, _, h, first = words(data, offsets, head=head)
        columns.append(h if head is None else mix64(h + _U(head)))
    return np.stack(columns, axis=1).reshape(-1), first * len(columns)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, steps: int = 40, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) by Newton's method on the binary losses of all thresholds together."""
    n, d = x.shape
    w, t = np.zeros(d), np.zeros(grades)
    above = (grade[:, None] >= np.arange(1, grades + 1)).astype(np.float64)
    # Classes weigh alike at each threshold.
    share = np.clip(above.mean(axis=0), 1e-6, 1 - 1e-6)
    weight = np.where(above > 0, 0.5 / share, 0.5 / (1 - share)) / (grades * n)
    for _ in range(steps):
        p = _sigmoid((x @ w)[:, None] - t)
        gap, curve = weight * (p - above), weight * np.maximum(p * (1 - p), 1e-6)
        gradient = np.concatenate([x.T @ gap.sum(axis=1) + decay * w, -gap.sum(axis=0) + 1e-6 * t])
        hessian = np.empty((d + grades, d + grades))
        hessian[:d, :d] = (x * curve.sum(axis=1)[:, None]).T @ x + decay * np.eye(d)
        hessian[:d, d:] = -(x.T @ curve)
        hessian[d:, :d] = hessian[:d, d:].T
        hessian[d:, d:] = np.diag(curve.sum(axis=0) + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w, t = w - step[:d], np.maximum.accumulate(t - step[d:])
        if np.abs(step).max() < 1e-8:
            break
    return w, t


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, grades: int = GRADES) -> Model:
    """Fit on the bounded sample; its distinct words are collected, never those of the corpus."""

    def bags(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, "text"):
            h, first = feature_ids(batch.column("text"))
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(sets, pa.binary())], ["doc_id", "y", "words"])

    rows = sample(docs, labels, label, per_class).select("doc_id", "y", "text").mapInArrow(bags, "doc_id long, y int, words binary").toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(np.int64)
    nothing = Model(np.zeros(0, _U), np.zeros(0), np.full(grades, 40.0))
    if len(set(y.tolist())) < 2:
        return nothing
    sets = [np.frombuffer(b, _U) for b in rows["words"]]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    vocabulary, column = np.unique(np.concatenate(sets), return_inverse=True)
    toxic = np.bincount(column, weights=y[doc], minlength=len(vocabulary))
    total = np.bincount(column, minlength=len(vocabulary))
    n1, n0 = y.sum(), len(y) - y.sum()
    p1, p0, p = toxic / n1, (total - toxic) / n0, total / len(y)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((total >= LEAST_DOCS) & (z > LEAST_Z))
    if not len(chosen):
        return nothing
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sets), len(chosen)))
    hit = place[column] >= 0
    x[doc[hit], place[column[hit]]] = 1
    if y.max() == 1 and grades > 1:
        evidence, part = np.zeros(len(y)), np.arange(len(y)) % FOLDS
        for k in range(FOLDS):
            if len(set(y[part != k].tolist())) == 2:
                evidence[part == k] = x[part == k] @ fit_ordinal(x[part != k], y[part != k], 1)[0]
        toxic_rows = y == 1
        y = y.copy()
        y[toxic_rows] = 1 + np.searchsorted(np.quantile(evidence[toxic_rows], np.arange(1, grades) / grades), evidence[toxic_rows], side="right")
    w, t = fit_ordinal(x, y, grades)
    return Model(vocabulary[chosen], w, t)


def severities(column: pa.Array, model: Model) -> np.ndarray:
    """(texts, grades): P(grade >= k)."""
    h, first = feature_ids(column)
    n = len(first) - 1
    linear = np.zeros(n)
    if len(model.words) and len(h):
        at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
        hit = np.flatnonzero(model.words[at] == h)
        doc = np.searchsorted(first, hit, side="right") - 1
        pair = np.unique(doc * len(model.words) + at[hit])
        linear = np.bincount(pair // len(model.words), weights=model.weights[pair % len(model.words)], minlength=n)
    return _sigmoid(linear[:, None] - model.thresholds)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_severity, grade (the most that is likelier than not), score (of any toxicity), predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def apply(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, "text"):
            p = severities(batch.column("text"), shared.value)
            grade = (p >= 0.5).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(grade), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5).astype(np.int32))], ["doc_id", "expected_severity", "grade", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(apply, "doc_id long, expected_severity double, grade int, score double, predicted int")
