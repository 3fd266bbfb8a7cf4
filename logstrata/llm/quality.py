"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its words, lower-cased and hashed into ``TERMS`` columns, and,
in as many columns of their own, the forms of its words (letter case, final mark,
length, whether it repeats one of the two words before it) and pairs of neighbouring
forms: what a text says and how it is written weigh alike. A bounded sample of labelled documents
(``PER_CLASS`` of either class) gives inverse document frequencies and, by a
singular value decomposition, ``RANK`` latent directions; its latent vectors and
labels are broadcast (PER_CLASS * 2 * RANK numbers at most). Every document, of
whatever length, is projected in whole, its cosines with all sample vectors are
computed exactly in blocks, and the ``NEIGHBOURS`` nearest vote, weighted by
similarity.

Defined results: a null or empty text has no direction and gets the sample's
share of good documents; without labelled rows every score is 0.5; rows with
equal texts get equal scores; labels that repeat for an id are averaged; extra
columns pass through ``keep_good`` unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .textkit import batches, mix64, texts, words

TERMS, RANK, PER_CLASS, NEIGHBOURS = 1024, 48, 2048, 25
#: Bytes of texts, and texts, that are looked at together: they bound a worker's memory, whatever the texts' lengths.
TOGETHER, ROWS = 1 << 20, 512
_U = np.uint64


class Model(NamedTuple):
    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _byte_kinds() -> np.ndarray:
    """0 other letters, 1 lower case, 2 upper case, 3 digits, 4 marks."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = 4
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    return kind


_KINDS = _byte_kinds()


def forms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(form of each word, first word of each text)."""
    data, offsets = texts(column)
    start, end, h, first = words(data, offsets)
    if not len(h):
        return np.zeros(0, _U), first
    kind = _KINDS[data]
    counts = []
    for k in (1, 2, 3, 4):
        # A column holds less than 2**31 bytes.
        sums = np.zeros(len(kind) + 1, np.int32)
        np.cumsum(kind == k, dtype=np.int32, out=sums[1:])
        counts.append(sums[end] - sums[start])
    lower, upper, digits, marks = counts
    size = end - start
    case = np.select([digits > 0, (upper > 1) & (lower == 0), (upper == 1) & (kind[start] == 2), upper > 0, marks == size], [1, 2, 3, 4, 5], 0)
    last = np.where(kind[end - 1] == 4, data[end - 1], 0).astype(np.int64)
    doubled = (size > 1) & (last > 0) & (data[end - 1] == data[np.maximum(end - 2, 0)])
    again = np.zeros(len(h), np.int64)
    again[2:] = (h[2:] == h[:-2]) * 2
    again[1:] = np.where(h[1:] == h[:-1], 1, again[1:])
    again[first[:-1][first[:-1] < len(h)]] = 0
    length = np.searchsorted([2, 4, 8, 16], size, side="right")
    return mix64((case + 8 * last + 2048 * doubled + 4096 * again + 16384 * length).astype(_U)), first


def word_counts(column: pa.Array, terms: int) -> np.ndarray:
    """(texts, terms): how often each hashed word occurs."""
    data, offsets = texts(column)
    _, _, h, first = words(data, offsets, fold=True)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    return np.bincount(doc * terms + (h % _U(terms)).astype(np.int64), minlength=n * terms).reshape(n, terms)


def term_rates(column: pa.Array, terms: int = TERMS) -> np.ndarray:
    """(texts, 2 * terms): square roots of the shares of hashed forms and pairs of forms, then of hashed words."""
    form, first = forms(column)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    out = np.bincount(doc * terms + (form % _U(terms)).astype(np.int64), minlength=n * terms).astype(np.float64)
    if len(form) > 1:
        with np.errstate(over="ignore"):
            pair = mix64(form[:-1] * _U(3) + form[1:])
        same = doc[:-1] == doc[1:]
        out += np.bincount(doc[:-1][same] * terms + (pair[same] % _U(terms)).astype(np.int64), minlength=n * terms)
    out = np.concatenate([out.reshape(n, terms), word_counts(column, terms)], axis=1)
    total = np.repeat(out.reshape(n, 2, terms).sum(axis=2), terms, axis=1)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, rank: int = RANK, terms: int = TERMS) -> Model:
    """Latent directions and vectors of the bounded sample; rows held out are never read."""

    def rates(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, "text", TOGETHER, ROWS):
            found = term_rates(batch.column("text"), terms)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([zstandard.compress(r.tobytes(), 1) for r in found], pa.binary())], ["doc_id", "y", "rates"])

    rows = sample(docs, labels, label, per_class, ~held_out()).select("doc_id", "y", "text").mapInArrow(rates, "doc_id long, y int, rates binary").toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(np.float64)
    # One matrix in single precision is all that the driver holds of the sample.
    x = np.zeros((len(rows), 2 * terms), np.float32)
    for row, blob in zip(x, rows.pop("rates"), strict=True):
        row[:] = np.frombuffer(zstandard.decompress(blob), np.float32)
    some = x.any(axis=1)
    prior = float(y.mean()) if len(y) else 0.5
    if not some.all():
        x, y = x[some], y[some]
    weights = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1
    if not len(x):
        return Model(weights, np.zeros((2 * terms, 1)), np.zeros((0, 1)), y, prior)
    # The right singular vectors come from the small matrix of term products.
    x *= weights.astype(np.float32)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vectors[:, ::-1][:, :rank].copy()
    del vectors
    return Model(weights.astype(np.float32), basis.astype(np.float32), _unit(x @ basis).astype(np.float32), y, prior)


def vote(rates: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores: the labels of the nearest sample vectors, weighted by cosine."""
    score = np.full(len(rates), model.prior)
    k = min(neighbours, len(model.labels))
    if not k:
        return score
    latent = _unit((rates * model.weights) @ model.basis)
    for a in range(0, len(rates), 256):
        near = latent[a : a + 256] @ model.vectors.T
        if k < near.shape[1]:
            best = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        else:
            best = np.tile(np.arange(k), (len(near), 1))
        weight = np.maximum(np.take_along_axis(near, best, axis=1).astype(np.float64), 0)
        total = weight.sum(axis=1)
        votes = (weight * model.labels[best]).sum(axis=1)
        part = score[a : a + 256]
        part[total > 0] = votes[total > 0] / total[total > 0]
    return np.clip(score, 0, 1)


def scored(frames: Iterator[pa.RecordBatch], model: Model, terms: int = TERMS) -> Iterator[pa.RecordBatch]:
    """(_doc, score) of batches (_doc, _text); without ``_text``, of the field ``text`` of ``_doc``."""
    named = ((b.column("_doc"), b.column("_text") if "_text" in b.schema.names else b.column("_doc").field("text")) for b in frames)
    both = (pa.RecordBatch.from_arrays(list(columns), ["_doc", "_text"]) for columns in named)
    for batch in batches(both, "_text", TOGETHER, ROWS):
        found = vote(term_rates(batch.column("_text"), terms), model)
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(found, pa.float64())], ["_doc", "score"])


def score(docs: DataFrame, model: Model, terms: int = TERMS) -> DataFrame:
    """``docs`` (columns as a struct ``_doc``, and ``_text`` unless the struct has it) with ``score``; whole texts are read where they lie, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scored(frames, shared.value, terms)

    return docs.mapInArrow(apply, f"_doc {docs.schema['_doc'].dataType.simpleString()}, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    rows = score(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("_doc"), F.col("text").alias("_text")), model)
    return rows.select("_doc.doc_id", "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with their own columns."""
    model = fit(docs, labels)
    # The text goes to the workers once, within its row.
    return score(docs.select(F.struct("*").alias("_doc")), model).where("score >= 0.5").select("_doc.*")
