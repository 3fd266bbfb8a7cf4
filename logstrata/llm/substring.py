"""Substring dedup by seed and extend.

Seeds: of every ``ANCHOR``-word shingle the winnowed ones, i.e. the least hash of
each run of shingles that a window of ``WINDOW`` words spans. Two equal windows
have the same least shingle, so every repeated passage of at least a window
shares a seed at the same place. Seeds meet across the corpus, and only those
that more than one document holds go on.

Extension: around a shared seed all windows that it anchors are hashed, which
extends the match word by word to both sides as far as the documents agree:
consecutive matching windows cover exactly the maximal repeat. Hashes have 64
bits, so two given windows that differ are taken as equal once in 2**64. Windows meet in turn, and a document learns which of
its windows begin in a document with a smaller id; their words are removed.

Batches of documents take part as wholes (see ``exchange``): a passage that a
third of the corpus shares costs an entry per batch, not per pair.

Defined results: null text has no words; a document of fewer words than a window
is kept whole; a null doc_id is neither smaller nor larger than any (kept whole,
no source); rows that share a doc_id do not remove each other's words; repeats
within one document stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logstrata.scratch import forget, materialize

from . import exchange as X
from .textkit import mix64, shingles, texts, words

WINDOW, ANCHOR = 13, 5
_U = np.uint64
_LAST = np.iinfo(np.int64).max


class _Batch:
    """A batch's words, windows and seeds."""

    def __init__(self, payload: bytes, window: int, anchor: int):
        self.table = X.unseal(payload)
        self.data, offsets = texts(self.table.column("text"))
        self.start, self.end, self.hash, self.first = words(self.data, offsets)
        self.id_set = self.table.column("doc_id").is_valid().to_numpy()
        ids = self.table.column("doc_id").fill_null(_LAST).to_numpy()
        count = np.diff(self.first)
        doc = np.repeat(np.arange(len(ids)), count)
        n = max(0, len(self.hash) - window + 1)
        inside = doc[:n] == doc[window - 1 : window - 1 + n]
        #: First words of the windows that lie in one document, with that document.
        self.at = np.flatnonzero(inside & self.id_set[doc[:n]])
        self.doc = doc[self.at]
        self.id = ids[self.doc]
        grams = shingles(self.hash, anchor)
        span = window - anchor + 1
        least = grams[: len(grams) - span + 1].copy()
        for t in range(1, span):
            np.minimum(least, grams[t : t + len(least)], out=least)
        #: Hashes of least value are spread again, else they would crowd the first buckets.
        self.seed = mix64(least[self.at]) if len(self.at) else np.zeros(0, _U)
        self.window = window

    def windows(self) -> np.ndarray:
        return shingles(self.hash, self.window, seed=7)[self.at] if len(self.at) else np.zeros(0, _U)


def _send(number: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    rows = [(number, b, X.as_bytes(keys[s]), X.as_bytes(values[s])) for b, s in X.dealt(keys, buckets)]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["batch", "bucket", "keys", "values"])


_SENT = "batch long, bucket long, keys binary, values binary"


def _shared(keys: np.ndarray, values: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Seeds that several batches hold."""
    first, group = X.groups(keys)
    return (np.diff(np.append(first, len(keys))) > 1)[group] if len(keys) else np.zeros(0, bool)


def _older(keys: np.ndarray, values: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Windows that a smaller id than any of the batch's own holds."""
    first, group = X.groups(keys)
    return values > values[first][group] if len(keys) else np.zeros(0, bool)


def _least_ids(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sorted keys, least id of each)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first, _ = X.groups(keys)
    return keys[first], ids[first]


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words as ``kept_text``)."""
    bundles = materialize(X.bundle(docs, {"doc_id": "cast(doc_id as long)", "text": "coalesce(text, '')"}), "substring-batches")
    size = bundles.groupBy().sum("bytes").first()[0] or 0
    # A word takes about six bytes, and one shingle in five or six is a seed.
    buckets = max(1, int(size / 6 / 5.5 / X.BUCKET))

    def seeds(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frames:
            for number, payload in zip(part.column("batch").to_pylist(), part.column("payload"), strict=True):
                keys = np.unique(_Batch(payload.as_py(), window, anchor).seed)
                yield _send(number, keys, np.zeros(len(keys), np.int64), buckets)

    def extend(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frames:
            for number, payload, back in zip(part.column("batch").to_pylist(), part.column("payload"), part.column("back").to_pylist(), strict=True):
                batch = _Batch(payload.as_py(), window, anchor)
                chosen = X.contains(X.received(back), batch.seed)
                keys, least = _least_ids(batch.windows()[chosen], batch.id[chosen])
                yield _send(number, keys, least, buckets)

    def remove(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frames:
            for payload, back in zip(part.column("payload"), part.column("back").to_pylist(), strict=True):
                yield _kept(_Batch(payload.as_py(), window, anchor), X.received(back), with_text)

    seed_rows = bundles.select("batch", "payload").mapInArrow(seeds, _SENT)
    back = materialize(X.meet(seed_rows, _shared), "substring-seeds")
    extended = bundles.select("batch", "payload").join(back.hint("shuffle_hash"), "batch").mapInArrow(extend, _SENT)
    older = materialize(X.meet(extended, _older), "substring-windows")
    forget(back)
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return bundles.select("batch", "payload").join(older.hint("shuffle_hash"), "batch", "left").mapInArrow(remove, columns)


def _kept(batch: _Batch, older: np.ndarray, with_text: bool) -> pa.RecordBatch:
    n = len(batch.hash)
    gone = np.zeros(n + 1, np.int64)
    if len(batch.at):
        keys = batch.windows()
        order = np.lexsort((batch.id, keys))
        first, group = X.groups(keys[order])
        hit = np.empty(len(keys), bool)
        hit[order] = batch.id[order] > batch.id[order][first][group]
        hit |= X.contains(older, keys)
        at = batch.at[hit]
        np.add.at(gone, at, 1)
        np.add.at(gone, np.minimum(at + batch.window, n), -1)
    gone = np.cumsum(gone)[:n] > 0
    data = batch.data.tobytes()
    start, end = batch.start.tolist(), batch.end.tolist()
    out: tuple[list, ...] = ([], [], [], [])
    kept_texts = []
    for i, doc_id in enumerate(batch.table.column("doc_id").to_pylist()):
        a, b = int(batch.first[i]), int(batch.first[i + 1])
        stay = (np.flatnonzero(~gone[a:b]) + a).tolist()
        kept = b" ".join([data[start[j] : end[j]] for j in stay])
        for column, value in zip(out, (doc_id, b - a, b - a - len(stay), hashlib.sha256(kept).hexdigest()), strict=True):
            column.append(value)
        if with_text:
            kept_texts.append(kept.decode("utf-8", "surrogatepass"))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)] + ([pa.array(kept_texts, pa.string())] if with_text else [])
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)
