"""Exchange of 64-bit keys between batches of documents.

Documents are bundled, where they are read, into batches of a few megabytes: one
row each, ``(batch, payload)``, the payload being compressed Arrow data. A batch
sends every key at most once, however many of its documents hold it, as sorted
arrays by key bucket. So a key that a third of all documents share costs one
entry per batch, and no task gathers the documents of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import batches

#: Bytes of text in a batch, and keys that a bucket is to hold about.
BATCH, BUCKET = 4 << 20, 400_000
_U = np.uint64


def seal(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return zstandard.compress(sink.getvalue(), 3)


def unseal(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all().combine_chunks()


def bundle(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(batch, bytes, payload): documents in bundles; ``columns`` maps names in the payload to expressions, ``text`` among them."""
    rows = docs.select(*[F.expr(e).alias(n) for n, e in columns.items()])

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([seal(table)], pa.binary())], ["batch", "bytes", "payload"])

        for part in batches(frames, "text", BATCH):
            held.append(part)
            size += part.column("text").nbytes
            if size >= BATCH * 3 // 4:
                yield row()
                held, size, number = [], 0, number + 1
        if held:
            yield row()

    return rows.mapInArrow(emit, "batch long, bytes long, payload binary")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the keys' high bits."""
    return ((keys >> _U(32)) * _U(buckets)) >> _U(32)


def dealt(keys: np.ndarray, buckets: int) -> Iterable[tuple[int, slice]]:
    """(bucket, slice) of sorted keys, for the buckets that have any."""
    if not len(keys):
        return ()
    own = bucket_of(keys, buckets)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return ((int(own[a]), slice(a, b)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True))


def as_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def meet(sent: DataFrame, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Keys of all batches meet by bucket; returns (batch, keys): per batch the keys that were chosen for it.

    ``sent``: (batch, bucket, keys, values), both binary 64-bit arrays of one length.
    ``decide(keys, values, batch)`` gets a bucket's entries sorted by key and says which to send back.
    """

    def reduce(table: pa.Table) -> pa.Table:
        key = [np.frombuffer(x, _U) for x in table.column("keys").to_pylist()]
        value = [np.frombuffer(x, np.int64) for x in table.column("values").to_pylist()]
        batch = np.repeat(table.column("batch").to_numpy(), [len(x) for x in key])
        keys, values = np.concatenate(key), np.concatenate(value)
        order = np.lexsort((values, keys))
        keys, values, batch = keys[order], values[order], batch[order]
        keep = decide(keys, values, batch)
        keys, batch = keys[keep], batch[keep]
        order = np.argsort(batch, kind="stable")
        keys, batch = keys[order], batch[order]
        ids, first = np.unique(batch, return_index=True)
        out = [as_bytes(x) for x in np.split(keys, first[1:])] if len(ids) else []
        return pa.table({"batch": pa.array(ids, pa.int64()), "keys": pa.array(out, pa.binary())})

    back = sent.groupBy("bucket").applyInArrow(reduce, "batch long, keys binary")
    return back.groupBy("batch").agg(F.collect_list("keys").alias("back"))


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, group number of each) of runs of equal sorted keys."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def contains(sorted_keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are among ``sorted_keys``."""
    if not len(sorted_keys):
        return np.zeros(len(asked), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)] == asked


def received(blobs: list[bytes] | None) -> np.ndarray:
    """The sorted keys that came back to a batch."""
    return np.sort(np.concatenate([np.frombuffer(b, _U) for b in blobs])) if blobs else np.zeros(0, _U)
