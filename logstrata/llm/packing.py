"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents become token ids closed by an end id; only documents longer than a
sequence are cut. Pieces are dealt evenly to groups of bounded size, and each
group is packed best-fit decreasing. Dual feasible functions of the group's
length histogram bound its number of sequences from below; a group that meets its
bound is certified. Groups with a gap (even the part of a sequence that rounding up
a bound would hide) give up the pieces of all sequences that are not full. These
are dealt anew, over fewer groups, and packed again, and the new packing is kept
when it needs fewer sequences; then certified groups with room join in. Rounds end
when the whole meets the bound of the whole histogram, or no longer gain.

A task packs about ``GROUP`` pieces, in later rounds up to ``WIDEST`` times as many;
none gathers more, however many documents there are.

Defined results: a null or empty text is the end id alone (length 1); repeated
rows are packed one by one; extra columns are ignored; an empty table gives no
rows. A sequence is ``capacity`` tokens; offsets within it are gapless from 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.scratch import materialize

from .textkit import batches
from .tokens import encoder

CAPACITY, GROUP, ROUNDS = 2048, 16384, 8
#: How many times GROUP pieces a group of a later round may hold.
WIDEST = 8


def lower_bound(counts: np.ndarray, capacity: int) -> Fraction:
    """Sequences that pieces need at least, before rounding up; counts[x] pieces have length x."""
    size = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    best = Fraction(int((counts * size).sum()), capacity)
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    mass = np.concatenate([[0], np.cumsum(counts * size)])
    for k in range(1, capacity // 2 + 1):
        # Lengths over capacity - k count as a sequence, under k as nothing.
        large, middle = int(above[min(capacity - k + 1, len(counts))]), int(mass[min(capacity - k + 1, len(counts))] - mass[k])
        if large * capacity + middle > best * capacity:
            best = Fraction(large * capacity + middle, capacity)
    for k in range(1, 21):
        # Rounded multiples: floor((k + 1) x / capacity) / k, or x / capacity where the multiple is whole.
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, scaled * k, (scaled // capacity) * capacity * (k + 1))
        best = max(best, Fraction(int((counts * value).sum()), capacity * k * (k + 1)))
    return best


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """(bin, offset) of each of the descending sizes, and the number of bins: each goes where least room is left."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, 0
    where, offset = [], []
    for size in sizes:
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            target = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            left, target = capacity, bins
            bins += 1
        where.append(target)
        offset.append(capacity - left)
        left -= size
        if left:
            if not room[left]:
                open_rooms |= 1 << left
            room[left].append(target)
    return where, offset, bins


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    end = int(end_id).to_bytes(4, "little")

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches(frames, "text"):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tool.ids(batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, _fill long, _gap boolean"


def _pack_groups(rows: DataFrame, groups: int, capacity: int, attempt: int) -> DataFrame:
    """Pack each group; ``_gap`` marks groups over their bound."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size = table.column("length").to_numpy()
        order = np.argsort(-size, kind="stable")
        where, offset, bins = best_fit(size[order].tolist(), capacity)
        bound = lower_bound(np.bincount(size, minlength=capacity + 1), capacity)
        where_by = np.empty(len(size), np.int64)
        offset_by = np.empty(len(size), np.int64)
        where_by[order], offset_by[order] = where, offset
        fill = np.bincount(where_by, weights=size, minlength=bins).astype(np.int64)
        base = (attempt << 52) + (int(key[0].as_py()) << 20)
        out = table.select(_COLUMNS)
        for name, values in (("sequence_id", where_by + base), ("offset", offset_by), ("_fill", fill[where_by]), ("_gap", np.full(len(size), bins > bound))):
            out = out.append_column(name, pa.array(values))
        return out

    # The row number is spread by a hash: neither a document nor a length decides the group.
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(attempt), "_row"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(pack, _PACKED)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Where every piece of every document goes: its columns, sequence_id and offset."""
    cut = materialize(pieces(docs, vocabulary, capacity, end_id).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(cut, capacity, group, rounds)


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``pack`` for pieces that have been cut (with a unique ``_row``)."""
    # The histogram has at most ``capacity`` rows; it bounds the whole as each group's bounds the group.
    histogram = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    total, bound = int(histogram.sum()), math.ceil(lower_bound(histogram, capacity))
    current = materialize(_pack_groups(cut, max(1, -(-total // group)), capacity, 0), "packed")
    used = current.agg(F.count_distinct("sequence_id")).first()[0]
    # First the groups over their own bounds exchange; then all that have room, since one group's room may fit another's pieces.
    wide, failures = False, 0
    for attempt in range(1, rounds + 1):
        if used <= bound:
            break
        loose = (F.col("_fill") < capacity) & (F.lit(wide) | F.col("_gap"))
        count, before = current.where(loose).agg(F.count("*"), F.count_distinct("sequence_id")).first()
        # Later rounds pack larger groups, up to a bound: fewer partitions, fewer gaps.
        groups = max(1, -(-count // (group * min(1 << attempt, WIDEST))))
        after = before
        if count:
            again = current.where(loose).select(*_COLUMNS, F.monotonically_increasing_id().alias("_row"))
            packed = materialize(_pack_groups(materialize(again, "loose"), groups, capacity, attempt), "packed")
            after = packed.agg(F.count_distinct("sequence_id")).first()[0]
        if after < before:
            used -= before - after
            rest = current.where(~loose)
            # Sequences that stay are read from where they were written.
            current = packed.unionByName(rest)
        elif wide:
            failures += 1
            if failures > 1 or groups == 1:
                break
        wide = wide or attempt > 1 or after >= before
    return current.select(*_COLUMNS, "sequence_id", "offset")
