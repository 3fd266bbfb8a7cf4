"""Document fingerprints by randomised edit embedding.

All texts are walked over with the same random bits: at step j of a walk the
current character is emitted, and the bit that j and the character's class select
says whether the walk moves on to the next character. Texts that differ by few
edits fall back into step, so edit distance becomes Hamming distance between the
walks. A walk may stay out of step after an edit, so ``WALKS`` walks with bits of their
own are taken. The fingerprint is a bit sample of the walks: of each 128 step positions,
shared by all texts and chosen consistently for every walk length (the position of
least hash in its class among the steps walked), each giving four hashed bits of the
character emitted there. The likeness of two walks is the share of equal samples,
corrected for chance; the likeness of two texts is that of the walks that agree most.

``near_groups`` bands the samples: texts that agree in a whole band of some walk
are candidates, verified by their likeness (see ``leaders``); equal fingerprints are
one class throughout.

The walks of many texts go in lockstep, a character of each at a time; when few texts
are left, they go on one by one, so a very long text holds up no others.

Defined results: null text is empty; an empty text has the fingerprint of zeros and is
linked with empty ones only; equal texts have equal fingerprints; rows follow one another
by descending doc_id (null last), then by hash of text, then as read; the last row is followed by
the first, a single row by itself; repeated rows are neighbours; a null doc_id has a
null component_id unless it is linked; a very long text is walked in whole; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.scratch import forget, materialize, width

from .leaders import Closeness, Near, joined_components, shared_keys
from .rowmarks import marks_of, picked, with_mark
from .textkit import batches, mix64

WALKS, SAMPLES, CLASSES, PERIOD = 4, 128, 64, 1024
#: Samples of a band (48 bits), and the least likeness of linked texts.
BAND, LEAST = 12, 0.7
#: Characters that go in lockstep at a time, texts from which lockstep pays, and bytes of texts held.
CELLS, FEW, HELD = 2 << 20, 32, 3 << 20
BYTES = WALKS * SAMPLES // 2
_U = np.uint64
_SEED = _U(0x51A7E0F1D3C2B495)


@lru_cache(maxsize=1)
def _walk_tables() -> np.ndarray:
    """next[walk, step * CLASSES + class]: the step (modulo PERIOD) after the character at a step is passed."""
    out = np.zeros((WALKS, PERIOD, CLASSES), np.int64)
    for w in range(WALKS):
        bits = (mix64(np.arange(PERIOD * CLASSES, dtype=_U) + _SEED + _U(w << 32)) >> _U(40)) & _U(1)
        move = bits.reshape(PERIOD, CLASSES).astype(bool)
        twice = np.concatenate([move, move])
        for c in range(CLASSES):
            ones = np.flatnonzero(twice[:, c])
            out[w, :, c] = (ones[np.searchsorted(ones, np.arange(PERIOD))] + 1) % PERIOD
    return out.reshape(WALKS, PERIOD * CLASSES)


@lru_cache(maxsize=1)
def _walk_states() -> np.ndarray:
    """The same tables one after another, a state being the place of its step's first class."""
    return ((_walk_tables() + np.arange(WALKS)[:, None] * PERIOD) * CLASSES).reshape(-1).astype(np.int32)


@lru_cache(maxsize=1)
def _walk_lists() -> list[list[int]]:
    """The same tables for texts that go one by one: a state is step * CLASSES."""
    return [(t * CLASSES).tolist() for t in _walk_tables()]


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    return (mix64(np.arange(0x110000, dtype=_U) + _SEED) & _U(CLASSES - 1)).astype(np.uint8)


class _Positions:
    """For each of the SAMPLES classes the step positions that hold its record least hash."""

    def __init__(self) -> None:
        self.limit = 0

    def grow(self, steps: int) -> None:
        self.limit = max(1 << 18, 1 << (steps + 1).bit_length())
        h = mix64(np.arange(self.limit, dtype=_U) * _U(0x9E3779B97F4A7C15) + _SEED)
        kind, least = (h & _U(SAMPLES - 1)).astype(np.int64), h >> _U(7)
        keys = []
        for b in range(SAMPLES):
            at = np.flatnonzero(kind == b)
            run = np.minimum.accumulate(least[at])
            keys.append(at[np.append(True, run[1:] < run[:-1])] + b * self.limit)
        self.first = np.cumsum([0, *map(len, keys)])[:-1]
        self.keys = np.concatenate(keys)

    def of(self, steps: np.ndarray) -> np.ndarray:
        """(texts, SAMPLES): positions for walks of so many steps."""
        if steps.max(initial=0) >= self.limit:
            self.grow(int(steps.max()))
        base = np.arange(SAMPLES) * self.limit
        found = np.searchsorted(self.keys, (steps[:, None] + base).reshape(-1)).reshape(len(steps), SAMPLES) - 1
        at = self.keys[np.maximum(found, 0)] - base
        spare = (mix64(np.arange(SAMPLES, dtype=_U) + _SEED)[None, :] % np.maximum(steps, 1).astype(_U)[:, None]).astype(np.int64)
        return np.where(found < self.first, spare, at)


_positions = _Positions()


class Walks(NamedTuple):
    """Walks of texts: the characters' code points one text after another, ``first`` the places where texts begin."""

    points: np.ndarray
    first: np.ndarray
    #: (walks, texts): the step modulo PERIOD before each text's first character.
    begin: np.ndarray
    #: (walks, characters): the step modulo PERIOD after each character.
    state: np.ndarray

    def taken(self, w: int) -> np.ndarray:
        """How many steps walk ``w`` has taken when it passes a character, from the text's beginning."""
        size = np.diff(self.first)
        some = size > 0
        gone = np.empty(len(self.points), np.int32)
        gone[1:] = self.state[w, :-1]
        gone[self.first[:-1][some]] = self.begin[w, some]
        # PERIOD is a power of two.
        gone = np.cumsum(((self.state[w] - gone - 1) & (PERIOD - 1)) + 1, dtype=np.int64)
        heads = self.first[:-1][some]
        base = np.where(heads > 0, gone[np.maximum(heads - 1, 0)], 0)
        return gone - np.repeat(base, size[some])


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points one text after another, places where texts begin and the last ends)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, texts)])


def walk(points: np.ndarray, first: np.ndarray, begin: np.ndarray | None = None) -> Walks:
    """The walks over texts, from steps ``begin`` (walks, texts) modulo PERIOD on."""
    kinds, size = _class_table()[points], np.diff(first)
    state = np.zeros((WALKS, len(points)), np.uint16)
    begin = np.zeros((WALKS, len(size)), np.int64) if begin is None else begin
    order, flat = np.argsort(-size, kind="stable"), _walk_states()
    at = 0
    while at < len(order) and size[order[at]]:
        # Texts of like length go together; their columns hold a bounded number of characters.
        some = order[at : at + max(FEW, CELLS // int(size[order[at]]))]
        some = some[size[some] > 0]
        at += len(some)
        length, start = size[some], first[some]
        longest = int(length[0])
        live = np.searchsorted(-length, -np.arange(longest), "left")
        lockstep = int(np.searchsorted(-live, -FEW, "right"))
        now = begin[:, some]
        if lockstep:
            kind = np.zeros((len(some), lockstep), np.uint8)
            for k, (a, n) in enumerate(zip(start.tolist(), np.minimum(length, lockstep).tolist(), strict=True)):
                kind[k, :n] = kinds[a : a + n]
            kind = np.ascontiguousarray(kind.T)
            seen = np.zeros((lockstep, WALKS, len(some)), np.int32)
            state_now = ((now + np.arange(WALKS)[:, None] * PERIOD) * CLASSES).astype(np.int32)
            for t, n in enumerate(live[:lockstep].tolist()):
                state_now[:, :n] = flat.take(state_now[:, :n] + kind[t, :n])
                seen[t, :, :n] = state_now[:, :n]
            now = (state_now // CLASSES) & (PERIOD - 1)
            turned = np.ascontiguousarray(((seen // CLASSES) & (PERIOD - 1)).astype(np.uint16).transpose(2, 1, 0))
            for k, (a, n) in enumerate(zip(start.tolist(), np.minimum(length, lockstep).tolist(), strict=True)):
                state[:, a : a + n] = turned[k, :, :n]
        for k in range(int(live[lockstep]) if lockstep < longest else 0):
            a, b = int(start[k]) + lockstep, int(start[k] + length[k])
            rest = kinds[a:b].tolist()
            for w, table in enumerate(_walk_lists()):
                s = int(now[w, k]) * CLASSES
                state[w, a:b] = np.frombuffer(array("i", [s := table[s | c] for c in rest]), np.int32) // CLASSES
    return Walks(points, first, begin, state)


def _bits(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Four bits of the characters emitted at step positions."""
    value = mix64(points.astype(_U) + _SEED) >> _U(16)
    return (mix64(value + at.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(60)).astype(np.uint8)


def _last(taken: np.ndarray, first: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Steps after the first ``kept`` characters of each text."""
    out = np.zeros(len(kept), np.int64)
    out[kept > 0] = taken[(first[:-1] + kept - 1)[kept > 0]]
    return out


def _emitted(walks: Walks, ends: np.ndarray, reach: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that texts ``rows`` emit at step positions ``at``; ``ends`` are the steps taken, ``reach`` apart from text to text."""
    asked = at + rows * reach
    # Searches in order find their places near one another.
    order = np.argsort(asked, kind="stable")
    place = np.empty(len(at), np.int64)
    place[order] = np.searchsorted(ends, asked[order], side="right")
    return walks.points[np.minimum(place, len(walks.points) - 1)]


def _apart(walks: Walks, taken: np.ndarray) -> tuple[np.ndarray, int]:
    """Steps taken, far enough apart from text to text that one search serves all."""
    reach = int(taken.max(initial=0)) + 2
    return taken + np.repeat(np.arange(len(walks.first) - 1) * reach, np.diff(walks.first)), reach


def _samples(walks: Walks, edits: tuple[np.ndarray, Walks] | None = None) -> list[np.ndarray]:
    """(texts, WALKS * SAMPLES) samples of four bits of the texts; with (cut, tail), also of their first ``cut`` characters and the tail's after them."""
    size = np.diff(walks.first)
    n, rows = len(size), np.arange(len(size))
    out = [np.zeros((n, WALKS, SAMPLES), np.uint8) for _ in range(1 + (edits is not None))]
    for w in range(WALKS):
        taken = walks.taken(w)
        total = _last(taken, walks.first, size)
        some = np.flatnonzero(total > 0)
        ends, reach = _apart(walks, taken)
        if len(some):
            at = _positions.of(total[some])
            found = _emitted(walks, ends, reach, np.repeat(rows[some], SAMPLES), at.reshape(-1))
            out[0][some, w] = _bits(found.reshape(at.shape), at)
        if edits is None:
            continue
        cut, tail = edits
        beyond = tail.taken(w)
        head = _last(taken, walks.first, cut)
        total = head + _last(beyond, tail.first, np.diff(tail.first))
        some = np.flatnonzero(total > 0)
        if len(some):
            at, end = _positions.of(total[some]), head[some][:, None]
            points = np.zeros(at.shape, np.uint32)
            early = at < end
            owner = np.broadcast_to(rows[some][:, None], at.shape)
            if early.any():
                points[early] = _emitted(walks, ends, reach, owner[early], at[early])
            if not early.all():
                points[~early] = _emitted(tail, *_apart(tail, beyond), owner[~early], (at - end)[~early])
            out[1][some, w] = _bits(points, at)
    return [x.reshape(n, WALKS * SAMPLES) for x in out]


def packed(samples: np.ndarray) -> np.ndarray:
    """(texts, BYTES): two samples a byte."""
    return samples[:, 0::2] << 4 | samples[:, 1::2]


def fingerprints(texts: list[str]) -> np.ndarray:
    return packed(_samples(walk(*points_of(texts)))[0])


def fingerprint(text: str | None) -> str:
    return fingerprints([text or ""])[0].tobytes().hex()


def likenesses(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 to 1 for pairs of packed rows: the equal samples of the walk that agrees most, beyond those that chance makes equal."""
    apart = (x ^ y).reshape(len(x), WALKS, SAMPLES // 2)
    equal = ((apart < 16).sum(axis=2) + ((apart & 15) == 0).sum(axis=2)).max(axis=1) / SAMPLES
    return np.maximum(0.0, (equal - 1 / 16) / (15 / 16))


_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGE = ", _pid int, _edge string, _id long, _text string"


def _compared(ids: list[int | None], texts: list[str], following: list[str], chained: bool) -> pa.RecordBatch:
    """Texts against their edited forms and the texts that follow them: in a chain, the next of ``texts`` and at the end the last of ``following``."""
    n = len(texts)
    everything = [*texts, following[-1]] if chained else [*texts, *following]
    own = walk(*points_of(everything))
    size = np.diff(own.first)
    cut = size - size // 3
    tails = [f[: k // 3] for f, k in zip(following, size[:n].tolist(), strict=True)] + [""] * (len(everything) - n)
    begin = np.zeros((WALKS, len(everything)), np.int64)
    begin[:, cut > 0] = own.state[:, (own.first[:-1] + cut - 1)[cut > 0]]
    plain, edited = map(packed, _samples(own, (cut, walk(*points_of(tails), begin))))
    after = plain[1:] if chained else plain[n:]
    plain, edited = plain[:n], edited[:n]
    sha = [hashlib.sha256((t[:c] + x).encode("utf-8", "surrogatepass")).hexdigest() for t, c, x in zip(texts, cut.tolist(), tails, strict=False)]
    columns = [ids, size[:n], sha, [r.tobytes() for r in plain], [r.tobytes() for r in edited], likenesses(plain, edited), likenesses(plain, after)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], list(_NAMES))


def _with_edges(batch: pa.RecordBatch | None, edges: list[tuple[int, str, int | None, str]]) -> pa.RecordBatch:
    n, m = (batch.num_rows if batch is not None else 0), len(edges)
    columns = [pa.concat_arrays([batch.column(k), pa.nulls(m, t)]) if batch is not None else pa.nulls(m, t) for k, t in enumerate(_TYPES)]
    columns += [pa.array([None] * n + [e[k] for e in edges], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, [*_NAMES, "_pid", "_edge", "_id", "_text"])


def _neighbours(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a sorted partition against the next; its first and last rows go out as edges."""
    part, held_id, held, begun = TaskContext.get().partitionId(), None, "", False
    for batch in batches(frames, "packed", HELD // 2):
        ids, texts = batch.column("doc_id").to_pylist(), [zstandard.decompress(b).decode("utf-8", "surrogatepass") for b in batch.column("packed").to_pylist()]
        edges = [] if begun else [(part, "head", ids[0], texts[0])]
        if begun:
            ids, texts = [held_id, *ids], [held, *texts]
        begun, held_id, held = True, ids[-1], texts[-1]
        yield _with_edges(_compared(ids[:-1], texts[:-1], texts[1:], True) if len(texts) > 1 else None, edges)
    if begun:
        yield _with_edges(None, [(part, "tail", held_id, held)])


def _across(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        if batch.num_rows:
            yield _compared(*(batch.column(c).to_pylist() for c in ("a", "x", "y")), False)


def _shrunk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are sorted whole."""
    small = zstandard.ZstdCompressor(level=1)
    for batch in frames:
        packed = pa.array([small.compress(b) for b in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_hash"), batch.column("_row"), packed], ["doc_id", "_hash", "_row", "packed"])


def compare_neighbours(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, their likeness to both those and the next document's, and the least id of the texts that likeness links."""
    parts = width(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"), F.encode(text, "UTF-8").alias("text"))
    rows = rows.mapInArrow(_shrunk, "doc_id long, _hash long, _row long, packed binary")
    order = [F.col("doc_id").desc_nulls_last(), "_hash", "_row"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "packed")
    done = materialize(placed.mapInArrow(_neighbours, _RESULT + _EDGE).withColumn("row", F.monotonically_increasing_id()), "editprint")
    edges = done.where("_edge is not null").select("_pid", "_edge", "_id", "_text")
    # The ids of the partitions that have rows: one number a partition.
    full = sorted(r[0] for r in edges.where("_edge = 'head'").select("_pid").collect())
    after = docs.sparkSession.createDataFrame([(p, full[(i + 1) % len(full)]) for i, p in enumerate(full)], "_pid int, _next int")
    tails = edges.where("_edge = 'tail'").join(after, "_pid").select(F.col("_id").alias("a"), F.col("_text").alias("x"), F.col("_next").alias("_pid"))
    heads = edges.where("_edge = 'head'").select("_pid", F.col("_text").alias("y"))
    # Rows of the edges are numbered as if they were in partitions of their own.
    across = tails.join(heads, "_pid").select("a", "x", "y").mapInArrow(_across, _RESULT)
    joins = materialize(across.withColumn("row", F.monotonically_increasing_id() + F.lit(1 << 60)), "editprint-edges")
    both = done.where("_edge is null").select("row", *_NAMES).unionByName(joins)
    groups, alone = _components(both.select("row", "doc_id", "n_chars", F.col("fingerprint").alias("payload")), least)
    marked = with_mark(both, alone, "row", "alone")
    others = marked.where("not alone").join(groups, "fingerprint", "left")
    shown = marked.where("alone").withColumn("component_id", F.col("doc_id")).unionByName(others)
    empty = both.where("n_chars = 0").agg(F.min("doc_id")).first()[0]
    component = F.when(F.col("n_chars") > 0, F.col("component_id")).otherwise(F.lit(empty).cast("long"))
    hexed = [F.lower(F.hex(c)).alias(c) if c.endswith("fingerprint") else F.col(c) for c in _NAMES]
    return shown.select(*hexed, component.alias("component_id"))


def alike(least: float) -> Near:
    """Likeness of fingerprints, negative under ``least``."""

    def near(payloads: list[bytes], keys: np.ndarray | None) -> Closeness:
        rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), BYTES)

        def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.empty(len(i))
            for s in range(0, len(i), 1 << 12):
                part = slice(s, s + (1 << 12))
                out[part] = likenesses(rows[i[part]], rows[j[part]])
            return np.where(out >= least, out, -1.0)

        return close

    return near


def _components(prints: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(fingerprint, component_id) of the fingerprints of texts that are not empty, and marks of the rows whose fingerprint nothing else has or is like, from (row, doc_id, n_chars, payload)."""
    some = prints.where("n_chars > 0").groupBy("payload").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    some = materialize(some, "prints")

    def band(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of runs of BAND samples of each walk."""
        for batch in frames:
            rows = np.frombuffer(b"".join(batch.column("payload").to_pylist()), np.uint8).reshape(batch.num_rows, WALKS, SAMPLES // 2)
            wide = BAND // 2
            for w in range(WALKS):
                for b in range(SAMPLES // BAND):
                    six = np.zeros((len(rows), 8), np.uint8)
                    six[:, :wide] = rows[:, w, b * wide : (b + 1) * wide]
                    key = mix64(six.view(_U)[:, 0] + _U((w * 64 + b + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("id")], ["key", "id"])

    keys = some.select("id", "payload").mapInArrow(band, "key long, id long")
    members = materialize(shared_keys(keys), "band-members")
    wanted = marks_of(members.select("id"), "band-wanted")
    payloads = materialize(picked(some.select("id", "payload"), wanted), "band-prints")
    found = joined_components(members, payloads, alike(least), lambda pairs: pairs)
    # Only fingerprints that several rows have, or that are linked, are sent to their rows.
    linked = marks_of(found.select("node"), "prints-linked")
    marked = with_mark(some, linked, "id", "linked")
    placed = marked.where("linked").select("id", "doc_id").join(found, F.col("id") == F.col("node")).select("id", "component", "doc_id")
    placed = materialize(placed, "prints-placed")
    least_ids = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(placed.join(least_ids, "component").select("id", "component_id"), "prints-named")
    of_linked = marked.where("linked").select("id", "payload").join(named, "id").select(F.col("payload").alias("fingerprint"), "component_id")
    repeated = marked.where("not linked and n > 1").select(F.col("payload").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    out = materialize(of_linked.union(repeated), "print-groups")
    alone = marks_of(marked.where("not linked and n = 1").select("id"), "prints-alone")
    forget(members, wanted, payloads, some, found, linked, placed, named)
    return out, alone


def near_groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, component_id: one row per row, the least id of the texts that likeness links."""
    found = compare_neighbours(docs, least)
    return found.select("doc_id", "component_id")
