"""MinHash near-dedup with tensored banding.

A document's set holds its distinct five-word shingles. Two collections of
``HALVES`` half-keys are drawn, each half-key from ``ROWS`` minhashes; a table's key
joins a half-key of the one with a half-key of the other, so HALVES**2 tables cost
2 * HALVES * ROWS minhashes, about the square root of what independent tables
need. With 12 halves of 2 a pair at similarity 0.75 shares no table once in 10 000,
at 0.8 once in 100 000, at 0.9 never in practice. Tables are made in ``WAVES``, so
that only a part of all keys is being shuffled at a time.

Equal sets are one class throughout. Classes that share a table key are compared by
leaders (see ``leaders``), first by odd sketches: a bit for every bucket of
shingles, set if the bucket holds an odd number of them. The bits in which two
sketches differ are never more than the shingles in which the sets differ, so a
pair is left out only if it cannot be alike enough; the others are compared on
their full sets. Every pair that shares a key ends up in one component or refuted;
nothing is capped.

Defined results: a text without words has the empty set, linked with nothing; a
shorter text than a shingle is one shingle; rows that share a doc_id but not a
text are grouped by their own texts; a null doc_id is linked with nothing,
its component_id is null and it is kept; a very long text is one set like any
other; extra columns are ignored (kept by ``deduplicate``, which also keeps one of
several rows of equal doc_id and text); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.scratch import forget, materialize

from .leaders import Closeness, Near, joined_components
from .textkit import batches, mix64, seeds, texts, word_sets, words

SHINGLE, HALVES, ROWS, PERCENT = 5, 12, 2, 75
#: Parts in which the tables are made.
WAVES = 4
_U = np.uint64
_SIGNS = "doc_id long, t1 long, t2 long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>, sketch binary"


def _sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    data, offsets = texts(column)
    _, _, h, first = words(data, offsets, fold=True)
    return word_sets(h, first, shingle)


def _identities(sets: list[np.ndarray]) -> np.ndarray:
    """(2, sets): two 64-bit sums over each set; 0 for an empty one."""
    out = np.zeros((2, len(sets)), np.int64)
    some = [i for i, x in enumerate(sets) if len(x)]
    if some:
        own = [sets[i] for i in some]
        flat, first = np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1]
        with np.errstate(over="ignore"):
            for k in range(2):
                out[k, some] = np.add.reduceat(mix64(flat + seeds(2, 41)[k]), first).view(np.int64)
    return out


def half_keys(sets: list[np.ndarray], halves: int, rows: int) -> np.ndarray:
    """(sets, 2 * halves) signed half-keys; sets must not be empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    times, plus = seeds(2 * halves * rows, 31), seeds(2 * halves * rows, 32)
    out = np.zeros((2 * halves, len(sets)), _U)
    with np.errstate(over="ignore"):
        for i in range(2 * halves * rows):
            # The hashes are uniform already; an odd multiple, its high half folded in, permutes them anew.
            x = (flat + plus[i]) * times[i]
            x ^= x >> _U(32)
            x *= times[i]
            out[i // rows] = mix64(out[i // rows] + np.minimum.reduceat(x, first))
    return out.T.view(np.int64)


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Odd sketches: the set's size (8 bytes), then bits for at least twice as many buckets, a power of two."""
    size = np.array([len(x) for x in sets], np.int64)
    buckets = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(buckets)])
    h = mix64(np.concatenate(sets) + seeds(1, 51)[0])
    at = np.repeat(first[:-1], size) + (h & (np.repeat(buckets, size).astype(_U) - _U(1))).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=int(first[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [n.tobytes() + bits[a // 8 : b // 8] for n, a, b in zip(size, first[:-1].tolist(), first[1:].tolist(), strict=True)]


def table_key(table: Column, x: Column, y: Column, tables: int) -> Column:
    """A key's remainder by the number of tables is the number of its table."""
    h = F.shiftright(F.xxhash64(table, x, y), 1)
    return h - F.pmod(h, F.lit(tables)) + table


def maybe_alike(percent: int, halves: int) -> Near:
    """The similarity that two sketches still allow, negative if under ``percent``; never less than the true one.

    A payload is 32 bits of each half-key, then the sketch, so a pair that shares
    several tables is told by the first of them alone.
    """
    head = 8 * halves

    def near(payloads: list[bytes], keys: np.ndarray | None) -> Closeness:
        marks = np.frombuffer(b"".join([b[:head] for b in payloads]), np.uint32).reshape(len(payloads), 2 * halves)
        size = np.array([np.frombuffer(b, np.int64, 1, head)[0] for b in payloads], np.int64)
        level = np.array([(len(b) - head - 8).bit_length() for b in payloads])
        place = np.zeros(len(payloads), np.int64)
        below = np.zeros(len(payloads), np.int64)
        rows: dict[int, np.ndarray] = {}
        # Halves added bit by bit are the sketch of half as many buckets.
        for k in sorted(set(level.tolist()), reverse=True):
            own = np.flatnonzero(level == k)
            bits = np.frombuffer(b"".join([payloads[i][head + 8 :] for i in own]), np.uint64).reshape(len(own), -1)
            before = rows.get(k)
            place[own] = np.arange(len(own)) + (0 if before is None else len(before))
            rows[k] = bits if before is None else np.concatenate([before, bits])
            half = bits.shape[1] // 2
            if half:
                below[own] = np.arange(len(own))
                rows[k - 1] = bits[:, :half] ^ bits[:, half:]

        def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.full(len(i), -1.0)
            n, m = size[i], size[j]
            some = np.flatnonzero((100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.abs(level[i] - level[j]) <= 1))
            least = np.minimum(level[i[some]], level[j[some]])
            for k in np.unique(least).tolist():
                at = some[least == k]
                table = rows[k]
                for s in range(0, len(at), 1 << 14):
                    part = at[s : s + (1 << 14)]
                    x, y = i[part], j[part]
                    u, v = np.where(level[x] == k, place[x], below[x]), np.where(level[y] == k, place[y], below[y])
                    apart = np.bitwise_count(table[u] ^ table[v]).sum(axis=1, dtype=np.int64)
                    total = size[x] + size[y]
                    good = (100 - percent) * total >= (100 + percent) * apart
                    if keys is not None:
                        hit = np.flatnonzero(good)
                        same = marks[x[hit]] == marks[y[hit]]
                        good[hit] = same[:, :halves].argmax(axis=1) * halves + same[:, halves:].argmax(axis=1) == keys[x[hit]] % (halves * halves)
                    out[part] = np.where(good, (total - apart) / np.maximum(total + apart, 1), -1.0)
            return out

        return close

    return near


def text_id(text: Column) -> tuple[Column, Column]:
    """A text's identity in 128 bits; null has its own."""
    return F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), F.length(text), text).alias("t2")


def signatures(docs: DataFrame, shingle: int = SHINGLE, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """Set sizes, set identities and half-keys of all documents."""

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, "text", 2 << 20):
            sets = _sets(batch.column("text"), shingle)
            size = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(size)
            keys = np.zeros((len(sets), 2 * halves), np.int64)
            identity = np.zeros((2, len(sets)), np.int64)
            shown = [b""] * len(sets)
            if len(some):
                own = [sets[i] for i in some]
                keys[some] = half_keys(own, halves, rows)
                for i, blob in zip(some.tolist(), sketches(own), strict=True):
                    shown[i] = keys[i].astype(np.uint64).astype(np.uint32).tobytes() + blob
                identity[:, some] = _identities(own)
            edge = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * halves)
            lists = [pa.ListArray.from_arrays(edge, pa.array(np.ascontiguousarray(part).reshape(-1))) for part in (keys[:, :halves], keys[:, halves:])]
            own_columns = [batch.column(c) for c in ("doc_id", "t1", "t2")]
            yield pa.RecordBatch.from_arrays([*own_columns, pa.array(size), pa.array(identity[0]), pa.array(identity[1]), *lists, pa.array(shown, pa.binary())], ["doc_id", "t1", "t2", "n_shingles", "s1", "s2", "a", "b", "sketch"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_id(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    return rows_in.mapInArrow(sign, _SIGNS)


def _verified(pairs: DataFrame, shown: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether their full sets are alike enough."""

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, "text_b", 1 << 20):
            # A leader's rows follow one another, so its set is built once.
            coded = batch.column("text_a").dictionary_encode()
            left, right = _sets(coded.dictionary, shingle), _sets(batch.column("text_b"), shingle)
            linked = []
            for i, y in zip(coded.indices.to_pylist(), right, strict=True):
                x = left[i]
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    first = pairs.join(shown.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    full = first.join(shown.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    checked = full.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, linked boolean")
    return checked.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _shared_keys(classes: DataFrame, halves: int) -> DataFrame:
    """(key, id) of the table keys that several classes hold; each part of the tables is written before the next is made."""
    parts = []
    for wave in range(min(WAVES, halves)):
        keys = (
            classes.select("id", F.posexplode("a").alias("i", "x"), "b")
            .where(F.pmod("i", F.lit(WAVES)) == wave)
            .select("id", "i", "x", F.posexplode("b").alias("j", "y"))
            .select(table_key(F.col("i") * halves + F.col("j"), F.col("x"), F.col("y"), halves * halves).alias("key"), "id")
        )
        led = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "tables")
        # Only keys with several classes; a hot key's side is split by the join.
        parts.append(materialize(keys.join(led, "key"), "members"))
        forget(led)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    together = materialize(out, "members")
    forget(*parts)
    return together


def _grouped(docs: DataFrame, shingle: int, halves: int, rows: int, percent: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles, component_id: one row per input row."""
    signed = materialize(signatures(docs, shingle, halves, rows), "signatures")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("sketch").alias("sketch"))
    # A document id with several texts has several classes; they are told apart by a number of their own.
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    signs = materialize(signed.select("doc_id", "t1", "t2", "n_shingles", "s1", "s2"), "signs")
    forget(signed)
    members = _shared_keys(classes, halves)
    wanted = members.select("id").distinct()
    payloads = materialize(classes.select("id", F.col("sketch").alias("payload")).join(wanted, "id", "left_semi"), "sketches")
    names = materialize(classes.select("id", "rep", "s1", "s2"), "class-names")
    forget(classes)

    def verify(pairs: DataFrame) -> DataFrame:
        """Full sets, from the texts of one document of each class."""
        return _verified(pairs, shown, shingle, percent).where("linked").select("a", "b")

    def own_text(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the texts that share a document id, those of the class."""
        for batch in batches(frames, "text", 1 << 20):
            ours = _identities(_sets(batch.column("text"), shingle))
            good = (ours[0] == batch.column("s1").to_numpy()) & (ours[1] == batch.column("s2").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text")], ["id", "text"]).filter(pa.array(good))

    # The texts of candidates are picked once, one of each class: texts that differ in case or spaces have one set.
    chosen = wanted.join(names, "id")
    texts_of = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text")).where("text is not null")
    picked = texts_of.join(chosen.hint("shuffle_hash"), "rep").select("id", "s1", "s2", "text")
    picked = materialize(picked.mapInArrow(own_text, "id long, text string"), "texts")
    shown = materialize(picked.groupBy("id").agg(F.min("text").alias("text")), "texts") if picked.count() > payloads.count() else picked
    found = joined_components(members, payloads, maybe_alike(percent, halves), verify)
    forget(picked, shown)
    # The least document id of each component; the component of a third of the classes is split by the joins.
    placed = names.join(found, F.col("id") == F.col("node"), "left").select("s1", "s2", "rep", F.coalesce("component", "id").alias("part"))
    placed = materialize(placed, "placed")
    forget(members, payloads, names, found)
    least = materialize(placed.groupBy("part").agg(F.min("rep").alias("component_id")), "least-ids")
    of_class = materialize(placed.join(least, "part").select("s1", "s2", "component_id"), "class-components")
    forget(placed, least)
    # Rows without words or id have no class, and no hash that they all share.
    out = signs.where("n_shingles > 0 and doc_id is not null").join(of_class, ["s1", "s2"], "left").select("doc_id", "t1", "t2", "n_shingles", "component_id")
    alone = signs.where("n_shingles = 0 or doc_id is null").select("doc_id", "t1", "t2", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone)


def groups(docs: DataFrame, shingle: int = SHINGLE, halves: int = HALVES, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    out = _grouped(docs, shingle, halves, rows, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that ``groups`` keeps, with their own columns; of rows with equal doc_id and text, one."""
    found = _grouped(docs, SHINGLE, HALVES, ROWS, PERCENT).where("doc_id = component_id")
    kept = materialize(found.groupBy(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.count("*").alias("_n")), "kept")
    first, second = text_id(F.col("text"))
    named = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), first.alias("_t1"), second.alias("_t2"))
    chosen = named.where("_id is not null").join(kept, ["_id", "_t1", "_t2"])
    once = chosen.where("_n > 1").dropDuplicates(["_id", "_t1", "_t2"]).select("_doc.*")
    return chosen.where("_n = 1").select("_doc.*").union(once).union(named.where("_id is null").select("_doc.*"))
