"""Embedding near-dedup with spherical-cap filters.

A filter is a direction; it takes the vectors within a cap around it. Directions
form random product codes: a rotated vector is split in two blocks, each block
has a codebook, and a filter is a pair of codewords, so M codewords a block give
M * M directions. The cap is as wide as lets ``SHARE`` random vectors in N pass a
filter; M is such that a pair at the least cosine shares ``SHARED`` filters of a code
on average, whatever N, and ``CODES`` codes with rotations of their own make misses
rare. List decoding finds all filters that a vector passes from 2 M products.

Vectors join on filters. The rows of one first codeword and a range of second ones
travel together, so a vector is sent once for several filters; within the task only
those that pass the same filter are compared, with exact products in double
precision, and a pair counts at the least filter that both pass. So the work is that
of the filters' groups, which hold SHARE random vectors each at any N. Rows that
travel together and are over ``BLOCK`` are dealt to pairs of blocks, so no task holds
more than two blocks; a task returns counts and a spanning forest of its links, never
the links themselves.

Equal vectors are one class, counted with its size.

Defined results: a vector that is null, empty, zero or holds a null or non-finite
component links with nothing and is kept; vectors of different lengths do not
link; rows that share a vec_id are vectors of their own; a null vec_id is counted
as a vector and, alone in its component, has a null component_id; a pair at just the
least cosine counts as linked; a vector of very many components is one like any other;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.scratch import forget, materialize, width

from .graph import components
from .leaders import runs

#: Measured with 64 components at cosine 0.95 exactly: one pair in 1 000 shares no filter, at 1 000, 50 000 and 1 000 000 vectors alike.
LEAST, CODES, SHARED, SHARE, BLOCK = 0.95, 3, 12.0, 32.0, 4096
#: Vectors that are to travel together for one first codeword, and members of a filter that are compared by a matrix product.
TOGETHER, MATRIX = 2048, 128


def cap_height(share: float, dim: int) -> float:
    """The product that a random unit vector of ``dim`` components exceeds with probability ``share``."""
    u = np.linspace(-1.0, 1.0, 200_001)
    density = np.maximum(1.0 - u * u, 0.0) ** max((dim - 3) / 2, 0.0)
    tail = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(u[min(np.searchsorted(-tail, -share), len(u) - 1)])


def both_pass(height: float, dim: int, cosine: float) -> float:
    """Probability that a vector passes a filter that another at ``cosine`` to it passes."""
    along, across = np.linspace(height, 1.0, 400), np.linspace(-1.0, 1.0, 1001)
    density = np.maximum(1.0 - along[:, None] ** 2 - across**2, 0.0) ** max((dim - 4) / 2, 0.0)
    passing = cosine * along[:, None] + math.sqrt(max(1.0 - cosine * cosine, 0.0)) * across >= height
    return float((density * passing).sum() / max(density.sum(), 1e-300))


@lru_cache(maxsize=16)
def plan(n: int, dim: int, least: float) -> tuple[int, float]:
    """(codewords a block, cap height) for n vectors."""
    share = min(SHARE / max(n, 1000), 0.25)
    height = cap_height(share, dim)
    passes = SHARED / max(both_pass(height, dim, least), 0.05)
    return int(math.ceil(math.sqrt(passes / share))), height


@lru_cache(maxsize=16)
def _code(dim: int, words: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, first codebook, second codebook); codewords have norm sqrt(1/2)."""
    rng = np.random.Generator(np.random.PCG64([5, dim, words, number]))
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    books = []
    for size in (dim - dim // 2, dim // 2):
        book = rng.standard_normal((words, size))
        norm = np.linalg.norm(book, axis=1, keepdims=True)
        books.append(book / np.maximum(norm, 1e-300) * math.sqrt(0.5) if size else book)
    return rotation, books[0], books[1]


def decode(vectors: np.ndarray, words: int, height: float, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) of all filters of a code that each unit vector passes, in order; filter i * words + j has codewords i and j."""
    dim = vectors.shape[1]
    rotation, one, two = _code(dim, words, number)
    turned, half = vectors @ rotation, dim - dim // 2
    who, passed = [], []
    for a in range(0, len(vectors), 1024):
        first, second = turned[a : a + 1024, :half] @ one.T, turned[a : a + 1024, half:] @ two.T
        if not dim // 2:
            second = np.zeros((len(first), words))
        need = height - second.max(axis=1)
        for k, (x, y) in enumerate(zip(first, second, strict=True)):
            i = np.flatnonzero(x >= need[k])
            if len(i):
                j = np.flatnonzero(y >= height - x[i].max())
                p, q = np.nonzero(x[i][:, None] + y[j] >= height)
                who.append(np.full(len(p), a + k))
                passed.append(i[p] * words + j[q])
    none = np.zeros(0, np.int64)
    return (np.concatenate(who), np.concatenate(passed)) if who else (none, none)


def _unit(blobs: list[bytes]) -> np.ndarray:
    return _normal(np.stack([np.frombuffer(b[1:], "<f4" if b[:1] == b"4" else "<f8").astype(np.float64) for b in blobs]))


def _normal(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that squares of very large or small components stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blob(x: np.ndarray) -> bytes:
    """The components, in single precision where that is exact."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return b"4" + short.tobytes() if (short == x).all() else b"8" + x.astype("<f8").tobytes()


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the links (i, j) of n nodes: each node to its least one."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _passed(unit: np.ndarray, words: int, height: float) -> list[np.ndarray]:
    """For each vector the filters of all codes that it passes, in order."""
    out: list[list[np.ndarray]] = [[] for _ in unit]
    for number in range(CODES):
        who, passed = decode(unit, words, height, number)
        for k, part in enumerate(np.split(passed, np.searchsorted(who, np.arange(1, len(unit))))):
            out[k].append(part + number * words * words)
    return [np.concatenate(x) for x in out]


def _met_before(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether vectors i and j pass a common filter below ``at``."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 20_000):
        x, y, least = i[s : s + 20_000], j[s : s + 20_000], at[s : s + 20_000]
        found = []
        for side in (x, y):
            flat = np.concatenate([lists[k] for k in side])
            pair = np.repeat(np.arange(len(side)), [len(lists[k]) for k in side])
            early = flat < least[pair]
            found.append((pair[early], flat[early]))
        pair, flat = np.concatenate([found[0][0], found[1][0]]), np.concatenate([found[0][1], found[1][1]])
        order = np.lexsort((flat, pair))
        pair, flat = pair[order], flat[order]
        again = (pair[1:] == pair[:-1]) & (flat[1:] == flat[:-1])
        out[s + pair[1:][again]] = True
    return out


class _Links:
    """Counts and spanning links of the rows of a group."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids, self.size = ids, size
        self.count, self.first, self.second = np.zeros(len(ids), np.int64), [], []

    def add(self, i: np.ndarray, j: np.ndarray, new: np.ndarray) -> None:
        np.add.at(self.count, i[new], self.size[j[new]])
        np.add.at(self.count, j[new], self.size[i[new]])
        u, v = _forest(len(self.ids), i, j)
        self.first.append(u)
        self.second.append(v)

    def batch(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.count)
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.first, self.second))
        if len(u):
            u, v = _forest(len(self.ids), u, v)
        ids = np.concatenate([self.ids[some], self.ids[u]])
        other = pa.array(np.concatenate([np.zeros(len(some), np.int64), self.ids[v]]), mask=np.arange(len(ids)) < len(some))
        return pa.RecordBatch.from_arrays([pa.array(ids), other, pa.array(np.concatenate([self.count[some], np.zeros(len(u), np.int64)]))], ["id", "other", "links"])


def _meet(table: pa.Table, words: int, height: float, least: float) -> pa.RecordBatch | None:
    """Links of rows that travelled together, by the filters that they share: (id, null, links counted here), (id, other, 0) of a spanning forest."""
    lo, hi, number = (table.column(c)[0].as_py() for c in ("lo", "hi", "code"))
    own = table.column("own").to_numpy()
    lists = [np.frombuffer(x, np.int64) for x in table.column("filters").to_pylist()]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists)
    order = np.argsort(flat, kind="stable")
    row, flat = row[order], flat[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    size = np.diff(np.append(start, len(flat)))
    if size.max() < 2:
        return None
    unit = _unit(table.column("vector").to_pylist())
    links = _Links(table.column("id").to_numpy(), table.column("m").to_numpy())
    full: dict[int, np.ndarray] = {}

    def passed(rows: np.ndarray) -> None:
        missing = np.array([k for k in np.unique(rows).tolist() if k not in full], np.int64)
        if len(missing):
            full.update(zip(missing.tolist(), _passed(unit[missing], words, height), strict=True))

    base = number * words * words
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, n in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = row[a : a + n]
        if n > MATRIX:
            _matrix(members, int(flat[a]) + base, unit, own, lo, hi, least, links, full, passed)
            continue
        i, j = np.triu_indices(n, 1)
        held.append((members[i], members[j], np.full(len(i), flat[a] + base)))
    if held:
        i, j, at = (np.concatenate(x) for x in zip(*held, strict=True))
        # Blocks that meet: a pair of one block only where the block meets itself.
        good = (own[i] != own[j]) | (lo == hi)
        i, j, at = np.minimum(i, j)[good], np.maximum(i, j)[good], at[good]
        order = np.lexsort((at, j, i))
        i, j, at = i[order], j[order], at[order]
        fresh = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])) if len(i) else np.zeros(0, bool)
        i, j, at = i[fresh], j[fresh], at[fresh]
        hit = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 14):
            p = slice(s, s + (1 << 14))
            hit[p] = np.einsum("ij,ij->i", unit[i[p]], unit[j[p]]) >= least
        i, j, at = i[hit], j[hit], at[hit]
        if len(i):
            passed(np.concatenate([i, j]))
            links.add(i, j, ~_met_before(full, i, j, at))
    return links.batch()


def _matrix(members, at, unit, own, lo, hi, least, links, full, passed) -> None:
    """A filter that many pass: products of blocks of its members, and of their marks at lesser filters."""
    passed(members)
    early = [full[k][full[k] < at] for k in members.tolist()]
    which = np.repeat(np.arange(len(members)), [len(x) for x in early])
    _, column, count = np.unique(np.concatenate(early), return_inverse=True, return_counts=True)
    several = count[column] > 1
    which, column = which[several], np.unique(column[several], return_inverse=True)[1]
    marks = np.zeros((len(members), int(column.max(initial=-1)) + 1), np.float32)
    marks[which, column] = 1
    block, vectors = own[members], unit[members]
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    for s in range(0, len(left), 512):
        some = left[s : s + 512]
        x, y = np.nonzero(vectors[some] @ vectors[right].T >= least)
        i, j = some[x], right[y]
        keep = i < j if lo == hi else np.ones(len(i), bool)
        x, y, i, j = x[keep], y[keep], i[keep], j[keep]
        if len(i):
            before = (marks[some] @ marks[right].T > 0)[x, y] if marks.shape[1] else np.zeros(len(i), bool)
            links.add(members[i], members[j], ~before)


_MET = "id long, other long, links long"
_SENT = "code int, key long, filters binary"


def near_groups(rows: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    doubles = F.col("embedding").cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    nonzero = F.exists(doubles, lambda x: x != 0)
    marked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v"), F.coalesce(~bad & nonzero, F.lit(False)).alias("ok"))
    # Equal vectors are known by 128 bits.
    hashes = [F.when(F.col("ok"), F.xxhash64(F.lit(k), F.size("v"), "v")).alias(f"h{k}") for k in (1, 2)]
    named = marked.select("vec_id", *hashes, "v")
    classes = named.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    n = max(classes.count(), 1)

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector's rows: one for each code, first codeword and range of second codewords, with the filters."""
        for whole in frames:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                lists = batch.column("v")
                flat, edge = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
                dims = np.diff(edge)
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    x = flat[(edge[at][:, None] + np.arange(dim)).reshape(-1)].reshape(len(at), dim)
                    words, height = plan(n, dim, least)
                    # As many ranges as keep what travels together at TOGETHER rows or so.
                    ranges = min(words, max(1, int(8 * n / words / TOGETHER)))
                    span = -(-words // ranges)
                    blobs, unit = [_blob(r) for r in x], _normal(x)
                    for number in range(CODES):
                        who, passed = decode(unit, words, height, number)
                        if not len(who):
                            continue
                        key = passed // words * ranges + passed % words // span
                        first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (key[1:] != key[:-1])))
                        order = np.lexsort((passed, key, who)) if ranges > 1 else None
                        if order is not None:
                            who, passed, key = who[order], passed[order], key[order]
                            first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (key[1:] != key[:-1])))
                        last = np.append(first[1:], len(who))
                        for s in range(0, len(first), 8192):
                            f, e = first[s : s + 8192], last[s : s + 8192]
                            w = at[who[f]]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(f), dim, np.int32)), pa.array(np.full(len(f), number, np.int32)), pa.array(key[f]), pa.array([passed[a:b].tobytes() for a, b in zip(f.tolist(), e.tolist(), strict=True)], pa.binary())]
                                + [batch.column("id").take(pa.array(w)), batch.column("m").take(pa.array(w)), pa.array([blobs[k] for k in who[f].tolist()], pa.binary())],
                                ["dim", "code", "key", "filters", "id", "m", "vector"],
                            )

    sent = classes.select("id", "m", "v").mapInArrow(emit, "dim int, code int, key long, filters binary, id long, m long, vector binary")
    sent = materialize(sent, "passed")
    group = ["dim", "code", "key"]
    counts = sent.groupBy(*group).agg(F.count("*").alias("c")).where("c > 1")
    counts = materialize(counts.select(*group, F.ceil(F.col("c") / block).cast("int").alias("blocks")), "travelling")
    dealt = sent.join(counts, group).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with")})
    names = (*group, "lo", "hi")

    def meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in runs(frames, names):
            for a, b in zip(first.tolist(), [*first[1:].tolist(), table.num_rows], strict=True):
                if b - a > 1:
                    words, height = plan(n, table.column("dim")[a].as_py(), least)
                    found = _meet(table.slice(a, b - a), words, height, least)
                    if found is not None:
                        yield found

    sorted_ = dealt.select(*names, "own", "id", "m", "vector", "filters").repartition(width(rows.sparkSession), *names).sortWithinPartitions(*names)
    met = materialize(sorted_.mapInArrow(meet, _MET), "met")
    forget(sent, counts)
    links = met.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    found = components(met.where("other is not null").select("id", "other"))
    placed = classes.select("id", "h1", "h2", "m", "rep").join(links, "id", "left").join(found, F.col("id") == F.col("node"), "left")
    placed = materialize(placed.select("h1", "h2", "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "placed")
    forget(met, found, classes)
    least_ids = materialize(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "least-ids")
    heads = materialize(placed.join(least_ids, "component").select("h1", "h2", "n_links", "component_id"), "heads")
    forget(placed, least_ids)
    linked = named.where("h1 is not null").join(heads, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = named.where("h1 is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
