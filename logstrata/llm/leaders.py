"""Components of similarity links among members that share keys, with linear output.

Members that share a key are candidates for each other. In keys of more than ``MOST``
members, every member is first compared with one leader: the member whose own keys
hold the most members, which in a group of near copies is the text that they are
copies of. The links found give components. Then keys of few members go through all
their pairs, the others through pairs of different components, block by block within
tasks, by payloads that bound the likeness: a task returns the ``most`` closest
candidates of each member. They are verified, components grow, and the keys in which a
member had more to offer go on, with many times as many, until none has.

A caller that can verify texts in place may have members that keys connect, as far as
they are at most ``WHOLE`` and their texts ``WHOLE_BYTES``, compared as wholes instead:
each text is sent once, to the one task of its group, which joins components as it finds
links and returns only links that joined. Larger groups go by keys as above.

So every pair that shares a key ends up in one component or refuted, nothing is
capped, and what tasks return grows with the members, not with their pairs. A task
holds two blocks of at most about ``BLOCK`` members, however many share a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.scratch import forget, materialize, width

from .graph import components

BLOCK = 2048
#: Members up to which a key's pairs are listed together with those of other keys; pairs looked at at a time; rows of a batch of pairs.
SMALL, PAIRS, STEP = 32, 1 << 17, 4096
#: Candidates of a member in the first round; keys of more members are compared with leaders first.
MOST = 32
#: Members, and bytes of their texts, up to which a group is compared as a whole.
WHOLE, WHOLE_BYTES = 1 << 16, 64 << 20
#: near(payloads, keys)(i, j): closeness of payloads i and j, negative where they cannot be linked.
#: Given the keys of the rows, it may leave out pairs that another key which they share will bring.
Closeness = Callable[[np.ndarray, np.ndarray], np.ndarray]
Near = Callable[[list[bytes], np.ndarray | None], Closeness]


def _with(pairs: DataFrame, payloads: DataFrame, name: str) -> DataFrame:
    return pairs.join(payloads.select(F.col("id").alias(name), F.col("payload").alias(f"payload_{name}")), name)


def _paired(pairs: DataFrame, payloads: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose payloads pass."""

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                n = part.num_rows
                close = near(part.column("payload_a").to_pylist() + part.column("payload_b").to_pylist(), None)
                good = close(np.arange(n), np.arange(n) + n) >= 0
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = _with(_with(pairs, payloads, "b"), payloads, "a")
    return full.select("a", "b", "payload_a", "payload_b").mapInArrow(keep, "a long, b long")


def runs(frames: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("key", "i", "j")) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, first row of each group) with whole groups of rows sorted by ``names``."""
    held: pa.Table | None = None
    for batch in frames:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        new = np.zeros(table.num_rows, bool)
        for name in names:
            values = table.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield table.slice(0, last).combine_chunks(), np.append(0, starts[:-1])
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.zeros(1, np.int64)


def _pairs(first: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of the left side, row of the right side) of each group: in small ones each pair once, in large ones all of a left row together."""
    end = np.append(first[1:], n)
    small = end - first <= SMALL
    group = np.repeat(np.arange(len(first)), end - first)
    rows = np.flatnonzero(small[group])
    for shift in range(1, int((end - first)[small].max(initial=0))):
        i = rows[rows + shift < n]
        j = i + shift
        i, j = i[group[i] == group[j]], j[group[i] == group[j]]
        there, back = left[i] & right[j], left[j] & right[i]
        yield i[there], j[there]
        back &= ~there
        yield j[back], i[back]
    for a, b in zip(first[~small].tolist(), end[~small].tolist(), strict=True):
        lefts, rights = np.flatnonzero(left[a:b]) + a, np.flatnonzero(right[a:b]) + a
        step = max(1, PAIRS // max(len(rights), 1))
        for s in range(0, len(lefts), step):
            some = lefts[s : s + step]
            yield np.repeat(some, len(rights)), np.tile(rights, len(some))


class Parts:
    """Components of a table's rows, joined as links are found."""

    def __init__(self, component: np.ndarray):
        _, self.of = np.unique(component, return_inverse=True)
        self.parent = np.arange(int(self.of.max(initial=-1)) + 1)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent[self.of[rows]]
            self.parent = up

    def join(self, i: np.ndarray, j: np.ndarray) -> list[int]:
        """Numbers of the links (i, j) that joined components."""
        parent, out = self.parent, []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for k, (x, y) in enumerate(zip(self.of[i].tolist(), self.of[j].tolist(), strict=True)):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append(k)
        return out


#: Links (rows i, rows j) that join parts of groups of texts that begin at the places given; the parts are updated.
Whole = Callable[[list[bytes], Parts, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def _wholes(first: DataFrame, found: DataFrame, texts: DataFrame, whole: Whole) -> tuple[DataFrame, DataFrame]:
    """(joining links of the groups that are compared as wholes, ids of the groups that are not)."""
    groups = components(first)
    placed = groups.join(found.withColumnRenamed("component", "part"), "node", "left").select(F.col("node").alias("id"), F.col("component").alias("group"), F.coalesce("part", "node").alias("part"))
    placed = materialize(placed.join(texts.select("id", F.octet_length("line").alias("size")), "id"), "groups")
    sizes = placed.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    sizes = materialize(sizes.select("group", ((F.col("n") <= WHOLE) & (F.col("bytes") <= WHOLE_BYTES)).alias("small")), "group-sizes")

    def join(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first_rows in runs(frames, ("group",)):
            ids = table.column("id").to_numpy()
            for i, j in whole(table.column("line").to_pylist(), Parts(table.column("part").to_numpy()), first_rows):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])

    rows = placed.join(sizes.where("small").select("group"), "group").join(texts, "id").select("group", "id", "part", "line")
    links = materialize(rows.repartition(width(first.sparkSession), "group").sortWithinPartitions("group").mapInArrow(join, "a long, b long"), "links")
    large = materialize(placed.join(sizes.where("not small"), "group", "left_semi").select("id"), "large-groups")
    forget(groups, placed, sizes)
    return links, large


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, id, head): the entries of ``keys`` (key, id) whose key several members hold, with the least of those members.

    Every entry is sent once, and none is gathered: a task's sorted entries pass by.
    """

    def several(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last entry so far with its head, and whether its key came before it.
        held: tuple[np.ndarray, ...] | None = None
        met = False
        for batch in frames:
            if not batch.num_rows:
                continue
            key, ids = (batch.column(c).to_numpy() for c in ("key", "id"))
            if held is not None:
                key, ids = np.append(held[0], key), np.append(held[1], ids)
            same = key[1:] == key[:-1]
            start = np.flatnonzero(np.append(True, ~same))
            first = ids[start]
            if held is not None:
                first[0] = held[2][0]
            head = np.repeat(first, np.diff(np.append(start, len(key))))
            good = np.append(met, same)
            good[:-1] |= same
            met, held = bool(good[-1]), (key[-1:], ids[-1:], head[-1:])
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][good[:-1]]) for x in (key, ids, head)], ["key", "id", "head"])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["key", "id", "head"])

    sorted_ = keys.select("key", "id").repartition(width(keys.sparkSession), "key").sortWithinPartitions("key", "id")
    return sorted_.mapInArrow(several, "key long, id long, head long")


_FOUND = "a long, b long, key long"


def _compare(rows: DataFrame, near: Near, most: int) -> DataFrame:
    """(a, b, null): the closest candidates of each member on the left, and (null, null, key): keys in which a member had others, of ``rows`` (key, i, j, id, component, lefts, rights, payload)."""

    def closest(table: pa.Table, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("lefts", "rights"))
        part, close = table.column("component").to_numpy(), near(table.column("payload").to_pylist(), table.column("key").to_numpy())
        held: list[tuple[np.ndarray, ...]] = []

        def best(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            if not held:
                return
            i, j, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((-c, i))
            i, j = i[order], j[order]
            start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
            many = np.diff(np.append(start, len(i)))
            rank = np.arange(len(i)) - np.repeat(start, many)
            top = rank < most
            yield i[top], j[top], np.repeat(many > most, many)[top]

        for i, j in _pairs(first, table.num_rows, left, right):
            apart = part[i] != part[j]
            i, j = i[apart], j[apart]
            c = close(i, j)
            good = c >= 0
            held.append((i[good], j[good], c[good]))
            if sum(len(x[0]) for x in held) > PAIRS:
                # Pairs of a left row in a large group come together, so its best are among those held; small groups are few rows.
                yield from best(False)
        yield from best(True)

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in runs(frames):
            ids, key = table.column("id").to_numpy(), table.column("key").to_numpy()
            for i, j, more in closest(table, first):
                if len(i):
                    a, b, longer = ids[i], ids[j], np.unique(key[i[more]])
                    none, blank = pa.nulls(len(a), pa.int64()), pa.nulls(len(longer), pa.int64())
                    columns = [pa.concat_arrays(c) for c in ([pa.array(np.minimum(a, b)), blank], [pa.array(np.maximum(a, b)), blank], [none, pa.array(longer)])]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "key"])

    sorted_ = rows.repartition(width(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_.mapInArrow(compare, _FOUND)


def _blocks(members: DataFrame, found: DataFrame, payloads: DataFrame) -> DataFrame | None:
    """Members of keys with several components, dealt to pairs of blocks: those outside their key's largest component on the left, all on the right."""
    placed = members.join(found, members["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    spread = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("members")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = spread.select("key", F.col("most.component").alias("largest"), blocks(F.col("members")).alias("right_blocks"), blocks(F.col("members") - F.col("most.size")).alias("left_blocks"))
    mixed = materialize(mixed, "mixed")
    if mixed.isEmpty():
        forget(mixed)
        return None
    rows = placed.join(mixed, "key").withColumn("outside", F.col("component") != F.col("largest")).withColumn("own", F.xxhash64(F.lit(9), "id"))

    def place(i: Column, j: Column, lefts: Column, rights: bool) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), lefts.alias("lefts"), F.lit(rights).alias("rights"))

    right = F.transform(F.sequence(F.lit(0), F.col("left_blocks") - 1), lambda i: place(i, F.pmod("own", F.col("right_blocks")), F.lit(False), True))
    left = F.transform(F.sequence(F.lit(0), F.col("right_blocks") - 1), lambda j: place(F.pmod("own", F.col("left_blocks")), j, F.lit(True), False))
    several = F.when(F.col("outside"), F.concat(right, left)).otherwise(right)
    places = F.when(F.col("right_blocks") == 1, F.array(place(F.lit(0), F.lit(0), F.col("outside"), True))).otherwise(several)
    dealt = rows.select("key", "id", "component", F.explode(places).alias("at")).select("key", "at.*", "id", "component")
    return dealt.join(payloads, "id").select("key", "i", "j", "id", "component", "lefts", "rights", "payload")


def _leaders(members: DataFrame) -> DataFrame:
    """(a, b): every member with the leader of each of its keys."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    weight = materialize(members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("weight")), "weights")
    led = members.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("leader")).select("key", F.col("leader.id").alias("a"))
    led = materialize(led, "leaders")
    pairs = materialize(members.join(led, "key").where("a <> id").select("a", F.col("id").alias("b")).distinct(), "led")
    forget(weight, led)
    return pairs


def joined_components(members: DataFrame, payloads: DataFrame, near: Near, verify: Callable[[DataFrame], DataFrame], whole: tuple[DataFrame, Whole] | None = None) -> DataFrame:
    """(node, component) of all members that have links.

    ``members``: (key, id), of keys with several members, each once; ``payloads``:
    (id, payload) of those; ``verify`` confirms candidates (a, b) that pass ``near``;
    ``whole``: (id, line) of the members, and what joins a group of those. Where
    ``members`` name the ``head`` of each key, it leads the key, however few hold it: its
    pairs are told once for all keys, so that payloads go to them and not to every key.
    """
    if whole:
        first = _leaders(members)
        links = materialize(verify(materialize(_paired(first, payloads, near), "tested")), "links")
        found = components(links)
        joining, large = _wholes(first, found, *whole)
        forget(first)
        links = links.union(joining)
        if not joining.isEmpty():
            older, found = found, components(links)
            forget(older)
        if large.isEmpty():
            forget(links, large)
            return found
        members = materialize(members.join(large, "id", "left_semi"), "large-members")
        forget(large)
        dealt, tested = _blocks(members, found, payloads), None
    elif "head" in members.columns:
        first = materialize(members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "led")
        tested = materialize(_paired(first, payloads, near), "tested")
        links = materialize(verify(tested), "links")
        found = components(links)
        tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        forget(first)
        dealt = _blocks(members, found, payloads)
    else:
        crowds = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key"), "crowds")
        if crowds.isEmpty():
            links = tested = found = None
        else:
            crowded = materialize(members.join(crowds, "key", "left_semi"), "crowded")
            first = _leaders(crowded)
            tested = materialize(_paired(first, payloads, near), "tested")
            links = materialize(verify(tested), "links")
            found = components(links)
            tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            forget(first)
        # Pairs of few members need no leader: their payloads meet at the key.
        few = members.join(crowds, "key", "left_anti").join(payloads, "id")
        yes, zero = F.lit(True), F.lit(0)
        dealt = few.select("key", zero.alias("i"), zero.alias("j"), "id", F.col("id").alias("component"), yes.alias("lefts"), yes.alias("rights"), "payload")
        if found is not None and (rest := _blocks(crowded, found, payloads)) is not None:
            dealt = dealt.union(rest)
    most = MOST
    while dealt is not None:
        listed = materialize(_compare(dealt, near, most).distinct(), "candidates")
        fresh = listed.where("key is null").select("a", "b")
        fresh = materialize(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"), "tested")
        new = materialize(verify(fresh), "links")
        if links is None or not new.isEmpty():
            links = new if links is None else links.union(new)
            older, found = found, components(links)
            if older is not None:
                forget(older)
        # A pair that was left out was so in a key where a member had more candidates; the other keys have told all theirs.
        longer = materialize(listed.where("key is not null").select("key"), "longer")
        forget(listed)
        if longer.isEmpty():
            forget(longer)
            break
        members = materialize(members.join(longer, "key", "left_semi"), "longer-members")
        forget(longer)
        tested, most = fresh if tested is None else tested.union(fresh), most * 32
        dealt = _blocks(members, found, payloads)
    forget(*[x for x in (tested, links) if x is not None])
    return found
