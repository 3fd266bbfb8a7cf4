"""Connected components of links, without gathering any component.

Every round hashes the nodes' names anew (a bijection of 64-bit numbers), lets a
node point at the least name among itself and its neighbours, and contracts the
links along those pointers; an expected constant share of the nodes goes each
round. All steps are aggregations with partial sums and joins against written
tables, so a node that a third of all links touch is split like any other. Once at
most ``FEW`` links are left, whatever their number was, one task finishes them in
memory (16 bytes a link); their number is checked first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.scratch import forget, materialize

FEW = 1 << 20


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for links (i, j) of n nodes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for ends in (label[i], label[j]):
            np.minimum.at(new, ends, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _local(links: DataFrame) -> DataFrame:
    """(node, component) of few links (u, v), in one task."""

    def solve(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in frames]
        if read:
            u, v = (np.concatenate(c) for c in zip(*read, strict=True))
            nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = least_labels(len(nodes), both[: len(u)], both[len(u) :])
            for s in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[s : s + (1 << 16)]), pa.array(nodes[label[s : s + (1 << 16)]])], ["node", "component"])

    return links.select("u", "v").coalesce(1).mapInArrow(solve, "node long, component long")


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for the nodes of ``links`` (two long columns); the component is its least node."""
    a, b = links.columns
    pairs = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    start = materialize(pairs, "links")
    if start.count() <= few:
        found = materialize(_local(start.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
        forget(start)
        return found
    nodes = start.select(F.col("a").alias("node")).union(start.select("b")).distinct()
    labels = nodes.select("node", F.xxhash64("node").alias("at"))
    edges = materialize(start.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")), "edges")
    scratch = [start, edges]
    while (left := edges.count()) > few:
        both = edges.union(edges.select("v", "u"))
        parent = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        moved = edges.join(parent, "u").select("v", F.col("p").alias("pu"))
        moved = moved.join(parent.select(F.col("u").alias("v"), "p"), "v").where("pu <> p")
        # The next round's names.
        moved = moved.select(F.xxhash64(F.least("pu", "p")).alias("u"), F.xxhash64(F.greatest("pu", "p")).alias("v")).distinct()
        labels = labels.join(parent, labels["at"] == parent["u"], "left").select("node", F.xxhash64(F.coalesce("p", "at")).alias("at"))
        edges = materialize(moved, "edges")
        scratch += [parent, edges]
    if left:
        last = materialize(_local(edges), "components")
        labels = labels.join(last.withColumnRenamed("node", "was"), F.col("at") == F.col("was"), "left").select("node", F.coalesce("component", "at").alias("at"))
        scratch.append(last)
    labels = materialize(labels, "labels")
    least = materialize(labels.groupBy("at").agg(F.min("node").alias("component")), "least")
    found = materialize(labels.join(least, "at").select("node", "component"), "components")
    forget(labels, least, *scratch)
    return found
