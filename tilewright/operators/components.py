"""Connected components of edge tables between integer nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 1 << 20  # edges that a task contracts at a time
FOREST = "old bigint, new bigint, part int"


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b) that isn't the smallest of its component, and that one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[left], parent[right]
        if np.array_equal(x, y):
            moved = np.flatnonzero(parent != np.arange(len(nodes)))
            return nodes[moved], nodes[parent[moved]]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition contracted to one per node, (node, smallest node it reaches there)."""
    none = np.empty(0, np.int64)
    done, waiting, size = (none, none), [], 0
    for batch in batches:
        waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > CHUNK:
            done = contract(*(np.concatenate([done[k], *[w[k] for w in waiting]]) for k in (0, 1)))
            waiting, size = [], 0
    old, new = contract(*(np.concatenate([done[k], *[w[k] for w in waiting]]) for k in (0, 1)))
    part = np.full(len(old), TaskContext.get().partitionId(), np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(old), pa.array(new), pa.array(part)], names=["old", "new", "part"])


def component_names(edges: DataFrame) -> DataFrame | None:
    """New name (the smallest node of its component) of every node that needs one, as columns
    old and new; None when the edges join nothing.

    Each task contracts its share of the edges to a forest. If one task saw all of them, that is the answer. Otherwise
    neighbours are moved to the smallest one, the larger ones (large star) and the smaller ones (small star) in
    turn, until nothing changes: both are partial aggregations, hubs included. Every round is stored.
    """
    links = edges.select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).where("a != b").distinct()
    links = cut_lineage(links.mapInArrow(_forest, FOREST))
    rows, mark, first, last = _mark(links.select("old", "new", "part"))
    if rows == 0:
        return None
    links = links.select("old", "new")
    while first != last:
        both = links.unionByName(links.select(F.col("new").alias("old"), F.col("old").alias("new")))
        least = both.groupBy("old").agg(F.min("new").alias("_m")).select("old", F.least("old", "_m").alias("_m"))
        large = both.where("new > old").join(least, "old").select(F.col("new").alias("old"), F.col("_m").alias("new")).distinct()
        least = large.groupBy("old").agg(F.min("new").alias("_m"))
        small = large.join(least, "old").where("new != _m").select(F.col("new").alias("old"), F.col("_m").alias("new"))
        links = cut_lineage(small.unionByName(least.select("old", F.col("_m").alias("new"))).distinct())
        before, mark = (rows, mark), None
        rows, mark, _, _ = _mark(links.withColumn("part", F.lit(0)))
        if (rows, mark) == before:
            break
    return links


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("old", "new")), F.min("part"), F.max("part")).first())


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id reachable from every node, as columns id and component."""
    names = component_names(edges)
    if names is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.select("id").join(names.select(F.col("old").alias("id"), "new"), "id", "left").select("id", F.coalesce("new", "id").alias("component"))
