"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: one link (node, root) per node that isn't a root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (id, component) for every node that links join to a smaller one; component is the
    smallest id it reaches.

    Links are contracted by union-find inside each partition, then by alternating
    large-star and small-star steps (Kiveris et al., 2014) until nothing changes: a number of
    rounds that grows with the logarithm of the nodes. Every round is written to the shared folder.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    edges = edges.where("u != v").mapInArrow(_forest, "u bigint, v bigint").where("u != v").distinct()
    edges = materialise(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        done, edges, before = edges, materialise(small, "links"), mark
        mark = _mark(edges)
        discard(done)
        if mark == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
