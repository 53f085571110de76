"""Near-duplicate vectors within a label: exact links above a cosine, by cover trees.

1. Equal vectors of a label are one point with a number of copies.
2. Around the square root of a label's points become the centres of its top level (chosen by a hash of the
   id). A point's home is its nearest centre. Two points of homes c and c' are at least as far apart as
   either is from the plane halfway between c and c', so a point visits exactly those other
   cells whose plane is within reach: no link is lost. It visits lower-numbered cells only,
   which finds each pair once.
3. The points of a cell and its visitors are dealt into pairs of blocks, each one task's group, so that a
   label or cell of any size is shared out. A group builds a cover tree per block and goes down
   both at once: node pairs beyond reach of their covering radii are pruned, those wholly within reach
   are taken as they are, single points are decided by their cosine in double precision.
4. A group returns a number of links per point and one root per point, never its pairs. Numbers are
   summed, roots joined to components (``groups.components``).

In spaces where all points are about equally far apart no bound prunes at the level of cells, and the
work is that of comparing blocks of a label; the bounds pay where vectors cluster.

Vectors without label or id, null or empty ones, those of length zero or with null or non-finite
components link with nothing and are kept. Vectors of different dimension don't link. Repeated rows
are vectors of their own. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covertree import SLACK, Tree, close_pairs
from .groups import components
from .kernel import grouped
from .store import materialise

BLOCK = 1024


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((vectors * vectors).sum(1))
    return vectors / norms[:, None], norms


def to_cells(points: DataFrame, cosine: float) -> DataFrame:
    """Rows (label, dim, cell, home, point, copies, vector): each point in its home cell and those it visits."""
    keys = ["label", "dim"]
    sizes = materialise(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("point").alias("_first")), "label-sizes")
    sized = points.join(sizes, keys)
    share = F.sqrt(F.col("n").cast("double")) / 4 / F.col("n")
    centres = sized.where((F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < share * (1 << 30)) | (F.col("point") == F.col("_first")))
    parts = F.ceil(F.col("n") / (2 * BLOCK))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("point", F.lit(1)), parts)).select(*keys, "part", "point", "copies", "vector")
    centres = centres.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).select(*keys, "part", "point", "vector")
    centres = materialise(centres, "centres")
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("point")
        own, centre = _unit(np.stack(left["vector"].to_list()).astype(float))[0], _unit(np.stack(right["vector"].to_list()).astype(float))[0]
        square = np.maximum(2 - 2 * own @ centre.T, 0)
        home = square.argmin(1)
        apart = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 0))
        each = np.arange(len(own))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (square - square[each, home][:, None]) / (2 * apart[home])
        visits = (plane <= reach) | ~np.isfinite(plane)
        visits &= np.arange(len(centre))[None, :] < home[:, None]
        row, cell = np.nonzero(visits)
        rows, cells = np.concatenate([each, row]), np.concatenate([home, cell])
        out = left.iloc[rows].reset_index(drop=True)
        return pd.DataFrame({"label": out["label"], "dim": out["dim"], "cell": right["point"].to_numpy()[cells], "home": np.arange(len(rows)) < len(own),
                             "point": out["point"], "copies": out["copies"], "vector": out["vector"]})

    schema = "label bigint, dim int, cell bigint, home boolean, point bigint, copies bigint, vector array<double>"
    return dealt.groupBy(*keys, "part").cogroup(centres.groupBy(*keys, "part")).applyInPandas(assign, schema)


def links_in_cells(cells: DataFrame, cosine: float) -> DataFrame:
    """Rows (point, n, root): links found in one pair of blocks, and the smallest point they reach there."""
    # centres are points of one label, so the cell alone tells groups apart
    sizes = cells.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).alias("_homes"), F.ceil(F.sum((~F.col("home")).cast("int")) / BLOCK).alias("_visitors"))
    rows = cells.join(sizes, "cell")
    block = F.pmod(F.xxhash64("point"), F.when(F.col("home"), F.col("_homes")).otherwise(F.col("_visitors")))
    number = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    # home blocks meet each other (i <= j, kind 0) and every block of visitors (kind 1)
    at = F.struct
    with_homes = F.transform(number("_homes"), lambda k: at(F.lit(0).alias("kind"), F.least(F.col("_own"), k).alias("i"), F.greatest(F.col("_own"), k).alias("j"), (F.col("_own") > k).alias("second")))
    with_visitors = F.transform(number("_visitors"), lambda k: at(F.lit(1).alias("kind"), F.col("_own").alias("i"), k.alias("j"), F.lit(False).alias("second")))
    as_visitor = F.transform(number("_homes"), lambda k: at(F.lit(1).alias("kind"), k.alias("i"), F.col("_own").alias("j"), F.lit(True).alias("second")))
    rows = rows.withColumn("_own", block).withColumn("g", F.explode(F.when(F.col("home"), F.concat(with_homes, with_visitors)).otherwise(as_visitor)))
    rows = rows.select("cell", "g.kind", "g.i", "g.j", "g.second", "point", "copies", "vector")
    keys = ["cell", "kind", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, kind, i, j), group in grouped(batches, keys):
            second = group["second"].to_numpy()
            point, copies = group["point"].to_numpy(), group["copies"].to_numpy()
            column = group["vector"].combine_chunks()
            vectors = column.flatten().to_numpy().reshape(len(point), -1)
            sides = [np.arange(len(point))] if kind == 0 and i == j else [np.flatnonzero(~second), np.flatnonzero(second)]
            if not all(map(len, sides)):
                continue
            trees, norms = [], []
            for side in sides:
                unit, norm = _unit(vectors[side])
                trees.append(Tree(unit))
                norms.append(norm)
            n, root = np.zeros(len(point), np.int64), np.arange(len(point))
            for a, b in close_pairs(trees[0], trees[1] if len(trees) > 1 else None, cosine, (norms[0], norms[-1]), (vectors[sides[0]], vectors[sides[-1]])):
                a, b = sides[0][a], sides[-1][b]
                np.add.at(n, a, copies[b])
                np.add.at(n, b, copies[a])
                _join(root, a, b)
            root = _flat(root)
            least = np.full(len(point), np.iinfo(np.int64).max)
            np.minimum.at(least, root, point)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(point[some]), pa.array(n[some]), pa.array(least[root[some]])], names=["point", "n", "root"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "point bigint, n bigint, root bigint")


def _flat(root: np.ndarray) -> np.ndarray:
    while True:
        higher = root[root]
        if (higher == root).all():
            return root
        root = higher


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of many pairs at once, by hooking larger roots below smaller ones until all agree."""
    while len(a):
        root[:] = _flat(root)
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vectors: vec_id, label, embedding. Returns vec_id, n_links, component_id, kept; a row per row."""
    v = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = materialise(rows.withColumn("usable", usable), "vectors")
    good = rows.where("usable").withColumn("dim", F.size(v))
    points = materialise(good.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("copies")), "points")
    found = materialise(links_in_cells(to_cells(points, cosine), cosine), "cell-links")
    # zero-padded sums: a point is linked in as many groups as it was dealt to
    counts = found.groupBy("point").agg(F.sum("n").alias("n"))
    labels = components(found, "point", "root").withColumnRenamed("id", "point")
    copied = points.where("copies > 1").select("label", "vector", F.col("point").alias("_point"), "copies")
    out = rows.where("usable").join(copied, ["label", "vector"], "left").withColumn("point", F.coalesce("_point", "vec_id"))
    out = out.join(counts, "point", "left").join(labels, "point", "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
