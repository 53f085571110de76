"""Grouping of tile vectors: cards, medoids, density clusters, KMeans."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from .blocks import block_pairs
from .components import connected, contract
from .vectors import euclidean, mean_vectors, unit


SCALE = 1e9  # coordinates of unit vectors are compared at nine decimals


def _coordinates(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1) / SCALE


def medoids(members: DataFrame, cluster: str) -> DataFrame:
    """Per cluster: the member nearest to the mean vector, and the size."""
    centre = mean_vectors(members, [cluster], "embedding", "_centre")
    away = members.join(centre, cluster).select(cluster, "tile_id", F.round(euclidean(F.col("embedding"), F.col("_centre")), 9).alias("_away"))
    return away.groupBy(cluster).agg(F.min_by("tile_id", F.struct("_away", "tile_id")).alias("representative_tile_id"),
                                     F.count(F.lit(1)).alias("tile_count"), F.min("_away").alias("medoid_distance"))


def cluster_profile(members: DataFrame, tiles: DataFrame, cluster: str) -> DataFrame:
    """Medoid, size, mean indices, greatest sensor name and label per cluster."""
    facts = members.select(cluster, "tile_id").join(tiles, "tile_id", "left").groupBy(cluster).agg(
        *[F.avg(f"mean_{n}").alias(f"avg_{n}") for n in ("ndvi", "ndwi", "ndbi")], F.max("sensor").alias("sensor"))
    df = medoids(members, cluster).join(facts, cluster)
    return df.withColumn("label", text.cluster_label(F.col(cluster), F.col("avg_ndvi"), F.col("avg_ndwi"), F.col("avg_ndbi")))


def cluster_cards(clusters: DataFrame, tiles: DataFrame) -> DataFrame:
    """Clusters with the metadata of their representative tile, if it exists."""
    t = tiles.withColumnRenamed("tile_id", "representative_tile_id")
    return clusters.join(t, "representative_tile_id", "left").withColumn(
        "label", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id"))))


def write_back(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles with their cluster id; noise (-1) and unknown tiles have none."""
    named = labels.select("tile_id", F.when(F.col("label") != -1, F.concat(F.lit("cluster_"), (F.col("label") + 1).cast("string"))).alias("cluster_id"))
    return tiles.drop("cluster_id").join(named, "tile_id", "left")


def kmeans_labels(vectors: DataFrame, k: int, runs: int = 10, seed: int = 42) -> DataFrame:
    """Best of several seeded KMeans runs on unit vectors."""
    points = vectors.select("tile_id", array_to_vector(unit(F.col("embedding"))).alias("features")).persist()
    models = [KMeans(k=k, seed=seed + i, maxIter=100).fit(points) for i in range(runs)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    points.unpersist()
    return best.transform(points).select("tile_id", F.col("prediction").cast("bigint").alias("label"))


def _neighbour_tasks(points: DataFrame, pivots: list, radius: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Home copies and visiting copies of every point per pivot cell, dealt into block pairs.

    A point is at home in its nearest pivot's cell and visits every cell whose pivot is
    at most ``2 * radius`` farther away; by the triangle inequality every pair within
    the radius meets in the home cell of each of its points.
    """
    spark = points.sparkSession
    centre = spark.sparkContext.broadcast(np.asarray(pivots, dtype=float) / SCALE)

    @F.pandas_udf("array<int>")
    def cells(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=object)
        rows = np.stack(batch.to_numpy()) / SCALE
        away = np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in centre.value], 1)
        home = away.argmin(1)
        limit = away.min(1) + 2 * radius + 1e-9
        return pd.Series([[int(h), *np.nonzero(a <= m)[0].tolist()] for h, a, m in zip(home, away, limit)])

    placed = points.select("point", "vector", "weight", cells("vector").alias("_cells"))
    home = placed.select("point", "vector", F.element_at("_cells", 1).alias("cell"))
    visit = placed.select(F.col("point").alias("other"), F.col("vector").alias("other_vector"), "weight",
                          F.explode(F.slice("_cells", 2, 1 << 20)).alias("cell"))
    return block_pairs(home, visit, ["cell"], "point", "other", block_rows, 2 * block_rows)


def density_labels(vectors: DataFrame, radius: float, min_points: int, min_size: int, pivots: int = 32,
                   block_rows: int = 32_768) -> DataFrame:
    """Flat density clusters of unit vectors (DBSCAN with core points only), noise -1.

    Equal vectors collapse to one weighted point first. Points are partitioned by pivot
    cells, and cells into block pairs of bounded size, which a task goes through in smaller
    pieces. It counts neighbours, or returns a spanning forest of its core pairs: never the
    pairs themselves. Coordinates travel as whole numbers of 1e-9, half the size of doubles.
    """
    rounded = vectors.select("tile_id", F.transform(unit(F.col("embedding")), lambda x: F.round(F.round(x, 9) * SCALE).try_cast("int")).alias("vector"))
    keyed = rounded.withColumn("point", F.xxhash64("vector"))
    points = keyed.groupBy("point").agg(F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("weight")).persist()
    centres = [r[0] for r in points.orderBy("point").select("vector").limit(pivots).collect()]
    if not centres:
        return rounded.select("tile_id", F.lit(-1).cast("bigint").alias("label"))
    groups = ["cell", "_lb", "_rb"]

    def pieces(a: pa.Table, b: pa.Table):
        """Pairs of both sides within the radius, piece by piece: first rows and a mask. Single precision decides
        but for pairs close to the radius."""
        x, y = _coordinates(a.column("vector")), _coordinates(b.column("other_vector"))
        single_x, single_y = x.astype(np.float32), y.astype(np.float32)
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        limit, off = radius * radius + 1e-12, 1e-6 * (x.shape[1] + 16)
        for i in range(0, len(x), 1024):
            for j in range(0, len(y), 4096):
                square = xx[i:i + 1024, None].astype(np.float32) + yy[None, j:j + 4096].astype(np.float32)
                square -= 2 * single_x[i:i + 1024] @ single_y[j:j + 4096].T
                near = square <= limit
                rows, columns = np.nonzero(np.abs(square - np.float32(limit)) <= off)
                for s in range(0, len(rows), 65_536):
                    r, c = rows[s:s + 65_536], columns[s:s + 65_536]
                    near[r, c] = xx[i + r] + yy[j + c] - 2 * np.einsum("ij,ij->i", x[i + r], y[j + c]) <= limit
                yield i, j, near

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        n = np.zeros(a.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            weight = b.column("weight").to_numpy()
            for i, j, near in pieces(a, b):
                r, c = np.nonzero(near)
                n[i:i + len(near)] += np.bincount(r, weight[j + c], len(near)).astype(np.int64)
        return pa.table([a.column("point"), pa.array(n)], names=["point", "n"])

    home, visit = _neighbour_tasks(points, centres, radius, block_rows)
    counts = home.groupBy(*groups).cogroup(visit.groupBy(*groups)).applyInArrow(count, "point bigint, n bigint")
    cores = counts.groupBy("point").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points)
    core_points = cut_lineage(points.join(cores.select("point"), "point", "left_semi"))

    def forest(a: pa.Table, b: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        old, new = none, none
        if a.num_rows and b.num_rows:
            left, right = a.column("point").to_numpy(), b.column("other").to_numpy()
            for i, j, near in pieces(a, b):
                r, c = np.nonzero(near)
                if len(r):
                    old, new = contract(np.concatenate([old, left[i + r]]), np.concatenate([new, right[j + c]]))
        return pa.table([pa.array(old), pa.array(new)], names=["a", "b"])

    home, visit = _neighbour_tasks(core_points, centres, radius, block_rows)
    edges = home.groupBy(*groups).cogroup(visit.groupBy(*groups)).applyInArrow(forest, "a bigint, b bigint")
    labelled = connected(core_points.select(F.col("point").alias("id")), edges)
    sized = labelled.join(points.select(F.col("point").alias("id"), "weight"), "id")
    kept = sized.groupBy("component").agg(F.sum("weight").alias("size")).where(F.col("size") >= min_size)
    placed = cut_lineage(keyed.join(sized.join(kept, "component").select(F.col("id").alias("point"), "component", "size"), "point", "left").select("tile_id", "component", "size"))
    points.unpersist()
    # one row per cluster: numbers by size, then by smallest tile id
    order = Window.orderBy(F.col("size").desc(), "first")
    numbers = placed.where("component IS NOT NULL").groupBy("component", "size").agg(F.min("tile_id").alias("first")).select(
        "component", (F.row_number().over(order) - 1).cast("bigint").alias("label"))
    return placed.join(numbers, "component", "left").select("tile_id", F.coalesce("label", F.lit(-1).cast("bigint")).alias("label"))


def cluster_archive(vectors: DataFrame, radius: float) -> DataFrame:
    """Strategy by archive size and result: one cluster for fewer than four vectors, else
    density clusters, else KMeans when density finds fewer than two."""
    n = vectors.count()
    if n < 4:
        return vectors.select("tile_id", F.lit(0).cast("bigint").alias("label"))
    least = min(5, max(2, n // 3))
    labels = density_labels(vectors, radius, least, least)
    found = labels.where(F.col("label") != -1).select("label").distinct().limit(2).count()
    return labels if found >= 2 else kmeans_labels(vectors, min(5, max(2, n // 2)))
