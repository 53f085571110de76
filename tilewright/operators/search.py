"""Search over tile vectors: ranking, hydration, spatial de-duplication, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text
from .vectors import cosine, nearest


def ranked(hits: DataFrame) -> DataFrame:
    """Merge the collections: one row per query and tile with its best score, then the rank.

    The candidate list per query is bounded by the number fetched per collection.
    """
    best = hits.groupBy("query_id", "tile_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "tile_id")
    return best.withColumn("rank", F.row_number().over(place).cast("bigint"))


def search_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Candidates of every query: max(4k, 25) per collection, merged, best per tile."""
    return ranked(nearest(queries, vectors, max(4 * k, 25), ["collection"]))


def hydrate(hits: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile metadata for ranked hits; vectors without a tile row drop out, the rank stays."""
    return hits.join(tiles, "tile_id", "inner")


def spatially_distinct(hits: DataFrame, k: int) -> DataFrame:
    """In rank order, keep a hit unless a kept one has its site or lies within 0.002 degrees
    in both coordinates; at most k per query.

    The choice depends on the order, so it is a fold over the query's candidate list,
    which is bounded by the search (never more than two collections' fetch limits).
    """
    item = F.struct("rank", "tile_id", F.coalesce("site_key", F.lit("")).alias("site"),
                    F.col("centroid_lat").cast("double").alias("lat"), F.col("centroid_lon").cast("double").alias("lon"), "score")
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("_c"))
    empty = F.slice(F.col("_c"), 1, 0)

    def near(a, b):
        apart = (F.abs(a["lat"] - b["lat"]) < K.DEDUP_DEGREES) & (F.abs(a["lon"] - b["lon"]) < K.DEDUP_DEGREES)
        return ((a["site"] != "") & (a["site"] == b["site"])) | F.coalesce(apart, F.lit(False))

    folded = F.aggregate(
        "_c", empty,
        lambda kept, x: F.when((F.size(kept) >= k) | F.exists(kept, lambda y: near(x, y)), kept).otherwise(
            F.concat(kept, F.array(x))))
    return listed.select("query_id", F.inline(folded)).select("query_id", "rank", "tile_id", "score")


def describe(hits: DataFrame) -> DataFrame:
    return hits.withColumn("spot_description", text.tile_description(
        F.col("mean_ndvi"), F.col("mean_ndwi"), F.col("mean_ndbi"), F.col("sensor")))


def search(queries: DataFrame, vectors: DataFrame, tiles: DataFrame, k: int, cutoff: float | None = None) -> DataFrame:
    """Whole search: candidates, metadata, distinct places, description; an image query's
    similarity cutoff comes last, after the top k."""
    found = hydrate(search_vectors(queries, vectors, k), tiles)
    kept = spatially_distinct(found, k)
    result = describe(found.join(kept.select("query_id", "tile_id"), ["query_id", "tile_id"], "left_semi"))
    return result if cutoff is None else result.where(F.bround("score", 4) >= cutoff)


def similar_tiles(seeds: DataFrame, vectors: DataFrame, tiles: DataFrame, k: int, min_similarity: float = 0.50) -> DataFrame:
    """Tiles most similar to stored tiles, without the seed itself."""
    queries = seeds.join(vectors, "tile_id").select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits = nearest(queries, vectors, max(k + 5, 20), ["collection"])
    hits = ranked(hits.where((F.col("score") >= min_similarity) & (F.col("tile_id") != F.col("query_id"))))
    return spatially_distinct(hydrate(hits.where(F.col("rank") <= 2 * k), tiles), k)


def cluster_members(seeds: DataFrame, vectors: DataFrame) -> DataFrame:
    """Members of each seed's cluster, ranked by similarity to the seed."""
    seed = seeds.select(F.col("tile_id").alias("seed_id"), "cluster_no", F.col("embedding").alias("_seed"))
    return vectors.join(seed, "cluster_no").select(
        "seed_id", "tile_id", F.round(cosine(F.col("embedding"), F.col("_seed")), 9).alias("score"))


def orphans(vectors: DataFrame, tiles: DataFrame) -> DataFrame:
    """Vectors without a tile and tiles without a vector."""
    a, b = vectors.select("tile_id"), tiles.select("tile_id")
    return a.join(b, "tile_id", "left_anti").withColumn("missing", F.lit("tile")).unionByName(
        b.join(a, "tile_id", "left_anti").withColumn("missing", F.lit("vector")))


def page(tiles: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page of a listing with the total number of rows."""
    total = tiles.agg(F.count(F.lit(1)).alias("n")).scalar()
    return tiles.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)
