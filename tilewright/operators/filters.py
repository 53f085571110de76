"""Catalogue filters. All are plain predicates, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def sensor_family(wanted: str) -> Column:
    """Exact sensor names of a family; any other name means equality."""
    low = wanted.lower().strip()
    if "sentinel" in low:
        return F.col("sensor").isin(K.SENTINEL_SENSORS)
    if "maxar" in low:
        return F.col("sensor").isin(K.MAXAR_SENSORS)
    return F.col("sensor") == wanted


def collections_for(wanted: str | None) -> list[str]:
    low = (wanted or "").lower()
    if "maxar" in low:
        return [K.COLLECTION_MAXAR]
    if "sentinel" in low or "s2" in low:
        return [K.COLLECTION_MAIN]
    return [K.COLLECTION_MAIN, K.COLLECTION_MAXAR]


def search_filter(sensor: str | None = None, start: str | None = None, end: str | None = None,
                  min_quality: float = 0.0, max_cloud_pct: float | None = None) -> Column:
    """All given conditions together. ``max_cloud_pct`` is a percentage, the column a fraction."""
    keep = F.lit(True)
    if sensor and sensor.strip():
        keep = keep & sensor_family(sensor)
    if start:
        keep = keep & (F.col("acquisition_date") >= F.to_timestamp_ntz(F.lit(start)))
    if end:
        keep = keep & (F.col("acquisition_date") <= F.to_timestamp_ntz(F.lit(end)))
    if min_quality > 0.0:
        keep = keep & (F.col("quality_confidence") >= min_quality)
    if max_cloud_pct is not None and max_cloud_pct < 100.0:
        keep = keep & (F.col("cloud_pct") <= max_cloud_pct / 100.0)
    return keep


def restrict(tiles: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """Keep the candidate tile ids; an empty candidate set gives an empty result."""
    return tiles if candidates is None else tiles.join(candidates.select("tile_id"), "tile_id", "left_semi")


def in_region(region: str | None) -> Column:
    if not region or region == "all":
        return F.lit(True)
    return F.col("tile_id").contains(region) | F.col("scene_id").contains(region)


def drop_empty_tiles(samples: DataFrame, tile: list[str], nodata: Column, min_valid: float = 0.01) -> DataFrame:
    """Tiles of which at least one percent of the samples holds data."""
    return (
        samples.groupBy(*tile).agg(F.count(F.lit(1)).alias("samples"), F.count_if(~nodata).alias("valid_samples"))
        .where(F.col("valid_samples") / F.col("samples") >= min_valid)
    )


def low_cloud_scenes(scenes: DataFrame, bucket: list[str], max_cloud: float) -> DataFrame:
    """Scenes below the cloud limit; a bucket without any falls back to a relaxed limit.

    The best tier per bucket is an aggregate of one row per bucket, joined back.
    """
    tier = F.when(F.col("cloud_cover") < max_cloud, 0).when(
        F.col("cloud_cover") < min(100.0, max_cloud + 20.0), 1)
    graded = scenes.withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = graded.groupBy(*bucket).agg(F.min("tier").alias("best_tier"))
    return graded.join(best, bucket).where(F.col("tier") == F.col("best_tier")).drop("best_tier")


def known_area(west: Column, south: Column) -> Column:
    """First known area whose window holds the lower left corner."""
    chain = None
    for name, x0, x1, y0, y1 in K.KNOWN_AREAS:
        hit = west.between(x0, x1) & south.between(y0, y1)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("UNKNOWN")


def registry_entries(domain: str | None = None, modality: str | None = None, task: str | None = None) -> Column:
    keep = F.lit(True)
    for name, value in (("domain", domain), ("modality", modality), ("task", task)):
        if value:
            keep = keep & (F.col(name) == value)
    return keep


def clusters_matching(category: str = "all", search: str = "") -> Column:
    keep = F.lit(True)
    label = F.lower(F.coalesce(F.col("label"), F.lit("")))
    if category.lower() != "all":
        keep = keep & label.contains(category.lower())
    text = search.lower().strip()
    if text:
        keep = keep & (
            label.contains(text) | F.lower("cluster_id").contains(text)
            | F.lower(F.coalesce(F.col("representative_tile_id"), F.lit(""))).contains(text)
        )
    return keep
