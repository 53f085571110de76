"""Catalogue building: aliases, mosaics, latest versions, best scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def resolve_band_aliases(files: DataFrame, key: list[str], bands: str) -> DataFrame:
    """For every canonical role, the file's band that carries it: its own name first, then the aliases in order."""
    spark = files.sparkSession
    rows = [(wanted, rank, alias) for wanted, names in K.BAND_ALIASES.items() for rank, alias in enumerate(names)]
    aliases = F.broadcast(spark.createDataFrame(rows, "wanted string, rank int, band string"))  # fixed table
    listed = files.select(*key, F.explode(bands).alias("_name")).select(*key, F.lower("_name").alias("band"))
    rank = F.when(F.col("band") == F.col("wanted"), -1).otherwise(F.col("rank"))
    return listed.join(aliases, "band").groupBy(*key, "wanted").agg(F.min_by("band", rank).alias("band"))


def latest_version(rows: DataFrame, key: list[str], version: Column) -> DataFrame:
    """One row per key: the one with the greatest version (an aggregate, so no key is ever sorted in one task)."""
    others = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*others), version).alias("_row"))
    return picked.select(*key, "_row.*")


def best_scene(scenes: DataFrame, key: list[str], cloud: str, item: str) -> DataFrame:
    """Least cloudy scene per key, ties by item id."""
    others = [c for c in scenes.columns if c not in key]
    picked = scenes.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(F.coalesce(F.col(cloud), F.lit(100.0)), F.col(item))).alias("_row"))
    return picked.select(*key, "_row.*")


def mosaic(layers: DataFrame, pixel: list[str], order: str, bands: list[str]) -> DataFrame:
    """Per pixel and band the last scene with a value above zero, else 0."""
    return layers.groupBy(*pixel).agg(*[
        F.coalesce(F.max_by(F.when(F.col(b) > 0, F.col(b)), F.when(F.col(b) > 0, F.col(order))), F.lit(0.0)).alias(b)
        for b in bands
    ])
