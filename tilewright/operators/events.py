"""Change events: keys, cached pairs, feature collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def repair_tile_ids(events: DataFrame, tiles: DataFrame, columns: list[str]) -> DataFrame:
    """Tile ids that are not in the catalogue become NULL."""
    known = tiles.select(F.col("tile_id").alias("_known")).distinct()
    for name in columns:
        events = events.join(known, events[name] == known["_known"], "left").withColumn(name, F.col("_known")).drop("_known")
    return events


def plan_pairs(wanted: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Which pairs are already stored and which have to be computed."""
    have = stored.select(*key).distinct().withColumn("_have", F.lit(True))
    return wanted.join(have, key, "left").select(*key, F.when(F.col("_have"), "cached").otherwise("compute").alias("action"))


def with_sentinels(events: DataFrame, pairs: DataFrame, pair: list[str]) -> DataFrame:
    """Events plus one "No Change" row for every pair that has none."""
    quiet = pairs.select(*pair).join(events.select(*pair).distinct(), pair, "left_anti")
    fields = [c for c in events.columns if c not in pair]
    types = dict(events.dtypes)
    fixed = {"change_type": K.NO_CHANGE, "class_b": "Stable", "class_a": "Stable", "area_px": 0, "area_m2": 0.0}
    return events.unionByName(quiet.select(*pair, *[F.lit(fixed.get(c)).cast(types[c]).alias(c) for c in fields]))


def explode_features(collections: DataFrame, key: list[str], part_rows: int = 10000) -> DataFrame:
    """One row per feature of each collection, with its ordinal over all parts of ``part_rows``."""
    rows = collections.select(*key, "part", F.posexplode("features").alias("_place", "feature"))
    return rows.select(*key, (F.col("part") * part_rows + F.col("_place")).cast("bigint").alias("feature_no"), "feature.*")
