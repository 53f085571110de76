"""Validation: every operator returns rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from ..session import dealt

SEVERITY = {"PASS": 0, "WARNING": 1, "FAIL": 2}


def _findings(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule."""
    flags = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return df.select(*keys, F.explode(F.array_compact(flags)).alias("finding"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def registry_findings(entries: DataFrame) -> DataFrame:
    """Missing fields, unknown values, tasks outside their domain, repeated ids."""
    blank = lambda name: F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
    given = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    rules = {f"missing {name}": blank(name) for name in K.REGISTRY_FIELDS}
    for name, allowed in (("domain", K.REGISTRY_DOMAINS), ("modality", K.REGISTRY_MODALITIES), ("task", K.REGISTRY_TASKS)):
        rules[f"invalid {name}"] = given(name) & ~F.col(name).isin(allowed)
    isolated = None
    for domain, tasks in K.DOMAIN_TASKS.items():
        hit = (F.col("domain") == domain) & given("task") & ~F.col("task").isin(tasks)
        isolated = hit if isolated is None else isolated | hit
    rules["domain isolation"] = isolated
    first = entries.groupBy("dataset_id").agg(F.min("entry_no").alias("_first"))
    tagged = entries.join(first, "dataset_id", "left")
    rules["duplicate id"] = F.col("entry_no") > F.col("_first")
    return _findings(tagged, ["entry_no", "dataset_id"], rules)


def roll_up(checks: DataFrame, key: list[str], status: str) -> DataFrame:
    """Worst status per key."""
    level = F.element_at(F.create_map(*[F.lit(v) for p in SEVERITY.items() for v in p]), F.col(status))
    worst = checks.groupBy(*key).agg(F.max(level).alias("_w")) if key else checks.agg(F.max(level).alias("_w"))
    return worst.select(*key, F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("_w") + 1).alias("status"))


def area_findings(areas: DataFrame) -> DataFrame:
    """Areas with columns type, rings and box."""
    lon = (F.col("min_lon") >= -180) & (F.col("max_lon") <= 180) & (F.col("min_lat") >= -90) & (F.col("max_lat") <= 90)
    known = F.col("type").isin("Polygon", "MultiPolygon", "Feature", "FeatureCollection")
    empty = F.coalesce(F.size("rings"), F.lit(0)) <= 0
    area = F.aggregate(F.transform("rings", geo.shoelace), F.lit(0.0), lambda a, x: a + x)
    km2 = geo.area_km2(area, F.col("min_lat"), F.col("max_lat"))
    crossing = F.exists("rings", lambda r: geo.self_intersects(geo.ring_edges(r)))
    off = lambda e: F.coalesce(e, F.lit(False))
    return _findings(areas, ["aoi_id"], {"unsupported type": ~known, "empty geometry": empty, "coordinates out of range": off(~lon),
                                         "degenerate area": off(~empty & (km2 < 1e-6)), "self-intersection": off(~empty & crossing)})


def checked_request(requests: DataFrame) -> DataFrame:
    """Date order and the clamped cloud limit."""
    return requests.withColumns({
        "date_status": F.when(F.col("date_from") > F.col("date_to"), "date_from later than date_to").otherwise("ok"),
        "max_cloud_cover": F.least(F.greatest(F.col("max_cloud_cover"), F.lit(0.0)), F.lit(100.0))})


def incompatible_layers(layers: DataFrame) -> DataFrame:
    """Scenes whose layers differ in height, width or reference system.

    Minimum and maximum per property find a difference without a distinct count."""
    props = ("height", "width", "crs")
    df = layers.groupBy("scene_id").agg(*[e for p in props for e in (F.min(p).alias(f"lo_{p}"), F.max(p).alias(f"hi_{p}"))])
    return _findings(df, ["scene_id"], {f"{p} mismatch": F.col(f"lo_{p}") != F.col(f"hi_{p}") for p in props})


def missing_bands(files: DataFrame, bands: str) -> DataFrame:
    upper = F.transform(bands, lambda b: F.upper(b))
    return files.withColumn("missing", F.array_except(F.array(*[F.lit(b) for b in K.CLOUD_MODEL_BANDS]), upper)).where(F.size("missing") > 0)


def output_findings(rasters: DataFrame) -> DataFrame:
    """Removal outputs with wrong band count, size or unknown provenance codes."""
    allowed = F.array(*[F.lit(i) for i in range(5)])
    return _findings(rasters, ["scene_id"], {
        "band count": F.col("bands") != 3, "size": (F.col("height") != F.col("expected_height")) | (F.col("width") != F.col("expected_width")),
        "provenance codes": F.size(F.array_except("codes", allowed)) > 0})


def catalogue_findings(tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Tiles without a scene, without geometry, or with values out of range."""
    known = scenes.select("scene_id").distinct().withColumn("_known", F.lit(True))
    df = tiles.join(known, "scene_id", "left")
    outside = lambda name, low, high: F.coalesce((F.col(name) < low) | (F.col(name) > high), F.lit(False))
    return _findings(df, ["tile_id"], {
        "unknown scene": F.col("_known").isNull(), "missing geometry": F.col("centroid_lat").isNull() | F.col("centroid_lon").isNull(),
        "latitude": outside("centroid_lat", -90, 90), "longitude": outside("centroid_lon", -180, 180),
        **{f"mean_{n}": outside(f"mean_{n}", -1, 1) for n in ("ndvi", "ndwi", "ndbi")}})


def routed(entries: DataFrame) -> DataFrame:
    """Reader that serves an entry, by domain and modality."""
    d, m = F.col("domain"), F.col("modality")
    return entries.withColumn("reader", F.when(d.isin("pipeline_validation", "eastern_ladakh") & m.isin("multispectral", "optical"), "multispectral scenes")
                              .when((d == "eastern_ladakh") & (m == "sar"), "radar scenes").when(d == "benchmark_change_detection", "bitemporal pairs")
                              .when(d == "maritime", "maritime scenes").otherwise("unsupported"))


def layout_findings(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries whose folder, expected sub-folders or manifest are missing from the listing.

    ``listing`` has local_path and folder (the first folder or file below it).
    """
    known = sorted({f for folders in K.EXPECTED_LAYOUT.values() for f in folders})
    # dealt by path before anything is counted, so that no task holds the paths of a whole file
    present = dealt(listing, "local_path").groupBy("local_path").agg(
        F.max(F.col("folder") == "manifest.json").alias("_manifest"), *[F.max(F.col("folder") == f).alias(f"_has_{f}") for f in known])
    live = F.col("status").isin("active", "configured")
    there = F.col("_manifest").isNotNull()
    wanted = F.coalesce(F.element_at(F.create_map(*[x for d, folders in K.EXPECTED_LAYOUT.items() for x in (F.lit(d), F.array(*[F.lit(f) for f in folders]))]), F.col("domain")), F.array().cast("array<string>"))
    held = F.array_compact(F.array(*[F.when(F.col(f"_has_{f}"), F.lit(f)) for f in known]))
    missing = F.transform(F.array_except(wanted, held), lambda f: F.concat(F.lit("missing sub-folder "), f))
    first = F.array_compact(F.array(F.when(~there & live, F.lit("missing folder")), F.when(there & ~F.col("_manifest") & (F.col("status") == "active"), F.lit("no manifest"))))
    return entries.select("entry_no", "domain", "status", "local_path").join(present, "local_path", "left").select(
        "entry_no", F.explode(F.concat(first, F.when(there, missing).otherwise(F.array().cast("array<string>")))).alias("finding"))
