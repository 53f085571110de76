"""Catalogue and registry filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import change, geo, spectral
from ..operators import filters, pairs
from .registry import query
from .sqltext import CHANGE

SENTINELS = """('sentinel-2','sentinel-2a','sentinel-2b','sentinel-2c','sentinel-2d','Sentinel-2','Sentinel-2A','Sentinel-2B',
 'Sentinel-2C','Sentinel-2D','Sentinel-2 L2A','sentinel2','sentinel','Organiser Sensor')"""
BOX = "centroid_lon - 0.0256 AS min_lon, centroid_lat - 0.0256 AS min_lat, centroid_lon + 0.0256 AS max_lon, centroid_lat + 0.0256 AS max_lat"


def obs(spark, d):
    return table(spark, d, "obs")


def boxed(spark, d):
    """Tile observations with their footprint box."""
    return obs(spark, d).selectExpr("*", *[e.strip() for e in BOX.split(",")])


@query("f01_sensor_family", ["obs"], f"""
SELECT 'sentinel' AS wanted, tile_id, sensor FROM obs WHERE sensor IN {SENTINELS}
UNION ALL SELECT 'maxar', tile_id, sensor FROM obs WHERE sensor IN ('Maxar','maxar','Maxar WorldView','Maxar WorldView / Wayback')
UNION ALL SELECT 'other', tile_id, sensor FROM obs WHERE sensor = 'Sentinel-2A'""")
def f01(spark, d):
    tiles = obs(spark, d).select("tile_id", "sensor")
    part = lambda name, cond: tiles.where(cond).select(F.lit(name).alias("wanted"), "tile_id", "sensor")
    return part("sentinel", filters.sensor_family("Sentinel-2")).unionByName(
        part("maxar", filters.sensor_family("maxar"))).unionByName(part("other", F.col("sensor") == "Sentinel-2A"))


@query("f02_date_range", ["obs"], """
SELECT tile_id, acquisition_date FROM obs WHERE acquisition_date >= TIMESTAMP '2024-01-05 00:00:00' AND acquisition_date <= TIMESTAMP '2024-01-20 12:00:00'""")
def f02(spark, d):
    keep = filters.search_filter(start="2024-01-05 00:00:00", end="2024-01-20 12:00:00")
    return obs(spark, d).where(keep).select("tile_id", "acquisition_date")


@query("f03_quality_gate", ["obs"], "SELECT tile_id, quality_confidence, quality_confidence >= 0.70 AS passed_gate FROM obs WHERE quality_confidence >= 0.5")
def f03(spark, d):
    return obs(spark, d).where(filters.search_filter(min_quality=0.5)).select(
        "tile_id", "quality_confidence", (F.col("quality_confidence") >= 0.70).alias("passed_gate"))


@query("f04_cloud_gate", ["obs"], "SELECT tile_id, cloud_pct FROM obs WHERE cloud_pct <= 0.25")
def f04(spark, d):
    return obs(spark, d).where(filters.search_filter(max_cloud_pct=25.0)).select("tile_id", "cloud_pct")


@query("f05_bbox_intersects", ["obs"], f"""WITH b AS (SELECT tile_id, {BOX} FROM obs)
SELECT tile_id FROM b WHERE min_lon <= 70.45 AND max_lon >= 70.2 AND min_lat <= 20.6 AND max_lat >= 20.1""")
def f05(spark, d):
    box = (F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))
    wanted = tuple(F.lit(v) for v in (70.2, 20.1, 70.45, 20.6))
    return boxed(spark, d).where(geo.boxes_intersect(box, wanted)).select("tile_id")


# a concave area of interest with a notch
RING = [(70.10, 20.10), (70.80, 20.15), (70.75, 20.80), (70.45, 20.40), (70.15, 20.85), (70.10, 20.10)]
EDGES = list(zip(RING[:-1], RING[1:]))


def _edge_sql() -> str:
    parts = []
    for (px, py), (qx, qy) in EDGES:
        s = [f"(({qx}-({px}))*({cy}-({py})) - ({qy}-({py}))*({cx}-({px})))" for cx, cy in
             (("min_lon", "min_lat"), ("min_lon", "max_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"))]
        parts.append(f"({min(px, qx)} <= max_lon AND {max(px, qx)} >= min_lon AND {min(py, qy)} <= max_lat AND {max(py, qy)} >= min_lat"
                     f" AND least({', '.join(s)}) <= 0 AND greatest({', '.join(s)}) >= 0)")
    cross = " + ".join(f"(CASE WHEN ({py} > min_lat) <> ({qy} > min_lat) AND min_lon < ({qx}-({px}))*(min_lat-({py}))/({qy}-({py}))+({px}) THEN 1 ELSE 0 END)"
                       for (px, py), (qx, qy) in EDGES)
    return f"({' OR '.join(parts)} OR ({cross}) % 2 = 1)"


@query("f06_area_intersects", ["obs"], f"WITH b AS (SELECT tile_id, {BOX} FROM obs) SELECT tile_id FROM b WHERE {_edge_sql()}")
def f06(spark, d):
    ring = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in RING])
    xs, ys = [p[0] for p in RING], [p[1] for p in RING]
    box = (F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))
    bounds = tuple(F.lit(v) for v in (min(xs), min(ys), max(xs), max(ys)))
    return (
        boxed(spark, d).where(geo.boxes_intersect(box, bounds))
        .where(geo.edges_intersect_box(geo.polygon_edges(F.array(ring)), *box)).select("tile_id")
    )


@query("f07_candidate_restriction", ["obs", "vectors"], """
SELECT o.tile_id, o.site_key FROM obs o WHERE o.tile_id IN (SELECT tile_id FROM vectors WHERE collection = 'tile_embeddings')""")
def f07(spark, d):
    candidates = table(spark, d, "vectors").where(F.col("collection") == "tile_embeddings")
    return filters.restrict(obs(spark, d).select("tile_id", "site_key"), candidates)


@query("f08_region_substring", ["obs"], "SELECT tile_id, scene_id FROM obs WHERE contains(tile_id, '_12') OR contains(scene_id, '_12')")
def f08(spark, d):
    return obs(spark, d).where(filters.in_region("_12")).select("tile_id", "scene_id")


_ND = lambda c: f"({c} = 0 OR {c} = -9999 OR {c} < -9000 OR isnan({c}) OR isinf({c}))"
_SENT = lambda c: f"({c} = -9999 OR {c} < -9000 OR isnan({c}) OR isinf({c}))"


@query("f09_nodata", ["canvas"], f"""
SELECT scene_id, prow, pcol, {_ND('green')} AS sample_nodata,
 ({' OR '.join(_SENT(b) for b in ('blue', 'green', 'red', 'nir', 'swir'))}) OR (blue = 0 AND green = 0 AND red = 0 AND nir = 0 AND swir = 0) AS pixel_nodata FROM canvas""")
def f09(spark, d):
    bands = [F.col(b) for b in ("blue", "green", "red", "nir", "swir")]
    return table(spark, d, "canvas").select(
        "scene_id", "prow", "pcol", spectral.nodata_value(F.col("green")).alias("sample_nodata"),
        spectral.nodata_pixel(bands).alias("pixel_nodata"))


@query("f10_empty_tiles", ["canvas"], f"""WITH t AS (SELECT scene_id, CAST(floor(prow / 2) AS BIGINT) AS trow, pcol, {_ND('red')} AS bad FROM canvas)
SELECT scene_id, trow, pcol, count(*) AS samples, count(*) FILTER (WHERE NOT bad) AS valid_samples FROM t GROUP BY ALL
HAVING count(*) FILTER (WHERE NOT bad) / count(*) >= 0.01""")
def f10(spark, d):
    df = table(spark, d, "canvas").selectExpr("scene_id", "CAST(floor(prow / 2) AS BIGINT) AS trow", "pcol", "red")
    return filters.drop_empty_tiles(df, ["scene_id", "trow", "pcol"], spectral.nodata_value(F.col("red")))


BOX_ROWS = f"""WITH {CHANGE}, bx AS (SELECT site_id, prow, pcol, change_type, class_b, class_a, ndvi_b, ndbi_b, ndwi_a,
 CASE change_type WHEN 'Demolition / Reversion' THEN 'Built-up → Ground' WHEN 'Construction' THEN 'Ground → Built-up' ELSE change_type END AS transition FROM ver WHERE verified)"""


def box_rows(spark, d):
    return (
        pairs.classify(table(spark, d, "pixels")).where("verified")
        .selectExpr("site_id", "prow", "pcol", "change_type", "class_b", "class_a", "ndvi_b", "ndbi_b", "ndwi_a",
                    "CASE change_type WHEN 'Demolition / Reversion' THEN 'Built-up → Ground' WHEN 'Construction' "
                    "THEN 'Ground → Built-up' ELSE change_type END AS transition")
    )


@query("f13_false_demolition", ["pixels"], f"""{BOX_ROWS} SELECT site_id, prow, pcol, change_type FROM bx
WHERE NOT ((contains(change_type, 'Demo') OR contains(transition, 'Built-up → Ground')) AND
 (contains(class_b, 'Soil') OR contains(class_b, 'Ground') OR contains(class_b, 'Barren') OR contains(class_b, 'Land') OR ndbi_b < 0.10 OR ndvi_b >= ndbi_b))""")
def f13(spark, d):
    c = F.col
    gone = change.is_false_demolition(c("change_type"), c("transition"), c("class_b"), c("ndvi_b"), c("ndbi_b"))
    return box_rows(spark, d).where(~gone).select("site_id", "prow", "pcol", "change_type")


@query("f14_display_boxes", ["pixels"], f"""{BOX_ROWS} SELECT site_id, prow, pcol, change_type FROM bx
WHERE NOT ((contains(lower(change_type), 'demo') OR contains(lower(transition), 'built-up → ground')) AND
   (ndvi_b >= 0.10 OR ndbi_b < 0.10 OR ndvi_b >= ndbi_b OR contains(lower(class_b), 'soil') OR contains(lower(class_b), 'ground') OR contains(lower(class_b), 'barren') OR contains(lower(class_b), 'land')))
 AND NOT ((contains(lower(change_type), 'construct') OR contains(lower(change_type), 'road') OR contains(lower(transition), 'built-up') OR contains(lower(transition), 'road'))
   AND (contains(lower(class_a), 'water') OR ndwi_a > 0.15))""")
def f14(spark, d):
    c = F.col
    gone = change.is_false_box(c("change_type"), c("transition"), c("class_b"), c("class_a"), c("ndvi_b"), c("ndbi_b"), c("ndwi_a"))
    return box_rows(spark, d).where(~gone).select("site_id", "prow", "pcol", "change_type")


@query("f16_registry_filter", ["registry"], """SELECT dataset_id, entry_no FROM registry
WHERE domain = 'eastern_ladakh' AND modality = 'multispectral' AND task = 'temporal_change_detection'""")
def f16(spark, d):
    keep = filters.registry_entries("eastern_ladakh", "multispectral", "temporal_change_detection")
    return table(spark, d, "registry").where(keep).select("dataset_id", "entry_no")


@query("f17_cluster_filter", ["registry"], """WITH c AS (SELECT concat('cluster_', entry_no) AS cluster_id, concat('Cluster — ', display_name) AS label, concat('tile_', entry_no * 7) AS representative_tile_id FROM registry)
SELECT cluster_id, label FROM c WHERE contains(lower(label), 'red') AND (contains(lower(label), '3') OR contains(lower(cluster_id), '3') OR contains(lower(representative_tile_id), '3'))""")
def f17(spark, d):
    clusters = table(spark, d, "registry").selectExpr(
        "concat('cluster_', entry_no) AS cluster_id", "concat('Cluster — ', display_name) AS label",
        "concat('tile_', entry_no * 7) AS representative_tile_id")
    return clusters.where(filters.clusters_matching("Red", " 3 ")).select("cluster_id", "label")


@query("f18_relaxed_cloud", ["items"], """WITH t AS (SELECT item_id, granule, date_trunc('day', datetime) AS bucket, cloud_cover, CASE WHEN cloud_cover < 1 THEN 0 WHEN cloud_cover < 21 THEN 1 END AS tier FROM items)
SELECT item_id, granule, bucket, tier FROM (SELECT *, min(tier) OVER (PARTITION BY granule, bucket) AS best FROM t) WHERE tier = best""")
def f18(spark, d):
    df = table(spark, d, "items").selectExpr(
        "item_id", "granule", "CAST(date_trunc('day', datetime) AS TIMESTAMP_NTZ) AS bucket", "cloud_cover")
    return filters.low_cloud_scenes(df, ["granule", "bucket"], 1.0).select("item_id", "granule", "bucket", "tier")


@query("f19_scene_covers_area", ["items"], """WITH o AS (SELECT item_id, greatest(0, least(max_lon, 70.9) - greatest(min_lon, 70.6)) * greatest(0, least(max_lat, 20.9) - greatest(min_lat, 20.6)) / ((70.9 - 70.6)::DOUBLE * (20.9 - 20.6)::DOUBLE) AS f FROM items)
SELECT item_id, round(f * 100, 4) AS overlap_pct FROM o WHERE f * 100 >= 90""")
def f19(spark, d):
    box = (F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))
    area = tuple(F.lit(v) for v in (70.6, 20.6, 70.9, 20.9))
    share = geo.overlap_fraction(box, area) * 100.0
    return table(spark, d, "items").select("item_id", share.alias("s")).where("s >= 90").select(
        "item_id", F.round("s", 4).alias("overlap_pct"))


@query("f20_known_area", ["obs"], """WITH b AS (SELECT tile_id, 72.7 + (obs_id % 70) / 10 AS west, 18.8 + (obs_id % 170) / 10 AS south FROM obs)
SELECT tile_id, CASE WHEN west BETWEEN 77.08 AND 77.16 AND south BETWEEN 28.56 AND 28.64 THEN 'pipeline_validation_delhi_cantonment'
 WHEN west BETWEEN 78.3 AND 79.2 AND south BETWEEN 33.5 AND 34.1 THEN 'pangong_tso_north_bank' WHEN west BETWEEN 77.8 AND 78.6 AND south BETWEEN 34.5 AND 35.1 THEN 'galwan_valley_confluence'
 WHEN west BETWEEN 77.6 AND 78.4 AND south BETWEEN 35.0 AND 35.7 THEN 'depsang_plains_y_junction' WHEN west BETWEEN 72.80 AND 72.90 AND south BETWEEN 18.88 AND 18.98 THEN 'mumbai_naval_anchorage'
 WHEN west BETWEEN 78.4 AND 79.0 AND south BETWEEN 33.3 AND 33.9 THEN 'chushul_rezang_la' ELSE 'UNKNOWN' END AS area_id FROM b""")
def f20(spark, d):
    df = obs(spark, d).selectExpr("tile_id", "CAST(72.7 AS DOUBLE) + (obs_id % 70) / 10 AS west", "CAST(18.8 AS DOUBLE) + (obs_id % 170) / 10 AS south")
    return df.select("tile_id", filters.known_area(F.col("west"), F.col("south")).alias("area_id"))
