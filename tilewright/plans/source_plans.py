"""Sources and sinks: each query writes its input to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import geo
from ..operators import events as ev
from ..session import fresh_path
from ..sources import layout, readers, sinks
from ..sources.tables import LoggedTable
from .filter_plans import boxed
from .registry import query
from .scalar_plans import BAND_SQL, FILE_NAME, SENSOR_SQL

c = F.col


@query("s01_catalogue_scan", ["obs"], """SELECT tile_id, region_id, CAST(acquisition_date AS DATE) AS day, cloud_pct FROM obs WHERE region_id IN ('region_1', 'region_5') AND CAST(acquisition_date AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'""")
def s01(spark, d):
    tiles = table(spark, d, "obs").select("tile_id", "region_id", c("acquisition_date").cast("date").alias("day"), "cloud_pct", "sensor")
    path = fresh_path(spark, "catalogue")
    tiles.hint("rebalance", "region_id", "day").write.partitionBy("region_id", "day").parquet(path)
    return readers.catalogue(spark, path, ["region_1", "region_5"], "2024-01-03", "2024-01-09").select("tile_id", "region_id", "day", "cloud_pct")


@query("s02_manifest_scan", ["obs"], """WITH k AS (SELECT *, CAST(replace(region_id, 'region_', '') AS BIGINT) % 3 AS kind FROM obs)
SELECT 'tile' AS kind, region_id, tile_id AS sample_id, scene_id, quality_confidence >= 0.7 AS passed_gate FROM k WHERE kind = 0
UNION ALL SELECT 'pair', region_id, 'pair_' || tile_id, scene_id, NULL FROM k WHERE kind = 1 UNION ALL SELECT DISTINCT 'document', region_id, 'doc_' || region_id, 'doc_' || region_id, NULL::BOOLEAN FROM k WHERE kind = 2""")
def s02(spark, d):
    kind = F.expr("CAST(replace(region_id, 'region_', '') AS BIGINT) % 3")
    tile = F.struct("tile_id", "scene_id", "site_key", F.date_format("acquisition_date", "yyyy-MM-dd").alias("acquisition_date"),
                    F.struct("cloud_pct", "quality_confidence", (c("quality_confidence") >= 0.7).alias("passed_gate")).alias("quality"))
    pair = F.struct(F.concat(F.lit("pair_"), c("tile_id")).alias("pair_id"), c("scene_id").alias("t1_scene_id"))
    tiles = table(spark, d, "obs").withColumn("kind", kind)
    docs = sinks.manifests(tiles.where("kind = 0"), ["region_id"], tile, c("obs_id")).select("region_id", "total_tiles", "tiles", "part")
    pairs = sinks.manifests(tiles.where("kind = 1"), ["region_id"], pair, c("obs_id")).select("region_id", c("tiles").alias("temporal_pairs"), "part")
    alone = tiles.where("kind = 2").select("region_id").distinct().select("region_id", F.concat(F.lit("doc_"), c("region_id")).alias("scene_id"), F.lit(0).alias("part"))
    path = fresh_path(spark, "manifests")
    for df in (docs, pairs, alone):  # one document per file, as manifests are kept
        df.withColumn("doc", F.concat_ws("_", "region_id", "part")).repartition("doc").write.mode("append").partitionBy("doc").json(path)
    return readers.manifest_samples(spark, path)


NESTED = "CAST(replace(region_id, 'region_', '') AS BIGINT) % 2 = 0"


def manifest_folder(spark, d):
    """Manifest documents of every region, nested or flat, and beside each a copy that breaks off."""
    tiles = table(spark, d, "obs").withColumns({"day": F.date_format("acquisition_date", "yyyy-MM-dd"), "tif": F.concat(F.lit("/data/"), c("tile_id"), F.lit(".tif"))})
    box = F.array(*[F.round(c(x) + s * 0.0256, 6) for s in (-1, 1) for x in ("centroid_lon", "centroid_lat")])
    indices = ["mean_ndvi", "mean_ndwi", "mean_ndbi"]
    nested = F.struct(
        "tile_id", "scene_id", "site_key", F.lit("sentinel").alias("source_type"), c("day").alias("acquisition_date"), F.struct(c("centroid_lat").alias("latitude"), c("centroid_lon").alias("longitude")).alias("centroid"),
        box.alias("bounds_epsg4326"), F.struct("cloud_pct", "quality_confidence", (c("quality_confidence") >= 0.7).alias("passed_gate")).alias("quality"), F.struct(*indices).alias("indices"),
        F.struct(F.array(F.lit("B02"), F.lit("B03")).alias("band_order"), F.lit("reflectance_fixed_10000").alias("pixel_scale")).alias("bands"), F.struct(c("tif").alias("geotiff_path")).alias("storage"))
    flat = F.struct("tile_id", "scene_id", "site_key", c("day").alias("acquisition_date"), "centroid_lat", "centroid_lon", box.alias("bounds"), "cloud_pct", "quality_confidence", *indices,
                    F.array(F.lit("B02")).alias("band_order"), c("tif").alias("geotiff_path"))
    path = fresh_path(spark, "manifests")
    for own, record in ((NESTED, nested), (f"NOT {NESTED}", flat)):
        docs = sinks.manifests(tiles.where(own), ["region_id"], record, c("obs_id"), 2000).withColumn("source_type", F.lit("organiser"))
        text = F.to_json(F.struct("manifest_version", "region_id", "source_type", "total_tiles", "tiles"), {"pretty": "true"})
        whole = docs.select(F.concat_ws("_", "region_id", "part").alias("doc"), text.alias("value"))
        broken = whole.where("doc LIKE '%\\_0'").select(F.concat("doc", F.lit("_broken")).alias("doc"), F.expr("left(value, length(value) div 2)").alias("value"))
        whole.unionByName(broken).repartition("doc").write.mode("append").partitionBy("doc").text(path)
    return path


@query("s02_manifest_records", ["obs"], """SELECT region_id, tile_id, scene_id, site_key, strftime(acquisition_date, '%Y-%m-%d') AS acquisition_date, CASE WHEN n % 2 = 0 THEN 'sentinel' ELSE 'organiser' END AS source_type, centroid_lat, centroid_lon,
 round(centroid_lon - 0.0256, 6) AS min_lon, round(centroid_lat - 0.0256, 6) AS min_lat, round(centroid_lon + 0.0256, 6) AS max_lon, round(centroid_lat + 0.0256, 6) AS max_lat, cloud_pct, quality_confidence, quality_confidence >= 0.7 AS passed_gate,
 mean_ndvi, mean_ndwi, mean_ndbi, CASE WHEN n % 2 = 0 THEN 'reflectance_fixed_10000' END AS pixel_scale, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS bands, '/data/' || tile_id || '.tif' AS geotiff_path FROM (SELECT *, CAST(replace(region_id, 'region_', '') AS BIGINT) AS n FROM obs)""")
def s02_records(spark, d):
    found = readers.tile_records(readers.read_documents(spark, manifest_folder(spark, d), readers.FULL_MANIFEST))
    return found.withColumn("bands", F.size("band_order")).drop("file", "manifest_version", "geometry", "band_order", "band_stats", "thumbnail_path", "bad_mask_path")


@query("s02_unreadable", ["obs"], """SELECT region_id, (count(*) + 1999) // 2000 AS readable, 1::BIGINT AS unreadable, count(*) AS tiles FROM obs GROUP BY region_id""")
def s02_unreadable(spark, d):
    docs = readers.read_documents(spark, manifest_folder(spark, d), readers.FULL_MANIFEST)
    region = F.regexp_extract("file", r"doc=(region_\d+)_", 1)
    return docs.groupBy(region.alias("region_id")).agg(F.count("document").alias("readable"), F.count("unreadable").alias("unreadable"), F.coalesce(F.sum(F.size("document.tiles")), F.lit(0)).alias("tiles"))


RING_JSON = "concat('[[', x1, ',', y1, '],[', x2, ',', y2, '],[', x3, ',', y3, '],[', x4, ',', y4, '],[', x1, ',', y1, ']]')"
AREA_JSON = f"""CASE aoi_no % 4 WHEN 0 THEN concat('{{"type":"Polygon","coordinates":[', {RING_JSON}, ']}}')
 WHEN 1 THEN concat('{{"type":"Feature","properties":{{}},"geometry":{{"type":"Polygon","coordinates":[', {RING_JSON}, ']}}}}')
 WHEN 2 THEN concat('{{"type":"MultiPolygon","coordinates":[[', {RING_JSON}, ']]}}')
 ELSE concat('{{"type":"FeatureCollection","features":[{{"geometry":{{"type":"Polygon","coordinates":[', {RING_JSON}, ']}}}},{{"geometry":{{"type":"Polygon","coordinates":[[[10,10],[11,10],[11,11],[10,10]]]}}}}]}}') END"""


@query("s03_area_scan", ["areas"], """SELECT aoi_id, CASE aoi_no % 4 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'Feature' WHEN 2 THEN 'MultiPolygon' ELSE 'FeatureCollection' END AS type, CASE WHEN aoi_no % 4 = 3 THEN 2 ELSE 1 END AS rings,
 round(CASE WHEN aoi_no % 4 = 3 THEN 10 ELSE least(x1, x2, x3, x4) END, 9) AS min_lon, round(greatest(y1, y2, y3, y4, 11), 9) AS max_lat FROM areas""")
def s03(spark, d):
    path = fresh_path(spark, "areas")
    table(spark, d, "areas").selectExpr("aoi_id", f"{AREA_JSON} AS document").write.json(path)
    stored = spark.read.schema("aoi_id string, document string").json(path)
    return readers.areas(stored).select("aoi_id", "type", F.size("rings").alias("rings"), F.round("min_lon", 9).alias("min_lon"), F.round("max_lat", 9).alias("max_lat"))


@query("s04_aoi_registry", ["areas"], """SELECT aoi_id, year, '07-01/10-31' AS seasonal_window, CAST(aoi_no % 3 AS INT) AS priority FROM areas, unnest(CASE WHEN aoi_no % 2 = 0 THEN [2017, 2020, 2023] ELSE [2019] END) AS u(year)""")
def s04(spark, d):
    entry = F.struct("aoi_id", F.expr("CASE WHEN aoi_no % 2 = 0 THEN array(2017, 2020, 2023) ELSE array(2019) END").alias("target_years"), F.lit("07-01/10-31").alias("seasonal_window"),
                     F.expr("CAST(aoi_no % 3 AS INT)").alias("priority"), F.lit("active").alias("status"))
    path = sinks.write_documents(table(spark, d, "areas"), F.expr("aoi_no div 50"), entry, c("aoi_no"), "aois", "aoi_registry")
    return readers.aoi_registry(spark, path).select("aoi_id", "year", "seasonal_window", "priority")


@query("s05_dataset_registry", ["registry"], "SELECT dataset_id, display_name, domain, modality, task, status, notes FROM registry")
def s05(spark, d):
    df = table(spark, d, "registry").drop("entry_no")
    path = sinks.write_documents(table(spark, d, "registry"), F.expr("entry_no div 100"), F.struct(*df.columns), c("entry_no"), "datasets", "datasets")
    return readers.dataset_registry(spark, path).select("dataset_id", "display_name", "domain", "modality", "task", "status", "notes")


@query("s06_item_scan", ["items"], """SELECT item_id AS scene_id, CASE WHEN item_no % 3 = 0 THEN 'Sentinel-2' ELSE 'sentinel-2b' END AS sensor, CASE item_no % 4 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:32643' ELSE 'EPSG:32644' END AS crs, coalesce(CASE WHEN item_no % 5 <> 0 THEN cloud_cover END, 0) AS cloud_cover,
 CASE WHEN item_no % 2 = 0 THEN 'https://x/' || item_no || '/red.tif' ELSE 'https://x/' || item_no || '/B04.tif' END AS red_href, CASE WHEN item_no % 2 = 0 THEN 'https://x/' || item_no || '/nir08.tif' END AS nir_href FROM items""")
def s06(spark, d):
    doc = """concat('{"id":"', item_id, '","bbox":[', min_lon, ',', min_lat, ',', max_lon, ',', max_lat, '],"properties":{"datetime":"', CAST(datetime AS STRING), '"', CASE WHEN item_no % 3 = 0 THEN '' ELSE ',"platform":"sentinel-2b"' END,
      CASE item_no % 4 WHEN 0 THEN '' WHEN 1 THEN ',"proj:epsg":32643' ELSE ',"proj:crs":"EPSG:32644"' END, CASE WHEN item_no % 5 <> 0 THEN concat(',"eo:cloud_cover":', cloud_cover) ELSE '' END, '},"assets":{',
      CASE WHEN item_no % 2 = 0 THEN concat('"red":{"href":"https://x/', item_no, '/red.tif"},"B04":{"href":"no"},"nir08":{"href":"https://x/', item_no, '/nir08.tif"}') ELSE concat('"B04":{"href":"https://x/', item_no, '/B04.tif"}') END, '}}') AS value"""
    path = sinks.write_lines(table(spark, d, "items").selectExpr(doc), "items")
    return readers.items(spark.read.text(path), "value").select("scene_id", "sensor", "crs", "cloud_cover", "red_href", "nir_href")


@query("s07_raster_files", ["files"], f"""WITH n AS (SELECT file_no, path, {FILE_NAME} AS nm, upper({FILE_NAME}) AS u, {SENSOR_SQL.replace('platform_tag', "''")} AS sensor FROM files), m AS (SELECT *, sensor = 'landsat' OR regexp_matches(u, 'LC08|LC09|_SR_B') AS ls FROM n)
SELECT path, sensor, {BAND_SQL} AS band FROM m""")
def s07(spark, d):
    path = fresh_path(spark, "rasters")
    sinks.raster_files(table(spark, d, "files").select("path"), path)
    listed = readers.raster_files(spark, path).select(F.url_decode(F.regexp_extract("path", r"/path=([^/]*)/", 1)).alias("path"))
    return readers.describe_files(listed, "path", [F.lit("")]).select("path", "sensor", "band")


TRIPLET = "concat(CASE doc_id % 3 WHEN 0 THEN 'train_' WHEN 1 THEN 'VAL_' ELSE 'x_' END, doc_id, '.png')"


@query("s08_triplets", None, f"""WITH d AS (SELECT doc_id, {TRIPLET} AS name FROM documents)
SELECT 'jl_' || replace(name, '.png', '') AS sample_id, 't1/' || name AS t1_path, CASE WHEN doc_id % 4 <> 0 THEN 't2/' || name END AS t2_path, CASE WHEN doc_id % 5 <> 0 THEN 'label/' || name END AS label_path, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM d""")
def s08(spark, d):
    df = table(spark, d, "documents").selectExpr("doc_id", f"{TRIPLET} AS name")
    side = lambda folder, cond: df.where(cond).select("name", F.concat(F.lit(folder + "/"), c("name")).alias("path"))
    return readers.triplets(side("t1", "true"), side("t2", "doc_id % 4 <> 0"), side("label", "doc_id % 5 <> 0"), "jl")


@query("s09_pixel_window", ["pixels"], "SELECT site_id, prow, pcol, nir_b, bad_b FROM pixels WHERE prow BETWEEN 8 AND 23 AND pcol BETWEEN 4 AND 19")
def s09(spark, d):
    path = fresh_path(spark, "pixels")
    layout.write_pixels(table(spark, d, "pixels"), path, ["site_id"])
    return readers.pixel_window(spark, path, (8, 23), (4, 19), ["site_id", "prow", "pcol", "nir_b", "bad_b"])


LAYER = "CASE file_no % 7 WHEN 0 THEN 'raw_canvas' WHEN 1 THEN 'cloud_mask' WHEN 2 THEN 'combined_mask' WHEN 3 THEN 'bad_mask' WHEN 4 THEN 'shadow_mask' WHEN 5 THEN 'normalized_canvas' ELSE 'notes' END"
LAYER_ROWS = f"SELECT concat('scene_', file_no % 40) AS scene, concat('s/', CASE WHEN file_no % 3 = 0 THEN 'intermediate/' ELSE '' END, 'f', file_no, '/', {LAYER}, '.tif') AS path FROM "


@query("s10_scene_layers", ["files"], f"""WITH l AS ({LAYER_ROWS} files), s AS (SELECT *, regexp_extract(path, '([^/]*)\\.tif', 1) AS stem FROM l), p AS (SELECT *, CASE stem WHEN 'combined_mask' THEN 'bad_mask' ELSE stem END AS layer FROM s WHERE stem <> 'notes'),
r AS (SELECT *, row_number() OVER (PARTITION BY scene, layer ORDER BY stem = 'combined_mask', len(string_split(path, '/')), path) AS k FROM p)
SELECT scene, max(path) FILTER (WHERE layer = 'raw_canvas') AS raw_canvas, max(path) FILTER (WHERE layer = 'cloud_probability') AS cloud_probability, max(path) FILTER (WHERE layer = 'cloud_mask') AS cloud_mask, max(path) FILTER (WHERE layer = 'shadow_mask') AS shadow_mask,
 max(path) FILTER (WHERE layer = 'bad_mask') AS bad_mask, max(path) FILTER (WHERE layer = 'normalized_canvas') AS normalized_canvas FROM r WHERE k = 1 GROUP BY scene""")
def s10(spark, d):
    return readers.scene_layers(spark.sql(LAYER_ROWS + "{f}", f=table(spark, d, "files")))


# ---- sinks ---------------------------------------------------------------------------


@query("k01_upsert", ["obs"], """WITH o AS (SELECT tile_id, cloud_pct, 1 AS batch FROM obs WHERE obs_id % 5 <> 4), n AS (SELECT tile_id, cloud_pct / 2 AS cloud_pct, 2 AS batch FROM obs WHERE obs_id % 3 = 0)
SELECT tile_id, cloud_pct, batch FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY batch DESC) AS k FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) WHERE k = 1""")
def k01(spark, d):
    tiles = table(spark, d, "obs")
    month = F.date_format("acquisition_date", "yyyy-MM").alias("month")
    old = tiles.where("obs_id % 5 <> 4").select("tile_id", "cloud_pct", F.lit(1).alias("batch"), "region_id", month)
    new = tiles.where("obs_id % 3 = 0").select("tile_id", (c("cloud_pct") / 2).alias("cloud_pct"), F.lit(2).alias("batch"), "region_id", month)
    stored = LoggedTable.create(fresh_path(spark, "tiles"), old, ["region_id", "month"])
    stored.upsert(new, ["tile_id"], "batch")
    return stored.read().select("tile_id", "cloud_pct", "batch")


@query("k02_replace_sites", ["obs"], """SELECT site_key, tile_id, 'old' AS version FROM obs WHERE site_key NOT IN (SELECT site_key FROM obs WHERE quality_confidence > 0.99)
UNION ALL SELECT site_key, tile_id, 'new' FROM obs WHERE quality_confidence > 0.99""")
def k02(spark, d):
    tiles = table(spark, d, "obs")
    old = tiles.select("site_key", "tile_id", F.lit("old").alias("version"))
    new = tiles.where("quality_confidence > 0.99").select("site_key", "tile_id", F.lit("new").alias("version"))
    stored = LoggedTable.create(fresh_path(spark, "events"), sinks.site_buckets(old, "site_key"), ["bucket"])
    stored.replace(sinks.site_buckets(new, "site_key"), "site_key")
    return stored.read().select("site_key", "tile_id", "version")


@query("k03_manifest_export", ["obs"], """SELECT region_id, strftime(acquisition_date, '%Y-%m-%d') AS day, count(*) AS total_tiles, count(*) FILTER (WHERE quality_confidence >= 0.70) AS passed, min(tile_id) AS first_tile FROM obs GROUP BY ALL""")
def k03(spark, d):
    record = F.struct("tile_id", "scene_id", F.struct("cloud_pct", (c("quality_confidence") >= 0.70).alias("passed_gate")).alias("quality"),
                      F.struct("mean_ndvi", "mean_ndwi", "mean_ndbi").alias("indices"))
    tiles = table(spark, d, "obs").withColumn("day", F.date_format("acquisition_date", "yyyy-MM-dd"))
    docs = sinks.manifests(tiles, ["region_id", "day"], record, c("obs_id"))
    path = fresh_path(spark, "export")
    docs.withColumns({"region": c("region_id"), "date": c("day")}).hint("rebalance", "region", "date").write.partitionBy("region", "date").json(path)
    back = spark.read.schema("region_id string, day string, total_tiles bigint, tiles array<struct<tile_id: string, quality: struct<passed_gate: boolean>>>").json(path)
    return back.select("region_id", "day", "total_tiles", F.inline("tiles")).groupBy("region_id", "day", "total_tiles").agg(
        F.count_if("quality.passed_gate").alias("passed"), F.min("tile_id").alias("first_tile"))


@query("k04_tile_partitions", ["obs"], "SELECT region_id, CAST(acquisition_date AS DATE) AS day, count(*) AS tiles FROM obs GROUP BY ALL")
def k04(spark, d):
    tiles = table(spark, d, "obs").select("tile_id", "region_id", c("acquisition_date").cast("date").alias("day"), "mean_ndvi")
    return sinks.write_and_read(tiles.hint("rebalance", "region_id", "day"), "tile_data", ["region_id", "day"]).groupBy("region_id", "day").agg(F.count(F.lit(1)).alias("tiles"))


@query("k05_feature_export", ["obs"], """SELECT site_key, count(*) AS features, round(max(centroid_lon + 0.0256), 6) AS east FROM obs GROUP BY site_key""")
def k05(spark, d):
    lines = sinks.feature_lines(boxed(spark, d), geo.box_ring(c("min_lon"), c("min_lat"), c("max_lon"), c("max_lat")), ["site_key", "tile_id", "cloud_pct"])
    path = sinks.write_lines(lines, "features")
    schema = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<site_key: string, tile_id: string>"
    back = spark.read.schema(schema).json(path)
    return back.groupBy(c("properties.site_key").alias("site_key")).agg(
        F.count(F.lit(1)).alias("features"), F.round(F.max(F.expr("geometry.coordinates[0][0][0]")), 6).alias("east"))


@query("k07_search_audit", None, """SELECT 'analyst_' || conv_id AS analyst_id, count(*) AS searches, max(length(text)) AS longest FROM conversations WHERE role = 'user' GROUP BY ALL""")
def k07(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select(
        F.concat(F.lit("analyst_"), c("conv_id")).alias("analyst_id"), c("text").alias("raw_query"), F.lit("text").alias("query_type"),
        F.to_json(F.struct(F.lit(20.0).alias("max_cloud_pct"))).alias("filters"), F.array().cast("array<string>").alias("result_tile_ids"))
    path = fresh_path(spark, "search_log")
    for part in (rows.where("length(raw_query) % 2 = 0"), rows.where("length(raw_query) % 2 = 1")):
        sinks.append(spark, part, path)
    return spark.read.parquet(path).groupBy("analyst_id").agg(F.count(F.lit(1)).alias("searches"), F.max(F.length("raw_query")).cast("bigint").alias("longest"))


@query("g05_feature_round_trip", ["obs"], """SELECT site_key, row_number() OVER (PARTITION BY site_key ORDER BY obs_id) - 1 AS feature_no, tile_id, cloud_pct FROM obs""")
def g05(spark, d):
    collections = sinks.manifests(table(spark, d, "obs"), ["site_key"], F.struct("tile_id", "cloud_pct"), c("obs_id")).select("site_key", "part", c("tiles").alias("features"))
    return ev.explode_features(collections, ["site_key"])


@query("k02_sentinels", ["obs"], """WITH p AS (SELECT DISTINCT site_key FROM obs), e AS (SELECT site_key, 'Clearance' AS change_type, count(*) AS area_px FROM obs WHERE quality_confidence > 0.98 GROUP BY site_key)
SELECT site_key, change_type, area_px FROM e UNION ALL SELECT site_key, 'No Change', 0 FROM p WHERE site_key NOT IN (SELECT site_key FROM e)""")
def k02_sentinels(spark, d):
    tiles = table(spark, d, "obs")
    found = tiles.where("quality_confidence > 0.98").groupBy("site_key").agg(F.lit("Clearance").alias("change_type"), F.count(F.lit(1)).alias("area_px"))
    return ev.with_sentinels(found, tiles.select("site_key").distinct(), ["site_key"])
