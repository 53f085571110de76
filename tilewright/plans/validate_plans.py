"""Findings, set checks, quality measures and review lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..fixtures import table
from ..functions import geo, naming
from ..operators import evaluate, search, validate
from ..session import dealt, fresh_path
from .change_plans import classified
from .registry import query
from .scalar_plans import BAND_SQL, FILE_NAME, SENSOR_SQL, SHOELACE_SQL, area_ring, file_name
from .search_plans import CANDIDATES, queries_of, vec
from .sqltext import CHANGE

c = F.col
DOMS = "('pipeline_validation', 'eastern_ladakh', 'benchmark_change_detection', 'maritime')"
TASKS = "('preprocessing_validation', 'temporal_change_detection', 'semantic_change_detection', 'ship_detection', 'semantic_retrieval')"
FINDINGS = f"""r AS (SELECT *, entry_no > min(entry_no) OVER (PARTITION BY dataset_id) AS dup FROM registry), fi AS (
 SELECT entry_no, dataset_id, 'missing source' AS finding FROM r WHERE trim(source) = '' UNION ALL SELECT entry_no, dataset_id, 'missing notes' FROM r WHERE notes IS NULL
 UNION ALL SELECT entry_no, dataset_id, 'invalid domain' FROM r WHERE domain NOT IN {DOMS} UNION ALL SELECT entry_no, dataset_id, 'invalid modality' FROM r WHERE modality NOT IN ('multispectral', 'optical', 'sar', 'multimodal')
 UNION ALL SELECT entry_no, dataset_id, 'invalid task' FROM r WHERE task NOT IN {TASKS} UNION ALL SELECT entry_no, dataset_id, 'domain isolation' FROM r WHERE (domain = 'pipeline_validation' AND task NOT IN ('preprocessing_validation', 'temporal_change_detection'))
  OR (domain IN ('eastern_ladakh', 'benchmark_change_detection') AND task NOT IN ('temporal_change_detection', 'semantic_change_detection')) OR (domain = 'maritime' AND task NOT IN ('ship_detection', 'semantic_retrieval'))
 UNION ALL SELECT entry_no, dataset_id, 'duplicate id' FROM r WHERE dup)"""


@query("v01_registry_rules", ["registry"], f"WITH {FINDINGS} SELECT * FROM fi")
def v01(spark, d):
    return validate.registry_findings(table(spark, d, "registry"))


@query("v02_status_roll_up", ["registry"], f"""WITH {FINDINGS}, s AS (SELECT domain, CASE WHEN entry_no IN (SELECT entry_no FROM fi WHERE finding LIKE 'invalid%') THEN 2 WHEN entry_no IN (SELECT entry_no FROM fi) THEN 1 ELSE 0 END AS w FROM registry)
SELECT domain, CASE max(w) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS status FROM s GROUP BY domain UNION ALL SELECT 'overall', CASE max(w) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END FROM s""")
def v02(spark, d):
    entries = table(spark, d, "registry")
    worst = validate.registry_findings(entries).select("entry_no", F.when(c("finding").startswith("invalid"), "FAIL").otherwise("WARNING").alias("status"))
    checks = entries.select("entry_no", "domain").join(validate.roll_up(worst, ["entry_no"], "status"), "entry_no", "left").withColumn("status", F.coalesce("status", F.lit("PASS")))
    return validate.roll_up(checks, ["domain"], "status").unionByName(validate.roll_up(checks, [], "status").select(F.lit("overall").alias("domain"), "status"))


@query("v03_area_rules", ["areas"], f"""WITH v AS (SELECT aoi_id, CASE WHEN aoi_no % 10 = 1 THEN 'Point' ELSE 'Polygon' END AS type, aoi_no % 9 = 2 AS empty, CASE WHEN aoi_no % 8 = 3 THEN 200.0 ELSE 0 END AS sx, CASE WHEN aoi_no % 7 = 4 THEN 0 ELSE 1 END AS f, aoi_no % 6 = 5 AS tw, * EXCLUDE (aoi_id) FROM areas)
SELECT aoi_id, 'unsupported type' AS finding FROM v WHERE type = 'Point' UNION ALL SELECT aoi_id, 'empty geometry' FROM v WHERE empty UNION ALL SELECT aoi_id, 'coordinates out of range' FROM v WHERE NOT empty AND sx > 0
UNION ALL SELECT aoi_id, 'degenerate area' FROM v WHERE NOT empty AND f = 0 UNION ALL SELECT aoi_id, 'self-intersection' FROM v WHERE NOT empty AND f = 1 AND tw""")
def v03(spark, d):
    df = table(spark, d, "areas")
    shift, flat, twist = F.when(c("aoi_no") % 8 == 3, 200.0).otherwise(0.0), c("aoi_no") % 7 == 4, c("aoi_no") % 6 == 5
    at = lambda i: F.array(c(f"x{i}") + shift, F.when(flat, c("y1")).otherwise(c(f"y{i}")))
    plain, crossed = F.array(at(1), at(2), at(3), at(4), at(1)), F.array(at(1), at(3), at(2), at(4), at(1))
    ring = F.when(twist & ~flat, crossed).otherwise(plain)
    df = df.withColumn("_r", ring).select(
        "aoi_id", F.when(c("aoi_no") % 10 == 1, "Point").otherwise("Polygon").alias("type"), F.when(c("aoi_no") % 9 == 2, F.array()).otherwise(F.array("_r")).alias("rings"),
        *[F.when(c("aoi_no") % 9 != 2, e).alias(n) for e, n in zip(geo.ring_bounds(c("_r")), ("min_lon", "min_lat", "max_lon", "max_lat"))])
    return validate.area_findings(df)


@query("v04_request_rules", ["items"], """SELECT item_id, CASE WHEN item_no % 4 = 0 THEN 'date_from later than date_to' ELSE 'ok' END AS date_status, greatest(0, least(100, cloud_cover * 2 - 20)) AS max_cloud_cover FROM items""")
def v04(spark, d):
    df = table(spark, d, "items").selectExpr("item_id", "CAST(datetime AS DATE) AS date_from", "CASE WHEN item_no % 4 = 0 THEN date_sub(CAST(datetime AS DATE), 1) ELSE date_add(CAST(datetime AS DATE), 9) END AS date_to", "cloud_cover * 2 - 20 AS max_cloud_cover")
    return validate.checked_request(df).select("item_id", "date_status", "max_cloud_cover")


@query("v05_layer_compatibility", ["obs"], """WITH l AS (SELECT scene_id, CASE WHEN obs_id % 401 = 0 THEN 511 ELSE 512 END AS height, 512 AS width, CASE WHEN obs_id % 307 = 0 THEN 'EPSG:32643' ELSE 'EPSG:4326' END AS crs FROM obs)
SELECT scene_id, 'height mismatch' AS finding FROM l GROUP BY scene_id HAVING count(DISTINCT height) > 1 UNION ALL SELECT scene_id, 'crs mismatch' FROM l GROUP BY scene_id HAVING count(DISTINCT crs) > 1""")
def v05(spark, d):
    return validate.incompatible_layers(table(spark, d, "obs").selectExpr(
        "scene_id", "CASE WHEN obs_id % 401 = 0 THEN 511 ELSE 512 END AS height", "512 AS width", "CASE WHEN obs_id % 307 = 0 THEN 'EPSG:32643' ELSE 'EPSG:4326' END AS crs"))


@query("v06_required_bands", ["files"], """WITH b AS (SELECT file_no, list_filter(['B01', 'b02', 'B04', 'B05', 'B08', 'B8a', 'B09', 'B10', 'B11', 'B12'], lambda x: (file_no % 3 = 0) OR (ascii(x[3]) + file_no) % 5 <> 0) AS bands FROM files),
m AS (SELECT file_no, list_filter(['B01', 'B02', 'B04', 'B05', 'B08', 'B8A', 'B09', 'B10', 'B11', 'B12'], lambda r: NOT list_contains(list_transform(bands, lambda x: upper(x)), r)) AS missing FROM b) SELECT file_no, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0""")
def v06(spark, d):
    df = table(spark, d, "files").selectExpr("file_no", "filter(array('B01', 'b02', 'B04', 'B05', 'B08', 'B8a', 'B09', 'B10', 'B11', 'B12'), x -> (file_no % 3 = 0) OR (ascii(substring(x, 3, 1)) + file_no) % 5 <> 0) AS bands")
    return validate.missing_bands(df, "bands").select("file_no", F.concat_ws(",", "missing").alias("missing"))


@query("v07_output_rules", ["clouds"], """WITH g AS (SELECT scene_id, list_sort(list(DISTINCT CASE WHEN noise = 1 AND scene_id % 4 = 0 THEN 7 ELSE noise % 5 END)) AS codes FROM clouds GROUP BY scene_id)
SELECT scene_id, 'provenance codes' AS finding FROM g WHERE list_contains(codes, 7) UNION ALL SELECT scene_id, 'band count' FROM g WHERE scene_id % 5 = 0 UNION ALL SELECT scene_id, 'size' FROM g WHERE scene_id % 6 = 0""")
def v07(spark, d):
    codes = table(spark, d, "clouds").groupBy("scene_id").agg(F.collect_set(F.expr("CAST(CASE WHEN noise = 1 AND scene_id % 4 = 0 THEN 7 ELSE noise % 5 END AS INT)")).alias("codes"))
    return validate.output_findings(codes.selectExpr("scene_id", "codes", "CASE WHEN scene_id % 5 = 0 THEN 4 ELSE 3 END AS bands", "32 AS height", "32 AS width", "32 AS expected_height", "CASE WHEN scene_id % 6 = 0 THEN 31 ELSE 32 END AS expected_width"))


@query("v08_catalogue_integrity", ["obs"], """WITH o AS (SELECT tile_id, scene_id, CASE WHEN obs_id % 21 = 0 THEN NULL ELSE centroid_lat + CASE WHEN obs_id % 33 = 0 THEN 80 ELSE 0 END END AS centroid_lat, mean_ndvi * 1.2 AS v, mean_ndbi * 3 AS b FROM obs), s AS (SELECT DISTINCT scene_id FROM obs WHERE user_ok(obs_id))
SELECT tile_id, 'unknown scene' AS finding FROM o WHERE scene_id NOT IN (SELECT scene_id FROM s) UNION ALL SELECT tile_id, 'missing geometry' FROM o WHERE centroid_lat IS NULL UNION ALL SELECT tile_id, 'latitude' FROM o WHERE centroid_lat > 90
UNION ALL SELECT tile_id, 'mean_ndvi' FROM o WHERE v > 1 OR v < -1 UNION ALL SELECT tile_id, 'mean_ndbi' FROM o WHERE b > 1 OR b < -1""".replace("user_ok(obs_id)", "CAST(floor(obs_id / 50) AS BIGINT) % 8 <> 0"))
def v08(spark, d):
    tiles = table(spark, d, "obs")
    broken = tiles.selectExpr("tile_id", "scene_id", "CASE WHEN obs_id % 21 = 0 THEN NULL ELSE centroid_lat + CASE WHEN obs_id % 33 = 0 THEN 80 ELSE 0 END END AS centroid_lat", "centroid_lon",
                              "mean_ndvi * 1.2D AS mean_ndvi", "mean_ndwi", "mean_ndbi * 3 AS mean_ndbi")
    return validate.catalogue_findings(broken, tiles.where("CAST(floor(obs_id / 50) AS BIGINT) % 8 <> 0").select("scene_id"))


@query("v09_reader_routing", ["registry"], """SELECT entry_no, CASE WHEN domain IN ('pipeline_validation', 'eastern_ladakh') AND modality IN ('multispectral', 'optical') THEN 'multispectral scenes' WHEN domain = 'eastern_ladakh' AND modality = 'sar' THEN 'radar scenes'
 WHEN domain = 'benchmark_change_detection' THEN 'bitemporal pairs' WHEN domain = 'maritime' THEN 'maritime scenes' ELSE 'unsupported' END AS reader FROM registry""")
def v09(spark, d):
    return validate.routed(table(spark, d, "registry")).select("entry_no", "reader")


LISTING = "SELECT local_path, folder FROM (SELECT local_path, entry_no, {x} AS folder FROM {r} WHERE entry_no % 7 <> 0) t WHERE folder <> 'tiles' OR entry_no % 2 = 0"
FOLDERS = ["raw", "intermediate", "normalized", "tiles", "manifests", "t1", "label", "manifest.json"]


@query("v10_layout", ["registry"], """WITH li AS (SELECT local_path, folder FROM (SELECT local_path, entry_no, unnest(['raw', 'intermediate', 'normalized', 'tiles', 'manifests', 't1', 'label', 'manifest.json']) AS folder FROM registry WHERE entry_no % 7 <> 0) t WHERE (folder <> 'tiles' OR entry_no % 2 = 0) AND (folder <> 'manifest.json' OR entry_no % 3 = 0)),
ex(domain, folder) AS (VALUES ('eastern_ladakh', 'raw'), ('eastern_ladakh', 'intermediate'), ('eastern_ladakh', 'normalized'), ('eastern_ladakh', 'tiles'), ('eastern_ladakh', 'manifests'), ('benchmark_change_detection', 't1'), ('benchmark_change_detection', 't2'), ('benchmark_change_detection', 'label'))
SELECT entry_no, 'missing folder' AS finding FROM registry WHERE local_path NOT IN (SELECT local_path FROM li) AND status IN ('active', 'configured')
UNION ALL SELECT entry_no, 'no manifest' FROM registry WHERE local_path IN (SELECT local_path FROM li) AND local_path NOT IN (SELECT local_path FROM li WHERE folder = 'manifest.json') AND status = 'active'
UNION ALL SELECT entry_no, 'missing sub-folder ' || ex.folder FROM registry JOIN ex USING (domain) WHERE local_path IN (SELECT local_path FROM li) AND (local_path, ex.folder) NOT IN (SELECT (local_path, folder) FROM li)""")
def v10(spark, d):
    entries = table(spark, d, "registry")
    listing = dealt(entries.where("entry_no % 7 <> 0").select("local_path", "entry_no"), "local_path").select("local_path", "entry_no", F.explode(F.array(*[F.lit(f) for f in FOLDERS])).alias("folder")).where(
        "(folder <> 'tiles' OR entry_no % 2 = 0) AND (folder <> 'manifest.json' OR entry_no % 3 = 0)").select("local_path", "folder")
    return validate.layout_findings(entries, listing)


@query("u03_correspondence", None, """WITH a AS (SELECT 'f' || doc_id AS name FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT 'f' || doc_id AS name FROM documents WHERE doc_id % 10 <> 2)
SELECT name, 'second' AS missing_in FROM (SELECT name FROM a EXCEPT ALL SELECT name FROM b) UNION ALL SELECT name, 'first' FROM (SELECT name FROM b EXCEPT ALL SELECT name FROM a)""")
def u03(spark, d):
    docs = table(spark, d, "documents")
    side = lambda skip: docs.where(f"doc_id % 10 <> {skip}").select(F.concat(F.lit("f"), c("doc_id")).alias("name"))
    a, b = side(1), side(2)
    return a.exceptAll(b).withColumn("missing_in", F.lit("second")).unionByName(b.exceptAll(a).withColumn("missing_in", F.lit("first")))


@query("u04_duplicate_keys", ["registry"], "SELECT dataset_id, count(*) AS copies FROM registry GROUP BY dataset_id HAVING count(*) > 1")
def u04(spark, d):
    return validate.duplicate_keys(table(spark, d, "registry"), "dataset_id")


@query("a23_retrieval_metrics", ["vectors"], f"""WITH {CANDIDATES}, rel AS (SELECT DISTINCT q.query_id, v.tile_id FROM (SELECT 'q_' || CAST(floor(vec_id / 4) AS BIGINT) AS query_id, cluster_no FROM vectors WHERE vec_id % 4 = 0) q JOIN vectors v USING (cluster_no)),
h AS (SELECT query_id, rank FROM rk JOIN rel USING (query_id, tile_id) WHERE rank <= 10), n AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY query_id), g AS (SELECT query_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM h GROUP BY query_id)
SELECT query_id, coalesce(hits, 0) / 10 AS precision, round(coalesce(hits, 0) / relevant, 9) AS recall, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= relevant), 9) AS ndcg FROM n LEFT JOIN g USING (query_id)""")
def a23(spark, d):
    v = vec(spark, d)
    ranked = search.search_vectors(queries_of(spark, d), v, 5)
    seeds = v.where("vec_id % 4 = 0").selectExpr("concat('q_', CAST(floor(vec_id / 4) AS BIGINT)) AS query_id", "cluster_no")
    out = evaluate.cluster_metrics(ranked, seeds, v.select("cluster_no", "tile_id"), "cluster_no", 10)
    return out.select("query_id", "precision", F.round("recall", 9).alias("recall"), F.round("ndcg", 9).alias("ndcg"))


@query("a24_change_metrics", ["pixels"], f"""WITH {CHANGE}, k AS (SELECT class_a AS p, class_b AS a, count(*) AS n FROM ver GROUP BY ALL), cl AS (SELECT p AS class FROM k UNION SELECT a FROM k),
m AS (SELECT class, coalesce((SELECT sum(n) FROM k WHERE p = class), 0)::BIGINT AS p, coalesce((SELECT sum(n) FROM k WHERE a = class), 0)::BIGINT AS a, coalesce((SELECT sum(n) FROM k WHERE p = class AND a = class), 0)::BIGINT AS tp FROM cl)
SELECT class, tp AS true_positive, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 9) AS precision, round(CASE WHEN a > 0 THEN tp / a ELSE 0 END, 9) AS recall, round(2 * tp / (p + a), 9) AS f1, round(tp / (p + a - tp), 9) AS iou FROM m""")
def a24(spark, d):
    out = evaluate.change_metrics(classified(spark, d), "class_a", "class_b")
    return out.select("class", "true_positive", *[F.round(n, 9).alias(n) for n in ("precision", "recall", "f1", "iou")])


@query("a25_latency_report", ["obs"], """SELECT sensor, count(*) AS runs, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value), 4) AS total FROM obs GROUP BY sensor""")
def a25(spark, d):
    out = evaluate.latency_report(table(spark, d, "obs"), ["sensor"], "value")
    return out.select("sensor", "runs", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("total", 4).alias("total"))


FILE_ROWS = "file_no, 70 + file_no % 7 AS min_lon, 20 + file_no % 5 AS min_lat, 71 + file_no % 9 AS max_lon, 21 + file_no % 4 AS max_lat, CASE WHEN file_no % 2 = 0 THEN 'EPSG:32643' ELSE 'EPSG:4326' END AS crs"


@query("a26_multi_file_scene", ["files"], f"""WITH n AS (SELECT *, {FILE_NAME} AS nm, upper({FILE_NAME}) AS u, {SENSOR_SQL} AS sensor FROM files), m AS (SELECT *, sensor = 'landsat' OR regexp_matches(u, 'LC08|LC09|_SR_B') AS ls FROM n),
b AS (SELECT CAST(floor(file_no / 5) AS BIGINT) AS scene, {BAND_SQL} AS band, {FILE_ROWS} FROM m), g AS (SELECT scene, band, min(file_no) AS no FROM b GROUP BY ALL),
o AS (SELECT scene, string_agg(band, ',' ORDER BY CASE lower(band) WHEN 'blue' THEN 1 WHEN 'green' THEN 2 WHEN 'red' THEN 3 WHEN 'nir' THEN 4 WHEN 'swir' THEN 5 WHEN 'swir2' THEN 6 WHEN 'coastal' THEN 7 WHEN 'qa_mask' THEN 99 ELSE 50 END, no) AS band_order FROM g GROUP BY scene)
SELECT scene, band_order, min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat, arg_min(crs, file_no) AS crs FROM b JOIN o USING (scene) GROUP BY scene, band_order""")
def a26(spark, d):
    files = table(spark, d, "files")
    band = naming.band_of(file_name(), naming.sensor_of(file_name(), [c("platform_tag")]))
    df = files.withColumn("band", band).selectExpr("CAST(floor(file_no / 5) AS BIGINT) AS scene", "band", *FILE_ROWS.split(", "))
    return evaluate.ordered_bands(df, ["scene"], K.BAND_ROLE_PRIORITY).select("scene", F.concat_ws(",", "band_order").alias("band_order"), "min_lon", "min_lat", "max_lon", "max_lat", "crs")


@query("a27_tile_compliance", ["obs"], """SELECT scene_id, count(*) AS total_tiles, count(*) FILTER (WHERE obs_id % 13 <> 0 AND obs_id % 29 <> 0) AS valid_512, CASE WHEN bool_and(obs_id % 13 <> 0 AND obs_id % 29 <> 0) THEN 'PASS' ELSE 'FAIL' END AS status FROM obs GROUP BY scene_id""")
def a27(spark, d):
    df = table(spark, d, "obs").selectExpr("scene_id", "CASE WHEN obs_id % 13 = 0 THEN 500 ELSE 512 END AS height", "512 AS width", "CASE WHEN obs_id % 29 = 0 THEN 1 ELSE 3 END AS bands")
    ok = (c("height") == 512) & (c("width") == 512) & (c("bands") == 3)
    return df.groupBy("scene_id").agg(F.count(F.lit(1)).alias("total_tiles"), F.count_if(ok).alias("valid_512"), F.when(F.bool_and(ok), "PASS").otherwise("FAIL").alias("status"))


@query("t10_review_queue", ["obs"], """SELECT tile_id, round(0.5 * quality_confidence + 0.3 * coalesce(mean_ndvi, 0) + 0.2 * mean_ndbi, 6) AS rank_score FROM obs WHERE obs_id % 3 = 0""")
def t10(spark, d):
    df = table(spark, d, "obs").withColumn("status", F.when(c("obs_id") % 3 == 0, "pending").otherwise("confirmed"))
    queue = evaluate.review_queue(df, {"quality_confidence": 0.5, "mean_ndvi": 0.3, "mean_ndbi": 0.2})
    return queue.select("tile_id", "obs_id", "rank_score").orderBy(c("rank_score").desc(), "obs_id").drop("obs_id")


@query("k06_evidence_export", ["obs"], """SELECT tile_id, scene_id, round(quality_confidence, 4) AS confidence, CASE WHEN obs_id % 4 = 0 THEN 'confirmed' ELSE 'rejected' END AS decision FROM obs WHERE obs_id % 2 = 0""")
def k06(spark, d):
    tiles = table(spark, d, "obs")
    review = tiles.where("obs_id % 2 = 0").select("tile_id", F.when(c("obs_id") % 4 == 0, "confirmed").otherwise("rejected").alias("decision"))
    path = fresh_path(spark, "evidence")
    review.join(tiles, "tile_id").select("tile_id", "scene_id", F.round("quality_confidence", 4).alias("confidence"), "decision").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("tile_id string, scene_id string, confidence double, decision string").csv(path)


# the fitted score is checked for its range and for rising with the decisions it learned from
@query("m06_decision_rerank", ["obs"], "SELECT tile_id, true AS in_range, true AS follows_decisions FROM obs WHERE obs_id % 2 = 1")
def m06(spark, d):
    df = table(spark, d, "obs").withColumn("decision", F.when(c("quality_confidence") + c("mean_ndbi") > 0.5, 1.0).otherwise(0.0))
    out = evaluate.rerank(df.where("obs_id % 2 = 0"), df.where("obs_id % 2 = 1"), ["quality_confidence", "mean_ndbi"], "decision")
    sure = F.abs(c("quality_confidence") + c("mean_ndbi") - 0.5) < 0.05  # near the line either side may win
    return out.select("tile_id", c("rerank_score").between(0.0, 1.0).alias("in_range"), (sure | ((c("rerank_score") > 0.5) == (c("decision") == 1.0))).alias("follows_decisions"))
