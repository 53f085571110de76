"""Column functions over the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..fixtures import table
from ..functions import change, cloud, geo, naming, spectral, text
from .registry import query
from .sqltext import IDX, CLS, idx_columns, land_cover

PIXEL = ["site_id", "prow", "pcol"]
SCENE = ["scene_id", "prow", "pcol"]
c = F.col


@query("x01_spectral_indices", ["pixels"], f"WITH {IDX} SELECT site_id, prow, pcol, ndvi_b, ndwi_b, ndbi_b FROM idx")
def x01(spark, d):
    return spectral.with_indices(table(spark, d, "pixels"), "b").select(*PIXEL, "ndvi_b", "ndwi_b", "ndbi_b")


def _ratio(a, b):
    return f"({a} - {b}) / (CASE WHEN {a} + {b} = 0 THEN 1e-6::DOUBLE ELSE {a} + {b} END)"


@query("x02_archive_indices", ["canvas"], f"""WITH n AS (SELECT *, CASE WHEN prow % 5 = 0 THEN NULL ELSE swir END AS sw FROM canvas)
SELECT scene_id, prow, pcol, {_ratio('nir', 'red')} AS ndvi, {_ratio('green', 'nir')} AS ndwi, {_ratio('sw', 'nir')} AS ndbi FROM n""")
def x02(spark, d):
    df = table(spark, d, "canvas").withColumn("sw", F.expr("CASE WHEN prow % 5 = 0 THEN NULL ELSE swir END"))
    idx = spectral.archive_indices(c("green"), c("red"), c("nir"), c("sw"))
    return df.select(*SCENE, *[e.alias(n) for n, e in idx.items()])


@query("x03_vari", ["clouds"], """SELECT scene_id, prow, pcol, greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
 (green - red) / CASE WHEN green + red - blue = 0 THEN 1e-6::DOUBLE ELSE green + red - blue END)) AS vari FROM clouds""")
def x03(spark, d):
    return table(spark, d, "clouds").select(*SCENE, spectral.vari(c("red"), c("green"), c("blue")).alias("vari"))


@query("x04_reflectance", ["clouds"], """WITH s AS (SELECT *, CASE WHEN scene_id % 2 = 0 THEN red * 80 ELSE red / 100 END AS v FROM clouds),
m AS (SELECT scene_id, max(v) AS top FROM s GROUP BY scene_id)
SELECT scene_id, prow, pcol, greatest(0, least(1.5::DOUBLE, v / 10000)) AS fixed,
 CASE WHEN top > 10 THEN greatest(0, least(1.5::DOUBLE, v / 10000)) ELSE v END AS automatic FROM s JOIN m USING (scene_id)""")
def x04(spark, d):
    df = table(spark, d, "clouds").selectExpr(*SCENE, "CASE WHEN scene_id % 2 = 0 THEN red * 80 ELSE red / 100 END AS v")
    top = df.groupBy("scene_id").agg(F.max("v").alias("top"))
    return df.join(top, "scene_id").select(*SCENE, spectral.reflectance(c("v")).alias("fixed"),
                                           spectral.auto_reflectance(c("v"), c("top")).alias("automatic"))


@query("x05_land_cover", ["pixels"], f"""WITH {IDX}, {CLS}
SELECT site_id, prow, pcol, class_b, class_a, {land_cover('_b', dark=False)} AS display_class FROM cls""")
def x05(spark, d):
    df = spectral.with_indices(spectral.with_indices(table(spark, d, "pixels"), "b"), "a")
    df = spectral.with_land_cover(spectral.with_land_cover(df, "b"), "a")
    return df.select(*PIXEL, "class_b", "class_a",
                     spectral.land_cover(c("ndvi_b"), c("ndwi_b"), c("ndbi_b")).alias("display_class"))


DESC_SQL = """CASE WHEN contains(lower(sensor), 'maxar') THEN 'High-resolution sub-meter reconnaissance imagery (True Color optical). Optimized for detailed tactical object, vehicle, and infrastructure identification'
   || CASE WHEN mean_ndvi IS NOT NULL THEN ' (VARI visible vegetation index: ' || printf('%.2f', mean_ndvi) || ')' ELSE '' END || '.'
 ELSE CASE
  WHEN w >= 0.25 THEN 'Open surface aquatic body or major river channel with high specular water reflectance and minimal terrestrial signature.'
  WHEN w >= 0.05 AND v >= 0.20 THEN 'Riparian wetland or active riverbank corridor exhibiting rich soil moisture and water-tolerant flora.'
  WHEN b >= 0.03 AND v < 0.18 AND w < -0.15 THEN 'High-density paved industrial or transport corridor (e.g. runways, logistics yards, tarmac aprons) with minimal vegetation.'
  WHEN b >= 0.04 AND v < 0.24 THEN 'Dense urban core or heavy commercial development characterized by concrete infrastructure, built structures, and road networks.'
  WHEN b >= 0.01 AND v >= 0.20 AND v < 0.38 THEN 'Mixed suburban landscape combining residential/commercial building clusters with planned green spaces and tree canopy.'
  WHEN v >= 0.40 AND b < -0.05 THEN 'Dense natural woodland or thick forest canopy with high chlorophyll biomass and zero artificial built-up footprint.'
  WHEN v >= 0.26 AND v < 0.40 AND b <= 0.02 THEN 'Cultivated agricultural cropland or active vegetative pasture with prominent chlorophyll activity.'
  WHEN v < 0.16 AND w < -0.20 AND b < 0.03 THEN 'Arid barren land or open cleared terrain with dry bare soil and sparse scrub, suitable for vehicle traversal or development.'
  WHEN v >= 0.16 AND v < 0.26 AND b <= 0.02 THEN 'Semi-arid open scrubland or sparse natural grassland with moderate background soil reflectance.'
  ELSE 'Mixed transition terrain with balanced vegetation, soil, and low-density structural features.' END
  || ' Spectral signature reflects ' || concat_ws(', ',
   CASE WHEN mean_ndvi >= 0.35 THEN 'dense vegetation' WHEN mean_ndvi >= 0.18 THEN 'sparse vegetation' WHEN mean_ndvi IS NOT NULL THEN 'minimal vegetation' END || ' (NDVI ' || printf('%.2f', mean_ndvi) || ')',
   CASE WHEN mean_ndwi >= 0.20 THEN 'prominent water presence' WHEN mean_ndwi >= -0.05 THEN 'moderate moisture' ELSE 'dry surface moisture' END || ' (NDWI ' || printf('%.2f', mean_ndwi) || ')',
   CASE WHEN mean_ndbi >= 0.04 THEN 'high built-up dominance' WHEN mean_ndbi >= 0.0 THEN 'moderate structural reflectance' ELSE 'non-built natural surface' END || ' (NDBI ' || printf('%.2f', mean_ndbi) || ')') || '.' END"""
# index values shifted off the rounding ties of two-decimal text
_SHIFT = "tile_id, sensor, mean_ndvi + CAST(0.0003 AS DOUBLE) AS mean_ndvi, mean_ndwi + CAST(0.0003 AS DOUBLE) AS mean_ndwi, mean_ndbi + CAST(0.0003 AS DOUBLE) AS mean_ndbi"


@query("x13_tile_description", ["obs"], f"""WITH o AS (SELECT {_SHIFT} FROM obs), v AS (SELECT *, coalesce(mean_ndvi, 0) AS v, coalesce(mean_ndwi, -0.2) AS w, coalesce(mean_ndbi, 0) AS b FROM o)
SELECT tile_id, {DESC_SQL} AS description FROM v""")
def x13(spark, d):
    df = table(spark, d, "obs").selectExpr(*_SHIFT.split(", "))
    return df.select("tile_id", text.tile_description(c("mean_ndvi"), c("mean_ndwi"), c("mean_ndbi"), c("sensor")).alias("description"))


LABEL_SQL = """'Cluster ' || (n + 1) || ' — ' || CASE WHEN w >= 0.15 THEN 'Aquatic & Coastal Water' WHEN v >= 0.35 THEN 'Dense Woodland & Forest Canopy'
 WHEN v >= 0.20 THEN 'Vegetative & Agricultural Fields' WHEN b >= 0.03 THEN 'Urban Core & Built-up Infrastructure' WHEN b >= 0 THEN 'Industrial / Tarmac Logistics'
 ELSE 'Open Arid & Transition Terrain' END || ' (' || concat_ws(', ', 'NDVI ' || printf('%.2f', v), 'NDWI ' || printf('%.2f', w), 'NDBI ' || printf('%.2f', b)) || ')'"""


@query("x14_cluster_label", ["obs"], f"""WITH o AS (SELECT {_SHIFT}, obs_id AS n FROM obs), s AS (SELECT tile_id, n, mean_ndvi AS v, mean_ndwi AS w, mean_ndbi AS b FROM o)
SELECT tile_id, {LABEL_SQL} AS label FROM s""")
def x14(spark, d):
    df = table(spark, d, "obs").selectExpr(*_SHIFT.split(", "), "obs_id AS n")
    return df.select("tile_id", text.cluster_label(c("n"), c("mean_ndvi"), c("mean_ndwi"), c("mean_ndbi")).alias("label"))


@query("x15_site_key", ["obs"], """WITH t AS (SELECT tile_id, printf('%.4f', centroid_lat) || '_' || printf('%.4f', centroid_lon) AS k FROM obs)
SELECT tile_id, 'site_' || k || '_' || left(sha256(k), 8) AS site_key FROM t""")
def x15(spark, d):
    return table(spark, d, "obs").select("tile_id", naming.site_key(c("centroid_lat"), c("centroid_lon")).alias("site_key"))


@query("x16_tile_id", ["obs"], """SELECT translate('S2:' || scene_id || '/x', ':/', '__') || '_tile_' || lpad(CAST(obs_id AS VARCHAR), 5, '0') AS new_id FROM obs""")
def x16(spark, d):
    scene = F.concat(F.lit("S2:"), c("scene_id"), F.lit("/x"))
    return table(spark, d, "obs").select(naming.tile_id(scene, c("obs_id")).alias("new_id"))


@query("x17_point_id", ["obs"], """WITH h AS (SELECT tile_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(tile_id)) AS h FROM obs)
SELECT tile_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def x17(spark, d):
    return table(spark, d, "obs").select("tile_id", naming.point_id(c("tile_id")).alias("point_id"))


@query("x18_epoch_seconds", ["obs"], """SELECT tile_id, CASE WHEN obs_id % 9 = 0 THEN 1700000000 ELSE CAST(epoch(date_trunc('second', acquisition_date)) AS BIGINT) END AS seconds FROM obs""")
def x18(spark, d):
    txt = F.when(c("obs_id") % 9 == 0, "no date").otherwise(F.date_format("acquisition_date", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "obs").select("tile_id", naming.epoch_seconds(txt, F.lit(1700000000).cast("bigint")).alias("seconds"))


@query("x19_elapsed", ["obs"], """WITH e AS (SELECT tile_id, CAST(floor((epoch_us(acquisition_date) - epoch_us(TIMESTAMP '2023-03-04 05:06:07')) / 86400000000.0) AS BIGINT) AS elapsed_days FROM obs)
SELECT tile_id, elapsed_days, round_even(elapsed_days / 365.25::DOUBLE, 2)::DOUBLE AS elapsed_years FROM e""")
def x19(spark, d):
    days = naming.elapsed_days(F.to_timestamp_ntz(F.lit("2023-03-04 05:06:07")), c("acquisition_date"))
    return table(spark, d, "obs").select("tile_id", days.alias("elapsed_days")).withColumn(
        "elapsed_years", naming.elapsed_years(c("elapsed_days")))


@query("x20_data_url", ["files"], """WITH f AS (SELECT *, CASE WHEN file_no % 7 = 0 THEN 'C:\\data\\x\\' || path ELSE path END AS p FROM files),
g AS (SELECT *, trim(replace(p, '\\', '/')) AS q, CASE WHEN file_no % 3 = 0 THEN p END AS thumb, CASE WHEN file_no % 3 = 1 THEN p END AS raster FROM f)
SELECT file_no, CASE WHEN contains(q, '/data/') THEN '/data/' || regexp_extract(q, '^.*?/data/(.*)$', 1) WHEN starts_with(q, 'data/') THEN '/' || q
  WHEN starts_with(q, 'app/data/') THEN '/data/' || q[10:] WHEN starts_with(q, '/') THEN q ELSE '/data/' || q END AS url,
 CASE WHEN thumb IS NOT NULL THEN CASE WHEN contains(q, '/data/') THEN '/data/' || regexp_extract(q, '^.*?/data/(.*)$', 1) WHEN starts_with(q, 'data/') THEN '/' || q WHEN starts_with(q, '/') THEN q ELSE '/data/' || q END
  WHEN raster IS NOT NULL THEN CASE WHEN contains(q, '/data/') THEN '/data/' || regexp_extract(replace(q, '.tif', '') || '_preview.jpg', '^.*?/data/(.*)$', 1) ELSE '/data/' || replace(q, '.tif', '') || '_preview.jpg' END
  WHEN file_no % 2 = 0 THEN '/data/tiles/site_' || file_no || '/t' || file_no || '_preview.jpg' ELSE '/data/tiles/t' || file_no || '_preview.jpg' END AS thumbnail FROM g""")
def x20(spark, d):
    df = table(spark, d, "files").withColumn("p", F.when(c("file_no") % 7 == 0, F.concat(F.lit("C:\\data\\x\\"), c("path"))).otherwise(c("path")))
    name = F.concat(F.lit("t"), c("file_no").cast("string"))
    site = F.when(c("file_no") % 2 == 0, F.concat(F.lit("site_"), c("file_no").cast("string")))
    return df.select(
        "file_no", naming.data_url(c("p")).alias("url"),
        naming.thumbnail_url(F.when(c("file_no") % 3 == 0, c("p")), F.when(c("file_no") % 3 == 1, c("p")), site, name).alias("thumbnail"))


@query("x21_date_folder", ["obs"], """SELECT tile_id, CASE WHEN obs_id % 5 = 0 THEN '2000-01-01' WHEN obs_id % 5 = 1 THEN '2024-13-99' ELSE strftime(acquisition_date, '%Y-%m-%d') END AS folder FROM obs""")
def x21(spark, d):
    txt = F.when(c("obs_id") % 5 == 1, "2024:13:99T00").when(c("obs_id") % 5 != 0, F.date_format("acquisition_date", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "obs").select("tile_id", naming.date_folder(txt, F.lit("2000-01-01")).alias("folder"))


FILE_NAME = "string_split(path, '/')[-1]"
SENSOR_SQL = f"""CASE WHEN contains(upper(platform_tag), 'LANDSAT') THEN 'landsat' WHEN contains(upper(platform_tag), 'SENTINEL') THEN 'sentinel2'
 WHEN regexp_matches(upper({FILE_NAME}), '^(LC08|LC09|LO08|LO09|LT05|LE07|LC8|LC9)') THEN 'landsat' WHEN regexp_matches(upper({FILE_NAME}), '_SR_B|_QA_PIXEL|LANDSAT') THEN 'landsat'
 WHEN regexp_matches(upper({FILE_NAME}), '^(S2A|S2B|S2C|SENTINEL)') THEN 'sentinel2' WHEN regexp_matches(upper({FILE_NAME}), 'PLANET|PSB|WORLDVIEW|WV02|WV03|PLEIADES|SPOT|NAIP') THEN 'commercial_highres' ELSE 'generic' END"""


def file_name():
    return F.element_at(F.split("path", "/"), -1)


@query("x22_sensor_of_file", ["files"], f"SELECT file_no, {SENSOR_SQL} AS sensor FROM files")
def x22(spark, d):
    return table(spark, d, "files").select("file_no", naming.sensor_of(file_name(), [c("platform_tag")]).alias("sensor"))


BAND_SQL = """CASE WHEN ls AND regexp_matches(u, '_B0?2\\.') THEN 'blue' WHEN ls AND regexp_matches(u, '_B0?3\\.') THEN 'green' WHEN ls AND regexp_matches(u, '_B0?4\\.') THEN 'red'
 WHEN ls AND regexp_matches(u, '_B0?5\\.') THEN 'nir' WHEN ls AND regexp_matches(u, '_B0?6\\.') THEN 'swir' WHEN ls AND regexp_matches(u, '_B0?7\\.') THEN 'swir2' WHEN ls AND regexp_matches(u, '_B0?1\\.') THEN 'coastal'
 WHEN ls AND regexp_matches(u, 'QA_PIXEL|BQA') THEN 'qa_mask' WHEN regexp_matches(u, '_B0?2|BLUE') THEN 'blue' WHEN regexp_matches(u, '_B0?3|GREEN') THEN 'green' WHEN regexp_matches(u, '_B0?4|RED') THEN 'red'
 WHEN regexp_matches(u, '_B0?8|NIR') THEN 'nir' WHEN regexp_matches(u, '_B11|SWIR') THEN 'swir' WHEN regexp_matches(u, '_B0?5') THEN 'B05' WHEN regexp_matches(u, '_B0?6') THEN 'B06' WHEN regexp_matches(u, '_B0?7') THEN 'B07'
 WHEN contains(u, '_B8A') THEN 'B8A' WHEN contains(u, '_B12') THEN 'B12' WHEN regexp_matches(u, 'SCL|QA|MASK') THEN 'qa_mask' ELSE regexp_replace(nm, '\\.[^.]*$', '') END"""


@query("x23_band_of_file", ["files"], f"""WITH n AS (SELECT file_no, {FILE_NAME} AS nm, upper({FILE_NAME}) AS u, {SENSOR_SQL} AS sensor FROM files),
m AS (SELECT *, sensor = 'landsat' OR regexp_matches(u, 'LC08|LC09|_SR_B') AS ls FROM n) SELECT file_no, {BAND_SQL} AS band FROM m""")
def x23(spark, d):
    sensor = naming.sensor_of(file_name(), [c("platform_tag")])
    return table(spark, d, "files").select("file_no", naming.band_of(file_name(), sensor).alias("band"))


_DESCS = ["B4", "Band 3", "SR_B2", "B08", "near infrared", "B5", "B8A", "red edge 1", "QA_PIXEL", "B10", "custom", "", "SWIR 1", "B12"]
_PICK = "CASE CAST(({x}) AS BIGINT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_DESCS)) + " END"


@query("x24_band_order", ["registry"], f"""WITH r AS (SELECT entry_no, CASE WHEN entry_no % 3 = 0 THEN 'landsat' ELSE 'auto' END AS sensor, entry_no % 15 + 1 AS n, entry_no % 4 <> 0 AS has_text FROM registry),
dsc AS (SELECT entry_no, sensor, n, has_text, i, CASE WHEN has_text THEN {_PICK.format(x='(entry_no + i * 3) % 14')} END AS txt FROM r, unnest(range(1, n + 1)) AS u(i)),
rl AS (SELECT *, lower(trim(txt)) AS lo, regexp_replace(upper(trim(txt)), '^(BAND|SR_B|B)[_\\s]*', 'B') AS tag FROM dsc),
ro AS (SELECT *, CASE WHEN coalesce(txt, '') = '' THEN 'band_' || i WHEN contains(lo, 'red') AND NOT contains(lo, 'edge') THEN 'red' WHEN contains(lo, 'green') THEN 'green' WHEN contains(lo, 'blue') THEN 'blue'
  WHEN regexp_matches(lo, 'nir|near-infrared|near infrared') THEN 'nir' WHEN regexp_matches(lo, 'swir|shortwave') THEN 'swir' WHEN regexp_matches(lo, 'qa|mask') THEN 'mask'
  WHEN sensor = 'landsat' THEN CASE tag WHEN 'B1' THEN 'coastal' WHEN 'B2' THEN 'blue' WHEN 'B3' THEN 'green' WHEN 'B4' THEN 'red' WHEN 'B5' THEN 'nir' WHEN 'B05' THEN 'nir' WHEN 'B8' THEN 'panchromatic' WHEN 'B08' THEN 'panchromatic' WHEN 'B10' THEN 'thermal' WHEN 'B11' THEN 'thermal' ELSE trim(txt) END
  ELSE CASE tag WHEN 'B2' THEN 'blue' WHEN 'B3' THEN 'green' WHEN 'B4' THEN 'red' WHEN 'B8' THEN 'nir' WHEN 'B08' THEN 'nir' WHEN 'B11' THEN 'swir' WHEN 'B12' THEN 'swir' WHEN 'B5' THEN 'B05' WHEN 'B8A' THEN 'B8A' WHEN 'B10' THEN 'B10' ELSE trim(txt) END END AS role FROM rl),
ag AS (SELECT entry_no, any_value(sensor) AS sensor, any_value(n) AS n, bool_or(has_text AND coalesce(txt, '') <> '') AS has_text, string_agg(role, ',' ORDER BY i) AS roles, string_agg('band_' || i, ',' ORDER BY i) AS numbered FROM ro GROUP BY entry_no)
SELECT entry_no, CASE WHEN has_text THEN roles ELSE CASE
  WHEN sensor = 'landsat' AND n = 4 THEN 'blue,green,red,nir' WHEN sensor = 'landsat' AND n = 5 THEN 'blue,green,red,nir,swir' WHEN sensor = 'landsat' AND n = 7 THEN 'coastal,blue,green,red,nir,swir,swir2' WHEN sensor = 'landsat' AND n = 8 THEN 'coastal,blue,green,red,nir,swir,swir2,qa'
  WHEN n = 1 THEN 'grayscale' WHEN n = 3 THEN 'red,green,blue' WHEN n = 4 THEN 'red,green,blue,nir' WHEN n = 5 THEN 'red,green,blue,nir,swir' WHEN n = 6 THEN 'blue,green,red,nir,swir,swir2' WHEN n = 7 THEN 'blue,green,red,nir,swir,swir2,mask'
  WHEN n = 8 THEN 'blue,green,red,nir,swir,swir2,band_7,band_8' WHEN n = 10 THEN 'B01,B02,B04,B05,B08,B8A,B09,B10,B11,B12' WHEN n = 12 THEN 'B01,B02,B03,B04,B05,B06,B07,B08,B8A,B09,B11,B12' WHEN n = 13 THEN 'B01,B02,B03,B04,B05,B06,B07,B08,B8A,B09,B10,B11,B12' ELSE numbered END END AS band_order FROM ag""")
def x24(spark, d):
    df = table(spark, d, "registry").selectExpr(
        "entry_no", "CASE WHEN entry_no % 3 = 0 THEN 'landsat' ELSE 'auto' END AS sensor", "CAST(entry_no % 15 + 1 AS INT) AS n",
        "CASE WHEN entry_no % 4 <> 0 THEN transform(sequence(1, CAST(entry_no % 15 + 1 AS INT)), i -> " + _PICK.format(x="(entry_no + i * 3) % 14") + ") END AS texts")
    return df.select("entry_no", F.concat_ws(",", naming.band_order(c("n"), c("texts"), c("sensor"))).alias("band_order"))


@query("x25_date_and_category", ["files"], f"""WITH n AS (SELECT file_no, lower(path) AS lp, lower({FILE_NAME}) AS nm, regexp_extract({FILE_NAME}, '((20|19)\\d{{2}})(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])') AS digits FROM files)
SELECT file_no, TRY_CAST(CASE WHEN digits <> '' THEN digits[1:4] || '-' || digits[5:6] || '-' || digits[7:8] END AS DATE) AS taken,
 CASE WHEN contains('/' || lp || '/', '/tiles/') OR starts_with(nm, 'tile_') THEN 'FINAL_TILE'
  WHEN contains('/' || lp || '/', '/intermediate/') THEN CASE WHEN contains(nm, 'canvas') THEN 'WORKING_CANVAS' WHEN regexp_matches(nm, 'probability|mask|cloud|shadow|bad') THEN 'QUALITY_LAYER' ELSE 'WORKING_CANVAS' END
  WHEN contains(nm, 'canvas') THEN 'WORKING_CANVAS' WHEN regexp_matches(nm, 'mask|probability') THEN 'QUALITY_LAYER' ELSE 'UNKNOWN' END AS category FROM n""")
def x25(spark, d):
    return table(spark, d, "files").select("file_no", naming.date_in_name(file_name()).alias("taken"), naming.raster_category(c("path")).alias("category"))


_ALIAS_VALUES = ", ".join(f"('{t}', {i}, '{a}')" for t, names in K.BAND_ALIASES.items() for i, a in enumerate(names))


@query("x26_band_alias", ["files"], f"""WITH al(wanted, rank, alias) AS (VALUES {_ALIAS_VALUES}),
bands AS (SELECT file_no, lower(u.b) AS band FROM files, unnest(['B02', CASE WHEN file_no % 2 = 0 THEN 'B5' ELSE 'nir' END, CASE WHEN file_no % 3 = 0 THEN 'swir' ELSE 'B6' END]) AS u(b)),
m AS (SELECT file_no, wanted, band, row_number() OVER (PARTITION BY file_no, wanted ORDER BY CASE WHEN band = wanted THEN -1 ELSE rank END) AS rn FROM bands JOIN al ON al.alias = bands.band)
SELECT file_no, wanted, band FROM m WHERE rn = 1""")
def x26(spark, d):
    from ..operators.catalog import resolve_band_aliases
    df = table(spark, d, "files").selectExpr(
        "file_no", "array('B02', CASE WHEN file_no % 2 = 0 THEN 'B5' ELSE 'nir' END, CASE WHEN file_no % 3 = 0 THEN 'swir' ELSE 'B6' END) AS bands")
    return resolve_band_aliases(df, ["file_no"], "bands").select("file_no", "wanted", "band")


RING_POINTS = [("x1", "y1"), ("x2", "y2"), ("x3", "y3"), ("x4", "y4")]
SHOELACE_SQL = "abs(" + " + ".join(f"({a}*{q} - {b}*{p})" for (a, b), (p, q) in zip(RING_POINTS, RING_POINTS[1:] + RING_POINTS[:1])) + ") / 2"


def area_ring():
    points = [F.array(c(x), c(y)) for x, y in RING_POINTS]
    return F.array(*points, points[0])


@query("x27_polygon_area", ["areas"], f"""WITH s AS (SELECT *, {SHOELACE_SQL} AS a2, cos(radians((least(y1,y2,y3,y4) + greatest(y1,y2,y3,y4)) / 2)) AS k FROM areas)
SELECT aoi_id, round(a2 * 111.132::DOUBLE * (111.320::DOUBLE * k), 6) AS area_km2, round(a2 * 111320 * (111320 * k), 1) AS area_m2 FROM s""")
def x27(spark, d):
    ring = area_ring()
    bounds = geo.ring_bounds(ring)
    return table(spark, d, "areas").select(
        "aoi_id", F.round(geo.area_km2(geo.shoelace(ring), bounds[1], bounds[3]), 6).alias("area_km2"),
        F.round(geo.area_m2(geo.shoelace(ring), bounds[1], bounds[3]), 1).alias("area_m2"))


@query("x28_buffered_box", ["areas"], """WITH b AS (SELECT aoi_id, least(x1,x2,x3,x4) AS x0, least(y1,y2,y3,y4) AS y0, greatest(x1,x2,x3,x4) AS xe, greatest(y1,y2,y3,y4) AS ye FROM areas)
SELECT aoi_id, greatest(-180, x0 - (xe - x0) * 0.05::DOUBLE) AS min_lon, greatest(-90, y0 - (ye - y0) * 0.05::DOUBLE) AS min_lat, least(180, xe + (xe - x0) * 0.05::DOUBLE) AS max_lon, least(90, ye + (ye - y0) * 0.05::DOUBLE) AS max_lat FROM b""")
def x28(spark, d):
    box = geo.buffered_box(geo.ring_bounds(area_ring()), 0.05)
    return table(spark, d, "areas").select("aoi_id", *[e.alias(n) for e, n in zip(box, ("min_lon", "min_lat", "max_lon", "max_lat"))])


@query("x29_web_tiles", ["obs"], """WITH s AS (SELECT tile_id, centroid_lat AS la, centroid_lon AS lo, (obs_id % 100) / 1000.0::DOUBLE AS span FROM obs),
z AS (SELECT *, CASE WHEN span <= 0.025 THEN 18 WHEN span <= 0.07 THEN 17 ELSE 16 END AS zoom FROM s),
t AS (SELECT *, CAST(floor((lo + 180) / 360 * pow(2, zoom)) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(la))) / pi()) / 2 * pow(2, zoom)) AS BIGINT) AS y FROM z)
SELECT tile_id, zoom, x, y, round(degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, zoom))))), 8) AS corner_lat, round(x / pow(2, zoom) * 360 - 180, 8) AS corner_lon FROM t""")
def x29(spark, d):
    df = table(spark, d, "obs").withColumn("zoom", geo.zoom_for_span((c("obs_id") % 100) / 1000.0))
    x, y = geo.web_tile(c("centroid_lat"), c("centroid_lon"), c("zoom"))
    df = df.select("tile_id", "zoom", x.alias("x"), y.alias("y"))
    lat, lon = geo.web_tile_corner(c("x"), c("y"), c("zoom"))
    return df.withColumns({"corner_lat": F.round(lat, 8), "corner_lon": F.round(lon, 8)})


CLIP = lambda e, lo="0", hi="1": f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {e}))"
PROB_SQL = (f"0.40::DOUBLE * {CLIP('(vm - 1500) / 4500')} + 0.25::DOUBLE * {CLIP('1 - ((abs(red - vm) + abs(green - vm) + abs(blue - vm)) / (vm + 1e-5)) / 0.35')}"
            f" + 0.20::DOUBLE * {CLIP('(nir - 1200) / 4000')} + 0.15::DOUBLE * {CLIP('1 - swir / (vm + 1e-5)')}")


# a band that some pixels lack, and the values that stand in for it
LACKING = {"green": "noise % 4 = 1", "nir": "noise % 5 = 2", "swir": "noise % 3 = 0"}
STAND_IN = {"green": "(blue + red) / 2", "nir": "red", "swir": "red * 0.5"}
BANDS_SQL = ", ".join(f"CASE WHEN {LACKING[b]} THEN {STAND_IN[b]} ELSE {b} END AS {b}" for b in LACKING)
SCORED_SQL = f"""v AS (SELECT *, (blue + green + red) / 3 AS vm FROM (SELECT scene_id, prow, pcol, noise, blue, red, {BANDS_SQL} FROM canvas)),
p AS (SELECT *, CASE WHEN NOT isnan(red) AND red > 0 THEN {CLIP(PROB_SQL)} END AS prob FROM v)"""


def with_gaps(df):
    """The canvas with NULL where a band is lacking."""
    return df.withColumns({b: F.when(~F.expr(cond), c(b)) for b, cond in LACKING.items()})


@query("x30_cloud_probability", ["canvas"], f"WITH {SCORED_SQL} SELECT scene_id, prow, pcol, round(prob, 9) AS prob, coalesce(round(prob, 9) >= 0.40, false) AS cloud FROM p")
def x30(spark, d):
    prob = cloud.cloud_probability(*[c(b) for b in ("blue", "green", "red", "nir", "swir")])
    df = with_gaps(table(spark, d, "canvas")).select(*SCENE, F.round(prob, 9).alias("prob"))
    return df.withColumn("cloud", F.coalesce(c("prob") >= K.CLOUD_THRESHOLD, F.lit(False)))


@query("x31_contrast_stretch", ["clouds"], """SELECT scene_id, prow, pcol, CAST(floor(greatest(0, least(1, (red - 20) / (200 - 20)::DOUBLE)) * 255) AS BIGINT) AS linear,
 CAST(floor(pow(greatest(0, least(1, (red - 20) / (200 - 20)::DOUBLE)), 0.8) * 255) AS BIGINT) AS toned FROM clouds""")
def x31(spark, d):
    low, high = F.lit(20.0), F.lit(200.0)
    return table(spark, d, "clouds").select(*SCENE, cloud.stretch(c("red"), low, high).alias("linear"),
                                            cloud.stretch(c("red"), low, high, 0.8).alias("toned"))


REGION_SQL = "CASE WHEN prob >= 0.70 THEN 3 WHEN prob >= 0.45 THEN 2 WHEN prob >= 0.20 OR cloud THEN 1 ELSE 0 END"


@query("x32_cloud_region", ["clouds"], f"""SELECT scene_id, prow, pcol, CASE WHEN noise = 3 THEN 4 ELSE {REGION_SQL} END AS region FROM clouds""")
def x32(spark, d):
    return table(spark, d, "clouds").select(*SCENE, cloud.cloud_region(c("prob"), c("cloud"), c("noise") == 3).alias("region"))


@query("x33_opacity", ["clouds"], """WITH t AS (SELECT *, CASE noise % 3 WHEN 0 THEN 0 WHEN 1 THEN 128 ELSE 255 END AS trimap FROM clouds)
SELECT scene_id, prow, pcol, trimap, round(CASE trimap WHEN 255 THEN 1 WHEN 128 THEN 0.05 + 0.9 * (0.5 * (1 - cos(pi() * greatest(0, least(1, (prob - 0.20) / 0.5))))) ELSE 0 END, 9) AS alpha FROM t""")
def x33(spark, d):
    df = table(spark, d, "clouds").withColumn("trimap", F.expr("CASE noise % 3 WHEN 0 THEN 0 WHEN 1 THEN 128 ELSE 255 END"))
    return df.select(*SCENE, "trimap", F.round(cloud.opacity(c("prob"), c("trimap")), 9).alias("alpha"))


@query("x34_unmix", ["clouds"], """SELECT scene_id, prow, pcol, round(greatest(0, least(255, (red - prob * 235) / greatest(0.10, least(1, 1 - prob + 0.05)))), 6) AS surface FROM clouds""")
def x34(spark, d):
    return table(spark, d, "clouds").select(*SCENE, F.round(cloud.unmix(c("red"), c("prob"), F.lit(235.0)), 6).alias("surface"))


@query("x35_provenance", ["clouds"], """WITH f AS (SELECT *, prob < 0.2 AS clear, prob >= 0.2 AND prob < 0.7 AS thin, prob >= 0.7 AND noise % 2 = 0 AS rec, prob >= 0.7 AND noise % 4 = 0 AS unres, noise = 11 AS nd FROM clouds)
SELECT scene_id, prow, pcol, CASE WHEN nd THEN 4 WHEN unres THEN 3 WHEN rec THEN 2 WHEN thin THEN 1 WHEN clear THEN 0 ELSE 3 END AS provenance FROM f""")
def x35(spark, d):
    p, n = c("prob"), c("noise")
    code = cloud.provenance(p < 0.2, (p >= 0.2) & (p < 0.7), (p >= 0.7) & (n % 2 == 0), (p >= 0.7) & (n % 4 == 0), n == 11)
    return table(spark, d, "clouds").select(*SCENE, code.alias("provenance"))


_BOXTYPE = "CASE noise % 8 WHEN 0 THEN 'Road Development' WHEN 1 THEN 'Clearance' WHEN 2 THEN 'Water-Extent Variation (shrinkage)' WHEN 3 THEN 'Water-Extent Variation (expansion)' WHEN 4 THEN 'Demolition / Reversion' WHEN 5 THEN 'Vegetation Shift (Large Scale)' WHEN 6 THEN 'Unclassified Structural Change' ELSE 'Construction' END"
_BOXLBL = "CASE noise % 5 WHEN 0 THEN 'Vegetation → Ground' WHEN 1 THEN 'Water → Land (Shrinkage)' WHEN 2 THEN 'Built-up → Ground' ELSE 'Ground → Built-up' END"


@query("x36_box_style", ["pixels"], f"""WITH b AS (SELECT site_id, prow, pcol, {_BOXTYPE} AS ct, {_BOXLBL} AS tl FROM pixels)
SELECT site_id, prow, pcol, round_even(pcol / 32 * 100, 2)::DOUBLE AS x, round_even(greatest(prow - pcol, 4) / 32 * 100, 2)::DOUBLE AS w,
 CASE WHEN contains(ct, 'Road') OR contains(tl, 'Road') THEN '#a855f7' WHEN contains(ct, 'Clearance') OR (contains(tl, 'Ground') AND NOT contains(tl, 'Built-up')) THEN '#fde047'
  WHEN contains(ct, 'Water') OR contains(tl, 'Water') THEN '#38bdf8' WHEN contains(ct, 'Demolition') THEN '#fb923c' WHEN contains(ct, 'Shift') THEN '#10b981' WHEN contains(ct, 'Unclassified') THEN '#6366f1' ELSE '#ef4444' END AS color,
 CASE WHEN contains(ct, 'Road') OR contains(tl, 'Road') THEN 'Vegetation → Road' WHEN contains(ct, 'Clearance') OR (contains(tl, 'Ground') AND NOT contains(tl, 'Built-up')) THEN 'Vegetation → Ground'
  WHEN contains(ct, 'Water') OR contains(tl, 'Water') THEN CASE WHEN contains(tl, 'Shrink') THEN 'Water → Land' ELSE 'Land → Water' END WHEN contains(ct, 'Demolition') THEN 'Built-up → Ground' WHEN contains(ct, 'Shift') THEN 'Vegetation Shift' WHEN contains(ct, 'Unclassified') THEN 'Unclassified' ELSE 'Vegetation → Built-up' END AS short_type FROM b""")
def x36(spark, d):
    df = table(spark, d, "pixels").selectExpr(*PIXEL, f"{_BOXTYPE} AS ct", f"{_BOXLBL} AS tl")
    x, w = change.box_percent(c("pcol"), c("prow"), F.lit(32))
    style = change.box_style(c("ct"), c("tl"))
    return df.select(*PIXEL, x.alias("x"), w.alias("w"), *[e.alias(n) for n, e in style.items()])


@query("x39_rgb_selection", ["clouds"], """SELECT scene_id, prow, pcol, CASE WHEN noise % 5 = 0 THEN blue WHEN noise % 3 = 0 THEN red_later ELSE red END AS r,
 CASE WHEN noise % 5 = 0 THEN red WHEN noise % 3 = 0 THEN green_later ELSE green END AS g, CASE WHEN noise % 5 = 0 THEN green WHEN noise % 3 = 0 THEN blue_later ELSE blue END AS b,
 red AS grey, green AS second FROM clouds""")
def x39(spark, d):
    n = c("noise")
    visual = [F.when(n % 5 == 0, c(b)) for b in ("blue", "red", "green")]
    named = {b: F.when(n % 3 == 0, c(f"{b}_later")) for b in ("red", "green", "blue")}
    r, g, b = spectral.rgb_selection(visual, named, [c("red"), c("green"), c("blue")])
    grey = spectral.rgb_selection(None, {}, [c("red")])[1]
    second = spectral.rgb_selection(None, {}, [c("red"), c("green")])[1]
    return table(spark, d, "clouds").select(*SCENE, r.alias("r"), g.alias("g"), b.alias("b"), grey.alias("grey"), second.alias("second"))


@query("x40_role_resolution", ["clouds"], """WITH b AS (SELECT *, CASE WHEN noise % 2 = 0 THEN red END AS b04, CASE WHEN noise % 3 = 0 THEN green END AS b05, CASE WHEN noise % 4 = 0 THEN blue END AS b11, CASE WHEN noise % 5 = 0 THEN blue_later END AS b02, CASE WHEN noise % 7 = 0 THEN red_later END AS b08 FROM clouds)
SELECT scene_id, prow, pcol, coalesce(b08, green_later) AS nir, coalesce(b11, b08, green_later) AS swir, coalesce(b04, b05, blue) AS red_out, coalesce(b02, red) AS blue_out, green AS green_out FROM b""")
def x40(spark, d):
    df = table(spark, d, "clouds").selectExpr(
        "*", "CASE WHEN noise % 2 = 0 THEN red END AS b04", "CASE WHEN noise % 3 = 0 THEN green END AS b05",
        "CASE WHEN noise % 4 = 0 THEN blue END AS b11", "CASE WHEN noise % 5 = 0 THEN blue_later END AS b02", "CASE WHEN noise % 7 = 0 THEN red_later END AS b08")
    named = {n.upper(): c(n) for n in ("b04", "b05", "b11", "b02", "b08")}
    roles = spectral.resolve_roles(4, named, [c("red"), c("green"), c("blue"), c("green_later")])
    return df.select(*SCENE, roles["nir"].alias("nir"), roles["swir"].alias("swir"), roles["red"].alias("red_out"),
                     roles["blue"].alias("blue_out"), roles["green"].alias("green_out"))


@query("x41_range_normalisation", ["clouds"], """WITH s AS (SELECT *, prob * CASE scene_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 255 END AS p FROM clouds),
m AS (SELECT scene_id, max(p) AS top, min(red) AS lo, max(red) AS hi FROM s GROUP BY scene_id)
SELECT scene_id, prow, pcol, round(greatest(0, least(1, CASE WHEN top <= 1 THEN p WHEN top <= 100 THEN p / 100 ELSE p / 255 END)), 9) AS prob,
 CASE WHEN hi > lo THEN CAST(floor(greatest(0, least(255, (red - lo) / (hi - lo) * 255))) AS BIGINT) ELSE 0 END AS red_byte FROM s JOIN m USING (scene_id)""")
def x41(spark, d):
    df = table(spark, d, "clouds").withColumn("p", F.expr("prob * CASE scene_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 255 END"))
    stats = df.groupBy("scene_id").agg(F.max("p").alias("top"), F.min("red").alias("lo"), F.max("red").alias("hi"))
    return df.join(stats, "scene_id").select(
        *SCENE, F.round(cloud.unit_probability(c("p"), c("top")), 9).alias("prob"),
        cloud.byte_range(c("red"), c("lo"), c("hi")).cast("bigint").alias("red_byte"))
