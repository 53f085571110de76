"""Aggregates over pixels and observations, and site timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..fixtures import table
from ..functions import cloud
from ..operators import catalog, pairs, raster, timeline
from ..operators.ranges import in_chunks
from .registry import ORACLES, query, recursive
from .scalar_plans import REGION_SQL
from .sqltext import CHANGE
from .change_plans import WATER_SQL, classified
from .region_plans import EPOCH_PAIRS, SITE_FEATURES, epoch_pairs, features_of

c = F.col
BANDS = ["blue", "green", "red", "nir", "swir"]
R = lambda a, b: f"(({a}) - ({b})) / (CASE WHEN {a} + {b} = 0 THEN 1e-6::DOUBLE ELSE {a} + {b} END)"
SENT = " OR ".join(f"{b} = -9999 OR {b} < -9000 OR isnan({b}) OR isinf({b})" for b in BANDS)
ZERO = " AND ".join(f"{b} = 0" for b in BANDS)
LOOSE = " OR ".join(f"isnan({b}) OR {b} < -9000" for b in BANDS)
TILED = "scene_id, CAST(floor(prow / 4) AS BIGINT) AS trow, CAST(floor(pcol / 4) AS BIGINT) AS tcol"


def _stat(fn, b, digits=2):
    parts = []
    for mode in ("valid", "loose", "true"):
        parts.append(f"round_even({fn}({b}) FILTER (WHERE {mode} AND NOT isnan({b}) AND {b} > -9000), {digits})")
    return f"coalesce(CASE WHEN count(*) FILTER (WHERE valid) > 0 THEN {parts[0]} WHEN count(*) FILTER (WHERE loose) > 0 THEN {parts[1]} ELSE {parts[2]} END, 0)::DOUBLE"


def _mean(n):
    return (f"CASE WHEN count(*) FILTER (WHERE valid) > 0 THEN avg({n}) FILTER (WHERE valid) WHEN count(*) FILTER (WHERE loose) > 0 "
            f"THEN avg({n}) FILTER (WHERE loose) ELSE avg({n}) END")


@query("a01_tile_summary", ["canvas"], f"""WITH t AS (SELECT {TILED}, {', '.join(BANDS)}, bad OR (floor(prow / 4) + floor(pcol / 4)) % 5 = 0 AS bad,
 {R('nir', 'red')} AS ndvi, {R('green', 'nir')} AS ndwi, {R('swir', 'nir')} AS ndbi FROM canvas),
f AS (SELECT *, NOT (bad OR ({SENT}) OR ({ZERO})) AS valid, NOT ({LOOSE}) AS loose FROM t)
SELECT scene_id, trow, tcol, round_even(avg(bad::INT::DOUBLE), 4)::DOUBLE AS cloud_pct, round_even(1 - avg(bad::INT::DOUBLE), 4)::DOUBLE AS quality_confidence,
 {', '.join(f'round({_mean(n)}, 9) AS mean_{n}' for n in ('ndvi', 'ndwi', 'ndbi'))}, {', '.join(f'{_stat(s if s != "mean" else "avg", b)} AS {b}_{s}' for b in BANDS for s in ('min', 'max', 'mean'))}
FROM f GROUP BY scene_id, trow, tcol""")
def a01(spark, d):
    df = table(spark, d, "canvas").selectExpr(*TILED.split(", ", 1)[:1], "CAST(floor(prow / 4) AS BIGINT) AS trow", "CAST(floor(pcol / 4) AS BIGINT) AS tcol",
                                              *BANDS, "bad OR (floor(prow / 4) + floor(pcol / 4)) % 5 = 0 AS bad")
    out = raster.tile_summary(df, ["scene_id", "trow", "tcol"], BANDS)
    return out.withColumns({f"mean_{n}": F.round(f"mean_{n}", 9) for n in ("ndvi", "ndwi", "ndbi")})


@query("a02_canvas_quality", ["canvas"], """WITH q AS (SELECT scene_id, round_even(avg(bad::INT::DOUBLE), 4)::DOUBLE AS cloud_fraction FROM canvas GROUP BY scene_id)
SELECT *, round_even(1 - cloud_fraction, 4)::DOUBLE AS valid_fraction FROM q""")
def a02(spark, d):
    return raster.canvas_quality(table(spark, d, "canvas"), ["scene_id"], c("bad"))


@query("a03_band_statistics", ["canvas"], f"""WITH u AS (UNPIVOT canvas ON {', '.join(BANDS)} INTO NAME band VALUE v),
g AS (SELECT scene_id, band, isnan(v) OR isinf(v) OR v = -9999 AS nd, v FROM u),
o AS (SELECT scene_id, round_even(avg(({' OR '.join(f'isnan({b}) OR isinf({b}) OR {b} = -9999' for b in BANDS)})::INT) * 100, 4)::DOUBLE AS overall_nodata_pct FROM canvas GROUP BY scene_id)
SELECT scene_id, overall_nodata_pct, band, count(*) FILTER (WHERE NOT nd) AS valid_pixels, count(*) FILTER (WHERE nd) AS nodata_pixels,
 round_even(min(v) FILTER (WHERE NOT nd), 4)::DOUBLE AS min, round_even(max(v) FILTER (WHERE NOT nd), 4)::DOUBLE AS max, round_even(avg(v) FILTER (WHERE NOT nd), 4)::DOUBLE AS mean,
 round_even(stddev_pop(v) FILTER (WHERE NOT nd), 4)::DOUBLE AS std, round_even(quantile_cont(v, 0.01) FILTER (WHERE NOT nd), 4)::DOUBLE AS p1,
 round_even(quantile_cont(v, 0.5) FILTER (WHERE NOT nd), 4)::DOUBLE AS p50, round_even(quantile_cont(v, 0.99) FILTER (WHERE NOT nd), 4)::DOUBLE AS p99
FROM g JOIN o USING (scene_id) GROUP BY scene_id, overall_nodata_pct, band""")
def a03(spark, d):
    return raster.band_statistics(table(spark, d, "canvas"), ["scene_id"], BANDS, -9999.0, exact=True)


# the sketch's quantiles of several scenes together, by their ranks among all values
@query("a03_sketch_error", ["canvas"], f"""WITH u AS (UNPIVOT (SELECT * REPLACE (scene_id % 3 AS scene_id) FROM canvas) ON {', '.join(BANDS)} INTO NAME band VALUE v)
SELECT scene_id, band, count(*) AS valid_pixels, true AS within FROM u WHERE NOT (isnan(v) OR v = -9999) GROUP BY ALL""")
def a03_sketch(spark, d):
    df = table(spark, d, "canvas").withColumn("scene_id", c("scene_id") % 3)
    found = raster.band_statistics(df, ["scene_id"], BANDS, -9999.0)
    values = df.select("scene_id", F.inline(F.array(*[F.struct(F.lit(b).alias("band"), c(b).alias("v")) for b in BANDS]))).where("NOT isnan(v) AND v <> -9999")
    both = values.join(found.select("scene_id", "band", "p1", "p50", "p99"), ["scene_id", "band"])  # a few rows beside all values
    close = F.lit(True)
    for p, share in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99)):
        below, upto = F.avg((c("v") < c(p) - 1e-4).cast("double")), F.avg((c("v") <= c(p) + 1e-4).cast("double"))
        close = close & (below - 0.005 <= share) & (share <= upto + 0.005)
    return both.groupBy("scene_id", "band").agg(F.count(F.lit(1)).alias("valid_pixels"), close.alias("within"))


@query("a04_mask_statistics", ["canvas"], """SELECT scene_id, count(*) FILTER (WHERE bad) AS masked, count(*) FILTER (WHERE NOT bad) AS clear_ground,
 round_even(count(*) FILTER (WHERE bad) / count(*) * 100, 4)::DOUBLE AS masked_pct FROM canvas GROUP BY scene_id""")
def a04(spark, d):
    return raster.mask_statistics(table(spark, d, "canvas"), ["scene_id"], c("bad"))


@query("a05_site_grid", ["obs"], """SELECT site_key, centroid_lat, centroid_lon, count(*) AS observation_count, min(acquisition_date) AS earliest_date, max(acquisition_date) AS latest_date,
 string_agg(DISTINCT CAST(year(acquisition_date) AS VARCHAR), ',' ORDER BY CAST(year(acquisition_date) AS VARCHAR)) AS available_years, count(*) >= 2 AS multi_temporal FROM obs GROUP BY site_key, centroid_lat, centroid_lon""")
def a05(spark, d):
    return table(spark, d, "obs").groupBy("site_key", "centroid_lat", "centroid_lon").agg(
        F.count(F.lit(1)).alias("observation_count"), F.min("acquisition_date").alias("earliest_date"), F.max("acquisition_date").alias("latest_date"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.year("acquisition_date").cast("string")))).alias("available_years"),
        (F.count(F.lit(1)) >= 2).alias("multi_temporal"))


@query("a06_archive_totals", ["obs"], """WITH cov AS (SELECT region_id, count(*) AS tile_count, CASE WHEN count(*) % 3 = 0 THEN 'pending' ELSE 'done' END AS status, max(acquisition_date) AS last_updated FROM obs GROUP BY region_id)
SELECT region_id, tile_count, status, last_updated, (SELECT count(*) FROM obs) AS total_tiles, (SELECT count(DISTINCT scene_id) FROM obs) AS total_scenes, (SELECT count(*) FROM cov WHERE status = 'done') AS total_regions FROM cov""")
def a06(spark, d):
    tiles = table(spark, d, "obs")
    regions = tiles.groupBy("region_id").agg(F.count(F.lit(1)).alias("tile_count"), F.max("acquisition_date").alias("last_updated")).withColumn(
        "status", F.when(c("tile_count") % 3 == 0, "pending").otherwise("done"))
    totals = tiles.agg(F.count(F.lit(1)).alias("n")).scalar()
    scenes = tiles.agg(F.count_distinct("scene_id").alias("n")).scalar()
    done = regions.agg(F.count_if(c("status") == "done").alias("n")).scalar()
    return regions.select("region_id", "tile_count", "status", "last_updated", totals.alias("total_tiles"), scenes.alias("total_scenes"), done.alias("total_regions"))


@query("a07_cut_points", ["canvas"], f"""WITH m AS (SELECT *, bad OR scene_id % 4 = 1 AS b2 FROM canvas), u AS (UNPIVOT m ON {', '.join(BANDS)} INTO NAME band VALUE v),
g AS (SELECT scene_id, band, avg((NOT b2)::INT) AS valid, quantile_cont(v, [0.02, 0.98]) FILTER (WHERE NOT b2 AND NOT isnan(v)) AS pv, quantile_cont(v, [0.02, 0.98]) FILTER (WHERE NOT isnan(v)) AS pa FROM u GROUP BY scene_id, band),
s AS (SELECT scene_id, band, CASE WHEN valid < 0.02 THEN pa ELSE pv END AS p FROM g)
SELECT scene_id, band, round(p[1], 6) AS vmin, round(CASE WHEN p[2] <= p[1] THEN p[1] + CASE WHEN p[1] > 1.5 THEN 1 ELSE 0.01 END ELSE p[2] END, 6) AS vmax FROM s""")
def a07(spark, d):
    df = table(spark, d, "canvas").withColumn("b2", F.expr("bad OR scene_id % 4 = 1"))
    return raster.cut_points(df, ["scene_id"], BANDS, "b2", exact=True).select("scene_id", "band", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


REGION_NAMES = {"clear_pct": 0, "thin_pct": 1, "uncertain_pct": 2, "thick_pct": 3, "nodata_pct": 4}
PROV_NAMES = {"observed_pct": 0, "corrected_pct": 1, "reconstructed_pct": 2, "unresolved_pct": 3}


@query("a15_cloud_shares", ["clouds"], f"""WITH r AS (SELECT scene_id, CASE WHEN noise = 3 THEN 4 ELSE {REGION_SQL} END AS region FROM clouds)
SELECT scene_id, count(*) AS total_pixels, {', '.join(f"round_even(count(*) FILTER (WHERE region = {v}) / count(*) * 100, 2)::DOUBLE AS {n}" for n, v in REGION_NAMES.items())},
 round_even(count(*) FILTER (WHERE region IN (1, 2)) / count(*) * 100, 2)::DOUBLE AS corrected_pct FROM r GROUP BY scene_id""")
def a15(spark, d):
    df = table(spark, d, "clouds").select("scene_id", cloud.cloud_region(c("prob"), c("cloud"), c("noise") == 3).alias("region"))
    df = df.withColumn("prov", F.when(c("region").isin(1, 2), 1).otherwise(0))
    shares = raster.code_shares(df, ["scene_id"], c("region"), REGION_NAMES)
    return shares.join(raster.code_shares(df, ["scene_id"], c("prov"), {"corrected_pct": 1}).drop("total_pixels"), "scene_id")


@query("a16_cloud_radiance", ["clouds"], """SELECT scene_id, round(coalesce(quantile_cont(red, 0.9) FILTER (WHERE prob >= 0.97 AND scene_id % 2 = 0), 235), 6) AS red_cloud, round(coalesce(quantile_cont(green, 0.9) FILTER (WHERE prob >= 0.97 AND scene_id % 2 = 0), 235), 6) AS green_cloud,
 round(coalesce(quantile_cont(blue, 0.9) FILTER (WHERE prob >= 0.97 AND scene_id % 2 = 0), 245), 6) AS blue_cloud FROM clouds GROUP BY scene_id""")
def a16(spark, d):
    df = raster.cloud_radiance(table(spark, d, "clouds"), ["scene_id"], (c("prob") >= 0.97) & (c("scene_id") % 2 == 0), exact=True)
    return df.withColumns({f"{b}_cloud": F.round(f"{b}_cloud", 6) for b in ("red", "green", "blue")})


@query("a17_preservation", ["clouds"], """WITH x AS (SELECT scene_id, prob < 0.2 AS clear, [abs(red_later - red), abs(green_later - green), abs(blue_later - blue)] AS ds FROM (SELECT * REPLACE (CASE WHEN scene_id % 3 = 0 THEN red ELSE red_later END AS red_later,
  CASE WHEN scene_id % 3 = 0 THEN green ELSE green_later END AS green_later, CASE WHEN scene_id % 3 = 0 THEN blue ELSE blue_later END AS blue_later) FROM clouds) t), e AS (SELECT scene_id, clear, unnest(ds) AS dd FROM x)
SELECT scene_id, count(*) FILTER (WHERE clear) // 3 AS clear_pixel_count, coalesce(round_even(avg(dd) FILTER (WHERE clear), 6), 0)::DOUBLE AS mae, coalesce(round_even(sqrt(avg(dd * dd) FILTER (WHERE clear)), 6), 0)::DOUBLE AS rmse,
 coalesce(round_even(max(dd) FILTER (WHERE clear), 6), 0)::DOUBLE AS max_difference, coalesce(round_even(count(*) FILTER (WHERE clear AND dd > 1e-4) / count(*) FILTER (WHERE clear) * 100, 4), 0)::DOUBLE AS modified_pct,
 CASE WHEN count(*) FILTER (WHERE clear) = 0 THEN 'PASS (No clear pixels to evaluate)' WHEN max(dd) FILTER (WHERE clear) <= 1e-4 THEN 'PASS' ELSE 'FAIL' END AS status FROM e GROUP BY scene_id""")
def a17(spark, d):
    df = table(spark, d, "clouds")
    df = df.withColumns({f"{b}_later": F.when(c("scene_id") % 3 == 0, c(b)).otherwise(c(f"{b}_later")) for b in ("red", "green", "blue")})
    return raster.preservation(df, ["scene_id"], c("prob") < 0.2, [(b, f"{b}_later") for b in ("red", "green", "blue")])


@query("a18_cloud_metrics", ["clouds", "items"], """WITH px AS (SELECT scene_id, round_even(avg(cloud::INT::DOUBLE) * 100, 2)::DOUBLE AS area_cloud_pct, round_even(avg((cloud OR noise < 5)::INT::DOUBLE) * 100, 2)::DOUBLE AS area_bad_pct FROM clouds GROUP BY scene_id),
t AS (SELECT scene_id, floor(prow / 8) * 4 + floor(pcol / 8) AS tile, round_even(avg(cloud::INT::DOUBLE) * 100, 2)::DOUBLE AS p FROM clouds GROUP BY ALL), tn AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY scene_id ORDER BY tile) - 1) / 10000) AS BIGINT) AS part FROM t),
tl AS (SELECT scene_id, part, string_agg(CAST(p AS VARCHAR), ',' ORDER BY tile) AS tile_cloud_pct FROM tn GROUP BY scene_id, part)
SELECT scene_id, part, round_even(cloud_cover, 2)::DOUBLE AS catalogue_cloud_pct, area_cloud_pct, area_bad_pct, tile_cloud_pct FROM px JOIN tl USING (scene_id) JOIN items ON item_no = scene_id""")
def a18(spark, d):
    px = table(spark, d, "clouds")
    pct = lambda e: F.bround(F.avg(e.cast("double")) * 100.0, 2)
    area = px.groupBy("scene_id").agg(pct(c("cloud")).alias("area_cloud_pct"), pct(c("cloud") | (c("noise") < 5)).alias("area_bad_pct"))
    tiles = px.groupBy("scene_id", F.expr("floor(prow / 8) * 4 + floor(pcol / 8)").alias("tile")).agg(pct(c("cloud")).alias("p"))
    listed = in_chunks(tiles, ["scene_id"], c("p"), c("tile"), "pcts")
    scenes = table(spark, d, "items").select(c("item_no").alias("scene_id"), F.bround("cloud_cover", 2).alias("catalogue_cloud_pct"))
    return area.join(listed, "scene_id").join(scenes, "scene_id").select(
        "scene_id", "part", "catalogue_cloud_pct", "area_cloud_pct", "area_bad_pct", F.concat_ws(",", F.transform("pcts", lambda x: x.cast("string"))).alias("tile_cloud_pct"))


@query("a13_water_envelope", ["pixels"], f"""WITH {CHANGE}, {WATER_SQL},
e AS (SELECT site_id, wx.is_extension_proven AS grown, count(*) AS n, min(prow) AS r0, max(prow) AS r1, min(pcol) AS c0, max(pcol) AS c1 FROM w JOIN wx USING (site_id)
 WHERE CASE WHEN is_extension_proven THEN NOT wb AND wa WHEN is_shrinkage_proven THEN wb AND NOT wa ELSE false END GROUP BY site_id, wx.is_extension_proven HAVING count(*) >= 25)
SELECT site_id, CASE WHEN grown THEN 'Water-Extent Variation (expansion)' ELSE 'Water-Extent Variation (shrinkage)' END AS change_type, round_even(n * 100.0, 1)::DOUBLE AS area_m2,
 round_even(c0 / 32 * 100, 2)::DOUBLE AS x, round_even(r0 / 32 * 100, 2)::DOUBLE AS y,
 round_even(CASE WHEN grown THEN greatest(4, c1 - c0) / 32 * 100 ELSE least(100 - c0 / 32 * 100, greatest(6, c1 - c0) / 32 * 100) END, 2)::DOUBLE AS w,
 round_even(CASE WHEN grown THEN greatest(4, r1 - r0) / 32 * 100 ELSE least(100 - r0 / 32 * 100, greatest(6, r1 - r0) / 32 * 100) END, 2)::DOUBLE AS h FROM e""")
def a13(spark, d):
    from ..operators.regions import water_envelope
    return water_envelope(classified(spark, d), ["site_id"], F.lit(32), F.lit(32)).select("site_id", "change_type", "area_m2", "x", "y", "w", "h")


@query("a19_class_histogram", ["pixels"], f"""WITH {CHANGE}, {SITE_FEATURES}, v AS (SELECT * FROM ver WHERE verified),
al AS (SELECT site_id, class_b, class_a FROM v UNION ALL SELECT site_id, class_b, class_a FROM fe),
b AS (SELECT site_id, class_b, count(*) AS n FROM al GROUP BY ALL), a AS (SELECT site_id, class_a, count(*) AS n FROM al GROUP BY ALL)
SELECT site_id, tb AS top_before, nb AS before_total, ta AS top_after, na AS after_total FROM (SELECT site_id, min_by(class_b, (-n, class_b)) AS tb, sum(n)::BIGINT AS nb FROM b GROUP BY site_id)
 FULL JOIN (SELECT site_id, min_by(class_a, (-n, class_a)) AS ta, sum(n)::BIGINT AS na FROM a GROUP BY site_id) USING (site_id)""")
def a19(spark, d):
    px, features, _ = features_of(spark, d)
    return pairs.class_histogram(px, features, ["site_id"])


@query("a28_sampled_water", ["pixels"], f"""WITH {CHANGE}, g AS (SELECT site_id, count(*) FILTER (WHERE class_b = 'Water') * 64 AS before_pixels, count(*) FILTER (WHERE class_a = 'Water') * 64 AS after_pixels FROM ver WHERE prow % 4 = 0 AND pcol % 4 = 0 GROUP BY site_id),
x AS (SELECT *, after_pixels - before_pixels AS delta_pixels FROM g)
SELECT *, greatest(0, delta_pixels) AS new_water_pixels, CASE WHEN delta_pixels >= 25 THEN 'Extended' WHEN delta_pixels <= -25 THEN 'Shrunk' ELSE 'Stable' END AS status,
 'Water Extent ' || CASE WHEN delta_pixels >= 25 THEN 'Expansion Verified' ELSE 'Stable' END || ': Δ ' || CASE WHEN delta_pixels >= 0 THEN '+' ELSE '' END || delta_pixels || ' px.' AS proof FROM x""")
def a28(spark, d):
    from ..operators.grids import sampled_water
    return sampled_water(classified(spark, d), ["site_id"], 4, 64)


@query("w01_epoch_stack", ["obs"], """WITH r AS (SELECT *, row_number() OVER w - 1 AS epoch_index, first_value(acquisition_date) OVER w AS base FROM obs WINDOW w AS (PARTITION BY site_key ORDER BY acquisition_date, obs_id)),
e AS (SELECT *, CAST(floor((epoch_us(acquisition_date) - epoch_us(base)) / 86400000000.0) AS BIGINT) AS elapsed_days FROM r)
SELECT site_key, tile_id, epoch_index, 'T' || (epoch_index + 1) AS epoch_label, elapsed_days, round_even(elapsed_days / 365.25::DOUBLE, 2)::DOUBLE AS elapsed_years FROM e""")
def w01(spark, d):
    df = timeline.epoch_stack(table(spark, d, "obs"), ["site_key"], "acquisition_date", "obs_id")
    return df.select("site_key", "tile_id", "epoch_index", "epoch_label", "elapsed_days", "elapsed_years")


@query("w02_consecutive_pairs", ["obs"], """WITH r AS (SELECT site_key, obs_id, acquisition_date AS d1, mean_ndvi AS v1, mean_ndbi AS b1, row_number() OVER w - 1 AS i, lead(obs_id) OVER w AS nid, lead(acquisition_date) OVER w AS d2, lead(mean_ndvi) OVER w AS v2, lead(mean_ndbi) OVER w AS b2
 FROM obs WINDOW w AS (PARTITION BY site_key ORDER BY acquisition_date, obs_id)), e AS (SELECT *, CAST(floor((epoch_us(d2) - epoch_us(d1)) / 86400000000.0) AS BIGINT) AS dd FROM r WHERE nid IS NOT NULL)
SELECT site_key, i AS step_index, 'T' || (i + 1) || ' → T' || (i + 2) AS transition_label, obs_id AS before_id, nid AS after_id, d1 AS date_before, d2 AS date_after, dd AS elapsed_days, round_even(dd / 365.25::DOUBLE, 2)::DOUBLE AS elapsed_years,
 round_even(v2 - v1, 4)::DOUBLE AS delta_mean_ndvi, round_even(b2 - b1, 4)::DOUBLE AS delta_mean_ndbi FROM e""")
def w02(spark, d):
    return timeline.consecutive_pairs(table(spark, d, "obs"), ["site_key"], "acquisition_date", "obs_id", ["mean_ndvi", "mean_ndbi"])


@query("w03_best_scene", ["items"], """SELECT granule, bucket, item_id, cloud_cover FROM (SELECT *, row_number() OVER (PARTITION BY granule, bucket ORDER BY cloud_cover, item_no) AS rn FROM (SELECT *, date_trunc('week', datetime)::TIMESTAMP AS bucket FROM items)) WHERE rn = 1""")
def w03(spark, d):
    df = table(spark, d, "items").selectExpr("granule", "CAST(date_trunc('week', datetime) AS TIMESTAMP_NTZ) AS bucket", "item_id", "item_no", "cloud_cover")
    return catalog.best_scene(df, ["granule", "bucket"], "cloud_cover", "item_no").select("granule", "bucket", "item_id", "cloud_cover")


@query("w04_latest_version", ["obs"], """SELECT site_key, sensor, tile_id, acquisition_date FROM (SELECT *, row_number() OVER (PARTITION BY site_key, sensor ORDER BY acquisition_date DESC, obs_id DESC) AS rn FROM obs) WHERE rn = 1""")
def w04(spark, d):
    df = table(spark, d, "obs").select("site_key", "sensor", "tile_id", "acquisition_date", "obs_id")
    return catalog.latest_version(df, ["site_key", "sensor"], F.struct("acquisition_date", "obs_id")).drop("obs_id")


@query("w05_mosaic", ["epochs"], """WITH l AS (SELECT site_id, prow, pcol, epoch, CASE WHEN bad THEN 0 ELSE nir END AS nir, CASE WHEN (epoch + prow) % 3 = 0 THEN 0 ELSE red END AS red FROM epochs)
SELECT site_id, prow, pcol, coalesce(max_by(nir, epoch) FILTER (WHERE nir > 0), 0)::DOUBLE AS nir, coalesce(max_by(red, epoch) FILTER (WHERE red > 0), 0)::DOUBLE AS red FROM l GROUP BY ALL""")
def w05(spark, d):
    df = table(spark, d, "epochs").selectExpr("site_id", "prow", "pcol", "epoch", "CASE WHEN bad THEN 0D ELSE nir END AS nir", "CASE WHEN (epoch + prow) % 3 = 0 THEN 0D ELSE red END AS red")
    return catalog.mosaic(df, ["site_id", "prow", "pcol"], "epoch", ["nir", "red"])


# a third of the epochs lacks its value; gaps are filled from the change profiles of the pairs beside them
EPOCH_NDVI = "CASE WHEN (site_id + epoch) % 3 <> 0 THEN round(avg(CASE WHEN nir + red > 0 THEN (nir - red) / (nir + red) END), 6) END"


@query("w06_gap_fill", ["epochs"], f"""WITH {EPOCH_PAIRS}, {CHANGE}, s AS (SELECT site_id, epoch, {EPOCH_NDVI} AS v FROM epochs GROUP BY site_id, epoch),
g AS (SELECT site_id // 10 AS site, site_id % 10 AS step, coalesce(round_even(avg(ndvi_b) FILTER (WHERE verified), 3)::DOUBLE, 0) AS b, coalesce(round_even(avg(ndvi_a) FILTER (WHERE verified), 3)::DOUBLE, 0) AS a FROM ver GROUP BY ALL)
SELECT s.site_id, CAST(epoch AS BIGINT) AS epoch_index, coalesce(v, CASE WHEN o.site IS NOT NULL THEN o.b ELSE q.a END)::DOUBLE AS mean_ndvi FROM s LEFT JOIN g o ON o.site = s.site_id AND o.step = epoch LEFT JOIN g q ON q.site = s.site_id AND q.step = epoch - 1""")
def w06(spark, d):
    stack = spark.sql("SELECT site_id, CAST(epoch AS BIGINT) AS epoch_index, " + EPOCH_NDVI + " AS mean_ndvi FROM {e} GROUP BY site_id, epoch", e=table(spark, d, "epochs"))
    found = pairs.spectral_profile(pairs.classify(epoch_pairs(spark, d)), ["site_id"])
    profiles = found.selectExpr("site_id div 10 AS site_id", "site_id % 10 AS step_index", "ndvi_b AS mean_ndvi_before", "ndvi_a AS mean_ndvi_after")
    return timeline.fill_gaps(stack, profiles, ["site_id"], ["mean_ndvi"])


@query("w09_trajectory", ["obs"], """SELECT site_key, obs_id, row_number() OVER w - 1 AS epoch_index, round(avg(mean_ndvi) OVER w, 12) AS mean_mean_ndvi, round(avg(mean_ndbi) OVER w, 12) AS mean_mean_ndbi,
 round(mean_ndvi - first_value(mean_ndvi) OVER w, 6) AS change_mean_ndvi, round(mean_ndbi - first_value(mean_ndbi) OVER w, 6) AS change_mean_ndbi FROM obs WINDOW w AS (PARTITION BY site_key ORDER BY acquisition_date, obs_id)""")
def w09(spark, d):
    return timeline.trajectory(table(spark, d, "obs"), ["site_key"], "acquisition_date", "obs_id", ["mean_ndvi", "mean_ndbi"])


@query("w08_backward_walk", ["obs"], """WITH u AS (SELECT *, CASE WHEN mean_ndbi > -0.2 THEN 'built' ELSE 'open' END AS state FROM obs WHERE quality_confidence >= 0.3),
l AS (SELECT site_key, arg_max(state, (acquisition_date, obs_id)) AS confirmed_state, max(acquisition_date) AS last_date FROM u GROUP BY site_key),
k AS (SELECT u.site_key, max((acquisition_date, obs_id)) FILTER (WHERE state <> confirmed_state) AS br FROM u JOIN l USING (site_key) GROUP BY u.site_key)
SELECT site_key, confirmed_state, last_date, min(acquisition_date) AS earliest_date, count(*) AS supporting_observations FROM u JOIN l USING (site_key) JOIN k USING (site_key) WHERE br IS NULL OR (acquisition_date, obs_id) > br GROUP BY ALL""")
def w08(spark, d):
    df = table(spark, d, "obs").withColumn("state", F.when(c("mean_ndbi") > -0.2, "built").otherwise("open")).withColumn("ok", c("quality_confidence") >= 0.3)
    return timeline.earliest_confirmed(df, ["site_key"], "acquisition_date", "obs_id", "ok", "state")


@query("j09_as_of", ["obs"], """WITH w AS (SELECT DISTINCT site_key, label, target FROM obs, (VALUES ('A', DATE '2024-01-04'), ('B', DATE '2024-02-02')) AS v(label, target)),
h AS (SELECT w.*, obs_id, abs(date_diff('day', target, CAST(acquisition_date AS DATE))) AS dist FROM w JOIN obs o ON o.site_key = w.site_key AND quality_confidence >= 0.7 AND abs(date_diff('day', target, CAST(acquisition_date AS DATE))) <= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY site_key, label ORDER BY dist, obs_id) AS rn FROM h)
SELECT w.site_key, w.label, w.target, b.obs_id AS nearest_id, b.dist::INT AS distance_days, CASE WHEN b.obs_id IS NULL THEN 'insufficient_coverage' ELSE 'ok' END AS status FROM w LEFT JOIN b ON b.site_key = w.site_key AND b.label = w.label AND rn = 1""")
def j09(spark, d):
    tiles = table(spark, d, "obs")
    wanted = tiles.select("site_key").distinct().select(
        "site_key", F.inline(F.expr("array(struct('A' AS label, DATE '2024-01-04' AS target), struct('B' AS label, DATE '2024-02-02' AS target))")))
    return timeline.nearest_observation(tiles, wanted, ["site_key"], "acquisition_date", "obs_id", 3, 0.7)


ORACLES["a19_class_histogram"] = recursive(ORACLES["a19_class_histogram"])
