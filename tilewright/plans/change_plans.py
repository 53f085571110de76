"""Pair analysis: from pixels of two dates to change statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..fixtures import table
from ..functions import change, spectral
from ..operators import pairs
from .registry import query
from .sqltext import CHANGE, CHG, CLS, IDX, MAJOR, VEG, SOIL, BUILT, CONF, UNCL

PIXEL = ["site_id", "prow", "pcol"]


def classified(spark, d):
    return pairs.classify(table(spark, d, "pixels"))


@query("change_by_site", ["pixels"], f"""WITH {CHANGE}
SELECT site_id, change_type, count(*) AS pixels, total_pixels, round_even(count(*) / total_pixels * 100, 2)::DOUBLE AS percent
FROM ver JOIN (SELECT site_id, count(*) AS total_pixels FROM pixels GROUP BY ALL) USING (site_id)
WHERE verified GROUP BY site_id, change_type, total_pixels""")
def change_by_site(spark, d):
    df = pairs.change_by_site(classified(spark, d), ["site_id"])
    return df.select("site_id", "change_type", "pixels", "total_pixels", "percent")


@query("f11_usable_pairs", ["pixels"], """
SELECT site_id, count(*) AS total_pixels, count(*) FILTER (WHERE NOT (bad_b OR bad_a)) AS usable_pixels
FROM pixels GROUP BY site_id HAVING avg((NOT (bad_b OR bad_a))::INT) >= 0.30""")
def f11(spark, d):
    df = table(spark, d, "pixels")
    return (
        df.groupBy("site_id").agg(F.count(F.lit(1)).alias("total_pixels"), F.count_if(pairs.usable()).alias("usable_pixels"))
        .where(F.col("usable_pixels") / F.col("total_pixels") >= K.MIN_USABLE)
    )


@query("f12_sanitized_mask", ["pixels"], """WITH m AS (SELECT *, (noise < 60 OR site_id % 2 = 0 AND noise < 40) AS bad FROM pixels),
st AS (SELECT site_id, avg(bad::INT::DOUBLE) AS share, avg(blue_b) FILTER (WHERE bad) AS mean_blue FROM m GROUP BY site_id)
SELECT site_id, prow, pcol, CASE WHEN share > 0.5 AND mean_blue < 0.30 THEN bad AND blue_b > 0.35 AND red_b > 0.30 ELSE bad END AS bad
FROM m JOIN st USING (site_id)""")
def f12(spark, d):
    df = table(spark, d, "pixels").withColumn("bad", F.expr("noise < 60 OR site_id % 2 = 0 AND noise < 40"))
    return pairs.sanitize_mask(df, ["site_id"], "bad", "blue_b", "red_b").select(*PIXEL, "bad")


@query("f15_major_types", ["pixels"], f"""WITH {CHANGE}
SELECT site_id, prow, pcol, change_type FROM ver WHERE candidate AND is_real AND change_type IN {MAJOR}""")
def f15(spark, d):
    return classified(spark, d).where(F.col("verified")).select(*PIXEL, "change_type")


@query("x06_candidates", ["pixels"], f"WITH {IDX}, {CLS}, {CHG} SELECT site_id, prow, pcol, candidate FROM chg")
def x06(spark, d):
    return classified(spark, d).select(*PIXEL, "candidate")


@query("x07_band_distance", ["pixels"], """
SELECT site_id, prow, pcol, sqrt((green_a-green_b)*(green_a-green_b) + (red_a-red_b)*(red_a-red_b)
  + (nir_a-nir_b)*(nir_a-nir_b) + (swir_a-swir_b)*(swir_a-swir_b)) AS distance,
  sqrt((green_a-green_b)*(green_a-green_b) + (red_a-red_b)*(red_a-red_b)
  + (nir_a-nir_b)*(nir_a-nir_b) + (swir_a-swir_b)*(swir_a-swir_b)) > 0.15 AS changed FROM pixels""")
def x07(spark, d):
    names = ["green", "red", "nir", "swir"]
    distance = change.band_distance([(F.col(f"{b}_b"), F.col(f"{b}_a")) for b in names])
    return table(spark, d, "pixels").select(*PIXEL, distance.alias("distance"),
                                            (distance > K.REFLECTANCE_DIFF).alias("changed"))


@query("x08_semantic_filter", ["pixels"], f"WITH {IDX}, {CLS}, {CHG} SELECT site_id, prow, pcol, class_b, class_a, is_real AS is_change FROM chg")
def x08(spark, d):
    return classified(spark, d).select(*PIXEL, "class_b", "class_a", F.col("real").alias("is_change"))


@query("x09_pixel_transition", ["pixels"], f"WITH {IDX}, {CLS}, {CHG} SELECT site_id, prow, pcol, change_type FROM chg")
def x09(spark, d):
    return classified(spark, d).select(*PIXEL, "change_type")


# every pair of class names, with areas around the thresholds, counted over the whole pixel table
_NAMES = ["Water", "Dense Vegetation", "Sparse Vegetation", "Built-up", "Bare Soil / Open Land",
          "Built-up / Bare-land Confusion", "Unclassified / Other", "Built-up / Urban", "Bare Soil / Barren"]
_CASE = lambda x: f"CASE CAST({x} AS BIGINT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
REGION_ROWS = (f"SELECT site_id, prow, pcol, {_CASE('(site_id + floor(prow / 4) + noise) % 9')} AS class_b, "
               f"{_CASE('(site_id * 2 + floor(pcol / 3) + noise * 5) % 9')} AS class_a, CAST(noise * noise * 8 AS DOUBLE) AS area_m2 FROM ")
REGION_TYPE = f"""CASE WHEN class_b = class_a THEN 'No Change'
  WHEN class_b IN {VEG} AND class_a IN {VEG} THEN CASE WHEN area_m2 >= 50000 THEN 'Vegetation Shift (Large Scale)' ELSE 'No Change' END
  WHEN class_b = {CONF} AND class_a = {CONF} THEN 'No Change'
  WHEN (class_b = {CONF} AND class_a IN {SOIL}) OR (class_b IN {SOIL} AND class_a = {CONF}) THEN 'No Change'
  WHEN class_b = {CONF} AND class_a IN {BUILT} AND area_m2 < 1000 THEN 'No Change'
  WHEN class_b IN {BUILT} AND class_a = {CONF} THEN 'No Change'
  WHEN class_b IN {SOIL} AND class_a IN {VEG} THEN 'No Change'
  WHEN (class_b IN {UNCL} AND class_a IN {VEG}) OR (class_b IN {VEG} AND class_a IN {UNCL}) THEN 'No Change'
  WHEN class_b IN {UNCL} AND class_a IN {UNCL} THEN 'No Change'
  WHEN (class_b IN {VEG} OR class_b IN {SOIL} OR class_b = {CONF}) AND class_a IN {BUILT} THEN 'Construction'
  WHEN class_b = 'Dense Vegetation' AND (class_a IN {SOIL} OR class_a = {CONF}) THEN 'Clearance'
  WHEN class_b IN {VEG} AND class_a IN {SOIL} AND area_m2 >= 5000 THEN 'Clearance'
  WHEN class_b IN {VEG} AND class_a IN {SOIL} THEN 'No Change'
  WHEN class_b = 'Water' AND class_a <> 'Water' THEN 'Water-Extent Variation (shrinkage)'
  WHEN class_b <> 'Water' AND class_a = 'Water' THEN 'Water-Extent Variation (expansion)'
  WHEN class_b IN {BUILT} AND class_a IN {SOIL} THEN 'Demolition / Reversion'
  WHEN class_b IN {BUILT} AND class_a IN {VEG} THEN 'No Change'
  WHEN class_a IN {BUILT} AND class_b NOT IN {BUILT} THEN 'Construction' ELSE 'No Change' END"""


def _regions(spark, d):
    return spark.sql(REGION_ROWS + "{px}", px=table(spark, d, "pixels"))


@query("x10_region_transition", ["pixels"], f"""WITH r AS ({REGION_ROWS} pixels)
SELECT site_id, prow, pcol, class_b, class_a, area_m2, {REGION_TYPE} AS change_type FROM r""")
def x10(spark, d):
    return _regions(spark, d).withColumn(
        "change_type", change.region_change_type(F.col("class_b"), F.col("class_a"), F.col("area_m2")))


@query("x11_transition_label", ["pixels"], f"""WITH r AS ({REGION_ROWS} pixels), t AS (SELECT *, CASE WHEN area_m2 > 60000 AND class_a IN {BUILT} THEN 'Road Development' ELSE {REGION_TYPE} END AS ct FROM r),
s AS (SELECT *, CASE WHEN contains(class_b, 'Vegetation') THEN 'Vegetation' WHEN contains(class_b, 'Soil') OR contains(class_b, 'Barren') OR contains(class_b, 'Land') THEN 'Ground' ELSE class_b END AS bs,
  CASE WHEN contains(class_a, 'Vegetation') THEN 'Vegetation' WHEN contains(class_a, 'Soil') OR contains(class_a, 'Barren') OR contains(class_a, 'Land') THEN 'Ground'
       WHEN contains(class_a, 'Built') THEN 'Built-up' ELSE class_a END AS as_ FROM t)
SELECT site_id, prow, pcol, ct AS change_type, CASE
  WHEN ct = 'Road Development' THEN CASE WHEN contains(class_b, 'Vegetation') THEN 'Vegetation → Road' ELSE 'Ground → Road' END
  WHEN ct = 'Construction' THEN CASE WHEN contains(class_b, 'Vegetation') THEN 'Vegetation → Built-up' ELSE 'Ground → Built-up' END
  WHEN ct = 'Clearance' THEN 'Vegetation → Ground'
  WHEN ct LIKE '%(expansion)' THEN 'Land → Water (Extension)' WHEN ct LIKE '%(shrinkage)' THEN 'Water → Land (Shrinkage)'
  WHEN ct = 'Demolition / Reversion' THEN 'Built-up → Ground'
  WHEN ct = 'Vegetation Shift (Large Scale)' THEN ct ELSE bs || ' → ' || as_ END AS transition_label FROM s""")
def x11(spark, d):
    df = _regions(spark, d)
    b, a = F.col("class_b"), F.col("class_a")
    kind = F.when((F.col("area_m2") > 60000) & a.isin(K.BUILT_NAMES), K.ROAD).otherwise(
        change.region_change_type(b, a, F.col("area_m2")))
    return df.withColumn("change_type", kind).select(
        *PIXEL, "change_type", change.transition_label(b, a, F.col("change_type")).alias("transition_label"))


@query("x12_display_transition", ["pixels"], f"""WITH r AS ({REGION_ROWS} pixels), f AS (SELECT *,
  contains(class_b,'Water') AS wb, contains(class_a,'Water') AS wa, contains(class_b,'Vegetation') AS vb, contains(class_a,'Vegetation') AS va,
  contains(class_b,'Bare Soil') OR contains(class_b,'Land') AS sb, contains(class_a,'Bare Soil') OR contains(class_a,'Land') AS sa,
  contains(class_b,'Built-up') AS ub, contains(class_a,'Built-up') AS ua, class_b || ' → ' || class_a AS arrow FROM r)
SELECT site_id, prow, pcol, CASE WHEN class_b = class_a THEN 'Stable Surface: ' || class_b || ' (Unchanged)'
  WHEN wb AND wa THEN 'Stable Surface: Water Body (Unchanged)' WHEN vb AND va THEN '🌱 Seasonal Phenology (' || arrow || ')'
  WHEN contains(class_b,'Confusion') OR contains(class_a,'Confusion') THEN '⚠️ ' || arrow || ' (Spectral Ambiguity)'
  WHEN wb AND NOT wa THEN '💧 Water Shrinkage (Water → ' || class_a || ')' WHEN wa AND NOT wb THEN '💧 Water Expansion (' || class_b || ' → Water)'
  WHEN (vb OR sb) AND ua THEN '🏗️ Construction (' || class_b || ' → Built-up)' WHEN vb AND sa THEN '🪓 Land Clearance (' || arrow || ')'
  WHEN sb AND va THEN '🌱 Vegetation Growth (' || arrow || ')' WHEN ub AND (va OR sa) THEN '🏚️ Demolition / Reversion (Built-up → ' || class_a || ')'
  ELSE arrow END AS sentence FROM f""")
def x12(spark, d):
    return _regions(spark, d).select(*PIXEL, change.display_transition(F.col("class_b"), F.col("class_a")).alias("sentence"))


@query("x38_pair_confidence", ["pixels"], """
SELECT site_id, greatest(0.1::DOUBLE, least(0.99::DOUBLE, avg((NOT (bad_b OR bad_a))::INT::DOUBLE) * 0.95)) AS confidence FROM pixels GROUP BY site_id""")
def x38(spark, d):
    df = table(spark, d, "pixels")
    return df.groupBy("site_id").agg(change.pair_confidence(F.avg(pairs.usable().cast("double"))).alias("confidence"))


@query("a08_pair_report", ["pixels"], """WITH p AS (SELECT site_id, NOT (bad_b OR bad_a) AS ok, sqrt((green_a-green_b)*(green_a-green_b) + (red_a-red_b)*(red_a-red_b)
  + (nir_a-nir_b)*(nir_a-nir_b) + (swir_a-swir_b)*(swir_a-swir_b)) AS dist FROM pixels),
g AS (SELECT site_id, count(*) AS total_pixels, count(*) FILTER (WHERE ok) AS evaluated_pixels, count(*) FILTER (WHERE ok AND dist > 0.15) AS ch, avg(dist) FILTER (WHERE ok) AS m FROM p GROUP BY site_id),
v AS (SELECT *, evaluated_pixels / total_pixels AS vf FROM g)
SELECT site_id, total_pixels, evaluated_pixels, CASE WHEN vf >= 0.3 THEN 'ok' ELSE 'insufficient_coverage' END AS status,
 round_even(vf, 4)::DOUBLE AS valid_fraction, round_even((1 - vf) * 100, 2)::DOUBLE AS cloud_unusable_pct,
 CASE WHEN vf >= 0.3 THEN round_even(greatest(0.1, least(0.99, vf * 0.95)), 4)::DOUBLE ELSE 0 END AS confidence,
 CASE WHEN vf >= 0.3 THEN round_even(ch / evaluated_pixels * 100, 2)::DOUBLE ELSE 0 END AS change_percentage,
 CASE WHEN vf >= 0.3 THEN ch ELSE 0 END AS change_pixel_count, CASE WHEN vf >= 0.3 THEN round_even(m, 4)::DOUBLE END AS mean_spectral_diff FROM v""")
def a08(spark, d):
    return pairs.pair_report(table(spark, d, "pixels"), ["site_id"], ["green", "red", "nir", "swir"])


@query("a09_epoch_difference", ["clouds"], """WITH p AS (SELECT scene_id, sqrt((red_later-red)*(red_later-red) + (green_later-green)*(green_later-green) + (blue_later-blue)*(blue_later-blue)) AS dist FROM clouds)
SELECT scene_id, count(*) FILTER (WHERE dist > 35) AS change_pixels, count(*) AS total_pixels,
 round_even(count(*) FILTER (WHERE dist > 35) / count(*) * 100, 2)::DOUBLE AS change_percentage FROM p GROUP BY scene_id""")
def a09(spark, d):
    df = table(spark, d, "clouds")
    bands = ["red", "green", "blue"]
    df = df.select("scene_id", *[F.col(b).alias(f"{b}_b") for b in bands], *[F.col(f"{b}_later").alias(f"{b}_a") for b in bands])
    return pairs.epoch_difference(df, ["scene_id"], bands)


@query("a10_filter_statistics", ["pixels"], f"""WITH {CHANGE}, g AS (SELECT site_id, count(*) FILTER (WHERE candidate) AS candidate_changes,
 count(*) FILTER (WHERE candidate AND is_real) AS semantic_changes, count(*) FILTER (WHERE verified) AS verified_changes FROM ver GROUP BY site_id)
SELECT *, candidate_changes - verified_changes AS false_positives_rejected,
 CASE WHEN candidate_changes > 0 THEN round_even((candidate_changes - semantic_changes) / candidate_changes, 4)::DOUBLE ELSE 0 END AS rejection_ratio FROM g""")
def a10(spark, d):
    return pairs.filter_statistics(classified(spark, d), ["site_id"])


@query("a11_spectral_profile", ["pixels"], f"""WITH {CHANGE}, g AS (SELECT site_id, {', '.join(f"coalesce(round_even(avg({n}_{s}) FILTER (WHERE verified), 3)::DOUBLE, 0) AS {n}_{s}" for s in 'ba' for n in ('ndvi', 'ndbi', 'ndwi'))} FROM ver GROUP BY site_id)
SELECT *, {', '.join(f"round_even({n}_a - {n}_b, 3)::DOUBLE AS delta_{n}" for n in ('ndvi', 'ndbi', 'ndwi'))} FROM g""")
def a11(spark, d):
    return pairs.spectral_profile(classified(spark, d), ["site_id"])


WATER_SQL = """w AS (SELECT *, ndvi_b < 0 OR class_b = 'Water' AS wb, ndvi_a < 0 OR class_a = 'Water' AS wa FROM ver),
wg AS (SELECT site_id, count(*) FILTER (WHERE wb) AS before_pixels, count(*) FILTER (WHERE wa) AS after_pixels,
 count(*) FILTER (WHERE NOT wb AND wa) AS new_water_pixels, count(*) FILTER (WHERE wb AND NOT wa) AS dried_pixels FROM w GROUP BY site_id),
wx AS (SELECT *, after_pixels - before_pixels AS delta_pixels, after_pixels > before_pixels AND new_water_pixels >= 25 AS is_extension_proven,
 after_pixels - before_pixels < -25 AS is_shrinkage_proven FROM wg)"""


@query("a12_water_extent", ["pixels"], f"""WITH {CHANGE}, {WATER_SQL}
SELECT *, CASE WHEN is_extension_proven THEN 'Extended' WHEN is_shrinkage_proven THEN 'Shrunk' ELSE 'Stable' END AS status,
 CASE WHEN is_extension_proven THEN 'Water Extent Expansion Verified: +' || delta_pixels || ' blue pixels (+' || round_even(delta_pixels / 100, 2)::DOUBLE
   || ' ha). Before: ' || format('{{:,}}', before_pixels) || ' px → After: ' || format('{{:,}}', after_pixels) || ' px (>25 px proof threshold).'
 WHEN is_shrinkage_proven THEN 'Water Extent Shrinkage: ' || delta_pixels || ' blue pixels (' || round_even(delta_pixels / 100, 2)::DOUBLE
   || ' ha). Before: ' || format('{{:,}}', before_pixels) || ' px → After: ' || format('{{:,}}', after_pixels) || ' px.'
 ELSE 'Water Extent Stable / Unchanged: Δ ' || CASE WHEN delta_pixels >= 0 THEN '+' ELSE '' END || delta_pixels || ' px (Baseline: '
   || format('{{:,}}', before_pixels) || ' px vs After: ' || format('{{:,}}', after_pixels) || ' px; below 25 px threshold).' END AS proof FROM wx""")
def a12(spark, d):
    return pairs.water_extent(classified(spark, d), ["site_id"])


@query("j04_pixel_pairs", ["epochs"], """WITH ag AS (SELECT a.site_id, a.epoch, b.epoch AS epoch_after, a.prow, a.pcol, a.nir AS nir_b, b.nir AS nir_a FROM epochs a
 JOIN epochs b ON a.site_id = b.site_id AND a.prow = b.prow AND a.pcol = b.pcol AND b.epoch = a.epoch + 1)
SELECT site_id, epoch, epoch_after, count(*) AS pixels, CAST(sum(CAST(round((nir_a - nir_b) * 10000) AS BIGINT)) AS BIGINT) AS nir_gain FROM ag GROUP BY ALL""")
def j04(spark, d):
    df = table(spark, d, "epochs").select(*PIXEL, "epoch", "nir")
    before = df.withColumnRenamed("nir", "nir_b")
    after = df.select(*PIXEL, (F.col("epoch") - 1).alias("epoch"), F.col("nir").alias("nir_a"))
    joined = pairs.join_dates(before, after, [*PIXEL, "epoch"]).withColumn("epoch_after", F.col("epoch") + 1)
    return joined.groupBy("site_id", "epoch", "epoch_after").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum(F.round((F.col("nir_a") - F.col("nir_b")) * 10000).cast("bigint")).alias("nir_gain"))


@query("j05_mask_attach", ["pixels"], """WITH mask AS (SELECT site_id, prow, pcol FROM pixels WHERE bad_b)
SELECT p.site_id, p.prow, p.pcol, m.site_id IS NOT NULL AS bad FROM pixels p LEFT JOIN mask m ON p.site_id = m.site_id AND p.prow = m.prow AND p.pcol = m.pcol""")
def j05(spark, d):
    df = table(spark, d, "pixels")
    mask = df.where("bad_b").select(*PIXEL, F.lit(True).alias("bad"))
    return pairs.attach_mask(df.select(*PIXEL), mask, PIXEL, "bad")
