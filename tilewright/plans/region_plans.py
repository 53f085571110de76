"""Change regions: components, boxes, temporal union."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import grids, pairs, regions
from ..session import cut_lineage, fresh_path
from ..sources import sinks
from ..sources.tables import LoggedTable
from .change_plans import WATER_SQL, classified
from .registry import ORACLES, query, recursive
from .sqltext import CHANGE

c = F.col
SIZE = 32


def components_sql(name: str, source: str, keys: str) -> str:
    """4-connected components of ``source`` (keys, prow, pcol) by repeated smallest label."""
    ks = keys.split(", ")
    eq = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    pick = lambda a: ", ".join(f"{a}.{k}" for k in ks)
    return f"""{name}_e AS MATERIALIZED (SELECT {pick('a')}, a.prow AS r1, a.pcol AS c1, b.prow AS r2, b.pcol AS c2 FROM {source} a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dr, dc), {source} b WHERE {eq('a', 'b')} AND b.prow = a.prow + dr AND b.pcol = a.pcol + dc),
{name} ({keys}, prow, pcol, lab) USING KEY ({keys}, prow, pcol) AS (SELECT {keys}, prow, pcol, prow * 100000 + pcol FROM {source}
 UNION (SELECT {pick('n')}, n.prow, n.pcol, min(cur.lab) FROM {name} cur JOIN {name}_e e ON {eq('cur', 'e')} AND cur.prow = e.r1 AND cur.pcol = e.c1 JOIN recurring.{name} n ON {eq('n', 'e')} AND n.prow = e.r2 AND n.pcol = e.c2 WHERE cur.lab < n.lab GROUP BY ALL))"""


LAT = "(23 + site_id * 0.01::DOUBLE)"
SHAPES = """sh AS (SELECT *, sqrt((a + b + s) / (a + b - s)) AS elongation FROM (SELECT *, sqrt((a - b) * (a - b) + 4 * cv * cv) AS s FROM (SELECT site_id, lab, count(*) AS area_px, min(prow) AS r0, max(prow) AS r1, min(pcol) AS c0, max(pcol) AS c1,
 var_pop(prow) + 1.0::DOUBLE / 12 AS a, var_pop(pcol) + 1.0::DOUBLE / 12 AS b, covar_pop(prow, pcol) AS cv FROM cc GROUP BY site_id, lab HAVING count(*) >= 15)))"""
FEATURES = f"""vp AS MATERIALIZED (SELECT * FROM ver WHERE verified), vk AS MATERIALIZED (SELECT site_id, prow, pcol FROM vp), {components_sql('cc', 'vk', 'site_id')}, {SHAPES},
mr AS (SELECT cc.site_id, cc.lab, cc.prow, cc.pcol, cc.pcol - row_number() OVER (PARTITION BY cc.site_id, cc.lab ORDER BY cc.pcol) AS run FROM cc JOIN sh ON sh.site_id = cc.site_id AND sh.lab = cc.lab AND cc.prow = (r0 + r1) // 2),
ru AS (SELECT site_id, lab, prow, run, min(pcol) AS st, count(*) AS ln FROM mr GROUP BY ALL), ip AS (SELECT site_id, lab, prow, st + (ln - 1) // 2 AS pcol FROM (SELECT *, row_number() OVER (PARTITION BY site_id, lab ORDER BY ln DESC, st) AS k FROM ru) WHERE k = 1),
fe AS MATERIALIZED (SELECT sh.site_id, sh.lab, sh.site_id || '|' || (sh.lab // 100000) || '|' || (sh.lab % 100000) AS component, area_px, r0, c0, elongation, class_b, class_a, CASE WHEN change_type = 'Construction' AND elongation >= 4 THEN 'Road Development' ELSE change_type END AS change_type,
 round_even(area_px * 11.132::DOUBLE * (11.132::DOUBLE * cos(radians(LATEXPR - (r0 + r1 + 1) / 2 * 0.0001::DOUBLE))), 1)::DOUBLE AS area_m2,
 round_even(c0 / 32 * 100, 2)::DOUBLE AS x, round_even(r0 / 32 * 100, 2)::DOUBLE AS y, round_even(greatest(4, least(c1 + 1, 31) - c0) / 32 * 100, 2)::DOUBLE AS w, round_even(greatest(4, least(r1 + 1, 31) - r0) / 32 * 100, 2)::DOUBLE AS h,
 round_even(ndvi_b, 3)::DOUBLE AS ndvi_b, round_even(ndbi_a, 3)::DOUBLE AS ndbi_a FROM sh JOIN ip USING (site_id, lab) JOIN vp ON vp.site_id = sh.site_id AND vp.prow = ip.prow AND vp.pcol = ip.pcol)"""
SITE_FEATURES = FEATURES.replace("LATEXPR", "(23 + sh.site_id * 0.01::DOUBLE)")
_cols = ["area_px", "area_m2", "r0", "c0", "x", "y", "w", "h", "change_type", "class_b", "class_a", "ndvi_b", "ndbi_a"]


def features_of(spark, d):
    px = cut_lineage(classified(spark, d))  # classified once for the features, the water extent and the envelope
    features, labelled = regions.region_features(px, ["site_id"], SIZE, SIZE, F.lit(23.0) + c("site_id") * 0.01)
    return px, features, labelled


@query("n04_regions", ["pixels"], f"WITH {CHANGE}, {SITE_FEATURES} SELECT site_id, component, {', '.join(_cols)} FROM fe")
def n04(spark, d):
    return features_of(spark, d)[1].select("site_id", "component", *_cols)


# the sites of every third number are analysed again and keep only their larger regions, or none
@query("k02_region_events", ["pixels"], f"""WITH {CHANGE}, {SITE_FEATURES} SELECT site_id, component, change_type, area_m2, CASE WHEN site_id % 3 = 0 THEN 2 ELSE 1 END AS analysis FROM fe WHERE site_id % 3 <> 0 OR area_m2 >= 3000""")
def k02_events(spark, d):
    found = features_of(spark, d)[1].select("site_id", "component", "change_type", "area_m2", F.lit(1).alias("analysis"))
    again = found.where("site_id % 3 = 0")
    stored = LoggedTable.create(fresh_path(spark, "region-events"), sinks.site_buckets(found, "site_id", 16), ["bucket"])
    stored.replace(sinks.site_buckets(again.where("area_m2 >= 3000").withColumn("analysis", F.lit(2)), "site_id", 16), "site_id", sinks.site_buckets(again, "site_id", 16))
    return stored.read().drop("bucket")


@query("n05_elongation", ["pixels"], f"WITH {CHANGE}, {SITE_FEATURES} SELECT site_id, component, round(elongation, 6) AS elongation, elongation >= 4 AS is_thin FROM fe")
def n05(spark, d):
    f = features_of(spark, d)[1]
    return f.select("site_id", "component", F.round("elongation", 6).alias("elongation"), (c("elongation") >= 4).alias("is_thin"))


# blocks of 8 x 8 pixels, so that nearly every component crosses a block edge
@query("n06_cross_block_components", ["pixels"], f"""WITH {CHANGE}, vk AS MATERIALIZED (SELECT site_id, prow, pcol FROM ver WHERE verified), {components_sql('cc', 'vk', 'site_id')}
SELECT site_id, count(*) AS pixels, min(prow) AS r0, max(prow) AS r1, min(pcol) AS c0, max(pcol) AS c1 FROM cc GROUP BY site_id, lab""")
def n06(spark, d):
    px = classified(spark, d).where("verified").select("site_id", "prow", "pcol")
    return regions.label_components(px, ["site_id"], block=8).groupBy("site_id", "component").agg(
        F.count(F.lit(1)).alias("pixels"), F.min("prow").alias("r0"), F.max("prow").alias("r1"), F.min("pcol").alias("c0"), F.max("pcol").alias("c1")).drop("component")


# rings from blocks of 8 x 8 pixels: signed area and length against pixels and open sides
@query("n07_outlines", ["pixels"], f"""WITH {CHANGE}, vk AS MATERIALIZED (SELECT site_id, prow, pcol FROM ver WHERE verified), {components_sql('cc', 'vk', 'site_id')},
i AS (SELECT a.site_id, a.lab, count(*) AS shared FROM cc a JOIN cc b ON a.site_id = b.site_id AND a.lab = b.lab AND abs(a.prow - b.prow) + abs(a.pcol - b.pcol) = 1 GROUP BY ALL),
n AS (SELECT site_id, lab, count(*) AS pixels FROM cc GROUP BY ALL)
SELECT site_id, site_id || '|' || (lab // 100000) || '|' || (lab % 100000) AS component, pixels AS area, 4 * pixels - coalesce(shared, 0) AS length, 1::BIGINT AS outer_rings FROM n LEFT JOIN i USING (site_id, lab)""")
def n07(spark, d):
    px = classified(spark, d).where("verified").select("site_id", "prow", "pcol")
    rings = regions.outlines(regions.label_components(px, ["site_id"], block=8), ["site_id"], block=8)
    sides = F.transform(F.sequence(F.lit(2), F.size("points")), lambda k: F.struct(F.element_at("points", k - 1).alias("p"), F.element_at("points", k).alias("q")))
    total = lambda f: F.aggregate(sides, F.lit(0).cast("bigint"), lambda acc, e: acc + f(e["p"], e["q"]))
    area = total(lambda p, q: p[0] * q[1] - q[0] * p[1])
    length = total(lambda p, q: F.abs(p[0] - q[0]) + F.abs(p[1] - q[1]))
    rings = rings.select("site_id", regions.component_name(["site_id"], c("component")).alias("component"), "ring", area.alias("a"), length.alias("l"))
    return rings.groupBy("site_id", "component").agg(F.expr("sum(a) div 2").alias("area"), F.sum("l").alias("length"), F.count_if((c("a") > 0) & (c("ring") == 0)).alias("outer_rings"))


@query("n09_grid_regions", ["pixels"], f"""WITH {CHANGE}, gp AS MATERIALIZED (SELECT site_id, prow // 2 AS prow, pcol // 2 AS pcol, class_b, class_a, verified FROM ver WHERE prow % 2 = 0 AND pcol % 2 = 0), vk AS MATERIALIZED (SELECT site_id, prow, pcol FROM gp WHERE verified), {components_sql('cc', 'vk', 'site_id')},
s AS (SELECT site_id, lab, count(*) AS cells, min(prow) AS r0, max(prow) AS r1, min(pcol) AS c0, max(pcol) AS c1 FROM cc GROUP BY site_id, lab HAVING count(*) >= 3)
SELECT s.site_id, cells, r0, r1, c0, c1, class_b, class_a, CASE WHEN contains(class_a, 'Built') THEN 'Construction' WHEN contains(class_a, 'Soil') OR contains(class_a, 'Ground') THEN 'Clearance' ELSE 'Major Change' END AS change_type
FROM s JOIN gp ON gp.site_id = s.site_id AND gp.prow = (r0 + r1) // 2 AND gp.pcol = (c0 + c1) // 2""")
def n09(spark, d):
    grid = classified(spark, d).where("prow % 2 = 0 AND pcol % 2 = 0").selectExpr(
        "site_id", "CAST(prow / 2 AS BIGINT) AS prow", "CAST(pcol / 2 AS BIGINT) AS pcol", "class_b", "class_a", "verified")
    cells = regions.label_components(grid.where("verified").select("site_id", "prow", "pcol"), ["site_id"]).groupBy("site_id", "component").agg(
        F.count(F.lit(1)).alias("cells"), F.min("prow").alias("r0"), F.max("prow").alias("r1"), F.min("pcol").alias("c0"), F.max("pcol").alias("c1")).where("cells >= 3")
    mid = cells.withColumns({"prow": F.floor((c("r0") + c("r1")) / 2), "pcol": F.floor((c("c0") + c("c1")) / 2)})
    kind = F.when(c("class_a").contains("Built"), "Construction").when(c("class_a").rlike("Soil|Ground"), "Clearance").otherwise("Major Change")
    return mid.join(grid, ["site_id", "prow", "pcol"]).select("site_id", "cells", "r0", "r1", "c0", "c1", "class_b", "class_a", kind.alias("change_type"))


MAJOR_BOX = f"""{SITE_FEATURES}, {WATER_SQL}, mb AS (SELECT fe.* FROM fe JOIN wx USING (site_id) WHERE area_m2 >= 1000 AND NOT (change_type LIKE '%(expansion)' AND NOT is_extension_proven) AND NOT (change_type LIKE '%(shrinkage)' AND NOT is_shrinkage_proven))"""


@query("t05_major_boxes", ["pixels"], f"WITH {CHANGE}, {MAJOR_BOX} SELECT site_id, component, change_type, area_m2 FROM mb")
def t05(spark, d):
    px, features, _ = features_of(spark, d)
    return regions.major_boxes(features, pairs.water_extent(px, ["site_id"]), ["site_id"]).select("site_id", "component", "change_type", "area_m2")


@query("t05_archive_boxes", ["pixels"], f"""WITH {CHANGE}, {SITE_FEATURES} SELECT site_id, component, place FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY area_m2 DESC, component) AS place FROM fe
WHERE NOT (class_b = class_a AND contains(class_b, 'Veg') AND area_m2 < 50000) AND NOT (contains(change_type, 'Demo') AND regexp_matches(class_b, 'Soil|Ground|Barren|Land')) AND (regexp_matches(change_type, 'Construct|Road|Clear|Demo|Water') OR area_m2 >= 2000)) WHERE place <= 25""")
def t05_archive(spark, d):
    return regions.archive_boxes(features_of(spark, d)[1], ["site_id"]).select("site_id", "component", "place")


NMS = f"""{MAJOR_BOX}, bo AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY area_m2 DESC, component) AS pos FROM mb),
nf AS (SELECT site_id, 0::BIGINT AS pos, []::STRUCT(component VARCHAR, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS kept FROM (SELECT DISTINCT site_id FROM bo)
 UNION ALL SELECT nf.site_id, bo.pos, CASE WHEN len(kept) >= 8 OR len(list_filter(kept, lambda k: greatest(0, least(k.x + k.w, bo.x + bo.w) - greatest(k.x, bo.x)) * greatest(0, least(k.y + k.h, bo.y + bo.h) - greatest(k.y, bo.y))
   / (k.w * k.h + bo.w * bo.h - greatest(0, least(k.x + k.w, bo.x + bo.w) - greatest(k.x, bo.x)) * greatest(0, least(k.y + k.h, bo.y + bo.h) - greatest(k.y, bo.y))) > 0.35)) > 0 THEN kept
  ELSE list_append(kept, {{'component': bo.component, 'x': bo.x, 'y': bo.y, 'w': bo.w, 'h': bo.h}}) END FROM nf JOIN bo ON bo.site_id = nf.site_id AND bo.pos = nf.pos + 1),
nk AS (SELECT site_id, unnest(kept).component AS component FROM (SELECT site_id, arg_max(kept, pos) AS kept FROM nf GROUP BY site_id)), kb AS (SELECT mb.* FROM mb JOIN nk USING (site_id, component))"""


@query("t06_distinct_boxes", ["pixels"], f"WITH {CHANGE}, {NMS} SELECT site_id, component, area_m2 FROM kb")
def t06(spark, d):
    px, features, _ = features_of(spark, d)
    major = regions.major_boxes(features, pairs.water_extent(px, ["site_id"]), ["site_id"])
    return regions.distinct_boxes(major, ["site_id"]).select("site_id", "component", "area_m2")


ENVELOPE = """en AS (SELECT site_id, CASE WHEN wx.is_extension_proven THEN 'Water-Extent Variation (expansion)' ELSE 'Water-Extent Variation (shrinkage)' END AS change_type, round_even(count(*) * 100.0, 1)::DOUBLE AS area_m2,
 round_even(min(pcol) / 32 * 100, 2)::DOUBLE AS x, round_even(min(prow) / 32 * 100, 2)::DOUBLE AS y,
 round_even(CASE WHEN wx.is_extension_proven THEN greatest(4, max(pcol) - min(pcol)) / 32 * 100 ELSE least(100 - min(pcol) / 32 * 100, greatest(6, max(pcol) - min(pcol)) / 32 * 100) END, 2)::DOUBLE AS w,
 round_even(CASE WHEN wx.is_extension_proven THEN greatest(4, max(prow) - min(prow)) / 32 * 100 ELSE least(100 - min(prow) / 32 * 100, greatest(6, max(prow) - min(prow)) / 32 * 100) END, 2)::DOUBLE AS h
 FROM w JOIN wx USING (site_id) WHERE CASE WHEN is_extension_proven THEN NOT wb AND wa WHEN is_shrinkage_proven THEN wb AND NOT wa ELSE false END GROUP BY site_id, wx.is_extension_proven HAVING count(*) >= 25)"""


@query("t07_consolidated_boxes", ["pixels"], f"""WITH {CHANGE}, {NMS}, {ENVELOPE},
wt AS (SELECT site_id, min_by(change_type, (-area_m2, component)) AS change_type, round_even(sum(area_m2), 1)::DOUBLE AS area_m2, min(x) AS x, min(y) AS y, CASE WHEN count(*) = 1 THEN max(w) ELSE round_even(least(100 - min(x), max(x + w) - min(x)), 2)::DOUBLE END AS w,
 CASE WHEN count(*) = 1 THEN max(h) ELSE round_even(least(100 - min(y), max(y + h) - min(y)), 2)::DOUBLE END AS h FROM kb WHERE contains(lower(change_type), 'water') GROUP BY site_id),
al AS (SELECT site_id, 2 AS k, component, change_type, area_m2, x, y, w, h FROM kb WHERE NOT contains(lower(change_type), 'water')
 UNION ALL SELECT site_id, 1, '', change_type, area_m2, x, y, w, h FROM wt WHERE site_id NOT IN (SELECT site_id FROM en WHERE change_type LIKE '%(shrinkage)')
 UNION ALL SELECT site_id, 0, '', change_type, area_m2, x, y, w, h FROM en WHERE change_type LIKE '%(shrinkage)' OR site_id NOT IN (SELECT site_id FROM wt WHERE change_type LIKE '%(expansion)'))
SELECT site_id, place, change_type, area_m2, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY k, area_m2 DESC, component) AS place FROM al) WHERE place <= 8""")
def t07(spark, d):
    px, features, _ = features_of(spark, d)
    major = regions.major_boxes(features, pairs.water_extent(px, ["site_id"]), ["site_id"])
    kept = regions.distinct_boxes(major, ["site_id"])
    return regions.consolidated_boxes(kept, regions.water_envelope(px, ["site_id"], SIZE, SIZE), ["site_id"])


# ---- sequences of several dates -------------------------------------------------------
BANDS = ["blue", "green", "red", "nir", "swir"]
EPOCH_PAIRS = f"""pixels AS MATERIALIZED (SELECT a.site_id * 10 + a.epoch AS site_id, a.prow, a.pcol, a.bad AS bad_b, b.bad AS bad_a, {', '.join(f'a.{n} AS {n}_b, b.{n} AS {n}_a' for n in BANDS)}
 FROM epochs a JOIN epochs b ON a.site_id = b.site_id AND a.prow = b.prow AND a.pcol = b.pcol AND b.epoch = a.epoch + 1)"""
SEQ_FEATURES = FEATURES.replace("LATEXPR", "(23 + (sh.site_id // 10) * 0.01::DOUBLE)")
TEMPORAL = f"""{SEQ_FEATURES}, fp AS MATERIALIZED (SELECT fe.site_id // 10 AS site, change_type, cc.prow, cc.pcol, min(DATE '2019-06-15' + CAST((fe.site_id % 10 + 1) * 365 AS INT)) AS date_after FROM fe JOIN cc ON cc.site_id = fe.site_id AND cc.lab = fe.lab GROUP BY ALL),
fk AS MATERIALIZED (SELECT site, change_type, prow, pcol FROM fp), {components_sql('tc', 'fk', 'site, change_type')},
tr AS (SELECT tc.site, tc.change_type, tc.lab, min(fp.date_after) AS earliest_supported_date FROM tc JOIN fp ON fp.site = tc.site AND fp.change_type = tc.change_type AND ((fp.prow = tc.prow AND fp.pcol = tc.pcol) OR (abs(fp.prow - tc.prow) = 1 AND abs(fp.pcol - tc.pcol) = 1)) GROUP BY ALL),
rg AS (SELECT site AS site_id, change_type, lab, count(*) AS area_px, round_even(count(*) * 11.132::DOUBLE * (11.132::DOUBLE * cos(radians(23 + site * 0.01::DOUBLE - (min(prow) + max(prow) + 1) / 2 * 0.0001::DOUBLE))), 1)::DOUBLE AS area_m2, earliest_supported_date FROM tc JOIN tr USING (site, change_type, lab) GROUP BY site, change_type, lab, earliest_supported_date)"""


def epoch_pairs(spark, d):
    joined = pairs.join_next_date(table(spark, d, "epochs"), ["site_id", "prow", "pcol"], "epoch", ["bad", *BANDS])
    return joined.withColumn("pair_id", c("site_id") * 10 + c("epoch")).drop("site_id", "epoch").withColumnRenamed("pair_id", "site_id")


def temporal(spark, d):
    px = pairs.classify(epoch_pairs(spark, d))
    site = F.floor(c("site_id") / 10)
    features, labelled = regions.region_features(px, ["site_id"], SIZE, SIZE, F.lit(23.0) + site * 0.01)
    pixels = labelled.join(features.select("site_id", c("label").alias("component"), "change_type"), ["site_id", "component"]).select(
        F.floor(c("site_id") / 10).alias("site"), "change_type", "prow", "pcol",
        F.date_add(F.lit("2019-06-15").cast("date"), ((F.pmod("site_id", F.lit(10)) + 1) * 365).cast("int")).alias("date_after"))
    return regions.temporal_regions(pixels.withColumnRenamed("site", "site_id"), ["site_id"], 0.0001, F.lit(23.0) + F.first("site_id") * 0.01)


@query("u02_region_union", ["epochs"], f"WITH {EPOCH_PAIRS}, {CHANGE}, {TEMPORAL} SELECT site_id, change_type, area_px, area_m2 FROM rg")
def u02(spark, d):
    return temporal(spark, d).select("site_id", "change_type", "area_px", "area_m2")


@query("j13_touching_features", ["epochs"], f"WITH {EPOCH_PAIRS}, {CHANGE}, {TEMPORAL} SELECT site_id, change_type, area_px, earliest_supported_date FROM rg")
def j13(spark, d):
    return temporal(spark, d).select("site_id", "change_type", "area_px", "earliest_supported_date")


@query("w07_earliest_date", ["epochs"], f"WITH {EPOCH_PAIRS}, {CHANGE}, {TEMPORAL} SELECT site_id, change_type, min(earliest_supported_date) AS earliest_date, count(*) AS regions FROM rg GROUP BY ALL")
def w07(spark, d):
    return temporal(spark, d).groupBy("site_id", "change_type").agg(F.min("earliest_supported_date").alias("earliest_date"), F.count(F.lit(1)).alias("regions"))


@query("a14_region_breakdown", ["epochs"], f"""WITH {EPOCH_PAIRS}, {CHANGE}, {TEMPORAL}, t AS (SELECT site_id, change_type, count(*) AS regions, sum(area_m2) AS a FROM rg GROUP BY ALL)
SELECT site_id, change_type, regions, round_even(a, 1)::DOUBLE AS area_m2, round_even(a / sum(a) OVER (PARTITION BY site_id) * 100, 1)::DOUBLE AS percent, round_even(sum(a) OVER (PARTITION BY site_id), 1)::DOUBLE AS total_area_m2 FROM t""")
def a14(spark, d):
    return regions.region_breakdown(temporal(spark, d), ["site_id"])


@query("a20_site_summary", ["epochs"], f"""WITH {EPOCH_PAIRS}, {CHANGE}, {TEMPORAL}, t AS (SELECT site_id, change_type, count(*) AS n, sum(area_m2) AS a, min(earliest_supported_date) AS f FROM rg GROUP BY ALL)
SELECT site_id, sum(n)::BIGINT AS regions, min(f) AS earliest_date, round_even(sum(a), 1)::DOUBLE AS total_area_m2, min_by(change_type, (-a, change_type)) AS dominant_type FROM t GROUP BY site_id""")
def a20(spark, d):
    return regions.site_summary(temporal(spark, d), ["site_id"])


for _name in ("n04_regions", "k02_region_events", "n05_elongation", "n06_cross_block_components", "n07_outlines", "n09_grid_regions", "t05_major_boxes", "t05_archive_boxes", "t06_distinct_boxes",
              "t07_consolidated_boxes", "u02_region_union", "j13_touching_features", "w07_earliest_date", "a14_region_breakdown", "a20_site_summary"):
    ORACLES[_name] = recursive(ORACLES[_name])
