"""Tile windows, time buckets, neighbourhoods, cloud removal, spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..fixtures import table
from ..functions import cloud, geo
from ..operators import grids, pairs, raster, spatial
from .change_plans import classified
from .filter_plans import BOX, boxed
from .registry import query
from .scalar_plans import REGION_SQL, RING_POINTS, area_ring
from .sqltext import CHANGE

c = F.col
SCENE = ["scene_id", "prow", "pcol"]

# canvas sizes derived from the parts table: 300 .. 4095 pixels a side
CANVAS = "entry_no, CAST(300 + (entry_no * 131) % 3796 AS BIGINT) AS height, CAST(300 + (entry_no * 577) % 3796 AS BIGINT) AS width"
GRID_SQL = """cv AS (SELECT CANVAS FROM registry), sz AS (SELECT *, least(512, height, width) AS size, greatest(1, CAST(round_even(least(512, height, width) * 0.9::DOUBLE, 0) AS BIGINT)) AS st FROM cv),
ys AS (SELECT *, unnest(CASE WHEN height <= size THEN [0::BIGINT] ELSE list_sort(list_distinct(list_append(range(0, height - size + 1, st), height - size))) END) AS y0 FROM sz),
xs AS (SELECT *, unnest(CASE WHEN width <= size THEN [0::BIGINT] ELSE list_sort(list_distinct(list_append(range(0, width - size + 1, st), width - size))) END) AS x0 FROM ys),
wn AS (SELECT entry_no, height, width, size, y0, x0, row_number() OVER (PARTITION BY entry_no ORDER BY y0, x0) AS window_no FROM xs)""".replace("CANVAS", CANVAS)


def canvases(spark, d):
    return table(spark, d, "registry").selectExpr(*[e if i == 0 else "CAST(" + e for i, e in enumerate(CANVAS.split(", CAST("))])


@query("g02_tile_windows", ["registry"], f"WITH {GRID_SQL} SELECT entry_no, size, y0, x0, window_no FROM wn")
def g02(spark, d):
    return grids.tile_windows(canvases(spark, d), ["entry_no"], 512, 0.10).select("entry_no", "size", "y0", "x0", "window_no")


@query("g03_window_bounds", ["registry"], f"""WITH {GRID_SQL} SELECT entry_no, window_no, round(72 + x0 * 0.0001::DOUBLE, 9) AS min_lon, round(72 + (x0 + size) * 0.0001::DOUBLE, 9) AS max_lon, round(23 - (y0 + size) * 0.0001::DOUBLE, 9) AS min_lat, round(23 - y0 * 0.0001::DOUBLE, 9) AS max_lat,
 round_even((72 + x0 * 0.0001::DOUBLE + (72 + (x0 + size) * 0.0001::DOUBLE)) / 2 + 1e-8, 6)::DOUBLE AS centroid_lon FROM wn WHERE 72 + x0 * 0.0001::DOUBLE <= 72.21 AND 72 + (x0 + size) * 0.0001::DOUBLE >= 72.05 AND 23 - (y0 + size) * 0.0001::DOUBLE <= 22.95 AND 23 - y0 * 0.0001::DOUBLE >= 22.72""")
def g03(spark, d):
    df = grids.window_bounds(grids.tile_windows(canvases(spark, d), ["entry_no"], 512, 0.10), F.lit(72.0), F.lit(23.0), 0.0001)
    box = tuple(c(n) for n in ("min_lon", "min_lat", "max_lon", "max_lat"))
    # clip to an area of interest
    x0, y0, x1, y1 = area = 72.05, 22.72, 72.21, 22.95
    ring = [(x1, y0), (x1, y1), (x0, y1), (x0, y0), (x1, y0)]
    df = df.where(geo.boxes_intersect(box, tuple(map(F.lit, area)))).where(geo.fixed_ring_intersects_box(ring, *box))
    middle = F.bround((c("min_lon") + c("max_lon")) / 2 + 1e-8, 6)
    return df.select("entry_no", "window_no", *[F.round(n, 9).alias(n) for n in ("min_lon", "max_lon", "min_lat", "max_lat")], middle.alias("centroid_lon"))


@query("g04_pixels_by_window", ["canvas"], """WITH o AS (SELECT unnest([0, 12, 18]) AS v)
SELECT scene_id, y.v::BIGINT AS y0, x.v::BIGINT AS x0, count(*) AS pixels, round(avg(bad::INT::DOUBLE), 9) AS bad_share FROM canvas JOIN o y ON prow >= y.v AND prow < y.v + 14 JOIN o x ON pcol >= x.v AND pcol < x.v + 14 GROUP BY ALL""")
def g04(spark, d):
    df = grids.pixels_by_window(table(spark, d, "canvas"), F.lit(32), F.lit(32), 14, 0.15)
    return df.groupBy("scene_id", "y0", "x0").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg(c("bad").cast("double")), 9).alias("bad_share"))


@query("g01_time_buckets", ["obs"], """WITH s AS (SELECT site_key, min(acquisition_date)::DATE AS d0, max(acquisition_date)::DATE AS d1, CAST(replace(site_key, 'site_', '') AS BIGINT) % 4 + 1 AS want FROM obs GROUP BY site_key),
n AS (SELECT *, date_diff('day', d0, d1) AS days, greatest(1, least(CASE WHEN want = 1 THEN 2 ELSE 4 END, date_diff('day', d0, d1))) AS n FROM s),
b AS (SELECT site_key, i, n, days, d0, d1, CASE WHEN days <= 0 THEN 'bucket_single' WHEN n = 2 THEN CASE i WHEN 0 THEN 'historical_T1' ELSE 'recent_T2' END ELSE 'time_bucket_' || (i + 1) END AS bucket,
 CASE WHEN days <= 0 THEN d0 ELSE d0 + CAST(floor(i * (days / n)) AS INT) END AS bucket_start, CASE WHEN days <= 0 OR i = n - 1 THEN d1 ELSE d0 + CAST(floor((i + 1) * (days / n)) - 1 AS INT) END AS bucket_end FROM n, unnest(range(0, CASE WHEN days <= 0 THEN 1 ELSE n END)) AS u(i))
SELECT b.site_key, bucket, bucket_start::DATE AS bucket_start, bucket_end::DATE AS bucket_end, count(o.tile_id) AS scenes FROM b LEFT JOIN obs o ON o.site_key = b.site_key AND o.acquisition_date::DATE BETWEEN bucket_start AND bucket_end GROUP BY ALL""")
def g01(spark, d):
    tiles = table(spark, d, "obs")
    ranges = tiles.groupBy("site_key").agg(F.min("acquisition_date").cast("date").alias("d0"), F.max("acquisition_date").cast("date").alias("d1"))
    two = F.expr("CAST(replace(site_key, 'site_', '') AS BIGINT) % 4 = 0")
    buckets = grids.time_buckets(ranges.where(two), "d0", "d1", 2).unionByName(grids.time_buckets(ranges.where(~two), "d0", "d1", 4))
    day = tiles.select("site_key", "tile_id", c("acquisition_date").cast("date").alias("day"))
    # buckets of a site are few; the equi-join on site with a range filter keeps all buckets
    cond = (c("b.site_key") == c("o.site_key")) & c("o.day").between(c("b.bucket_start"), c("b.bucket_end"))
    # counted over an inner join, whose large side may be split, then joined to the empty buckets
    keys = ["site_key", "bucket", "bucket_start", "bucket_end"]
    counts = day.alias("o").join(buckets.alias("b"), cond).groupBy(*[f"b.{k}" for k in keys]).agg(F.count("o.tile_id").alias("scenes"))
    return buckets.select(*keys).join(counts, keys, "left").withColumn("scenes", F.coalesce("scenes", F.lit(0).cast("bigint")))


@query("g06_sample_grid", ["pixels"], f"""WITH {CHANGE} SELECT site_id, prow // 2 AS grid_row, string_agg(printf('%.3f', ndvi_b), ',' ORDER BY pcol) AS ndvi, string_agg(class_a, ',' ORDER BY pcol) AS classes FROM ver WHERE prow % 2 = 0 AND pcol % 2 = 0 GROUP BY ALL""")
def g06(spark, d):
    df = grids.sample_grid(classified(spark, d).withColumn("v", F.format_string("%.3f", "ndvi_b")), ["site_id"], ["v", "class_a"], 2)
    return df.select("site_id", "grid_row", F.concat_ws(",", "v").alias("ndvi"), F.concat_ws(",", "class_a").alias("classes"))


@query("g08_regrid_nearest", ["clouds"], """WITH t AS (SELECT unnest(range(0, 20)) AS i) SELECT scene_id, y.i AS trow, x.i AS tcol, red FROM clouds JOIN t y ON prow = floor((y.i + 0.5) * 1.6) JOIN t x ON pcol = floor((x.i + 0.5) * 1.6)""")
def g08(spark, d):
    return grids.regrid_nearest(table(spark, d, "clouds"), ["scene_id"], ["red"], 32, 20)


@query("g08_regrid_bilinear", ["clouds"], """WITH t AS (SELECT i, least(greatest((i + 0.5::DOUBLE) * (32 / 50) - 0.5, 0), 31) AS at FROM (SELECT unnest(range(0, 50)) AS i))
SELECT scene_id, y.i AS trow, x.i AS tcol, round(sum(red * (1 - abs(y.at - prow)) * (1 - abs(x.at - pcol))), 6) AS red FROM clouds JOIN t y ON abs(y.at - prow) < 1 JOIN t x ON abs(x.at - pcol) < 1 GROUP BY ALL""")
def g08b(spark, d):
    return grids.regrid_bilinear(table(spark, d, "clouds"), ["scene_id"], ["red"], 32, 50).withColumn("red", F.round("red", 6))


@query("n01_shadows", ["canvas"], """WITH s AS (SELECT scene_id, prow, pcol, noise % 17 = 0 AS cloud, (red + green + blue) / 3 AS vis, nir FROM canvas), m AS (SELECT scene_id, max(vis) FILTER (WHERE NOT isnan(vis)) AS top FROM s GROUP BY scene_id),
k AS (SELECT s.*, vis < CASE WHEN top <= 1.5 THEN 0.045 ELSE 450 END AND nir < CASE WHEN top <= 1.5 THEN 0.0675 ELSE 675 END AS dark FROM s JOIN m USING (scene_id)),
o AS (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest(range(-25, 26, 4)) AS i) a, (SELECT unnest(range(-25, 26, 4)) AS i) b WHERE a.i * a.i + b.i * b.i <= 625), n AS (SELECT DISTINCT scene_id, prow + dr AS prow, pcol + dc AS pcol FROM k, o WHERE cloud)
SELECT k.scene_id, k.prow, k.pcol, dark AND NOT cloud AND n.scene_id IS NOT NULL AS shadow FROM k LEFT JOIN n ON n.scene_id = k.scene_id AND n.prow = k.prow AND n.pcol = k.pcol""")
def n01(spark, d):
    df = grids.dark_pixels(table(spark, d, "canvas").withColumn("cloud", c("noise") % 17 == 0), ["scene_id"])
    return grids.shadow_mask(df.select(*SCENE, "cloud", "dark"), ["scene_id"], "cloud", "dark")


MORPH = """sd AS (SELECT scene_id, prow, pcol, prob, prob >= 0.7 OR cloud AS seed FROM clouds), o AS (SELECT a.i AS dr, b.i AS dc FROM (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS i) b),
nb AS (SELECT s.scene_id, s.prow, s.pcol, count(*) FILTER (WHERE t.seed AND abs(dr) <= 1 AND abs(dc) <= 1) = 9 AS core, bool_or(t.seed) AS zone FROM sd s, o, sd t WHERE t.scene_id = s.scene_id AND t.prow = s.prow + dr AND t.pcol = s.pcol + dc GROUP BY ALL)"""


@query("n02_morphology", ["clouds"], f"WITH {MORPH} SELECT * FROM nb")
def n02(spark, d):
    df = table(spark, d, "clouds").select(*SCENE, ((c("prob") >= K.THICK_PROB) | c("cloud")).alias("seed"))
    return grids.morphology(df, ["scene_id"], "seed")


@query("n03_trimap", ["clouds"], f"WITH {MORPH} SELECT scene_id, prow, pcol, CASE WHEN core THEN 255 WHEN zone AND prob >= 0.2 THEN 128 ELSE 0 END AS trimap FROM nb JOIN sd USING (scene_id, prow, pcol)")
def n03(spark, d):
    return grids.trimap(table(spark, d, "clouds"), ["scene_id"], "prob", "cloud")


@query("n08_gaussian_fill", ["clouds"], """WITH k AS (SELECT i, exp(-0.5 * (i / 3.0::DOUBLE) * (i / 3.0::DOUBLE)) AS g FROM (SELECT unnest(range(-12, 13)) AS i)), wk AS (SELECT i, g / (SELECT sum(g) FROM k) AS w FROM k), s AS (SELECT scene_id, max(prow) + 1 AS hh FROM clouds GROUP BY scene_id),
v AS (SELECT a.scene_id, a.prow, a.pcol, sum(b.red * w) AS red FROM clouds a JOIN s USING (scene_id), wk, clouds b WHERE b.scene_id = a.scene_id AND b.pcol = a.pcol AND b.prow = CASE WHEN (a.prow + i + 4 * hh) % (2 * hh) >= hh THEN 2 * hh - 1 - (a.prow + i + 4 * hh) % (2 * hh) ELSE (a.prow + i + 4 * hh) % (2 * hh) END GROUP BY ALL),
h AS (SELECT a.scene_id, a.prow, a.pcol, sum(b.red * w) AS red FROM v a, wk, v b WHERE b.scene_id = a.scene_id AND b.prow = a.prow AND b.pcol = CASE WHEN (a.pcol + i + 128) % 64 >= 32 THEN 63 - (a.pcol + i + 128) % 64 ELSE (a.pcol + i + 128) % 64 END GROUP BY ALL)
SELECT c.scene_id, c.prow, c.pcol, round(CASE WHEN prob >= 0.7 THEN h.red ELSE c.red END, 6) AS red FROM clouds c JOIN h USING (scene_id, prow, pcol)""")
def n08(spark, d):
    df = table(spark, d, "clouds").select(*SCENE, "red", (c("prob") >= K.THICK_PROB).alias("thick"))
    return grids.gaussian_fill(df, ["scene_id"], ["red"], "thick").withColumn("red", F.round("red", 6))


@query("j12_temporal_fill", ["clouds"], """SELECT scene_id, prow, pcol, CASE WHEN prob >= 0.7 AND noise % 4 <> 0 THEN red_later ELSE red END AS red, CASE WHEN prob >= 0.7 THEN CASE WHEN noise % 4 <> 0 THEN 2 ELSE 3 END WHEN prob >= 0.2 OR cloud THEN 1 ELSE 0 END AS provenance FROM clouds""")
def j12(spark, d):
    from ..operators.removal import temporal_fill
    px = table(spark, d, "clouds")
    later = px.where("noise % 4 <> 0").select(*SCENE, c("red_later").alias("red"))
    px = px.withColumn("region", cloud.cloud_region(c("prob"), c("cloud")))
    return temporal_fill(px, later, ["scene_id"], ["red"]).select(*SCENE, "red", "provenance")


@query("cloud_removal", ["clouds"], f"""WITH {MORPH}, rd AS (SELECT scene_id, coalesce(quantile_cont(red, 0.9) FILTER (WHERE prob >= 0.7), 235) AS cl FROM clouds GROUP BY scene_id),
p AS (SELECT c.scene_id, c.prow, c.pcol, c.red, c.prob, CASE WHEN c.prob >= 0.70 THEN 3 WHEN c.prob >= 0.45 THEN 2 WHEN c.prob >= 0.20 OR c.cloud THEN 1 ELSE 0 END AS region, cl, CASE WHEN core THEN 1 WHEN zone AND c.prob >= 0.2 THEN 0.05 + 0.9 * (0.5 * (1 - cos(pi() * greatest(0, least(1, (c.prob - 0.20) / 0.5))))) ELSE 0 END AS alpha FROM clouds c JOIN nb USING (scene_id, prow, pcol) JOIN rd USING (scene_id))
SELECT scene_id, prow, pcol, CASE WHEN region IN (1, 2) THEN 1 WHEN region = 3 THEN 3 ELSE 0 END AS provenance, round(CASE WHEN region IN (1, 2) THEN greatest(0, least(255, (red - alpha * cl) / greatest(0.10, least(1, 1 - alpha + 0.05)))) ELSE red END, 6) AS red FROM p""")
def cloud_removal(spark, d):
    from ..operators.removal import remove_clouds
    out = remove_clouds(table(spark, d, "clouds"), ["scene_id"])
    return out.select(*SCENE, "provenance", F.round("red", 6).alias("red"))


AREA_EDGES = " UNION ALL ".join(f"SELECT aoi_id, {a} AS px, {b} AS py, {p} AS qx, {q} AS qy FROM areas" for (a, b), (p, q) in zip(RING_POINTS, RING_POINTS[1:] + RING_POINTS[:1]))
_S = lambda x, y: f"((qx - px) * ({y} - py) - (qy - py) * ({x} - px))"
_CORNERS = ", ".join(_S(x, y) for x, y in (("min_lon", "min_lat"), ("min_lon", "max_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat")))


@query("j02_tiles_in_areas", ["obs", "areas"], f"""WITH b AS (SELECT tile_id, centroid_lon, centroid_lat, {BOX} FROM obs), bx AS (SELECT DISTINCT min_lon, min_lat, max_lon, max_lat FROM b), e AS ({AREA_EDGES}),
h AS (SELECT bx.*, e.aoi_id, bool_or(least(px, qx) <= max_lon AND greatest(px, qx) >= min_lon AND least(py, qy) <= max_lat AND greatest(py, qy) >= min_lat AND least({_CORNERS}) <= 0 AND greatest({_CORNERS}) >= 0)
 OR (count(*) FILTER (WHERE (py > min_lat) <> (qy > min_lat) AND min_lon < (qx - px) * (min_lat - py) / (qy - py) + px)) % 2 = 1 AS hit FROM bx, e GROUP BY ALL)
SELECT tile_id, aoi_id FROM b JOIN h USING (min_lon, min_lat, max_lon, max_lat) WHERE hit""")
def j02(spark, d):
    ring = area_ring()
    bounds = geo.ring_bounds(ring)
    areas = table(spark, d, "areas").select("aoi_id", geo.polygon_edges(F.array(ring)).alias("edges"),
                                            *[e.alias(n) for e, n in zip(bounds, ("min_lon", "min_lat", "max_lon", "max_lat"))])
    return spatial.tiles_in_areas(boxed(spark, d), areas)


@query("j10_nearest_release", ["obs"], """WITH r(y, r) AS (VALUES (2020, '6049'), (2021, '10020'), (2022, '14458'), (2023, '18092'), (2024, '20112'), (2025, '24200'), (2026, '26334')), o AS (SELECT tile_id, CAST(2014 + obs_id % 17 AS INT) AS year FROM obs)
SELECT tile_id, year, min_by(y, (abs(y - year), y)) AS release_year, min_by(r, (abs(y - year), y)) AS release_id FROM o, r GROUP BY ALL""")
def j10(spark, d):
    df = table(spark, d, "obs").selectExpr("tile_id", "CAST(2014 + obs_id % 17 AS INT) AS year")
    return spatial.nearest_release(df, "year", K.RELEASE_YEARS)


@query("j16_web_tile_cover", ["areas"], """WITH b AS (SELECT aoi_id, aoi_no, least(x1,x2,x3,x4) AS lo, least(y1,y2,y3,y4) AS la, greatest(x1,x2,x3,x4) AS lo2, greatest(y1,y2,y3,y4) AS la2 FROM areas),
z AS (SELECT *, CASE WHEN greatest(lo2 - lo, la2 - la) <= 0.025 THEN 18 WHEN greatest(lo2 - lo, la2 - la) <= 0.07 THEN 17 ELSE 16 END AS zoom FROM b),
t AS (SELECT *, CAST(floor((lo + 180) / 360 * pow(2, zoom)) AS BIGINT) AS xa, CAST(floor((lo2 + 180) / 360 * pow(2, zoom)) AS BIGINT) AS xb, CAST(floor((1 - asinh(tan(radians(la2))) / pi()) / 2 * pow(2, zoom)) AS BIGINT) AS ya, CAST(floor((1 - asinh(tan(radians(la))) / pi()) / 2 * pow(2, zoom)) AS BIGINT) AS yb FROM z),
x AS (SELECT *, unnest(range(xa, xb + 1)) AS x FROM t), y AS (SELECT aoi_id, zoom, x, unnest(range(ya, yb + 1)) AS y FROM x) SELECT aoi_id, zoom, x, y, (x + y) % 3 = 0 AS fetched FROM y""")
def j16(spark, d):
    box = geo.ring_bounds(area_ring())
    areas = table(spark, d, "areas").select("aoi_id", *[e.alias(n) for e, n in zip(box, ("min_lon", "min_lat", "max_lon", "max_lat"))])
    areas = areas.withColumn("zoom", geo.zoom_for_span(F.greatest(c("max_lon") - c("min_lon"), c("max_lat") - c("min_lat"))))
    needed = spatial.web_tile_cover(areas, spark.createDataFrame([], "zoom int, x bigint, y bigint"))
    fetched = needed.where("(x + y) % 3 = 0").select("zoom", "x", "y").distinct()
    return spatial.web_tile_cover(areas, fetched)


@query("t08_ranked_scenes", ["items"], """WITH o AS (SELECT item_id, item_no, cloud_cover, greatest(0, least(max_lon, 70.9) - greatest(min_lon, 70.6)) * greatest(0, least(max_lat, 20.9) - greatest(min_lat, 20.6)) / ((70.9 - 70.6)::DOUBLE * (20.9 - 20.6)::DOUBLE) * 100 AS ov FROM items)
SELECT item_id, item_no, round_even(abs(cloud_cover - 12.0), 2)::DOUBLE AS cloud_distance, round(ov, 6) AS overlap_pct FROM o WHERE ov >= 90""")
def t08(spark, d):
    df = spatial.ranked_candidates(table(spark, d, "items"), tuple(F.lit(v) for v in (70.6, 20.6, 70.9, 20.9)), 12.0)
    return df.select("item_id", "item_no", "cloud_distance", F.round("overlap_pct", 6).alias("overlap_pct")).orderBy("cloud_distance", c("overlap_pct").desc(), "item_no")


@query("j06_tile_key_repair", ["obs", "vectors"], """SELECT o.obs_id, v.tile_id AS tile_before FROM (SELECT obs_id, CASE WHEN obs_id % 2 = 0 THEN tile_id ELSE tile_id || '_gone' END AS t FROM obs) o LEFT JOIN vectors v ON v.tile_id = o.t""")
def j06(spark, d):
    from ..operators.events import repair_tile_ids
    events = table(spark, d, "obs").selectExpr("obs_id", "CASE WHEN obs_id % 2 = 0 THEN tile_id ELSE concat(tile_id, '_gone') END AS tile_before")
    return repair_tile_ids(events, table(spark, d, "vectors"), ["tile_before"]).select("obs_id", "tile_before")


@query("j11_cached_pairs", ["obs"], """WITH r AS (SELECT site_key, obs_id AS before_id, lead(obs_id) OVER (PARTITION BY site_key ORDER BY acquisition_date, obs_id) AS after_id FROM obs), p AS (SELECT * FROM r WHERE after_id IS NOT NULL)
SELECT site_key, before_id, after_id, CASE WHEN (before_id + after_id) % 3 = 0 THEN 'cached' ELSE 'compute' END AS action FROM p""")
def j11(spark, d):
    from ..operators import timeline
    from ..operators.events import plan_pairs
    wanted = timeline.consecutive_pairs(table(spark, d, "obs"), ["site_key"], "acquisition_date", "obs_id", []).select("site_key", "before_id", "after_id")
    stored = wanted.where("(before_id + after_id) % 3 = 0")
    return plan_pairs(wanted, stored, ["site_key", "before_id", "after_id"])


@query("g07_season_windows", ["areas"], """SELECT aoi_id, year, year || '-07-01/' || year || '-10-31' AS date_range FROM areas, unnest([2017, 2020, 2023]) AS u(year)""")
def g07(spark, d):
    df = table(spark, d, "areas").selectExpr("aoi_id", "array(2017, 2020, 2023) AS target_years", "'07-01/10-31' AS seasonal_window")
    return grids.season_windows(df, "target_years", "seasonal_window").select("aoi_id", "year", "date_range")


@query("x03_mean_vari", ["clouds"], """WITH v AS (SELECT scene_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (green - red) / CASE WHEN green + red - blue = 0 THEN 1e-6::DOUBLE ELSE green + red - blue END)) AS vari FROM clouds)
SELECT scene_id, round_even(avg(vari), 4)::DOUBLE AS mean_vari FROM v GROUP BY scene_id""")
def x03_mean(spark, d):
    return raster.vari_mean(table(spark, d, "clouds"), ["scene_id"])
