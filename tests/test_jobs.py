"""Distributed operators against brute force on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.functions import cloud
from tilewright.operators import clusters, components, events, grids, pairs, ranges, regions, search, spatial, timeline, vectors
from tilewright.sources import readers, sinks
from tilewright.streaming import jobs


def flood(cells):
    """4-connected components by flood fill."""
    left, found = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            for n in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        found.append(frozenset(part))
    return set(found)


@pytest.mark.parametrize("block", [5, 512])
def test_components_equal_flood_fill_for_any_block(spark, block):
    rng = random.Random(3)
    cells = [(r, c) for r in range(24) for c in range(24) if rng.random() < 0.6]
    df = spark.createDataFrame([("s", r, c) for r, c in cells], "site string, prow bigint, pcol bigint")
    got = {}
    for row in regions.label_components(df, ["site"], block).collect():
        got.setdefault(row.component, set()).add((row.prow, row.pcol))
    assert {frozenset(v) for v in got.values()} == flood(cells)


def test_component_names_on_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
    names = components.connected(spark.createDataFrame([(i,) for i in list(range(61)) + list(range(1000, 1080)) + [5000]], "id bigint"),
                                 spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r.id: r.component for r in names.collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1080)) and got[5000] == 5000


def ring_area(points):
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(points, points[1:])) / 2


@pytest.fixture(scope="module")
def drawn(spark):
    """Random cells, a ring that crosses every block, and parts that touch in corners."""
    rng = random.Random(5)
    cells = {(r, c) for r in range(20) for c in range(20) if rng.random() < 0.65}
    cells |= {(r, c) for r in range(30, 58) for c in range(30, 58) if r in (30, 57) or c in (30, 57) or (r, c) in ((33, 33), (34, 34), (34, 35))}
    df = spark.createDataFrame([("s", r, c) for r, c in sorted(cells)], "site string, prow bigint, pcol bigint")
    return regions.label_components(df, ["site"])


def test_outlines_enclose_exactly_the_pixels_for_any_block(spark, drawn):
    pixels = {r.component: r.n for r in drawn.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = []
    for block in (5, 8, 512):
        rings = {}
        for row in regions.outlines(drawn, ["site"], block).collect():
            assert row.points[0] == row.points[-1] and (ring_area(row.points) > 0) == (row.ring == 0)
            rings.setdefault(row.component, {})[row.ring] = tuple(map(tuple, row.points))
        assert {k: sum(map(ring_area, v.values())) for k, v in rings.items()} == pixels
        assert all(sorted(v) == list(range(len(v))) for v in rings.values())
        seen.append(rings)
    assert seen[0] == seen[1] == seen[2]


def test_thin_construction_becomes_a_road_and_small_parts_drop(spark):
    def block(r0, r1, c0, c1):
        return [(r, c) for r in range(r0, r1) for c in range(c0, c1)]
    cells = block(5, 65, 10, 14) + block(70, 90, 40, 60) + block(0, 2, 90, 95)
    df = spark.createDataFrame([("s", r, c) for r, c in cells], "site string, prow bigint, pcol bigint").withColumns({
        "verified": F.lit(True), "change_type": F.lit(K.CONSTRUCTION), "class_b": F.lit(K.BARE_SOIL), "class_a": F.lit(K.BUILT_UP),
        **{f"{n}_{s}": F.lit(0.1) for s in "ba" for n in ("ndvi", "ndbi", "ndwi")}})
    features, _ = regions.region_features(df, ["site"], 100, 100, F.lit(23.0))
    got = {r.area_px: r.change_type for r in features.collect()}
    assert got == {240: K.ROAD, 400: K.CONSTRUCTION}


def greedy(boxes):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[1], b[0])):
        def iou(a):
            w = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
            h = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
            return w * h / (a[4] * a[5] + b[4] * b[5] - w * h)
        if len(kept) < K.MAX_BOXES and all(iou(a) <= K.NMS_IOU for a in kept):
            kept.append(b)
    return {b[0] for b in kept}


@pytest.mark.parametrize("window", [3, 64])
def test_box_suppression_equals_the_loop_for_any_pass_size(spark, window):
    rng = random.Random(11)
    boxes = {p: [(f"c{i}", float(rng.randint(1, 40)), rng.uniform(0, 30), rng.uniform(0, 30), 20.0, 20.0) for i in range(40)] for p in ("p", "q")}
    df = spark.createDataFrame([(p, *b) for p, bs in boxes.items() for b in bs], "pair string, component string, area_m2 double, x double, y double, w double, h double")
    got = {}
    for r in regions.distinct_boxes(df, ["pair"], window).collect():
        got.setdefault(r.pair, set()).add(r.component)
    assert got == {p: greedy(bs) for p, bs in boxes.items()}


def test_neighbours_are_the_same_broadcast_and_blocked(spark):
    rng = np.random.default_rng(0)
    data = [(f"t{i}", [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((120, 8)))]
    v = spark.createDataFrame(data, "tile_id string, embedding array<float>")
    q = v.select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = {(r.query_id, r.place): r.tile_id for r in vectors.nearest(q, v, 5).collect()}
    partial = vectors._block_scores(q, v, 5, [], 50)
    from pyspark.sql import Window
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "tile_id")
    blocked = {(r.query_id, r.place): r.tile_id for r in partial.withColumn("place", F.row_number().over(place)).where("place <= 5").collect()}
    assert whole == blocked
    m = np.array([d[1] for d in data], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(m @ m.T), axis=1)[:, :5]
    assert all(whole[(f"t{i}", k + 1)] == f"t{best[i, k]}" for i in range(120) for k in range(5))
    close = vectors.approximate_nearest(q, v, 5, tables=40, bits=2)
    found = {(r.query_id, r.tile_id) for r in close.collect()}
    assert len(found & {(f"t{i}", f"t{j}") for i in range(120) for j in best[i]}) / 600 > 0.95


def test_registered_neighbour_settings_reach_the_recall(spark):
    m = np.random.default_rng(3).standard_normal((300, 64))
    v = spark.createDataFrame([(f"t{i}", [float(x) for x in p]) for i, p in enumerate(m)], "tile_id string, embedding array<double>")
    q = v.select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(m @ m.T), axis=1)[:, :8]
    found = {(r.query_id, r.tile_id) for r in vectors.approximate_nearest(q, v, 8).collect()}
    assert len(found & {(f"t{i}", f"t{j}") for i in range(300) for j in best[i]}) / 2400 >= 0.9


def test_density_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((3, 6))
    points = np.concatenate([c + 0.05 * rng.standard_normal((25, 6)) for c in centres] + [rng.standard_normal((6, 6)), np.repeat(centres[:1], 5, 0)])
    df = spark.createDataFrame([(f"t{i}", [float(x) for x in p]) for i, p in enumerate(points)], "tile_id string, embedding array<double>")
    radius, least = 0.25, 5
    got = {r.tile_id: r.label for r in clusters.density_labels(df, radius, least, least, pivots=4, block_rows=10).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = np.linalg.norm(unit[:, None] - unit[None], axis=2) <= radius
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(points)), -1)
    for _ in range(len(points)):
        for i in np.nonzero(core)[0]:
            label[i] = min(label[j] for j in np.nonzero(near[i] & core)[0])
    groups = lambda names: {frozenset(k for k, v in names.items() if v == g) for g in set(names.values()) if g != -1}
    assert groups(got) == groups({f"t{i}": int(x) for i, x in enumerate(label)})
    assert {k for k, v in got.items() if v == -1} == {f"t{i}" for i, x in enumerate(label) if x == -1}


def test_sequence_over_spans_equals_one_window(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else f"s{rng.randint(0, 3)}", i, f"20{rng.randint(19, 23)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} 10:00:00", rng.random()) for i in range(300)]
    df = spark.createDataFrame(data, "site string, id int, d string, v double").selectExpr("site", "id", "CAST(d AS TIMESTAMP_NTZ) AS d", "v")
    got = {r.id: (r.epoch_index, r.next_row.id if r.next_row else None, round(r.running_sum_v, 9)) for r in timeline.in_sequence(df, ["site"], "d", "id", ["v"], ["v"]).collect()}
    expected = {}
    by_site = {}
    for site, i, d, v in data:
        by_site.setdefault(site, []).append((d, i, v))
    for items in by_site.values():
        items.sort()
        total = 0.0
        for k, (_, i, v) in enumerate(items):
            total += v
            expected[i] = (k, items[k + 1][1] if k + 1 < len(items) else None, round(total, 9))
    assert got == expected


@pytest.mark.parametrize("block", [7, 512])
def test_shadow_and_dilation_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(4)
    cloud, dark = rng.random((40, 40)) < 0.01, rng.random((40, 40)) < 0.5
    df = spark.createDataFrame([("s", r, c, bool(cloud[r, c]), bool(dark[r, c])) for r in range(40) for c in range(40)], "scene string, prow bigint, pcol bigint, cloud boolean, dark boolean")
    got = {(r.prow, r.pcol) for r in grids.shadow_mask(df, ["scene"], "cloud", "dark", radius=6, step=4, block=block).where("shadow").collect()}
    steps = [(a, b) for a in range(-6, 7, 4) for b in range(-6, 7, 4) if a * a + b * b <= 36]
    near = {(r + a, c + b) for r, c in zip(*np.nonzero(cloud)) for a, b in steps}
    assert got == {(r, c) for r in range(40) for c in range(40) if dark[r, c] and not cloud[r, c] and (r, c) in near}
    zone = {(r.prow, r.pcol) for r in grids.morphology(df, ["scene"], "cloud", block=block).where("zone").collect()}
    assert zone == {(r + a, c + b) for r, c in zip(*np.nonzero(cloud)) for a in range(-2, 3) for b in range(-2, 3) if 0 <= r + a < 40 and 0 <= c + b < 40}


def test_large_and_small_areas_give_each_pair_once(spark):
    tiles = spark.createDataFrame([(f"t{i}", 0.3 * i, 0.2 * i, 0.3 * i + 0.3, 0.2 * i + 0.3) for i in range(60)], "tile_id string, min_lon double, min_lat double, max_lon double, max_lat double")
    from tilewright.functions import geo
    boxes = [("small", 1.0, 0.5, 2.0, 1.5), ("large", -5.0, -5.0, 14.0, 9.0)]
    areas = spark.createDataFrame(boxes, "aoi_id string, min_lon double, min_lat double, max_lon double, max_lat double").withColumn(
        "edges", geo.polygon_edges(F.array(geo.box_ring(*[F.col(n) for n in ("min_lon", "min_lat", "max_lon", "max_lat")]))))
    got = sorted((r.tile_id, r.aoi_id) for r in spatial.tiles_in_areas(tiles, areas).collect())
    want = sorted((f"t{i}", n) for i in range(60) for n, x0, y0, x1, y1 in boxes if 0.3 * i <= x1 and 0.3 * i + 0.3 >= x0 and 0.2 * i <= y1 and 0.2 * i + 0.3 >= y0)
    assert got == want


def test_distinct_places_keep_rank_order_and_distance(spark):
    rng = random.Random(9)
    data = [("q", k, f"t{k}", f"s{rng.randint(0, 30)}", 20 + rng.randint(0, 20) / 1000, 70 + rng.randint(0, 20) / 1000, 1 - k / 100) for k in range(50)]
    df = spark.createDataFrame(data, "query_id string, rank int, tile_id string, site_key string, centroid_lat double, centroid_lon double, score double")
    kept = []
    for row in data:
        if len(kept) < 7 and all(row[3] != k[3] and not (abs(row[4] - k[4]) < 0.002 and abs(row[5] - k[5]) < 0.002) for k in kept):
            kept.append(row)
    got = [r.tile_id for r in search.spatially_distinct(df, 7).orderBy("rank").collect()]
    assert got == [k[2] for k in kept]


def test_upsert_is_idempotent_and_large_lists_split(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, batch int")
    new = spark.createDataFrame([("b", 3, 1), ("c", 4, 1)], "k string, v int, batch int")
    once = sinks.upsert(old, new, ["k"], "batch")
    assert sorted(map(tuple, sinks.upsert(once, new, ["k"], "batch").collect())) == sorted(map(tuple, once.collect())) == [("a", 1, 0), ("b", 3, 1), ("c", 4, 1)]
    docs = sinks.manifests(spark.range(100).select(F.lit("r").alias("run"), "id"), ["run"], F.struct("id"), F.col("id"), part_rows=30).collect()
    assert {d.part: [t.id for t in d.tiles] for d in docs} == {k: list(range(30 * k, min(30 * k + 30, 100))) for k in range(4)} and {d.total_tiles for d in docs} == {100}


def test_features_of_one_large_site_keep_their_numbers(spark):
    rows = spark.range(25000, numPartitions=4).select(F.when(F.col("id") < 24000, "big").otherwise("small").alias("site"), (F.col("id") * 7919 % 25000).alias("n"))
    stored = sinks.manifests(rows, ["site"], F.struct("n"), F.col("n")).select("site", "part", F.col("tiles").alias("features"))
    got = events.explode_features(stored, ["site"]).collect()
    for site in ("big", "small"):
        own = sorted((r.feature_no, r.n) for r in got if r.site == site)
        assert [k for k, _ in own] == list(range(len(own))) and [n for _, n in own] == sorted(n for _, n in own)
    assert len(got) == 25000


def test_row_numbers_of_null_keys(spark):
    rows = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(7)], "k string, v int")
    got = ranges.numbered(rows, ["k"], -F.col("v")).collect()
    assert {(r.k, r.v, r.row_no) for r in got} == {(None, i, 49 - i) for i in range(50)} | {("a", i, 6 - i) for i in range(7)}


def test_cloud_score_without_bands(spark):
    bands = ("blue", "green", "red", "nir", "swir")
    rows = [(3000.0, None, 3200.0, None, None), (3000.0, 3100.0, 3200.0, 3200.0, 1600.0), (3000.0, 3100.0, float("nan"), 1.0, 1.0), (3000.0, 3100.0, -9999.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{b} double" for b in bands))
    got = [r.p for r in df.select(cloud.cloud_probability(*[F.col(b) for b in bands]).alias("p")).collect()]
    assert got[0] == got[1] > 0 and got[2] is None and got[3] is None


def test_observations_without_date_are_kept(spark):
    rows = spark.createDataFrame([("s", None, "x", 0.5)] + [("s", f"2024-0{m}-01", f"t{m}", 0.1) for m in (1, 2, 3)], "site string, day string, tile string, ndvi double").withColumn("day", F.col("day").cast("date"))
    got = timeline.in_sequence(rows, ["site"], "day", "tile", ["ndvi"]).orderBy("epoch_index").collect()
    assert [(r.tile, r.epoch_index) for r in got] == [("x", 0), ("t1", 1), ("t2", 2), ("t3", 3)]


def test_bright_ground_is_not_cloud(spark):
    df = spark.createDataFrame([("s", i < 6, 0.36 if i == 0 else 0.2, 0.4) for i in range(10)], "scene string, bad boolean, blue double, red double")
    assert pairs.sanitize_mask(df, ["scene"], "bad", "blue", "red").where("bad").count() == 1


def names_by_part(path):
    return {p.relative_to(path).as_posix() for p in path.rglob("*.parquet")}


def test_upserts_leave_other_partitions_alone(spark, tmp_path):
    stored = spark.range(100).select((F.col("id") % 5).cast("int").alias("day"), F.col("id").alias("k"), F.lit(1).alias("batch"), F.lit(0).alias("v"))
    path = tmp_path / "tiles"
    stored.write.partitionBy("day").parquet(str(path))
    before = names_by_part(path)
    new = spark.createDataFrame([(2, 7, 2, 9), (2, 1002, 2, 9)], "day int, k bigint, batch int, v int")
    sinks.upsert_in_place(spark, str(path), new, ["day"], ["k"], "batch")
    after = names_by_part(path)
    assert {x for x in before if "day=2" not in x} == {x for x in after if "day=2" not in x} and not {x for x in before & after if "day=2" in x}
    got = {(r.k, r.v) for r in spark.read.parquet(str(path)).where("day = 2").collect()}
    assert got == {(k, 9 if k == 7 else 0) for k in range(2, 100, 5)} | {(1002, 9)} and spark.read.parquet(str(path)).count() == 101
    path = tmp_path / "events"
    rows = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 30).alias("site"), "id")
    sinks.site_buckets(rows, "site").write.partitionBy("bucket").parquet(str(path))
    before = names_by_part(path)
    for _ in range(2):
        sinks.replace_in_place(spark, str(path), spark.createDataFrame([("s3", -1)], "site string, id bigint"), "site")
    assert len({x.split("/")[0] for x in before - names_by_part(path)}) == 1
    got = spark.read.parquet(str(path))
    assert [r.id for r in got.where("site = 's3'").collect()] == [-1] and got.count() == 291


def test_registries_of_any_layout(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "version": "1",\n "aois": [\n  {"aoi_id": "x",\n   "target_years": [2017, 2020]},\n  {"aoi_id": "y", "target_years": [2019]}\n ]\n}\n')
    (tmp_path / "b.json").write_text('{"version":"1","aois":[{"aoi_id":"z","target_years":[2023]}]}')
    (tmp_path / "c.json").write_text('{"version": "1", "aois": [')
    got = {(r.aoi_id, r.year) for r in readers.aoi_registry(spark, str(tmp_path)).collect()}
    assert got == {("x", 2017), ("x", 2020), ("y", 2019), ("z", 2023)}
    (bad,) = readers.unreadable_documents(spark, str(tmp_path), readers.AOI_REGISTRY).collect()
    assert bad.file.endswith("c.json")


def test_stream_of_late_rows_and_versions(spark, tmp_path):
    """Two versions in one batch, a late row, a replayed batch: the tables equal one pass over all rows."""
    def deliver(name, batches, schema, run):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            run(jobs.file_stream(spark, str(tmp_path / name), spark.createDataFrame([], schema).schema), str(tmp_path / f"{name}-log"))

    deliver("tiles", [[("a", 1, 0.1), ("a", 2, 0.2), ("b", 5, 0.5)], [("b", 4, 0.4), ("c", 1, 0.9)]], "tile_id string, version int, q double",
            lambda s, log: jobs.ingest_tiles(s, log, str(tmp_path / "stored"), lambda df: df, "version"))
    got = lambda: {(r.tile_id, r.version, r.q) for r in jobs.latest_by(spark, str(tmp_path / "stored"), ["tile_id"], "version").collect()}
    assert got() == {("a", 2, 0.2), ("b", 5, 0.5), ("c", 1, 0.9)}
    jobs.compact(spark, str(tmp_path / "stored"), ["tile_id"], ["version"], 1)
    assert got() == {("a", 2, 0.2), ("b", 5, 0.5), ("c", 1, 0.9)} and not (tmp_path / "stored" / "batch=0").exists()

    day = lambda n: None if n is None else f"2024-01-{n:02d} 00:00:00"
    batches = [[("s", day(1), 1, 0.1), ("s", day(9), 2, 0.4), ("t", day(1), 3, 0.0)], [("s", day(5), 4, 0.2), ("u", day(2), 5, 0.3)], [("t", day(3), 6, 0.7), ("u", day(4), 7, 0.1)]]
    names = [str(tmp_path / n) for n in ("pairs", "late", "state", "history")]
    fields = ("site", "at", "obs", ["ndvi"])
    typed = lambda s: s.withColumn("at", F.col("at").cast("timestamp"))
    deliver("obs", batches, "site string, at string, obs bigint, ndvi double", lambda s, log: jobs.compare_with_predecessor(typed(s), log, *names, *fields))
    found = jobs.settled_pairs(*[spark.read.parquet(n) for n in (names[0], names[1], names[3])], *fields).collect()
    assert {(r.site, r.before_id, r.after_id, r.elapsed_days) for r in found} == {("s", 1, 4, 4), ("s", 4, 2, 4), ("t", 3, 6, 2), ("u", 5, 7, 2)}
    assert {r.site for r in spark.read.parquet(names[2]).where("batch = 2").collect()} == {"t", "u"}


def test_blocks_of_queries_read_beside_the_vectors(spark, tmp_path, monkeypatch):
    """More queries than are sent to every task, the collection kept, one of them null, masses of copies, a zero vector."""
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((400, 8)).round(3)
    rows[50:300] = rows[50]
    rows[350] = 0
    data = [(f"tile_{i}", [None, "a", "b"][i % 3], r.tolist()) for i, r in enumerate(rows)]
    spark.createDataFrame(data, "tile_id string, collection string, embedding array<float>").write.parquet(f"{tmp_path}/v")
    read = lambda: spark.read.parquet(f"{tmp_path}/v")
    queries = vectors.ensemble(read().selectExpr("concat('q', tile_id) AS query_id", "embedding AS query_vector"), ["query_id"], "query_vector")
    get = lambda: {(r.query_id, r.collection, r.place): (r.tile_id, r.score) for r in vectors.nearest(queries, read(), 6, ["collection"]).collect()}
    whole = get()
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", 100)
    assert len(whole) == 400 * 3 * 6 and get() == whole
    ranked = search.search_vectors(queries, read(), 2).where("rank = 1")
    assert ranked.count() == 400


def test_rasters_that_share_a_path_are_all_listed(spark, tmp_path):
    from tilewright.plans import load
    # pages 7,980 apart have the same folder, date and band, so the same path
    spark.createDataFrame([(i, "u") for i in (1, 7_981, 15_961, 2, 3)], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    paths = sorted(r.path for r in load().QUERIES["s07_raster_files"](spark, str(tmp_path)).collect())
    from tilewright.fixtures import table
    assert paths == sorted(r.path for r in table(spark, str(tmp_path), "files").collect()) and len(set(paths)) < len(paths)


def test_rasters_are_dealt_into_folders(spark, tmp_path, monkeypatch):
    """Rasters are dealt into folders, all of a path into one, and are listed by as few tasks as a shuffle has."""
    from tilewright.fixtures import table
    from tilewright.plans import load, source_plans
    pages = [*range(60), *range(7_980, 8_000)]
    spark.createDataFrame([(i, "u") for i in pages], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(source_plans, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(sinks, "FOLDER_FILES", 8, raising=False)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 26))  # two files a task, as 32 by default
    try:
        found = load().QUERIES["s07_raster_files"](spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted(r.path for r in found.collect()) == sorted(r.path for r in table(spark, str(tmp_path), "files").collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    written = [f.parts[-3:] for f in (tmp_path / "rasters").rglob("*.txt")]
    assert len(written) == len(pages) and len({w[0] for w in written}) > 1
    assert len({w[1] for w in written}) == len({w[:2] for w in written}) < len(pages)  # a path is in one folder


def test_layout_is_dealt_by_path_before_it_is_counted(spark):
    from tilewright.operators import validate
    entries = spark.createDataFrame([(1, "eastern_ladakh", "active", "a"), (2, "maritime", "active", "b"), (3, None, "configured", "c"), (4, "eastern_ladakh", "archived", None)],
                                    "entry_no long, domain string, status string, local_path string")
    listing = spark.createDataFrame([("a", "raw"), ("a", "raw"), ("a", "tiles"), ("b", "manifest.json"), ("x", "raw")], "local_path string, folder string")
    found = validate.layout_findings(entries, listing)
    assert sorted((r.entry_no, r.finding) for r in found.collect()) == [
        (1, "missing sub-folder intermediate"), (1, "missing sub-folder manifests"), (1, "missing sub-folder normalized"), (1, "no manifest"), (3, "missing folder")]
    assert "RepartitionByExpression [local_path" in found._jdf.queryExecution().optimizedPlan().toString()


def test_windows_are_dealt_over_tasks_and_clipped_by_a_known_ring(spark):
    from tilewright.functions import geo
    one = spark.createDataFrame([(1, 900, 700), (2, 100, 300)], "s long, height long, width long").coalesce(1)
    assert grids.tile_windows(one, ["s"], 512, 0.1).rdd.getNumPartitions() > 1
    rng = random.Random(3)
    boxes = [(x, y, x + rng.choice([0.0, 0.5, 2.0]), y + rng.choice([0.0, 0.5, 2.0])) for x, y in ((rng.choice([0.0, 1.0, rng.uniform(-2, 4)]), rng.uniform(-2, 4)) for _ in range(300))]
    df = spark.createDataFrame(boxes, "a double, b double, c double, d double")
    for ring in ([(3.0, 0.0), (3.0, 2.0), (0.0, 2.0), (0.0, 0.0), (3.0, 0.0)], [(0.0, 0.0), (3.0, 1.0), (1.0, 3.0), (0.0, 0.0)]):
        edges = geo.polygon_edges(F.array(F.array(*[F.array(*map(F.lit, p)) for p in ring])))
        box = [F.col(n) for n in "abcd"]
        got = df.select(geo.fixed_ring_intersects_box(ring, *box).alias("x"), geo.edges_intersect_box(edges, *box).alias("y")).collect()
        assert all(r.x == r.y for r in got) and {r.x for r in got} == {True, False}


def test_a_place_with_many_dates_meets_its_areas_in_lists(spark, monkeypatch):
    from tilewright.functions import geo
    monkeypatch.setattr(spatial, "LIST_AREAS", 2)
    tiles = spark.range(40).selectExpr("concat('t', id) AS tile_id", "0.0D AS min_lon", "0.0D AS min_lat", "0.1D AS max_lon", "0.1D AS max_lat")
    ring = F.array(*[F.array(*map(F.lit, p)) for p in ((0.0, 0.0), (0.2, 0.0), (0.2, 0.2), (0.0, 0.0))])
    box = [e.alias(n) for e, n in zip(geo.ring_bounds(ring), ("min_lon", "min_lat", "max_lon", "max_lat"))]
    areas = spark.range(7).select(F.concat(F.lit("a"), "id").alias("aoi_id"), geo.polygon_edges(F.array(ring)).alias("edges"), *box)
    found = spatial.tiles_in_areas(tiles.coalesce(1), areas)
    rows = [(r.tile_id, r.aoi_id) for r in found.collect()]
    assert len(rows) == len(set(rows)) == 280
    assert "Generate explode(_areas" in found._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_areas_are_dealt_and_are_the_outer_side(spark, monkeypatch):
    """A place's tiles and areas meet list by list over many tasks: row by row the same few areas repeat, not all areas for every tile."""
    from tilewright.functions import geo
    monkeypatch.setattr(spatial, "LIST_AREAS", 2)
    monkeypatch.setattr(spatial, "LIST_TILES", 8, raising=False)
    box = "double(p) AS min_lon", "0.0D AS min_lat", "p + 0.1D AS max_lon", "0.1D AS max_lat"
    tiles = spark.range(120).selectExpr("id", "id % 3 AS p").selectExpr("IF(id = 5, null, concat('t', id)) AS tile_id", *box)
    tiles = tiles.union(spark.createDataFrame([("nowhere", None, 0.0, 0.1, 0.1)], tiles.schema))
    areas = spark.range(14).selectExpr("id", "id % 2 AS p")
    ring = F.array(*[F.array(F.col("p") + x, F.lit(y)) for x, y in ((0.0, 0.0), (0.2, 0.0), (0.2, 0.2), (0.0, 0.0))])
    edges = [e.alias(n) for e, n in zip(geo.ring_bounds(ring), ("min_lon", "min_lat", "max_lon", "max_lat"))]
    areas = areas.select(F.concat(F.lit("a"), "id").alias("aoi_id"), geo.polygon_edges(F.array(ring)).alias("edges"), *edges)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = [[(r.tile_id, r.aoi_id) for r in rows] for rows in spatial.tiles_in_areas(tiles.coalesce(1), areas).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    rows = [r for task in tasks for r in task]
    want = [(None if t == 5 else f"t{t}", f"a{a}") for t in range(120) for a in range(14) if t % 3 == a % 2]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert sum(map(bool, tasks)) > 1
    runs = sum(a[0] != b[0] for task in tasks for a, b in zip([("", "")] + task, task))
    assert runs > 160  # 80 tiles; more runs than that where a list is the outer side


def test_the_next_date_is_joined_in_one_shuffle(spark):
    """As the table joined with itself, repeated dates, gaps and null keys included."""
    rows = [(1, 0, 0, 0, 1.0), (1, 0, 0, 1, 2.0), (1, 0, 0, 1, 3.0), (1, 0, 0, 2, 4.0), (1, 0, 1, 0, 5.0), (1, 0, 1, 2, 6.0), (2, 0, 0, 3, None), (2, 0, 0, 4, 7.0), (None, 0, 0, 0, 8.0), (None, 0, 0, 1, 9.0)]
    df = spark.createDataFrame(rows, "site long, prow long, pcol long, epoch long, v double")
    got = pairs.join_next_date(df, ["site", "prow", "pcol"], "epoch", ["v"])
    before, after = df.withColumnRenamed("v", "v_b"), df.select("site", "prow", "pcol", (F.col("epoch") - 1).alias("epoch"), F.col("v").alias("v_a"))
    want = pairs.join_dates(before, after, ["site", "prow", "pcol", "epoch"])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.select(*got.columns).collect()), key=key)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


def test_density_pairs_close_to_the_radius_and_masses_of_points(spark):
    """Counts and forests by pieces equal brute force in double precision, and a vector is copied to few blocks."""
    rng = np.random.default_rng(6)
    angle = np.concatenate([np.arange(60) * 2 * np.arcsin(0.05), rng.uniform(3.5, 5.9, 2000)])  # neighbours at exactly the radius, up to rounding
    points = np.stack([np.cos(angle), np.sin(angle)], 1)
    df = spark.createDataFrame([(f"t{i}", [float(x) for x in p]) for i, p in enumerate(points)], "tile_id string, embedding array<double>")
    unit = np.round(points / np.linalg.norm(points, axis=1, keepdims=True), 9)
    square = (unit * unit).sum(1)
    near = square[:, None] + square[None] - 2 * unit @ unit.T <= 0.1 ** 2 + 1e-12
    got = {r.tile_id: r.label for r in clusters.density_labels(df, 0.1, 3, 3, pivots=3).collect()}
    core = near.sum(1) >= 3
    assert {k for k, v in got.items() if v != -1} >= {f"t{i}" for i in np.nonzero(core)[0][60:]} and len({v for v in got.values()} - {-1}) >= 1
    assert all(got[f"t{i}"] == got[f"t{j}"] for i, j in zip(*np.nonzero(near & core[:, None] & core[None])))
    home, visit = clusters._neighbour_tasks(spark.createDataFrame([(i, [int(round(x * 1e9)) for x in p], 1) for i, p in enumerate(unit)], "point long, vector array<int>, weight long"), [[10 ** 9, 0]], 0.1, 32_768)
    assert home.count() == visit.count() == len(points)
