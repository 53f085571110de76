"""Logged tables, document readers, component names and the vector index on small tables."""

import random
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tilewright.operators import blocks, components, quantiles, raster, regions, vectors
from tilewright.operators.index import VectorIndex
from tilewright.sources import layout, readers, tables
from tilewright.sources.tables import LoggedTable, WriteConflict
from tilewright.streaming import jobs


def files_below(path):
    return {p.relative_to(path).as_posix() for p in path.rglob("*.parquet") if "/log/" not in str(p)}


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture()
def stored(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 5).cast("int").alias("day"), F.col("id").alias("k"), F.lit(1).alias("batch"), F.lit(0).alias("v"))
    odd = spark.createDataFrame([(None, 500, 1, 0)], "day int, k bigint, batch int, v int")
    return LoggedTable.create(str(tmp_path / "tiles"), rows.unionByName(odd), ["day"])


NEW = "day int, k bigint, batch int, v int"


@pytest.mark.parametrize("listed", [10_000, 0])
def test_an_upsert_reads_and_writes_its_partitions_only(spark, stored, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(tables, "LISTED", listed)
    before, seen = files_below(tmp_path / "tiles"), stored.read()
    opened = []
    load = LoggedTable._load
    monkeypatch.setattr(LoggedTable, "_load", lambda self, held: opened.append(load(self, held)) or opened[-1])
    stored.upsert(spark.createDataFrame([(2, 7, 2, 9), (2, 1002, 2, 9), (None, 500, 2, 8), (77, 1, 2, 7)], NEW), ["k"], "batch")  # a stored batch: no filter to push
    assert {r.day for r in opened[0].select("day").distinct().collect()} == {2, None}  # what was opened: the folders of two partitions
    assert opened[0].inputFiles() and all(any(f.endswith(b.split("/")[-1]) for b in before) for f in opened[0].inputFiles())
    monkeypatch.undo()
    assert before <= files_below(tmp_path / "tiles")
    assert seen.count() == 101 and seen.agg(F.sum("v")).first()[0] == 0  # who read before still sees the old rows
    expected = {(k % 5, k, 0) for k in range(100)} - {(2, 7, 0)} | {(2, 7, 9), (2, 1002, 9), (None, 500, 8), (77, 1, 7)}
    assert set(map(tuple, stored.read().select("day", "k", "v").collect())) == expected
    assert {r.k for r in stored.read(F.col("day") == 2).collect()} == {*range(2, 100, 5), 7, 1002}
    assert len(stored.read(F.col("day") == 2).inputFiles()) < len(stored.read().inputFiles())
    assert stored.read(F.col("day") == 12345).count() == 0 and stored.read(version=1).count() == 101
    stored.vacuum(keep=1)
    assert set(map(tuple, stored.read().select("day", "k", "v").collect())) == expected and stored.versions() == [2]


def test_the_second_of_two_writers_fails_and_changes_nothing(spark, stored):
    other = LoggedTable(spark, stored.path, ["day"])
    merge = lambda old: stored.upsert(spark.createDataFrame([(1, 1, 3, 3)], NEW), ["k"], "batch") or old
    with pytest.raises(WriteConflict):
        other._change(spark.createDataFrame([(1,)], "day int"), merge)  # another commit while it merges
    assert stored.versions() == [1, 2] and rows_of(stored.read().where("v > 0"), "day", "k", "v") == [(1, 1, 3)]
    stored.vacuum()
    assert stored.read().count() == 101


def test_replacing_all_rows_of_owners(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("s/ "), F.col("id") % 30).alias("site"), "id", (F.col("id") % 3).alias("part"))
    table = LoggedTable.create(str(tmp_path / "events"), rows, ["part"])
    gone = spark.createDataFrame([("s/ 3", 0), ("s/ 4", 1)], "site string, part bigint")
    for _ in range(2):
        table.replace(spark.createDataFrame([("s/ 3", -1, 0)], "site string, id bigint, part bigint"), "site", gone)
    assert rows_of(table.read().where("site IN ('s/ 3', 's/ 4')"), "site", "id") == [("s/ 3", -1)] and table.read().count() == 281
    table.replace(rows.limit(0), "site", rows.select("site", "part"))
    assert table.read().count() == 0 and table.read().columns == ["site", "id", "part"]
    table.upsert(rows.where("id < 3"), ["id"], "id")
    assert table.read().count() == 3


def test_documents_of_any_kind(spark, tmp_path):
    texts = {"a": '{"x": 1}', "b": '{"x": 2', "c": " \n", "d": "[1]", "e": '{\n "x": 3, "y": {"z": [1]}}\n', "f": "null", "g": '{"y": 5}', "h": '{"x": "no number"}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.file[-6]: r for r in readers.read_documents(spark, str(tmp_path), "x bigint, y string").collect()}
    assert set(got) == set(texts)
    assert {k: tuple(r.document) for k, r in got.items() if r.document} == {"a": (1, None), "e": (3, '{"z":[1]}'), "g": (None, "5")}
    assert {k: r.unreadable for k, r in got.items() if r.unreadable is not None} == {k: texts[k] for k in "bcdfh"}


def test_records_of_both_layouts(spark, tmp_path):
    (tmp_path / "n.json").write_text("""{"manifest_version": "2.0.0", "region_id": "r", "scene_id": "s", "acquisition_date": "2024-01-02", "source_type": "sentinel", "tiles": [
      {"tile_id": "t1", "centroid": {"latitude": 1.5, "longitude": 2.5}, "bounds_epsg4326": [1, 2, 3, 4], "geometry": {"type": "Point", "coordinates": [1, 2]},
       "quality": {"cloud_pct": 0.25, "quality_confidence": 0.6, "passed_gate": false}, "indices": {"mean_ndvi": 0.5}, "bands": {"band_order": ["B02"], "band_stats": {"B02": {"mean": 1}}},
       "storage": {"geotiff_path": "/t1.tif"}}, {"tile_id": "t2", "scene_id": "own"}]}""")
    (tmp_path / "f.json").write_text('{"region_id": "r", "tiles": [{"tile_id": "t3", "centroid_lat": 7, "bounds": [1, 2], "quality_confidence": 0.7, "mean_ndvi": 0.1}]}')
    (tmp_path / "e.json").write_text('{"region_id": "r", "tiles": []}')
    got = {r.tile_id: r.asDict() for r in readers.tile_records(readers.read_documents(spark, str(tmp_path), readers.FULL_MANIFEST)).collect()}
    assert set(got) == {"t1", "t2", "t3"}
    pick = lambda t, *names: tuple(got[t][n] for n in names)
    assert pick("t1", "scene_id", "acquisition_date", "centroid_lat", "max_lat", "cloud_pct", "passed_gate", "mean_ndvi", "band_order", "geotiff_path") == ("s", "2024-01-02", 1.5, 4.0, 0.25, False, 0.5, ["B02"], "/t1.tif")
    assert got["t1"]["geometry"].startswith('{"type":"Point"') and got["t1"]["band_stats"] == '{"B02":{"mean":1}}'
    assert pick("t2", "scene_id", "source_type", "passed_gate", "min_lon") == ("own", "sentinel", None, None)
    assert pick("t3", "scene_id", "centroid_lat", "min_lat", "max_lat", "passed_gate", "mean_ndvi") == (None, 7.0, 2.0, None, True, 0.1)


def flood(cells):
    """First cell of each cell's component."""
    first = {}
    for start in sorted(cells):
        todo = [start] if start not in first else []
        while todo:
            at = todo.pop()
            if at in cells and at not in first:
                first[at] = start
                todo += [(at[0] + a, at[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    return first


@pytest.mark.parametrize("key", [["site"], ["name", "kind"]])
def test_component_names_are_first_pixels_for_any_block(spark, key):
    rng = random.Random(3)
    shapes = {}
    for site in (3, 11, 200):
        cells = {(r, c) for r in range(40) for c in range(700 if site == 3 else 50) if rng.random() < 0.62}
        cells |= {(16, c) for c in range(48)} | {(r, 8) for r in range(8, 17)}  # a strip whose smallest number isn't its smallest text
        shapes[site] = flood(cells)
    rows = [(s, f"n{s}", None if s == 11 else "k", *at) for s, cells in shapes.items() for at in cells]
    df = spark.createDataFrame(rows, "site bigint, name string, kind string, prow int, pcol int").repartition(5).cache()
    for block in (8, 16, 512):
        got = regions.label_components(df.select(*key, "prow", "pcol"), key, block).withColumn("text", regions.component_name(["prow"], F.col("component"))).collect()
        assert len(got) == len(rows)
        for r in got:
            site = r.site if key == ["site"] else int(r.name[1:])
            first = shapes[site][r.prow, r.pcol]
            assert r.component == first[0] << 31 | first[1] and r.text == f"{r.prow}|{first[0]}|{first[1]}"
    df.unpersist()
    with pytest.raises(ValueError):
        regions.label_components(spark.createDataFrame([(2**60, 7, 7)], "site bigint, prow bigint, pcol bigint"), ["site"], 8).collect()


def test_contracting_edges():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 40, 30), rng.integers(0, 40, 30)
        old, new = components.contract(a, b)
        least = {int(x): int(x) for x in [*a, *b]}
        for _ in range(40):
            for x, y in zip(a.tolist(), b.tolist()):
                least[x] = least[y] = min(least[x], least[y])
        assert dict(zip(old.tolist(), new.tolist())) == {k: v for k, v in least.items() if k != v}


def test_components_of_many_partitions(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(5000, 5600), rng.randrange(5000, 5600)) for _ in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one task sees all of them
    try:
        got = {r.old: r.new for r in components.component_names(spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    old, new = components.contract(*np.array(edges).T)
    assert got == dict(zip(old.tolist(), new.tolist()))


def test_the_index_finds_neighbours_and_compares_few(spark, tmp_path):
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((40, 30))
    data = np.concatenate([middles[rng.integers(0, 40, 1500)] + 0.35 * rng.standard_normal((1500, 30)), np.zeros((2, 30)), np.repeat(middles[:1], 3, 0)])
    v = spark.createDataFrame([(f"t{i}", x.tolist()) for i, x in enumerate(data)], "tile_id string, embedding array<double>").repartition(4)
    q = v.where("tile_id LIKE '%0'").select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex.build(v, str(tmp_path / "index"))
    assert index.codes.count() == len(data) and len(index.centres) == 39
    true = {(r.query_id, r.tile_id, r.score) for r in vectors.nearest(q, v, 5).collect()}
    wide = index.search(q, v, 5, probes=39, rerank=len(data)).collect()  # everything compared: exact
    assert {(r.query_id, r.tile_id) for r in wide} == {x[:2] for x in true}
    again = VectorIndex(spark, str(tmp_path / "index"))
    close = again.search(q, v, 5, probes=6, rerank=40).collect()
    assert len({(r.query_id, r.tile_id) for r in close} & {x[:2] for x in true}) >= 0.9 * len(true)
    n = q.count()
    assert again.candidates(q, 6, 40).count() <= 40 * n and len(close) == 5 * n


def touched_groups(path, rows, cols):
    """Share of row groups whose least and greatest row and column meet a window."""
    hit = total = 0
    for file in path.glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            stats = [meta.row_group(g).column(names[n]).statistics for n in ("prow", "pcol")]
            hit += all(s.min <= high and s.max >= low for s, (low, high) in zip(stats, (rows, cols)))
            total += 1
    return hit / total, total


def test_a_window_touches_few_row_groups(spark, tmp_path):
    codes = [(r, c) for r in range(16) for c in range(16)]
    at = {(x.r, x.c): x.z for x in spark.createDataFrame(codes, "r int, c int").select("r", "c", layout.z_order(F.col("r"), F.col("c")).alias("z")).collect()}
    assert all(z == sum((r >> b & 1) << 2 * b + 1 | (c >> b & 1) << 2 * b for b in range(4)) for (r, c), z in at.items())
    big = spark.createDataFrame([(2**31 - 1, 0), (0, 2**31 - 1)], "r int, c int").select(layout.z_order(F.col("r"), F.col("c")).alias("z")).collect()
    assert [x.z for x in big] == [0x2AAAAAAAAAAAAAAA, 0x1555555555555555]
    pixels = spark.range(2 * 256 * 256).select((F.col("id") / 65536).cast("bigint").alias("site_id"), (F.col("id") / 256 % 256).cast("int").alias("prow"), (F.col("id") % 256).cast("int").alias("pcol"), F.rand(1).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layout.write_pixels(pixels, str(tmp_path / "z"), ["site_id"])
        pixels.repartitionByRange("site_id", "prow").sortWithinPartitions("site_id", "prow", "pcol").write.parquet(str(tmp_path / "rows"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    columns = (0, 255), (100, 115)
    window = (96, 111), (100, 115)
    for rows, cols, most in ((*window, 0.12), (*columns, 0.4)):
        share, total = touched_groups(tmp_path / "z", rows, cols)
        assert total >= 60 and share <= most, share
    assert touched_groups(tmp_path / "rows", *columns)[0] == 1.0  # by rows, a window of columns touches everything
    got = readers.pixel_window(spark, str(tmp_path / "z"), *window, ["site_id", "prow", "pcol"]).collect()
    assert sorted(map(tuple, got)) == [(s, r, c) for s in range(2) for r in range(96, 112) for c in range(100, 116)]


def test_sketched_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=30000), "b": rng.integers(0, 5, 4000).astype(float), "c": np.arange(100.0)}
    rows = spark.createDataFrame([(k, float(x), i % 2 == 0) for k, v in data.items() for i, x in enumerate(v)] + [("d", None, True), ("d", float("nan"), True)], "k string, v double, bad boolean").repartition(6)
    shares = [0.02, 0.5, 0.98]
    value = F.when(~F.isnan("v"), F.col("v"))
    states = rows.groupBy("k").agg(quantiles.state(value, shares, False).alias("s"), F.count(value).alias("n"))
    got = {r.k: r.q for r in states.select("k", quantiles.read(F.col("s"), F.col("n"), shares, False).alias("q")).collect()}
    assert got["d"] is None
    for k, v in data.items():
        for q, share in zip(got[k], shares):
            assert q in v and (v < q).mean() - 4 * quantiles.RANK_ERROR <= share <= (v <= q).mean() + 4 * quantiles.RANK_ERROR + 1 / len(v)
    cuts = {r.k: (r.vmin, r.vmax) for r in raster.cut_points(rows, ["k"], ["v"], "bad").collect()}
    assert cuts["c"] == (3.0, 97.0) or abs(cuts["c"][0] - 3) <= 2 and abs(cuts["c"][1] - 97) <= 2
    exact = {r.k: (r.vmin, r.vmax) for r in raster.cut_points(rows, ["k"], ["v"], "bad", exact=True).collect()}
    assert exact["c"] == pytest.approx(tuple(np.quantile(np.arange(1.0, 100.0, 2), [0.02, 0.98]))) and set(cuts) == set(exact) == {"a", "b", "c", "d"}


def test_ingest_keeps_the_number_of_folders_bounded(spark, tmp_path):
    """Many small batches, tiles in several versions, late ones too; a reader holds its version while others are rewritten."""
    rng = random.Random(4)
    fields = "tile_id string, version int, part int, q double"
    empty = spark.createDataFrame([], fields + ", batch int")
    table = LoggedTable.create(str(tmp_path / "tiles"), empty, ["part"])
    (tmp_path / "in").mkdir()
    said, held = {}, None
    for batch in range(24):
        rows = {}
        for _ in range(6):
            t, v = rng.randrange(20), rng.randrange(30)
            rows[f"t{t}", v] = (t % 2, v / 10)
        for (t, v), (_, q) in rows.items():
            said[t] = max((v, q), said.get(t, (v, q)))
        spark.createDataFrame([(t, v, part, q) for (t, v), (part, q) in rows.items()], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if batch % 4 == 3:  # several files a run
            jobs.ingest_into(jobs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], fields).schema).withColumn("q", F.col("q")), str(tmp_path / "log"), table, ["tile_id"], "version", lambda df: df, most=3)
            if batch == 19:
                held = table.read(), {r.tile_id: (r.version, r.q) for r in jobs.current(table, ["tile_id"], "version").collect()}
                rows_held = held[0].count()
    assert {r.tile_id: (r.version, r.q) for r in jobs.current(table, ["tile_id"], "version").collect()} == said
    assert held[0].count() == rows_held  # its files are still there, one commit or two later
    assert len(table._names("data")) <= 8 and len(table.versions()) == 3 and table.versions()[-1] > 6
    assert table.manifest().groupBy("p").count().where("count > 3").isEmpty()


def test_the_index_measures_its_settings_on_vectors_without_structure(spark, tmp_path):
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(f"t{i}", x.tolist()) for i, x in enumerate(rng.standard_normal((4500, 48)))], "tile_id string, embedding array<float>").repartition(4)
    v.write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    q = v.where("tile_id LIKE '%7'").select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex.build(v, str(tmp_path / "index"))
    true = {(r.query_id, r.tile_id) for r in vectors.nearest(q, v, 8).collect()}
    found = {(r.query_id, r.tile_id) for r in index.search(q, v, 8).collect()}
    assert len(found & true) >= 0.9 * len(true)
    probes, rerank = index._settings(None, None)
    assert probes > 40 and rerank <= 4500 // 12  # forty cells do not hold the neighbours
    # a query leaves a group of cells with one list of pairs, not each cell with one
    assert index._ranked(q, probes, rerank)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_are_copied_as_packed_rows(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, (300, 6)).astype(float)  # many equal vectors and ties
    rows = [(f"t{i:03}", ["a", "b", None][i % 3], v.tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, f"tile_id string, part string, embedding array<{kind}>").repartition(5)
    seen, copied = [], blocks.copied
    monkeypatch.setattr(blocks, "copied", lambda left, right: (seen.append((left, right)), copied(left, right))[1])
    monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", 10)
    q = df.selectExpr("tile_id AS query_id", "embedding AS query_vector")
    found = {(r.query_id, r.part, r.place): (r.tile_id, r.score) for r in vectors.nearest(q, df, 4, ["part"], 80, 40).collect()}
    assert all(side.count() <= 3 * 8 for pair in seen for side in pair)  # blocks, not vectors
    unit = base / np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit @ unit.T, 12)
    for i in range(300):
        for part in ("a", "b", None):
            best = sorted((-scores[i, j], rows[j][0]) for j in range(300) if rows[j][1] == part)[:4]
            got = [found[f"t{i:03}", part, n + 1] for n in range(4)]
            assert [t for t, _ in got] == [t for _, t in best] and np.allclose([s for _, s in got], [-s for s, _ in best], 0, 1e-11)


def test_scores_are_computed_in_small_tiles():
    rows = np.random.default_rng(3).standard_normal((4096, 8))
    tracemalloc.start()
    vectors.best_pairs(rows[:1024], rows, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9e6, peak


def test_recall_scans_the_codes_once_and_counts_what_the_search_finds(spark, tmp_path, monkeypatch):
    """Besides the scan that sets the index up there is one; the pairs it finds are those that the search finds, ties and zero vectors included."""
    from tilewright.operators import vectors
    from tilewright.plans import load, search_plans
    rng = np.random.default_rng(8)
    rows = rng.standard_normal((600, 16)).round(2)
    rows[100:140], rows[200] = rows[100], 0
    spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    scans, built = [], []
    ranked, build = VectorIndex._ranked, VectorIndex.build
    monkeypatch.setattr(VectorIndex, "_ranked", lambda self, *a: scans.append(a) or ranked(self, *a))
    monkeypatch.setattr(VectorIndex, "build", lambda *a: built.append(build(*a)) or built[-1])
    row = load().QUERIES["j15_index_recall"](spark, str(tmp_path)).first()
    assert len(scans) == 2 and row.queries == 600 and row.finds_enough
    v = search_plans.vec(spark, str(tmp_path))
    q = v.selectExpr("tile_id AS query_id", "embedding AS query_vector")
    pairs = lambda df: {(r.query_id, r.tile_id) for r in df.collect()}
    true, found = pairs(vectors.nearest(q, v, 8)), pairs(built[0].search(q, v, 8))
    assert true & pairs(built[0].candidates(q)) == true & found and len(true & found) >= 0.9 * len(true)


def test_best_pairs_of_single_precision_keep_order_and_ties():
    from tilewright.operators.vectors import TopPairs
    rng = np.random.default_rng(9)
    for k, high in ((1, 1), (5, 1), (5, 1 << 20)):  # wide columns don't fit beside query and score
        scores = (rng.integers(-4, 5, (3000, 400)) / np.float32(7)).astype(np.float32)
        scores[scores == 0] *= -1
        top = TopPairs(3000, k)
        for low in range(0, 400, 50):
            top.offer(np.arange(3000), low, scores[:, low:low + 50])
        top.settle()
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        assert (top.column.reshape(-1, k) == best).all() and (top.query == np.repeat(np.arange(3000), k)).all()
        assert (top.score == np.take_along_axis(scores, best, 1).ravel()).all()
        some = top._ordered(np.array([1, 0, 0, 0]), np.array([0, 2, 1, 0]) * high, np.array([0.5, -0.25, -0.25, 0.125]))
        assert [x.tolist() for x in some] == [[0, 0, 0, 1], [0, high, 2 * high, 0], [0.125, -0.25, -0.25, 0.5]]
