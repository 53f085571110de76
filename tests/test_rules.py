"""Literal expectations and invariants of the rule functions."""

import itertools
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.functions import change, naming, spectral
from tilewright.operators import grids
from tilewright.plans import load


def rows(spark, data, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*exprs).collect()]


def chain(ndvi, ndwi, ndbi, dark=False):
    """The class rule as a plain chain of conditions."""
    if (ndwi >= 0.20 and ndbi <= -0.10 and -0.50 <= ndvi <= 0.20) or dark:
        return K.WATER
    if ndvi >= 0.50 and -0.60 <= ndwi <= 0.10 and ndbi <= -0.10:
        return K.DENSE_VEGETATION
    if 0.20 <= ndvi < 0.50 and -0.50 <= ndwi <= 0.10 and -0.40 <= ndbi <= 0.10:
        return K.SPARSE_VEGETATION
    if -0.10 <= ndvi <= 0.30 and -0.50 <= ndwi <= 0.10 and ndbi >= 0.15:
        return K.BUILT_UP
    if -0.20 <= ndvi < 0.20 and -0.50 <= ndwi <= 0.10 and -0.20 <= ndbi < 0:
        return K.BARE_SOIL
    if -0.10 <= ndvi <= 0.20 and -0.50 <= ndwi <= 0.10 and 0 <= ndbi < 0.15:
        return K.CONFUSION
    if ndwi >= 0.20 or (ndwi > 0.05 and ndvi < -0.10) or (ndvi < 0 and ndwi > -0.10 and ndbi < 0.10):
        return K.WATER
    if ndvi >= 0.50:
        return K.DENSE_VEGETATION
    if ndvi >= 0.20 and ndvi > ndbi:
        return K.SPARSE_VEGETATION
    if ndbi >= 0.15:
        return K.BUILT_UP
    if ndbi < 0 and ndvi < 0.20:
        return K.BARE_SOIL
    return K.CONFUSION


def test_land_cover_equals_the_plain_chain_at_and_around_every_limit(spark):
    steps = sorted({v + d for v in (-0.6, -0.5, -0.4, -0.2, -0.1, 0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5) for d in (-1e-9, 0.0, 1e-9)} | {-0.9, 0.9})
    triples = list(itertools.product(steps, repeat=3))
    df = spark.createDataFrame(triples, "v double, w double, b double")
    got = df.select("v", "w", "b", spectral.land_cover(F.col("v"), F.col("w"), F.col("b")).alias("c")).collect()
    assert len(got) == len(triples)
    wrong = [(r, chain(r.v, r.w, r.b)) for r in got if r.c != chain(r.v, r.w, r.b)]
    assert wrong == []


def test_land_cover_dark_water_and_unknown(spark):
    data = [(0.1, -0.3, 0.05, 0.04, 0.03, 0.04), (0.1, -0.3, 0.05, 0.05, 0.03, 0.04), (float("nan"), 0.5, -0.5, 0.1, 0.1, 0.1), (None, 0.5, -0.5, 0.1, 0.1, 0.1)]
    got = rows(spark, data, "v double, w double, b double, nir double, red double, swir double",
               spectral.land_cover(*[F.col(n) for n in ("v", "w", "b", "nir", "red", "swir")]))
    assert [g[0] for g in got] == [K.WATER, K.CONFUSION, K.CONFUSION, K.CONFUSION]


def test_indices_of_known_bands(spark):
    got = rows(spark, [(100.0, 80.0, 500.0, 200.0)], "g double, r double, n double, s double",
               *spectral.spectral_indices(F.col("g"), F.col("r"), F.col("n"), F.col("s")).values())[0]
    assert [round(x, 3) for x in got] == [0.724, -0.667, -0.429]


@pytest.mark.parametrize("before, after, expected", [
    (K.DENSE_VEGETATION, K.BUILT_UP, K.CONSTRUCTION), (K.DENSE_VEGETATION, K.BARE_SOIL, K.CLEARANCE), (K.SPARSE_VEGETATION, K.BARE_SOIL, K.NO_CHANGE),
    (K.WATER, K.BARE_SOIL, K.WATER_SHRINKAGE), (K.BARE_SOIL, K.WATER, K.WATER_EXPANSION), (K.BUILT_UP, K.BARE_SOIL, K.DEMOLITION),
    (K.BUILT_UP, K.DENSE_VEGETATION, K.NO_CHANGE), (K.CONFUSION, K.BARE_SOIL, K.NO_CHANGE), (K.CONFUSION, K.BUILT_UP, K.CONSTRUCTION),
    (K.DENSE_VEGETATION, K.SPARSE_VEGETATION, K.NO_CHANGE), (K.WATER, K.WATER, K.NO_CHANGE), (K.BARE_SOIL, K.SPARSE_VEGETATION, K.NO_CHANGE)])
def test_pixel_change_types(before, after, expected):
    assert change.change_type_of(before, after) == expected


def test_names_and_codes_agree(spark):
    n = len(K.CLASS_CODES)
    df = spark.range(n * n).selectExpr("CAST(id / 6 AS INT) AS b", "CAST(id % 6 AS INT) AS a")
    by_code = change.by_code(change.change_type_of, F.col("b"), F.col("a"))
    by_name = change.pixel_change_type(spectral.class_name(F.col("b")), spectral.class_name(F.col("a")))
    assert df.where(by_code != by_name).count() == 0


def test_region_rule_uses_area(spark):
    data = [(K.SPARSE_VEGETATION, K.BARE_SOIL, 4999.0), (K.SPARSE_VEGETATION, K.BARE_SOIL, 5000.0), (K.CONFUSION, K.BUILT_UP, 999.0),
            (K.CONFUSION, K.BUILT_UP, 1000.0), (K.DENSE_VEGETATION, K.SPARSE_VEGETATION, 50000.0)]
    got = rows(spark, data, "b string, a string, m double", change.region_change_type(F.col("b"), F.col("a"), F.col("m")))
    assert [g[0] for g in got] == [K.NO_CHANGE, K.CLEARANCE, K.NO_CHANGE, K.CONSTRUCTION, K.VEGETATION_SHIFT]


def test_point_id_is_a_version_five_uuid(spark):
    names = ["tile_1", "s_tile_00001", "é"]
    got = rows(spark, [(n,) for n in names], "n string", naming.point_id(F.col("n")))
    assert [g[0] for g in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_elongation_of_a_strip(spark):
    strip = spark.range(60 * 4).selectExpr("CAST(id / 4 AS DOUBLE) AS r", "CAST(id % 4 AS DOUBLE) AS c").withColumn("r", F.floor("r").cast("double"))
    value = strip.agg(change.elongation(F.count(F.lit(1)), F.var_pop("r"), F.var_pop("c"), F.covar_pop("r", "c"))).first()[0]
    assert value == pytest.approx(15.0, abs=0.6) and value >= K.ROAD_ELONGATION


@pytest.mark.parametrize("size, window, stride, expected", [(1500, 512, 435, [0, 435, 870, 988]), (512, 512, 461, [0]), (300, 512, 461, [0]), (973, 512, 461, [0, 461])])
def test_window_offsets(spark, size, window, stride, expected):
    got = spark.range(1).select(grids.window_offsets(F.lit(size), F.lit(window), F.lit(stride))).first()[0]
    assert got == expected


@pytest.mark.parametrize("height, width, count", [(1837, 3061, 28), (735, 735, 4), (512, 612, 2)])
def test_tiles_per_canvas(spark, height, width, count):
    df = spark.createDataFrame([(1, height, width)], "scene int, height bigint, width bigint")
    assert grids.tile_windows(df, ["scene"], 512, 0.10).count() == count


@settings(max_examples=25, deadline=None)
@given(size=st.integers(5, 90), window=st.integers(4, 30), overlap=st.sampled_from([0.0, 0.1, 0.15, 0.5]))
def test_covering_windows_match_the_window_list(spark, size, window, overlap):
    window = min(window, size)
    stride = grids.stride_of(window, overlap)
    offsets = spark.range(1).select(grids.window_offsets(F.lit(size), F.lit(window), F.lit(stride))).first()[0]
    got = spark.range(size).select("id", grids.covering_windows(F.col("id"), F.lit(size), F.lit(window), F.lit(stride)).alias("w")).collect()
    for row in got:
        assert sorted(row.w) == [o for o in offsets if o <= row.id < o + window]
        assert row.w  # the windows cover the canvas


def test_time_bucket_labels(spark):
    df = spark.createDataFrame([("2023-01-01", "2024-06-30"), ("2023-01-01", "2023-01-01")], "a string, b string").selectExpr("CAST(a AS DATE) AS a", "CAST(b AS DATE) AS b")
    two = [r.bucket for r in grids.time_buckets(df, "a", "b", 2).orderBy("bucket_end").collect()]
    assert two == ["bucket_single", "historical_T1", "recent_T2"]
    four = [r.bucket for r in grids.time_buckets(df, "a", "b", 4).where("b > a").orderBy("bucket_start").collect()]
    assert four == [f"time_bucket_{i}" for i in (1, 2, 3, 4)]


def test_registry_is_complete():
    registry = load()
    assert len(registry.QUERIES) >= 150
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert np.mean([n in registry.ORACLES for n in registry.QUERIES]) > 0.9
