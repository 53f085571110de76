"""Domain tables as deterministic projections of the sample parquet tables.

The sample data holds no imagery, so tiles, pixels, vectors and scenes are
computed from its rows. Each text is SQL with ``{table}`` placeholders and runs in Spark
(``table``) and in the DuckDB check (``cte``), but for the words of ``_SPARK_TEXT`` and
``_DUCKDB_TEXT``: array types, exploding a list and looking up its n-th value are spelt
differently by the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _case(column: str, values: list[int]) -> str:
    """Look a small code up in a list of values; the list syntax differs between the engines."""
    return "{pick_open}" + ", ".join(map(str, values)) + "{pick_mid}" + column + " + 1{pick_close}"


_SPARK_TEXT = {"{float_array}": "ARRAY<FLOAT>", "{epoch_list}": "explode(array(0L, 1L, 2L, 3L))",
               "{pick_open}": "element_at(array(", "{pick_mid}": "), CAST(", "{pick_close}": " AS INT))"}
_DUCKDB_TEXT = {"{float_array}": "FLOAT[]", "{epoch_list}": "unnest([0, 1, 2, 3]::BIGINT[])",
                "{pick_open}": "list_element([", "{pick_mid}": "], (", "{pick_close}": "))"}


def _dialect(name: str, words: dict[str, str]) -> str:
    text = SQL[name]
    for word, local in words.items():
        text = text.replace(word, local)
    return text


# digital numbers per land-cover class, by band
_DN = {
    "blue": [800, 250, 600, 1100, 900, 850],
    "green": [900, 500, 800, 1500, 1200, 1000],
    "red": [700, 300, 900, 1800, 1300, 1100],
    "nir": [200, 4000, 2000, 2200, 1700, 1500],
    "swir": [100, 1500, 1600, 3400, 1400, 1700],
}

_PX0 = """
SELECT CAST(floor(o_orderkey / 1024) AS BIGINT) AS site_id,
       CAST(floor((o_orderkey % 1024) / 32) AS BIGINT) AS prow, o_orderkey % 32 AS pcol,
       CAST(floor(o_totalprice * 100) AS BIGINT) % 97 AS noise
FROM {orders}"""


def _bands(side: str, names: list[str]) -> str:
    return ", ".join(
        f"CAST(({_case('c' + side, _DN[b])}) + noise AS DOUBLE) / 10000 AS {b}_{side}" for b in names
    )


SQL = {}

SQL["obs"] = """
SELECT concat('tile_', event_id) AS tile_id,
       concat('scene_', CAST(floor(event_id / 50) AS BIGINT)) AS scene_id,
       concat('site_', user_id) AS site_key,
       ts AS acquisition_date,
       CASE event_type WHEN 'click' THEN 'Sentinel-2A' WHEN 'view' THEN 'Sentinel-2B'
            WHEN 'purchase' THEN 'sentinel-2' WHEN 'signup' THEN 'Maxar WorldView'
            ELSE 'Organiser Sensor' END AS sensor,
       CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS cloud_pct,
       CAST(100 - (event_id * 37) % 100 AS DOUBLE) / 100 AS quality_confidence,
       CASE WHEN event_id % 17 = 0 THEN NULL
            ELSE CAST((event_id * 7919) % 1601 AS DOUBLE) / 1000 - 0.6 END AS mean_ndvi,
       CAST((event_id * 104729) % 1001 AS DOUBLE) / 1000 - 0.6 AS mean_ndwi,
       CAST((event_id * 1299709) % 801 AS DOUBLE) / 1000 - 0.4 AS mean_ndbi,
       CAST(2000 + (user_id * 13) % 100 AS DOUBLE) / 100 AS centroid_lat,
       CAST(7000 + (user_id * 29) % 100 AS DOUBLE) / 100 AS centroid_lon,
       CAST(event_id AS BIGINT) AS obs_id,
       concat('region_', user_id % 12) AS region_id,
       value
FROM {events}"""

# two dates of every site, 32 x 32 pixels in 8 x 8 blocks of one class
SQL["pixels"] = f"""
SELECT site_id, prow, pcol, noise, (noise % 13 = 0) AS bad_b, (noise % 11 = 0) AS bad_a,
       {_bands('b', ['blue', 'green', 'red', 'nir', 'swir'])}, {_bands('a', ['blue', 'green', 'red', 'nir', 'swir'])}
FROM (SELECT *, CAST((site_id * 7 + floor(prow / 8) * 3 + floor(pcol / 8) * 5) AS BIGINT) % 6 AS cb,
             CAST((site_id * 5 + floor(prow / 8) * 1 + floor(pcol / 8) * 4) AS BIGINT) % 6 AS ca
      FROM ({_PX0}) px0) px1"""

# four dates of every site in long form
SQL["epochs"] = f"""
SELECT site_id, epoch, prow, pcol, ((noise + epoch) % 13 = 0) AS bad,
       {_bands('e', ['blue', 'green', 'red', 'nir', 'swir']).replace('_e', '')}
FROM (SELECT *, CAST((site_id * 7 + epoch * (2 + site_id % 3) + floor(prow / 8) * 3 + floor(pcol / 8) * 5) AS BIGINT) % 6 AS ce
      FROM (SELECT *, {{epoch_list}} AS epoch FROM ({_PX0}) px0) pe) px1"""

# raw scenes in digital numbers, with the nodata sentinels
SQL["canvas"] = f"""
SELECT site_id AS scene_id, prow, pcol, noise,
       {", ".join(
           f"CASE WHEN noise = 5 THEN 0.0 WHEN noise = 7 THEN -9999.0 WHEN noise = 9 THEN CAST('NaN' AS DOUBLE) "
           f"ELSE CAST(({_case('c', _DN[b])}) * (CASE WHEN noise > 70 THEN 3 ELSE 1 END) + noise * {k} AS DOUBLE) END AS {b}"
           for k, b in enumerate(_DN, start=1))},
       (noise % 13 = 0) AS bad
FROM (SELECT *, CAST((site_id * 7 + floor(prow / 8) * 3 + floor(pcol / 8) * 5) AS BIGINT) % 6 AS c FROM ({_PX0}) px0) px1"""

# scenes prepared for cloud removal: probability, mask, byte colours and a clear later scene
SQL["clouds"] = f"""
SELECT site_id AS scene_id, prow, pcol, noise,
       CAST(k * 10 + noise % 10 AS DOUBLE) / 100 AS prob, (k * 10 + noise % 10 >= 40) AS cloud,
       CAST((k * 20 + noise) % 256 AS DOUBLE) AS red, CAST((k * 23 + noise * 2) % 256 AS DOUBLE) AS green,
       CAST((k * 19 + noise * 3) % 256 AS DOUBLE) AS blue,
       CAST((noise * 5) % 256 AS DOUBLE) AS red_later, CAST((noise * 6) % 256 AS DOUBLE) AS green_later,
       CAST((noise * 7) % 256 AS DOUBLE) AS blue_later
FROM (SELECT *, CAST((site_id * 3 + floor(prow / 8) * 5 + floor(pcol / 8) * 7) AS BIGINT) % 10 AS k
      FROM ({_PX0}) px0) px1"""

SQL["vectors"] = """
SELECT concat('tile_', vec_id) AS tile_id, vec_id,
       CASE WHEN vec_id % 5 = 0 THEN 'maxar_tile_embeddings' ELSE 'tile_embeddings' END AS collection,
       CAST(embedding AS {float_array}) AS embedding, CAST(label AS BIGINT) AS cluster_no
FROM {embeddings}"""

SQL["items"] = """
SELECT concat('item_', event_id) AS item_id, CAST(event_id AS BIGINT) AS item_no, user_id % 20 AS granule,
       ts AS datetime, value % 100 AS cloud_cover,
       70.0 + CAST((event_id * 31) % 100 AS DOUBLE) / 100 AS min_lon, 20.0 + CAST((event_id * 17) % 100 AS DOUBLE) / 100 AS min_lat,
       70.0 + CAST((event_id * 31) % 100 + 40 + event_id % 60 AS DOUBLE) / 100 AS max_lon,
       20.0 + CAST((event_id * 17) % 100 + 40 + event_id % 50 AS DOUBLE) / 100 AS max_lat
FROM {events}"""

# one area of interest per supplier: a quadrilateral
SQL["areas"] = """
SELECT concat('aoi_', s_suppkey) AS aoi_id, CAST(s_suppkey AS BIGINT) AS aoi_no,
       cx - w AS x1, cy - 0.5 * w AS y1, cx + w AS x2, cy - w AS y2,
       cx + 0.7 * w AS x3, cy + w AS y3, cx - w AS x4, cy + 0.8 * w AS y4
FROM (SELECT s_suppkey, 70.0 + CAST((s_suppkey * 37) % 100 AS DOUBLE) / 100 AS cx,
             20.0 + CAST((s_suppkey * 53) % 100 AS DOUBLE) / 100 AS cy,
             0.02 + CAST(s_suppkey % 9 AS DOUBLE) / 100 AS w FROM {supplier}) s"""

# raster file names derived from the page table
SQL["files"] = """
SELECT page_id AS file_no,
       concat(CASE page_id % 5 WHEN 0 THEN 'datasets/tiles/' WHEN 1 THEN 'scene/intermediate/' WHEN 2 THEN 'scene/raw/'
                   WHEN 3 THEN '/app/data/in/' ELSE 'data/' END,
              CASE page_id % 6 WHEN 0 THEN 'LC08_' WHEN 1 THEN 'S2A_' WHEN 2 THEN 'WORLDVIEW_' WHEN 3 THEN 'scene_'
                   WHEN 4 THEN 'S2B_' ELSE 'LC09_SR_' END,
              CASE page_id % 4 WHEN 0 THEN concat('20', 10 + page_id % 15, '0', 1 + page_id % 9, 10 + page_id % 19)
                   WHEN 1 THEN concat('19', 80 + page_id % 19, '12', 10 + page_id % 19) ELSE concat('id', page_id) END,
              CASE page_id % 14 WHEN 0 THEN '_B2' WHEN 1 THEN '_B03' WHEN 2 THEN '_B4' WHEN 3 THEN '_B5' WHEN 4 THEN '_B8A'
                   WHEN 5 THEN '_B11' WHEN 6 THEN '_B12' WHEN 7 THEN '_raw_canvas' WHEN 8 THEN '_cloud_mask'
                   WHEN 9 THEN '_probability' WHEN 10 THEN '_SCL' WHEN 11 THEN '_nir' WHEN 12 THEN '_B06' ELSE '_plain' END,
              '.tif') AS path,
       CASE WHEN page_id % 11 = 0 THEN 'LANDSAT_9' WHEN page_id % 13 = 0 THEN 'Sentinel-2' ELSE '' END AS platform_tag,
       url
FROM {pages}"""

SQL["registry"] = """
SELECT concat(CASE WHEN p_partkey % 50 = 3 THEN 'dup' ELSE concat('ds_', p_partkey) END) AS dataset_id, p_name AS display_name,
       CASE p_partkey % 5 WHEN 0 THEN 'pipeline_validation' WHEN 1 THEN 'eastern_ladakh'
            WHEN 2 THEN 'benchmark_change_detection' WHEN 3 THEN 'maritime' ELSE p_brand END AS domain,
       CASE WHEN p_size % 2 = 0 THEN 'Sentinel-2 MSI' ELSE 'Sentinel-1 C-SAR' END AS sensor,
       CASE p_type WHEN 'ECONOMY' THEN 'multispectral' WHEN 'PROMO' THEN 'optical' WHEN 'STANDARD' THEN 'sar'
            WHEN 'SMALL' THEN 'multimodal' ELSE p_type END AS modality,
       CASE p_size % 6 WHEN 0 THEN 'preprocessing_validation' WHEN 1 THEN 'temporal_change_detection'
            WHEN 2 THEN 'semantic_change_detection' WHEN 3 THEN 'ship_detection' WHEN 4 THEN 'semantic_retrieval'
            ELSE 'other_task' END AS task,
       'Everywhere' AS geographic_scope, '2017-2026' AS time_range, '10m GSD' AS spatial_resolution,
       CASE WHEN p_partkey % 23 = 0 THEN '  ' ELSE 'archive' END AS source, 'open' AS license,
       concat('datasets/', p_partkey) AS local_path,
       CASE p_partkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'configured' WHEN 2 THEN 'placeholder' ELSE 'archived' END AS status,
       CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 'note' END AS notes, CAST(p_partkey AS BIGINT) AS entry_no
FROM {part}"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table (or a plain sample table) as a DataFrame."""
    if name in TABLES:
        return source(spark, sf_dir, name)
    text = _dialect(name, _SPARK_TEXT)
    frames = {t: source(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **frames)


def cte(*names: str) -> str:
    """``WITH`` prefix that defines the domain tables for the DuckDB check."""
    parts = []
    for name in names:
        text = _dialect(name, _DUCKDB_TEXT)
        parts.append(f"{name} AS ({text.format(**{t: t for t in TABLES})})")
    return "WITH " + ",\n".join(parts)
