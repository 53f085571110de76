"""Readers of catalogue tables, manifests, areas, registries, items and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo, naming

TILE_RECORD = ("tile_id string, scene_id string, site_key string, acquisition_date string, "
               "quality struct<cloud_pct: double, quality_confidence: double, passed_gate: boolean>")
PAIR_RECORD = "pair_id string, t1_scene_id string, t2_scene_id string, time_delta_days bigint"
MANIFEST = (f"region_id string, scene_id string, status string, total_tiles bigint, "
            f"tiles array<struct<{TILE_RECORD.replace(' string', ': string').replace('quality struct', 'quality: struct')}>>, "
            f"temporal_pairs array<struct<{PAIR_RECORD.replace(' string', ': string').replace(' bigint', ': bigint')}>>")
GEOMETRY = "struct<type: string, coordinates: string>"
AREA_DOCUMENT = f"type string, coordinates string, geometry {GEOMETRY}, features array<struct<geometry: {GEOMETRY}>>"
ITEM_DOCUMENT = ("id string, bbox array<double>, properties struct<datetime: string, platform: string, `eo:cloud_cover`: double, "
                 "`proj:epsg`: string, `proj:crs`: string>, assets map<string, struct<href: string>>")
AOI_REGISTRY = "version string, aois array<struct<aoi_id: string, target_years: array<int>, seasonal_window: string, priority: int, status: string>>"


def catalogue(spark: SparkSession, path: str, regions: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Tiles stored by region and day; the filters prune folders before any file is opened."""
    df = spark.read.parquet(path)
    if regions:
        df = df.where(F.col("region_id").isin(regions))
    if start:
        df = df.where(F.col("day") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("day") <= F.lit(end).cast("date"))
    return df


def manifest_samples(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample of many manifest documents: their tiles, else their temporal
    pairs, else the document itself."""
    docs = spark.read.schema(MANIFEST).json(path, multiLine=True, recursiveFileLookup=True)
    tiles = docs.where("tiles IS NOT NULL").select("region_id", F.inline("tiles")).select(
        F.lit("tile").alias("kind"), "region_id", F.col("tile_id").alias("sample_id"), "scene_id", F.col("quality.passed_gate").alias("passed_gate"))
    pairs = docs.where("tiles IS NULL AND temporal_pairs IS NOT NULL").select("region_id", F.inline("temporal_pairs")).select(
        F.lit("pair").alias("kind"), "region_id", F.col("pair_id").alias("sample_id"), F.col("t1_scene_id").alias("scene_id"), F.lit(None).cast("boolean").alias("passed_gate"))
    itself = docs.where("tiles IS NULL AND temporal_pairs IS NULL").select(
        F.lit("document").alias("kind"), "region_id", F.col("scene_id").alias("sample_id"), "scene_id", F.lit(None).cast("boolean").alias("passed_gate"))
    return tiles.unionByName(pairs).unionByName(itself)


def areas(documents: DataFrame, text: str = "document") -> DataFrame:
    """Rings and box of each area document: Polygon, MultiPolygon, Feature or a FeatureCollection
    (several features become one area of several parts)."""
    doc = F.from_json(text, AREA_DOCUMENT)
    single = F.when(F.col("_d.type").isin("Polygon", "MultiPolygon"), F.array(F.struct(F.col("_d.type").alias("type"), F.col("_d.coordinates").alias("coordinates")))) \
        .when(F.col("_d.type") == "Feature", F.array(F.col("_d.geometry"))) \
        .when(F.col("_d.type") == "FeatureCollection", F.transform("_d.features", lambda f: f["geometry"]))
    ring = "array<array<array<double>>>"

    def rings(g: Column) -> Column:
        many = F.flatten(F.from_json(g["coordinates"], f"array<{ring}>"))
        return F.when(g["type"] == "Polygon", F.from_json(g["coordinates"], ring)).when(g["type"] == "MultiPolygon", many)

    df = documents.withColumn("_d", doc).withColumn("_g", F.filter(single, lambda g: g.isNotNull()))
    df = df.withColumns({"type": F.col("_d.type"), "rings": F.flatten(F.transform("_g", rings))}).drop("_d", "_g")
    every = F.flatten("rings")
    bounds = geo.ring_bounds(every)
    return df.withColumns(dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), bounds)))


DATASET_REGISTRY = "version string, datasets array<struct<" + ", ".join(f"{f}: string" for f in K.REGISTRY_FIELDS) + ">>"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file, each a JSON document of any layout; ``_unreadable`` holds the text of a broken one."""
    return spark.read.schema(schema + ", _unreadable string").json(path, multiLine=True, recursiveFileLookup=True, columnNameOfCorruptRecord="_unreadable")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file below ``path``: file, the parsed ``document``, and ``unreadable``, the text of a file that holds no such
    document (broken JSON, a blank file, a list or a value of another type). Files of no bytes give no row: Spark's file sources skip them."""
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), "value")
    parsed = texts.withColumn("_d", F.from_json("value", schema + ", _unreadable string", {"columnNameOfCorruptRecord": "_unreadable", "mode": "PERMISSIVE"}))
    fields = [f for f in parsed.schema["_d"].dataType.names if f != "_unreadable"]
    broken = F.col("_d").isNull() | F.col("_d._unreadable").isNotNull() | (F.trim("value") == "")
    return parsed.select("file", F.when(~broken, F.struct(*[F.col(f"_d.`{f}`").alias(f) for f in fields])).alias("document"), F.when(broken, F.col("value")).alias("unreadable"))


def unreadable_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold no such document."""
    return read_documents(spark, path, schema).where("unreadable IS NOT NULL").select("file", F.col("unreadable").alias("_unreadable"))


RECORD = ("tile_id: string, scene_id: string, site_key: string, source_type: string, acquisition_date: string, "
          "centroid: struct<latitude: double, longitude: double>, bounds_epsg4326: array<double>, geometry: string, "
          "quality: struct<cloud_pct: double, quality_confidence: double, passed_gate: boolean>, indices: struct<mean_ndvi: double, mean_ndwi: double, mean_ndbi: double>, "
          "bands: struct<band_order: array<string>, band_stats: string, pixel_scale: string>, storage: struct<geotiff_path: string, thumbnail_path: string, bad_mask_path: string>, "
          # the flat layout
          "centroid_lat: double, centroid_lon: double, bounds: array<double>, cloud_pct: double, quality_confidence: double, mean_ndvi: double, mean_ndwi: double, mean_ndbi: double, "
          "band_order: array<string>, geotiff_path: string, thumbnail_path: string, bad_mask_path: string")
FULL_MANIFEST = ("manifest_version string, generated_at string, region_id string, scene_id string, acquisition_date string, source_type string, total_tiles bigint, "
                 f"aoi_geometry string, metadata string, tiles array<struct<{RECORD}>>")


def tile_records(documents: DataFrame) -> DataFrame:
    """One row per tile of manifest documents (``document`` of ``read_documents`` with FULL_MANIFEST), in the nested layout with
    centroid, bounds, quality, indices, bands and storage, or with the same values beside the id. What a tile
    doesn't say of its scene, date and source, its document does."""
    rows = documents.where("document IS NOT NULL").select("file", F.col("document.region_id").alias("region_id"), F.col("document").alias("d"), F.explode("document.tiles").alias("t"))
    both = lambda nested, flat: F.coalesce(F.col(f"t.{nested}"), F.col(f"t.{flat}"))
    inherited = {n: F.coalesce(F.col(f"t.{n}"), F.col(f"d.{n}")) for n in ("scene_id", "acquisition_date", "source_type")}
    confidence = both("quality.quality_confidence", "quality_confidence")
    bounds = both("bounds_epsg4326", "bounds")
    edges = dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), (F.get(bounds, F.lit(i)) for i in range(4))))
    return rows.select(
        "file", "region_id", F.col("d.manifest_version").alias("manifest_version"), F.col("t.tile_id").alias("tile_id"), F.col("t.site_key").alias("site_key"),
        *[v.alias(n) for n, v in inherited.items()],
        both("centroid.latitude", "centroid_lat").alias("centroid_lat"), both("centroid.longitude", "centroid_lon").alias("centroid_lon"), *[v.alias(n) for n, v in edges.items()],
        F.col("t.geometry").alias("geometry"), both("quality.cloud_pct", "cloud_pct").alias("cloud_pct"), confidence.alias("quality_confidence"),
        F.coalesce("t.quality.passed_gate", confidence >= K.QUALITY_GATE).alias("passed_gate"), *[both(f"indices.{n}", n).alias(n) for n in ("mean_ndvi", "mean_ndwi", "mean_ndbi")],
        both("bands.band_order", "band_order").alias("band_order"), F.col("t.bands.band_stats").alias("band_stats"), F.col("t.bands.pixel_scale").alias("pixel_scale"),
        *[both(f"storage.{n}", n).alias(n) for n in ("geotiff_path", "thumbnail_path", "bad_mask_path")])


def aoi_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per registered area and target year."""
    df = json_documents(spark, path, AOI_REGISTRY).select(F.inline("aois"))
    return df.withColumn("year", F.explode("target_years")).drop("target_years")


def dataset_registry(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, DATASET_REGISTRY).select(F.inline("datasets"))


def items(documents: DataFrame, text: str = "document") -> DataFrame:
    """Flat scene rows of catalogue items; each asset by the first alias present."""
    df = documents.select(F.from_json(text, ITEM_DOCUMENT).alias("d"))
    epsg, crs = F.col("d.properties.`proj:epsg`"), F.col("d.properties.`proj:crs`")
    code = F.when(epsg.rlike(r"^\d+$"), F.concat(F.lit("EPSG:"), epsg)).otherwise(epsg)
    href = lambda names: F.coalesce(*[F.col("d.assets")[n]["href"] for n in names])
    return df.select(
        F.col("d.id").alias("scene_id"), F.col("d.properties.datetime").alias("acquisition_date"),
        F.coalesce("d.properties.platform", F.lit("Sentinel-2")).alias("sensor"), F.coalesce(code, crs, F.lit("EPSG:4326")).alias("crs"),
        F.coalesce("d.properties.`eo:cloud_cover`", F.lit(0.0)).alias("cloud_cover"), F.col("d.bbox").alias("bbox"),
        *[href(names).alias(f"{role}_href") for role, names in K.ASSET_ALIASES.items()])


def raster_files(spark: SparkSession, path: str) -> DataFrame:
    """File listing only: the content column is never read, so a task takes many files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return listed.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))


def describe_files(files: DataFrame, path: str, tags: list[Column]) -> DataFrame:
    """Sensor, band role, date and category inferred from each path and its tags."""
    name = F.element_at(F.split(path, "/"), -1)
    sensor = naming.sensor_of(name, tags)
    return files.withColumn("sensor", sensor).withColumns({
        "band": naming.band_of(name, F.col("sensor")), "taken": naming.date_in_name(name), "category": naming.raster_category(F.col(path))})


def triplets(first: DataFrame, second: DataFrame, label: DataFrame, dataset: str) -> DataFrame:
    """Before, after and label files matched by name, with the split taken from the name."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    low = F.lower(stem)
    df = first.select("name", F.col("path").alias("t1_path"))
    for other, column in ((second, "t2_path"), (label, "label_path")):
        df = df.join(other.select("name", F.col("path").alias(column)), "name", "left")
    return df.select(F.concat(F.lit(dataset + "_"), stem).alias("sample_id"), "t1_path", "t2_path", "label_path",
                     F.when(low.contains("train"), "train").when(low.contains("val"), "val").otherwise("test").alias("split"))


def scene_layers(files: DataFrame) -> DataFrame:
    """One row per scene with the path of each expected layer. A flat file wins over one in a
    sub-folder; a combined mask stands in for the bad-pixel mask."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tif$", "")
    layer = F.when(stem == "combined_mask", "bad_mask").otherwise(stem)
    rank = F.struct((stem == "combined_mask").cast("int"), F.size(F.split("path", "/")), F.col("path"))
    df = files.withColumns({"layer": layer, "_rank": rank}).where(F.col("layer").isin(K.SCENE_LAYERS))
    return df.groupBy("scene").agg(*[
        F.min_by(F.when(F.col("layer") == name, F.col("path")), F.when(F.col("layer") == name, F.col("_rank"))).alias(name) for name in K.SCENE_LAYERS])


def pixel_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], columns: list[str]) -> DataFrame:
    """Part of the stored pixel table: only the asked columns, row groups pruned by the window."""
    return spark.read.parquet(path).select(*columns).where(F.col("prow").between(*rows) & F.col("pcol").between(*cols))
