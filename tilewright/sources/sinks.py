"""Writers: upserts, replacement by site, manifests, partitioned tiles, raster files, feature lines, audit rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import latest_version
from ..operators.ranges import in_chunks
from ..session import dealt, fresh_path

FOLDER_FILES = 256  # raster files of a folder


def write_and_read(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to a new folder in the shared space and return the stored table."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def raster_files(rasters: DataFrame, path: str) -> None:
    """One small file per row of ``rasters`` (path), also where rasters share a path; a file's folder carries the raster's own path.

    Above it are folders of about ``FOLDER_FILES`` files, which a reader lists side by side. Rasters of a path are of one task, so that a
    task that is run again writes the same names. Files go through pyarrow's file systems, which know the scheme of ``path``:
    Spark's writers start two processes for every file of a local folder, to set its mode, and move each raster's folder by the driver.
    """
    folders = max(1, -(-rasters.count() // FOLDER_FILES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path)
        stored: Counter = Counter()
        for batch in batches:
            for name, folder in zip(*(column.to_pylist() for column in batch.columns)):
                own = f"{base}/folder={folder}/path={quote(name, safe='')}"
                if own not in stored:
                    files.create_dir(own, recursive=True)
                with files.open_output_stream(f"{own}/raster-{stored[own]}.txt") as out:
                    out.write(b"x\n")
                stored[own] += 1
        yield pa.RecordBatch.from_arrays([pa.array([stored.total()], pa.int64())], names=["files"])

    rows = rasters.select("path", F.pmod(F.xxhash64("path"), F.lit(folders)).alias("folder")).na.fill("__HIVE_DEFAULT_PARTITION__", "path")
    dealt(rows, "folder").mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def upsert(old: DataFrame, new: DataFrame, key: list[str], batch: str) -> DataFrame:
    """Old and new rows merged, last batch wins, every column replaced.

    The result goes to a new table folder: readers keep the old one until they switch.
    """
    return latest_version(old.unionByName(new), key, F.col(batch))


def _touched(spark: SparkSession, path: str, new: DataFrame, parts: list[str]) -> DataFrame:
    """The stored rows of the partitions that ``new`` has rows for; other folders aren't opened."""
    return spark.read.parquet(path).join(new.select(*parts).distinct(), parts, "left_semi")


def _overwrite(df: DataFrame, path: str, parts: list[str]) -> None:
    """Replace the partitions that ``df`` has rows of. It is stored first, because it is made from them."""
    stored = write_and_read(df, "staged")
    stored.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def upsert_in_place(spark: SparkSession, path: str, new: DataFrame, parts: list[str], key: list[str], batch: str) -> None:
    """Merge ``new`` into a table stored by ``parts`` (functions of the key): only partitions with new rows are rewritten."""
    merged = upsert(_touched(spark, path, new, parts).select(*new.columns), new, [*parts, *key], batch)
    _overwrite(merged, path, parts)


def site_buckets(rows: DataFrame, site: str, buckets: int = 64) -> DataFrame:
    """Add the partition column of tables kept by site."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(site), F.lit(buckets)).cast("int"))


def replace_in_place(spark: SparkSession, path: str, new: DataFrame, site: str, buckets: int = 64) -> None:
    """All stored rows of the sites in ``new`` replaced by its rows: only their buckets are rewritten."""
    new = site_buckets(new, site, buckets)
    _overwrite(replace_sites(_touched(spark, path, new, ["bucket"]).select(*new.columns), new, site), path, ["bucket"])


def replace_sites(old: DataFrame, new: DataFrame, site: str) -> DataFrame:
    """All rows of the sites in ``new`` replaced by its rows."""
    return old.join(new.select(site).distinct(), site, "left_anti").unionByName(new)


def manifests(tiles: DataFrame, run: list[str], record: Column, order: Column, part_rows: int = 10000) -> DataFrame:
    """Documents of a run with totals and tile records in order: document ``part`` holds the records
    part * part_rows and following, whatever the size of the run."""
    totals = tiles.groupBy(*run).agg(F.count(F.lit(1)).alias("total_tiles"))
    listed = in_chunks(tiles, run, record, order, "tiles", part_rows)
    return listed.join(totals, run).select(F.lit("2.0.0").alias("manifest_version"), *run, "total_tiles", "part", "tiles")


def feature_lines(df: DataFrame, ring: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature per row as a JSON line."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_documents(rows: DataFrame, number: Column, entry: Column, order: Column, name: str, folder: str) -> str:
    """Pretty-printed JSON documents of a bounded number of entries each, one per file."""
    listed = rows.groupBy(number.alias("document")).agg(F.sort_array(F.collect_list(F.struct(order.alias("_o"), entry.alias("_e")))).alias("_l"))
    text = F.to_json(F.struct(F.lit("1").alias("version"), F.transform("_l", lambda x: x["_e"]).alias(name)), {"pretty": "true"})
    path = fresh_path(rows.sparkSession, folder)
    listed.select("document", text.alias("value")).repartition("document").write.partitionBy("document").text(path)
    return path


def write_lines(lines: DataFrame, name: str) -> str:
    path = fresh_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def append(spark: SparkSession, rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
