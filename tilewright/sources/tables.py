"""Tables that are changed in place while others read them: Parquet folders by partition, and a log of the current ones.

A change writes one new batch folder with the partitions that it touches, then a new version of the log, which lists for every
partition the batches that hold it: one, until rows are appended. The version appears by one rename that fails if another writer was first; who reads
holds a version and sees its files until ``vacuum`` deletes them. Files of other partitions are neither read nor written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.catalog import latest_version

LISTED = 10_000  # partitions named one by one; a change that touches more finds them by a join
PLACE = "p"  # folder column: a hash of the partition's values


class WriteConflict(RuntimeError):
    """Another writer has committed since this change was read."""


class LoggedTable:
    """A table below ``path``, dealt by the columns ``parts`` (nulls are values)."""

    def __init__(self, spark: SparkSession, path: str, parts: list[str]):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    @classmethod
    def create(cls, path: str, rows: DataFrame, parts: list[str]) -> LoggedTable:
        table = cls(rows.sparkSession, path, parts)
        rows.sparkSession.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.text(f"{table.path}/schema")
        table._commit(1, table._write(rows))
        return table

    # ---- the log ----

    def _hadoop(self, path: str):
        java = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return java, java.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._hadoop(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("log") if n[0] == "v")

    def manifest(self, version: int | None = None) -> DataFrame:
        """The partitions of a version (the newest) and the batches that hold them."""
        return self.spark.read.parquet(f"{self.path}/log/v{version or self.versions()[-1]:010d}")

    def _commit(self, version: int, manifest: DataFrame) -> None:
        staged = f"{self.path}/log/staged-{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(staged)
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE  # don't replace
        source, target = self._hadoop(staged)[0], self._hadoop(f"{self.path}/log/v{version:010d}")[0]
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, never)
        except Exception as e:
            if version in self.versions():
                raise WriteConflict(f"version {version} of {self.path} exists") from e
            raise

    # ---- files ----

    def _placed(self, rows: DataFrame) -> DataFrame:
        known = [x for c in self.parts for x in (F.col(c).isNull(), F.col(c))]
        return rows.withColumn(PLACE, F.xxhash64(*known))

    def _write(self, rows: DataFrame) -> DataFrame:
        """Rows as a new batch; its partitions."""
        batch = uuid.uuid4().hex
        path = f"{self.path}/data/{batch}"
        placed = self._placed(rows)
        placed.hint("rebalance", PLACE).write.partitionBy(PLACE).parquet(path)
        stored = self.spark.read.schema(placed.schema).parquet(path)
        return stored.select(PLACE, *self.parts).distinct().withColumn("batch", F.lit(batch))

    def _load(self, held: list) -> DataFrame | None:
        """Rows of the listed (batch, partition) folders."""
        out = None
        for batch in sorted({r.batch for r in held}):
            base = f"{self.path}/data/{batch}"
            folders = [f"{base}/{PLACE}={r[PLACE]}" for r in held if r.batch == batch]
            rows = self.spark.read.option("basePath", base).parquet(*folders).drop(PLACE)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self, where: Column | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version. ``where`` is about the partition columns and opens only the folders it holds for."""
        manifest = self.manifest(version)
        held = (manifest if where is None else manifest.where(where)).collect()  # a row per partition and batch
        rows = self._load(held)
        if rows is None:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0])))
        return rows if where is None else rows.where(where)

    # ---- changes ----

    def _change(self, touched: DataFrame, merge) -> None:
        """Replace the partitions of ``touched`` (their columns) by what ``merge`` makes of their rows (None: no rows yet)."""
        version = self.versions()[-1]
        manifest = self.manifest(version)
        places = self._placed(touched.select(*self.parts).distinct())
        named = [r[0] for r in places.select(PLACE).limit(LISTED + 1).collect()]
        if len(named) <= LISTED:
            held = manifest.where(F.col(PLACE).isin(named)).collect()
            left = manifest.where(~F.col(PLACE).isin(named))
        else:
            held = manifest.join(places.select(PLACE), PLACE, "left_semi").collect()
            left = manifest.join(places.select(PLACE), PLACE, "left_anti")
        written = self._write(merge(self._load(held)))
        self._commit(version + 1, left.unionByName(written.select(*left.columns)))

    def upsert(self, new: DataFrame, key: list[str], order: str) -> None:
        """Merge rows into the table: of rows with the same ``key`` in a partition the one with the largest ``order`` stays."""
        self._change(new, lambda old: latest_version(new if old is None else old.select(*new.columns).unionByName(new), [*self.parts, *key], F.col(order)))

    def append(self, new: DataFrame) -> None:
        """Add rows without reading any: partitions are then held by one more batch."""
        version = self.versions()[-1]
        manifest = self.manifest(version)
        self._commit(version + 1, manifest.unionByName(self._write(new).select(*manifest.columns)))

    def compact(self, key: list[str], order: Column, most: int = 8) -> bool:
        """Partitions in more than ``most`` batches rewritten as one, with the row of the largest ``order`` per ``key``; whether there were any."""
        version = self.versions()[-1]
        manifest = self.manifest(version)
        crowded = [r[0] for r in manifest.groupBy(PLACE).count().where(F.col("count") > most).select(PLACE).collect()]
        if not crowded:
            return False
        rows = self._load(manifest.where(F.col(PLACE).isin(crowded)).collect())
        written = self._write(latest_version(rows, [*self.parts, *key], order))
        self._commit(version + 1, manifest.where(~F.col(PLACE).isin(crowded)).unionByName(written.select(*manifest.columns)))
        return True

    def replace(self, new: DataFrame, owner: str, owners: DataFrame | None = None) -> None:
        """All rows of the owners replaced by ``new``: those in ``owners``, which may have no new rows, or else those that
        ``new`` has rows of. An owner's rows lie in one partition: ``parts`` are functions of it."""
        owners = (new if owners is None else owners).select(*self.parts, owner).distinct()
        self._change(owners, lambda old: new if old is None else old.join(owners.select(owner), owner, "left_anti").select(*new.columns).unionByName(new))

    def vacuum(self, keep: int = 2) -> None:
        """Delete the versions before the last ``keep``, and the batches that only they or failed changes used. Readers of
        older versions and writers at work must be done."""
        kept = self.versions()[-keep:]
        used = {r.batch for v in kept for r in self.manifest(v).select("batch").distinct().collect()}
        for folder, gone in (("data", lambda n: n not in used), ("log", lambda n: n[0] != "v" or int(n[1:]) not in kept)):
            for name in filter(gone, self._names(folder)):
                path, files = self._hadoop(f"{self.path}/{folder}/{name}")
                files.delete(path, True)
