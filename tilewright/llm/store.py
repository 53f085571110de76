"""Intermediate tables in the shared folder, and prefix sums that no key can overload."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from .kernel import BITS, hit


BATCH_BYTES = "1m"


def small_batches(spark: SparkSession) -> None:
    """Let Python workers of this session take and return at most 1 MB of rows at a time. The default counts rows, of which
    10,000 long texts fill tens of MB on the JVM's side, outside its heap, and again in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table, by way of Arrow. A list goes through an RDD of Python objects, for which every executor
    starts Python workers beside those of the queries and keeps them."""
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return spark.createDataFrame(pa.table([pa.array(c, arrow[k]) for c, k in zip(columns, kinds)], names=list(names)))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: its lineage ends there, so a
    lost executor costs a read, and later uses don't compute it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def folded(ids: np.ndarray) -> np.ndarray:
    """Document ids as bitmap places; ``folded_column`` is the same for Spark."""
    ids = np.ascontiguousarray(ids).view(np.uint64)
    return ids ^ (ids >> np.uint64(24))


def folded_column(column: str) -> Column:
    return F.col(column).bitwiseXOR(F.shiftrightunsigned(column, 24))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone`` (column doc_id); null ids stay.

    Texts aren't shuffled to drop some of them: a bitmap of fixed size tells the rows that are surely
    not in ``gone``. The ids of the others are joined exactly, and those that the bitmap took for gone come
    back by a join with just them. A bitmap that fills up costs a shuffle, not rows.
    """
    gone = materialise(gone.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "gone")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(folded_column("doc_id").alias("hash"))))

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        return pd.Series(known & hit(bits.value, folded(ids.fillna(0).to_numpy(np.int64))))

    key = docs["doc_id"].cast("bigint")
    doubtful = docs.where(maybe(key))
    wrongly = materialise(doubtful.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(gone, "doc_id", "left_anti").withColumnRenamed("doc_id", "_back"), "wrongly-gone")
    clear = docs.where(~maybe(key))
    if wrongly.isEmpty():
        return clear
    return clear.unionByName(doubtful.join(wrongly, key == wrongly["_back"], "left_semi"))


def running_start(df: DataFrame, keys: list[str], bucket: Column, order: list, size: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows of the same keys that come earlier.

    Rows are ordered by ``bucket``, then by ``order``. Only the rows of one bucket are ever
    sorted together, and only one total per bucket is summed up along a key; keys may be null.
    """
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*keys, "_bucket").agg(F.sum(size).alias("_total"))
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum(size).over(within), F.lit(0)))
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(totals, same).withColumn(out, F.col("_base") + F.col("_inner")).drop(
        "_bucket", "_b", "_base", "_inner", *[f"_k{i}" for i in range(len(keys))])


def bitmap(codes: DataFrame) -> np.ndarray:
    """One bit per value of the low BITS bits of ``hash``: at most 2**(BITS - 15) rows of 4 kB."""
    place = F.col("hash").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = codes.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out
