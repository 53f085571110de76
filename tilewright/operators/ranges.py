"""Row numbers per key, and ordered lists in fixed chunks, without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path


def numbered(rows: DataFrame, key: list[str], order: Column, name: str = "row_no") -> DataFrame:
    """Add the place of each row, from 0, among the rows of its key by ``order`` (unique per key).

    Rows are dealt by ranges of (key, order), so a hot key is spread over many ranges; counts of the earlier
    ranges are carried into the later ones. The dealt rows are stored, so that a repeated
    task can't deal them differently.
    """
    path = fresh_path(rows.sparkSession, "ranges")
    rows.withColumn("_order", order).repartitionByRange(*key, "_order").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], F.col("_range").alias("_own"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_range") == F.col("_own")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    inside = F.row_number().over(Window.partitionBy(*key, "_range").orderBy("_order"))
    joined = dealt.withColumn("_inside", inside).join(counts, same)
    return joined.withColumn(name, (F.col("_offset") + F.col("_inside") - 1).cast("bigint")).select(*rows.columns, name)


def in_chunks(rows: DataFrame, key: list[str], item: Column, order: Column, name: str, chunk_rows: int = 10000) -> DataFrame:
    """Ordered lists per key: chunk ``part`` holds rows part * chunk_rows and following. The rule is the
    same for every size of a key, and reading the parts in turn gives the whole order."""
    placed = numbered(rows, key, order)
    listed = placed.withColumn("part", F.floor(F.col("row_no") / chunk_rows)).groupBy(*key, "part").agg(
        F.sort_array(F.collect_list(F.struct(F.col("row_no").alias("_o"), item.alias("_v")))).alias("_l"))
    return listed.select(*key, "part", F.transform("_l", lambda x: x["_v"]).alias(name))
