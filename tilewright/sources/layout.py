"""Storage order of pixel tables: along a Z-curve, so that a window of rows and columns is in few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _spread(x: Column) -> Column:
    """The low 31 bits of a number, with a free bit before each."""
    x = x.cast("bigint")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def z_order(row: Column, col: Column) -> Column:
    """Place of a pixel on the Z-curve: bits of row and column in turn (both non-negative)."""
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))


def write_pixels(pixels: DataFrame, path: str, key: list[str], group_bytes: int = 16 << 20) -> None:
    """Store pixels by key and Z-order. Each row group then holds pixels of few squares of a site, and its
    least and greatest row and column tell whether a window touches it. A large site is dealt over many files."""
    placed = pixels.withColumn("_z", z_order(F.col("prow"), F.col("pcol")))
    dealt = placed.repartitionByRange(*key, "_z").sortWithinPartitions(*key, "_z").drop("_z")
    dealt.write.option("parquet.block.size", group_bytes).parquet(path)
