"""Splitting of two keyed tables into pairs of bounded blocks.

Comparing every row of a key with every other cannot be one task when one key may hold
a third of the table. Both sides of a key are dealt into blocks of bounded size; each
pair of blocks is one task. Keys are matched by a normal join, so keys found on only
one side cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str,
          block_rows: int = 4096, right_rows: int | None = None, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both sides without copies: ``left`` with its block ``_lb`` and the number ``_nr`` of the right side's blocks, ``right`` with ``_rb`` and ``_nl``.
    ``right_rows`` is the size of the right side's blocks, where it is another. The left side of a key has ``least`` blocks
    or more, if they hold 256 rows each, so that a few large blocks still keep many tasks busy."""
    def sizes(df: DataFrame, name: str, rows: int, least: int = 1) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy(*key).agg(F.greatest(F.ceil(n / rows), F.least(F.lit(least).cast("bigint"), F.ceil(n / 256))).alias(name))

    both = sizes(left, "_nl", block_rows, least).join(sizes(right, "_nr", right_rows or block_rows), key)
    deal = lambda i, n: F.pmod(F.xxhash64(i), F.col(n))
    return left.join(both, key).withColumn("_lb", deal(left_id, "_nl")).drop("_nl"), right.join(both, key).withColumn("_rb", deal(right_id, "_nr")).drop("_nr")


def copied(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``dealt`` once for every block of the other side, ready for a cogroup on key, _lb, _rb."""
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    return left.withColumn("_rb", many("_nr")).drop("_nr"), right.withColumn("_lb", many("_nl")).drop("_nl")


def block_pairs(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str,
                block_rows: int = 4096, right_rows: int | None = None, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_lb`` and ``_rb`` block numbers, ready for a cogroup on key, _lb, _rb; see ``dealt``."""
    return copied(*dealt(left, right, key, left_id, right_id, block_rows, right_rows, least))
