"""Running totals of groups of any size with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(hexadecimal: Column, blocks: int) -> Column:
    """A block number that rises with the first 32 bits of a hexadecimal hash."""
    head = F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("bigint")
    return F.floor(head * F.lit(blocks) / F.lit(1 << 32)).cast("bigint")


def running_total(df: DataFrame, group: str, block: str, order: list[str], value: str, total: str) -> DataFrame:
    """Add ``total``: the sum of ``value`` up to the row, within ``group`` by ``order``.

    ``block`` must rise with ``order``.  A group is summed block by block, the block
    sums are added up, and only rows of one block are ever sorted together, so a group
    with a third of all rows is spread over its blocks.  ``group`` must not be null.
    """
    sums = df.groupBy(F.col(group).alias("_g"), F.col(block).alias("_b")).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_g", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(sums, (F.col(group) == F.col("_g")) & (F.col(block) == F.col("_b")))
    return joined.withColumn(total, F.col("_before") + F.sum(value).over(within)).drop("_g", "_b", "_before")
