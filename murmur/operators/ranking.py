"""Ranks over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.session import shared_dir

# monotonically_increasing_id keeps the row index in its lower 33 bits.
_INDEX_BITS = 33


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in ``order``, which must be total.

    The table is range-partitioned and sorted within partitions, so the sort is
    spread over the cluster.  Position = rows in earlier partitions + index in
    this one.  The sorted rows are checkpointed with their (partition, index)
    first, which fixes both however often a task is run again.  Only the row
    counts, one per partition, go through a single task.
    """
    spark = df.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .checkpoint()
        .withColumns(
            {
                "_part": F.shiftright("_id", _INDEX_BITS),
                "_index": F.col("_id").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)),
            }
        )
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    ranked = placed.join(F.broadcast(offsets), "_part")
    return ranked.withColumn(name, F.col("_offset") + F.col("_index") + 1).drop(
        "_id", "_part", "_index", "_offset"
    )
