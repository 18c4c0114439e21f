"""Sorted tables with a stored index of their files, so that a lookup opens only the files it needs.

Layout below ``root``::

    data    the rows, range-partitioned and sorted, in files of bounded size
    index   a row per file: its name, its rows, the first and last value of the leading column

The index is written last; a table without a finished one is not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.ranking import global_rank
from murmur.sinks import storage

FILE_ROWS = 1_000_000
POSITION = "position"


def write_indexed(df: DataFrame, root: str, *order: str, file_rows: int = FILE_ROWS) -> None:
    """Write ``df`` in the order of these columns, the first of which can be looked up.

    Rows without it cannot be found by a range; they are kept, and counted in the index.
    """
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.option("maxRecordsPerFile", file_rows).parquet(f"{root}/data")
    stored = spark.read.parquet(f"{root}/data")
    files = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("rows"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")
    )
    files.write.parquet(f"{root}/index")


def index(spark: SparkSession, root: str) -> DataFrame:
    if not storage.complete(spark, f"{root}/index"):
        raise ValueError(f"no finished table at {root}")
    return spark.read.parquet(f"{root}/index")


def read_range(spark: SparkSession, root: str, column: str, low, high) -> DataFrame:
    """Rows whose leading ``column`` lies in [low, high], from the files that can hold such rows.

    Only names of these files come to the driver, no more than the answer needs.
    """
    meets = (F.col("last") >= F.lit(low)) & (F.col("first") <= F.lit(high))
    names = sorted(row["file"] for row in index(spark, root).where(meets).select("file").collect())
    wanted: Column = F.col(column).between(F.lit(low), F.lit(high))
    if not names:
        return spark.read.parquet(f"{root}/data").where(F.lit(False))
    return spark.read.parquet(*(f"{root}/data/{name}" for name in names)).where(wanted)


def write_pages(table: DataFrame, root: str, order: list[Column], file_rows: int = FILE_ROWS) -> None:
    """Write ``table`` for reading by pages: ranked once, by an order that must be total."""
    write_indexed(global_rank(table, order, POSITION), root, POSITION, file_rows=file_rows)


def read_page(spark: SparkSession, root: str, number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1): the files that hold its positions are read, and nothing is ranked anew."""
    if number < 1:
        raise ValueError("pages are numbered from 1")
    first = (number - 1) * size + 1
    return read_range(spark, root, POSITION, first, first + size - 1).orderBy(POSITION).drop(POSITION)


def page_count(spark: SparkSession, root: str, size: int = 10) -> DataFrame:
    """Number of pages, from the index alone; an empty table has one."""
    pages = F.ceil(F.sum("rows") / size)
    return index(spark, root).agg(F.greatest(F.lit(1).cast("bigint"), pages).alias("pages"))
