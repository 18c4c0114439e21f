"""Batch and streaming readers for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.schemas import RAW_POST, TYPED_POST


def with_arrival(df: DataFrame) -> DataFrame:
    """Add ``arrival``: file, block and row order of a file scan.

    Row ids grow within a block, so the order does not depend on which task
    reads which block.
    """
    return df.withColumn(
        "arrival",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def read_lines(spark: SparkSession, path: str | list[str], arrival: bool = False) -> DataFrame:
    """Text lines as ``value``, blank lines left out."""
    lines = spark.read.text(path)
    if arrival:
        lines = with_arrival(lines)
    return lines.where(F.trim("value") != "")


def read_posts(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = RAW_POST
) -> DataFrame:
    """JSON posts with a fixed schema; ``schema=None`` infers it with an extra pass."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_partitioned_posts(
    spark: SparkSession, root: str, schema: T.StructType = RAW_POST, path: str | None = None
) -> DataFrame:
    """Posts stored under ``coin=/date=/hour=`` directories, with these columns.

    Filters on the three columns skip whole directories.  ``path`` may narrow the
    scan to a glob below ``root``.  The directory columns have fixed types, so a
    coin named like a number stays text.
    """
    fields = [f for f in schema.fields if f.name not in ("coin", "date", "hour")]
    full = (
        T.StructType(fields)
        .add("coin", T.StringType())
        .add("date", T.DateType())
        .add("hour", T.IntegerType())
    )
    return spark.read.schema(full).option("basePath", root).json(path or root)


def stream_posts(
    spark: SparkSession,
    path: str,
    schema: T.StructType = TYPED_POST,
    files_per_trigger: int | None = 1,
) -> DataFrame:
    """JSON files of a directory as a stream of posts."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def stream_lines(
    spark: SparkSession, path: str, topic: str = "files", files_per_trigger: int | None = 1
) -> DataFrame:
    """Text files of a directory as a stream of (topic, value) messages."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.lit(topic).alias("topic"), "value")


def read_documents(
    spark: SparkSession, path: str, fmt: str = "parquet", time: str = "timestamp"
) -> DataFrame:
    """A stored collection without its internal id, with a real timestamp column."""
    df = spark.read.format(fmt).load(path).drop("_id")
    if isinstance(df.schema[time].dataType, T.StringType):
        df = df.withColumn(time, F.try_to_timestamp(time))
    return df


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A rated word list in the published layout: token, mean, deviation, ratings by tab."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", "\t")
    return lines.select(
        F.trim(parts[0]).alias("token"), parts[1].cast("double").alias("valence")
    )


def find(
    df: DataFrame, where: str, columns: list[str], order: str, limit: int
) -> DataFrame:
    """Filtered, projected, sorted and limited lookup, newest first."""
    return df.where(where).orderBy(F.desc(order)).limit(limit).select(*columns)


def union_topics(*streams: DataFrame) -> DataFrame:
    """Bag union of inputs that need not have the same columns."""
    first, *others = streams
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
