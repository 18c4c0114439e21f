"""Joining the many small JSON files that appends leave in ``coin=/date=/hour=`` folders.

The lines of crowded folders are first written, joined, below ``root/_compaction/ID``, which readers of
``root`` do not see, and only when all are there do the new folders take the places of the old, by a rename.
A run that breaks off in between loses nothing: a folder that is still below the copy has not taken its
place, and the next run goes on with those.  While a
folder is replaced a reader may miss it, and lines appended to it meanwhile would be lost, so only
folders of days before ``before``, which no writer adds to, are taken.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.sinks import storage
from murmur.sinks.files import RAW_LAYOUT

FILE_BYTES = 128 << 20


def _folder(path: Column) -> Column:
    """The part of a file's path that names its partition."""
    return F.rtrim(F.regexp_extract(path, r"((?:[^/=]+=[^/]*/)+)[^/]*$", 1), F.lit("/"))


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, day, length) of every data file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    day = F.to_date(F.regexp_extract("path", r"/date=([0-9-]{10})/", 1))
    return files.select(_folder(F.col("path")).alias("folder"), day.alias("day"), "length")


def crowded_folders(spark: SparkSession, root: str, before: date, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(folder, files, bytes) of the folders with more files than their bytes need."""
    sizes = stored_files(spark, root).where(F.col("day") < F.lit(before)).groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    )
    return sizes.where(F.col("files") > F.greatest(F.ceil(F.col("bytes") / file_bytes), F.lit(1)))


def compact(spark: SparkSession, root: str, before: date, file_bytes: int = FILE_BYTES) -> int:
    """Join the files of crowded folders; return how many folders that were.

    A folder's files come to about ``file_bytes``, so a run that follows finds nothing to do.
    """
    pending = f"{root}/_compaction"
    for name in storage.children(spark, pending):
        if storage.complete(spark, f"{pending}/{name}"):
            _replace(spark, root, f"{pending}/{name}")
        storage.delete(spark, f"{pending}/{name}")
    # One row per crowded folder, as a writer of partitions lists them on the driver too.
    folders = crowded_folders(spark, root, before, file_bytes).collect()
    if not folders:
        return 0
    staged = f"{pending}/{uuid.uuid4().hex}"
    reader = spark.read.option("basePath", root).option("recursiveFileLookup", False)
    schema = "value string, coin string, date string, hour string"
    lines = reader.schema(schema).text([f"{root}/{row['folder']}" for row in folders])
    # The hour's text as it is in the folder's name: whole folders are replaced, so names must not change.
    parts = spark.createDataFrame(
        [(row["folder"], max(1, -(-row["bytes"] // file_bytes))) for row in folders], "folder string, wanted bigint"
    )
    # Rows tell their file as an encoded address, in which a plus stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    # The folders were listed on the driver, so they are few enough to go to every task; the lines do not travel for it.
    placed = lines.withColumn("folder", _folder(path)).join(F.broadcast(parts), "folder")
    dealt = placed.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("wanted")))
    # A file's rows meet in one task.
    (
        dealt.repartition(*RAW_LAYOUT, "part")
        .select("value", *RAW_LAYOUT)
        .write.partitionBy(*RAW_LAYOUT)
        .option("compression", "none")
        .text(staged)
    )
    _replace(spark, root, staged)
    storage.delete(spark, staged)
    return len(folders)


def _replace(spark: SparkSession, root: str, staged: str) -> None:
    """Move the folders that are left below the whole copy to their places."""
    inner = [""]
    for _ in RAW_LAYOUT:
        inner = [f"{f}/{n}" for f in inner for n in storage.children(spark, f"{staged}{f}") if "=" in n]
    for folder in inner:
        storage.replace(spark, f"{staged}{folder}", f"{root}{folder}")
