"""The few file-system calls the sinks need, through Hadoop so that any store works."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    location = hadoop.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    fs, location = _fs(spark, path)
    return fs.exists(location)


def complete(spark: SparkSession, path: str) -> bool:
    """Did a Spark write to ``path`` finish?"""
    return exists(spark, f"{path}/_SUCCESS")


def children(spark: SparkSession, path: str) -> list[str]:
    fs, location = _fs(spark, path)
    if not fs.exists(location):
        return []
    return [status.getPath().getName() for status in fs.listStatus(location)]


def delete(spark: SparkSession, path: str) -> None:
    fs, location = _fs(spark, path)
    fs.delete(location, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to the place of another, which goes; may be run again after a failure."""
    fs, old = _fs(spark, target)
    new = _fs(spark, source)[1]
    fs.delete(old, True)
    fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        raise OSError(f"cannot move {source} to {target}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, location = _fs(spark, path)
    stream = fs.open(location)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, or not at all if ``path`` is there already; tells which.

    The text goes to a hidden file first, which is renamed without replacing, so readers never
    see a part of it and of two writers just one succeeds.
    """
    fs, location = _fs(spark, path)
    hadoop, gateway = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    draft = hadoop.Path(location.getParent(), f".{location.getName()}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(hadoop, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = hadoop.FileContext.getFileContext(location.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, location, options)
    except Py4JJavaError:
        fs.delete(draft, False)
        if fs.exists(location):
            return False
        raise
    return True
