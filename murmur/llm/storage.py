"""Scratch tables and files in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame

from murmur.session import scratch_path
from murmur.sinks import storage as files

#: Whether a query's shuffle files are deleted when it ends.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read from there.

    Cuts the lineage: a lost executor costs its running tasks, not the steps before.  What the
    writing shuffled is deleted as soon as the table is there, as nothing reads it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREES_SHUFFLES, None)
    spark.conf.set(FREES_SHUFFLES, True)
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREES_SHUFFLES)
        else:
            spark.conf.set(FREES_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    if (made := _passing.get()) is not None:
        made.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`stored` wrote; nothing that is still to be computed may read it."""
    for table in tables:
        files.delete(table.sparkSession, table.stored_at)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside go at the end, but for those given to the function that it yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    outer = _passing.set(made)
    try:
        yield lambda table: kept.append(table) or table
    finally:
        _passing.reset(outer)
        if (around := _passing.get()) is not None:
            around.extend(kept)
        for table in made:
            if all(table is not x for x in kept):
                discard(table)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """As many partitions as the session shuffles into, but ``least`` or more."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tasks_for(rows: DataFrame, row_bytes: int, task_bytes: int = 64 << 20) -> int:
    """Tasks for a shuffle of a stored table: as many as the session's, or more to keep each at ``task_bytes``."""
    return partitions_for(rows, -(-rows.count() * row_bytes // task_bytes))
