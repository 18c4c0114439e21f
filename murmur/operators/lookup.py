"""Joins with lookup tables whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 500_000, 64 << 20


def small_side(
    table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Mark ``table`` for broadcast if it has at most so many rows and bytes.

    A larger table is returned as it is: the join is then shuffled, and adaptive
    execution splits its skewed keys.  The result is the same either way.
    """
    return F.broadcast(table) if fits(table, max_rows, max_bytes) else table


def fits(
    table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Does ``table`` have at most so many rows, and so many bytes when written as JSON?

    Reads no more than one row beyond ``max_rows``.
    """
    written = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = table.limit(max_rows + 1).agg(F.count("*"), written).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def active_directory(
    names: DataFrame, directory: DataFrame, key: str = "name", value: str = "account_id"
) -> DataFrame:
    """Names with their directory entry; unknown names are left out."""
    return names.join(small_side(directory.select(key, value)), key, "inner")


def unknown_names(names: DataFrame, directory: DataFrame, key: str = "name") -> DataFrame:
    """Names that have no directory entry."""
    return names.join(small_side(directory.select(key)), key, "left_anti")


def tag_members(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a boolean column: does ``key`` occur in ``members``?"""
    marked = members.select(key).distinct().withColumn(flag, F.lit(True))
    joined = df.join(small_side(marked), key, "left")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))
