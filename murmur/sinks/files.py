"""JSON-lines and partitioned file output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.parse import partition_date, partition_hour
from murmur.functions.text import normalize_coin

RAW_LAYOUT = ("coin", "date", "hour")


def balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Bring rows of one output directory together before a partitioned write.

    Rebalancing is a hint to adaptive execution: small directories share a task
    and a directory that holds a large part of the data is split over several.
    """
    return df.hint("rebalance", *columns)


def write_json(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append rows; an empty input adds none.  The input is evaluated once."""
    df.write.mode("append").json(path)


def raw_layout(df: DataFrame, coin: Column, time: Column | None = None) -> DataFrame:
    """Add the directory columns; rows without a time belong to the present hour."""
    now = F.current_timestamp()
    moment = now if time is None else F.coalesce(time, now)
    return df.withColumns(
        {
            "coin": normalize_coin(coin),
            "date": partition_date(moment),
            "hour": partition_hour(moment),
        }
    )


def store_raw_posts(
    df: DataFrame, root: str, coin: Column, time: Column | None = None, mode: str = "append"
) -> None:
    """Write posts as JSON lines under ``coin=/date=/hour=``, by each row's own time."""
    placed = raw_layout(df, coin, time)
    balanced(placed, *RAW_LAYOUT).write.mode(mode).partitionBy(*RAW_LAYOUT).json(root)


def replace_partitions(df: DataFrame, root: str, *columns: str, fmt: str = "parquet") -> None:
    """Overwrite just the directories that occur in ``df``."""
    (
        balanced(df, *columns)
        .write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .save(root)
    )
