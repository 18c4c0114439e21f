"""Duplicate removal."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.settings import WATERMARK_DELAY, interval


def dedupe_latest(
    df: DataFrame, key: str = "tweet_id", time: str = "created_at", arrival: str = "arrival"
) -> DataFrame:
    """Keep the latest row per key; equal times keep the first to arrive.

    ``row_number() = 1`` lets Spark cut every map partition down to one row per
    key before the shuffle (WindowGroupLimit), so an id that holds a third of
    all rows reaches its reducer as one row per map task.
    """
    newest = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(arrival).asc())
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def dedupe_first_in_stream(
    df: DataFrame,
    key: str = "tweet_id",
    time: str = "created_at",
    delay: timedelta = WATERMARK_DELAY,
    spread: bool = False,
) -> DataFrame:
    """Streaming form: the first arrival wins, and state is dropped behind the watermark.

    A stream cannot take back a row it has passed on, so it keeps the first row
    where the batch form keeps the latest.  ``spread`` first removes duplicates
    per (key, input partition): a key that holds a large part of a batch then
    meets in one task as one row per input partition.  It costs a second state
    entry per key, and a repeat later than the delay may pass or not by the
    partition it arrives in, so it is off unless asked for.
    """
    marked = df.withWatermark(time, interval(delay))
    if not spread:
        return marked.dropDuplicatesWithinWatermark([key])
    split = marked.withColumn("_part", F.spark_partition_id())
    once = split.dropDuplicatesWithinWatermark([key, "_part"]).drop("_part")
    return once.dropDuplicatesWithinWatermark([key])


def by_time(df: DataFrame, time: str = "created_at", key: str = "tweet_id") -> DataFrame:
    return df.orderBy(time, key)
