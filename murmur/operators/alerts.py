"""The life of a spike alert: open, ongoing, closed."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COOL_DOWN = timedelta(minutes=15)
FIELDS = ("symbol", "opened_at", "last_spike_end", "spike_windows", "peak_mentions")


def seconds(span: timedelta) -> Column:
    return F.expr(f"INTERVAL '{span.total_seconds():.6f}' SECOND")


def alert_episodes(flagged: DataFrame, cool_down: timedelta = COOL_DOWN) -> DataFrame:
    """One row for each alert: the spiking windows of a symbol that follow each other.

    A spike opens an alert; the next one belongs to it if its window begins no later than
    ``cool_down`` after the last one's end, else it opens another.  The windows of a symbol are
    sorted together, which are as many as there were slides, however many posts it got.
    """
    spikes = flagged.where("is_spike")
    order = Window.partitionBy("symbol").orderBy("window_start", "window_end")
    so_far = F.max("window_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = so_far.isNull() | (F.col("window_start") > so_far + seconds(cool_down))
    numbered = spikes.withColumn("_opens", opens.cast("int")).withColumn(
        "_episode", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy("symbol", "_episode").agg(
        F.min("window_start").alias("opened_at"),
        F.max("window_end").alias("last_spike_end"),
        F.count("*").alias("spike_windows"),
        F.max("mention_count").alias("peak_mentions"),
    ).drop("_episode")


def with_status(episodes: DataFrame, windows: DataFrame, cool_down: timedelta = COOL_DOWN) -> DataFrame:
    """Add ``status`` and ``closed_at`` as of the newest window.

    An alert is closed once the cool-down after its last spike has passed without another,
    ongoing with several spiking windows until then, and open with one.
    """
    newest = windows.agg(F.max("window_end").alias("_newest"))  # one row
    ends = F.col("last_spike_end") + seconds(cool_down)
    status = (
        F.when(ends < F.col("_newest"), "closed").when(F.col("spike_windows") > 1, "ongoing").otherwise("open")
    )
    joined = episodes.crossJoin(F.broadcast(newest)).withColumn("status", status)
    return joined.withColumn("closed_at", F.when(F.col("status") == "closed", ends)).drop("_newest")


def latest_state(changes: DataFrame) -> DataFrame:
    """The newest row of each alert in a log of changes."""
    newest = Window.partitionBy("symbol", "opened_at").orderBy(F.desc("spike_windows"))
    return changes.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*FIELDS)
