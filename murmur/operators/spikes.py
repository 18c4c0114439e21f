"""Mention spikes against a rolling baseline of earlier windows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.settings import SpikeRule, interval

KEY = ("symbol", "window_start", "window_end")


def _previous(history: int):
    return (
        Window.partitionBy("symbol").orderBy("window_end", "window_start").rowsBetween(-history, -1)
    )


def with_baseline(windows: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Mean mentions of the last ``history`` existing windows before each row.

    A row frame, so gaps between windows are skipped.  The input is already one
    row per (symbol, window): the busiest symbol has as many rows here as there
    were slides, however many posts it got.
    """
    mean = F.round(F.avg("mention_count").over(_previous(rule.history)), 2)
    usable = F.col("symbol").isNotNull() & F.col("window_end").isNotNull()
    baseline = F.coalesce(F.when(usable, mean), F.lit(0.0))
    return windows.withColumn("baseline_mention_count", baseline)


def spike_fields(mentions: Column, baseline: Column, rule: SpikeRule = SpikeRule()) -> dict[str, Column]:
    """Baseline, growth and flag; the flag tests the growth before rounding."""
    floor = F.round(F.greatest(baseline, F.lit(0.0)), 2)
    growth = mentions / F.greatest(baseline, F.lit(1.0))
    return {
        "baseline_mention_count": floor,
        "growth_rate": F.round(growth, 2),
        "is_spike": (mentions >= rule.min_mentions) & (growth >= rule.min_growth),
    }


def flag_spikes(windows: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Add baseline, growth rate and spike flag to trend windows.

    Rows without a symbol or a mention count get NULL spike fields.
    """
    with_mean = with_baseline(windows, rule)
    judged = F.col("symbol").isNotNull() & F.col("mention_count").isNotNull()
    fields = spike_fields(F.col("mention_count"), F.col("baseline_mention_count"), rule)
    return with_mean.withColumns({k: F.when(judged, v) for k, v in fields.items()})


def stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("updated_at", F.current_timestamp())


def with_zscore(windows: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Standard score of the mentions against the baseline frame; NULL without spread."""
    frame = _previous(rule.history)
    spread = F.nullif(F.stddev_samp("mention_count").over(frame), F.lit(0.0))
    mean = F.avg("mention_count").over(frame)
    return windows.withColumn("z_score", (F.col("mention_count") - mean) / spread)


def refresh_spikes(
    batch: DataFrame, history: DataFrame, rule: SpikeRule = SpikeRule()
) -> DataFrame:
    """Spike fields of every window that a batch of new or changed windows affects.

    ``history`` holds stored windows, at least the ``history`` windows before the
    oldest one in the batch and all later ones, per symbol.  Batch rows replace
    stored rows of the same key.  Returned are the batch rows and those stored
    rows whose baseline frame contains one of them, so the stored table ends up
    the same however the stream was cut into batches.
    """
    base = [c for c in batch.columns if c in history.columns]
    symbols = batch.select("symbol").distinct()
    kept = (
        history.join(symbols, "symbol", "left_semi")
        .join(batch.select(*KEY), list(KEY), "left_anti")
        .select(*base)
        .withColumn("_new", F.lit(False))
    )
    merged = batch.select(*base).withColumn("_new", F.lit(True)).unionByName(kept)
    frame = _previous(rule.history)
    touched = F.col("_new") | F.coalesce(F.max("_new").over(frame), F.lit(False))
    flagged = flag_spikes(merged.withColumn("_touched", touched), rule)
    return flagged.where("_touched").drop("_new", "_touched")


def history_tail(
    windows: DataFrame, horizon: timedelta, rule: SpikeRule = SpikeRule()
) -> DataFrame:
    """The stored windows that later batches can still need.

    That is every window young enough to change (it ends less than ``horizon``
    before the newest one) and, per symbol, the ``history`` windows before those.
    """
    newest = windows.agg(F.max("window_end")).scalar()
    is_open = F.col("window_end") > newest - F.expr(
        f"INTERVAL '{horizon.total_seconds():.6f}' SECOND"
    )
    latest = Window.partitionBy("symbol", "_open").orderBy(
        F.col("window_end").desc(), F.col("window_start").desc()
    )
    ranked = windows.withColumn("_open", is_open).withColumn("_rn", F.row_number().over(latest))
    return ranked.where(F.col("_open") | (F.col("_rn") <= rule.history)).drop("_open", "_rn")


def spike_alerts(flagged: DataFrame, severity: str = "high") -> DataFrame:
    """Spiking windows as open alerts with their figures in the payload."""
    spikes = flagged.where("is_spike")
    message = F.concat_ws(
        " ", F.col("symbol"), F.lit("mentions"), F.col("mention_count").cast("string")
    )
    return spikes.select(
        F.lit("mention_spike").alias("alert_type"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        F.create_map(
            F.lit("symbol"), F.col("symbol"),
            F.lit("baseline"), F.col("baseline_mention_count").cast("string"),
            F.lit("growth_rate"), F.col("growth_rate").cast("string"),
        ).alias("payload"),
    )
