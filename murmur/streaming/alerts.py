"""Spike alerts kept up to date by a stream of closed windows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from murmur.operators.alerts import COOL_DOWN
from murmur.settings import SpikeRule

CHANGE = (
    "symbol string, opened_at timestamp, last_spike_end timestamp, spike_windows bigint, peak_mentions bigint"
)
STATE = "recent array<bigint>, opened_us bigint, end_us bigint, spikes bigint, peak bigint"


def closed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows that an append-mode query writes, one folder per batch, as a stream.

    Keyed state may not follow an aggregate in one query, so the closed windows are the hand-over
    between two.  All files that are there make a batch: no batch of windows is split.
    """
    schema = "symbol string, window_start timestamp, window_end timestamp, mention_count bigint"
    return spark.readStream.schema(schema).parquet(f"{folder}/batch_id=*")


def _micros(time: pd.Timestamp) -> int:
    return time.value // 1000


def alert_changes(windows: DataFrame, rule: SpikeRule = SpikeRule(), cool_down: timedelta = COOL_DOWN) -> DataFrame:
    """A row for each spiking window: its alert as it is then.

    ``windows`` is a stream of windows that do not change any more, in the order of time from batch
    to batch (append mode).  The state of a symbol is small, whatever its history: the mentions of
    its last windows, for the baseline, and its last alert.
    """
    span = cool_down // timedelta(microseconds=1)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, opened, end, spikes, peak = state.get if state.exists else ([], None, None, 0, 0)
        recent, out = list(recent), []
        # A batch's windows of one symbol: no more than it closes.
        rows = pd.concat(list(parts)).sort_values(["window_end", "window_start"])
        for start, stop, mentions in zip(rows["window_start"], rows["window_end"], rows["mention_count"]):
            mean = sum(recent) / len(recent) if recent else 0.0
            # The baseline is kept with two decimals, halves rounded up.
            baseline = int(mean * 100 + 0.5) / 100
            is_spike = mentions >= rule.min_mentions and mentions / max(baseline, 1.0) >= rule.min_growth
            recent = [*recent, int(mentions)][-rule.history :]
            if not is_spike:
                continue
            first, last = _micros(start), _micros(stop)
            if end is None or first > end + span:
                opened, end, spikes, peak = first, last, 0, 0
            end, spikes, peak = max(end, last), spikes + 1, max(peak, int(mentions))
            out.append((key[0], pd.Timestamp(opened, unit="us"), pd.Timestamp(end, unit="us"), spikes, peak))
        state.update((recent, opened, end, spikes, peak))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "opened_at", "last_spike_end", "spike_windows", "peak_mentions"])

    return (
        windows.select("symbol", "window_start", "window_end", "mention_count")
        .groupBy("symbol")
        .applyInPandasWithState(follow, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)
    )
