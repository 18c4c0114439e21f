"""Appended result documents: posts, sentiment metrics, spikes and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import normalize_coin
from murmur.schemas import ALERT, SENTIMENT_METRIC, TREND_SPIKE


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("created_at", F.current_timestamp())


def sentiment_documents(metrics: DataFrame) -> DataFrame:
    """Metrics with coin, three ratios, score and window, as stored documents."""
    named = metrics.withColumn("coin", normalize_coin(F.col("coin")))
    return _stamped(named).select(*SENTIMENT_METRIC.names)


def spike_documents(spikes: DataFrame) -> DataFrame:
    """Spikes with normalised related coins; a missing detection time becomes now."""
    found = F.col("detected_at") if "detected_at" in spikes.columns else F.lit(None)
    filled = spikes.withColumns(
        {
            "related_coins": F.transform("related_coins", normalize_coin),
            "detected_at": F.coalesce(found, F.current_timestamp()),
        }
    )
    return _stamped(filled).select(*TREND_SPIKE.names)


def alert_documents(alerts: DataFrame) -> DataFrame:
    """Alerts open with an empty payload unless they bring one."""
    empty = F.create_map().cast("map<string,string>")
    payload = F.coalesce("payload", empty) if "payload" in alerts.columns else empty
    opened = alerts.withColumns({"payload": payload, "status": F.lit("open")})
    return _stamped(opened).select(*ALERT.names)


def append_documents(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append; an empty input adds no rows.  The input is evaluated once."""
    df.write.format(fmt).mode("append").save(path)
