"""Fixed values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

# Symbol syntax, author classes, topics and spike rule.
CASHTAG_PATTERN = r"\$([A-Za-z][A-Za-z0-9]{1,9})"
WHALE_SIGNAL = "WHALE_SIGNAL"
WHALE_AUTHORS = ("elonmusk", "saylor", "vitalikbuterin", "whale_alert")
WHALE_WEIGHT = 5.0
MARKET_WEIGHT = 1.0
MARKET_TOPIC = "raw-tweets-market"
WHALE_TOPIC = "raw-tweets-whales"

# Streaming windows and watermarks.
TREND_WINDOW = timedelta(minutes=5)
TREND_SLIDE = timedelta(minutes=1)
BAD_RECORD_WINDOW = timedelta(minutes=5)
WATERMARK_DELAY = timedelta(minutes=10)


@dataclass(frozen=True)
class SpikeRule:
    """When a window counts as a spike, and how far back its baseline looks."""

    history: int = 6
    min_mentions: int = 10
    min_growth: float = 3.0


def interval(span: timedelta) -> str:
    """A timedelta as the interval text Spark's window functions accept."""
    micros = span // timedelta(microseconds=1)
    if micros <= 0:
        raise ValueError(f"window lengths must be positive, got {span}")
    return f"{micros} microseconds"
