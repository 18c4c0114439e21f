"""From a stream of messages to trend windows and rejected-record counts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.dedupe import dedupe_first_in_stream
from murmur.operators.posts import (
    explode_symbols,
    normalize_posts,
    parse_posts,
    rejected_posts,
    strict_posts,
    valid_posts,
)
from murmur.operators.trends import (
    rejected_by_window,
    streaming_trends,
    streaming_trends_exact,
    trend_totals_approx,
)
from murmur.settings import TREND_SLIDE, TREND_WINDOW, WATERMARK_DELAY, interval


def normalized_stream(messages: DataFrame) -> DataFrame:
    return normalize_posts(parse_posts(messages))


def trend_stream(
    normalized: DataFrame,
    size: timedelta = TREND_WINDOW,
    slide: timedelta = TREND_SLIDE,
    delay: timedelta = WATERMARK_DELAY,
    exact: bool = False,
    spread_ids: bool = True,
) -> DataFrame:
    """Trend windows of the valid posts.

    Default: sketched author counts, update mode.  ``exact``: exact counts,
    append mode.  ``spread_ids`` protects the dedupe from ids that repeat in bulk.
    """
    needed = valid_posts(normalized).select(
        "tweet_id", "cashtags", "user_id", "created_at", "engagement_score",
        "influence_score", "author_weight",
    )
    mentions = explode_symbols(dedupe_first_in_stream(needed, delay=delay, spread=spread_ids))
    metrics = streaming_trends_exact if exact else streaming_trends
    return metrics(mentions, size, slide)


def bad_record_stream(normalized: DataFrame, delay: timedelta = WATERMARK_DELAY) -> DataFrame:
    """Rejected posts per processing-time window and reason.

    Branches off before the event-time watermark: a plan has one watermark.
    """
    observed = rejected_posts(normalized).select(
        "invalid_reason", F.current_timestamp().alias("observed_at")
    )
    return rejected_by_window(observed.withWatermark("observed_at", interval(delay)))


def stream_outputs(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trend windows, rejected-record counts) of one message stream."""
    normalized = normalized_stream(messages)
    return trend_stream(normalized), bad_record_stream(normalized)


def running_totals(posts: DataFrame, rsd: float = 0.05) -> DataFrame:
    """Totals per symbol since the start of the stream, for complete mode."""
    return trend_totals_approx(explode_symbols(strict_posts(posts)), rsd)
