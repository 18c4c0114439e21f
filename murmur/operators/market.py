"""Signals set against categories of symbols and against market prices."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.lookup import small_side
from murmur.settings import interval


def category_mentions(
    mentions: DataFrame, categories: DataFrame, post: str = "tweet_id"
) -> DataFrame:
    """Mentions of categories in place of symbols, once per post and category.

    ``categories`` has ``symbol`` and ``category``; a symbol may be in several.
    The result has the columns that windows and spikes need, with the category
    as ``symbol``.  All rows of a post agree in them, so a plain distinct, which
    combines within each task first, leaves one row per post and category.
    """
    placed = mentions.join(small_side(categories.select("symbol", "category")), "symbol")
    return placed.select(
        post, F.col("category").alias("symbol"), "user_id", "created_at", "engagement_score",
        "influence_score", "author_weight",
    ).distinct()


def price_windows(prices: DataFrame, size: timedelta) -> DataFrame:
    """First and last price per (symbol, window) and the change between them.

    ``prices`` has ``symbol``, ``timestamp`` and ``price``.  Equal times are
    settled by the price, so the result does not depend on row order.
    """
    tick = F.struct("timestamp", "price")
    window = F.window("timestamp", interval(size))
    ends = prices.groupBy("symbol", window.alias("w")).agg(
        F.min(tick).alias("first"), F.max(tick).alias("last")
    )
    opened, closed = F.col("first.price"), F.col("last.price")
    return ends.select(
        "symbol",
        F.col("w.start").alias("window_start"),
        opened.alias("open_price"),
        closed.alias("close_price"),
        (closed / F.nullif(opened, F.lit(0.0)) - 1).alias("price_change"),
    )


def market_correlation(
    trends: DataFrame, prices: DataFrame, signal: str = "mention_count", against: str = "price_change"
) -> DataFrame:
    """Correlation of a trend column with the price change of the same windows, per symbol.

    NULL where either side never varies; the built-in correlation would divide by zero.
    """
    paired = trends.select("symbol", "window_start", signal).join(
        prices.select("symbol", "window_start", against), ["symbol", "window_start"]
    )
    both = paired.where(F.col(signal).isNotNull() & F.col(against).isNotNull())
    x, y = F.col(signal).cast("double"), F.col(against)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return both.groupBy("symbol").agg(
        F.count("*").alias("windows"),
        (F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))).alias("correlation"),
    )
