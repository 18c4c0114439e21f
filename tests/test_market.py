from datetime import datetime, timedelta

import pytest

from murmur.operators import market

MINUTE = timedelta(minutes=1)
START = datetime(2026, 4, 18, 8)


def test_category_counts_a_post_once(spark):
    rows = [("1", "BTC"), ("1", "ETH"), ("1", "FET"), ("2", "ETH"), ("2", "XRP")]
    mentions = spark.createDataFrame(
        [(*r, "u", START, 1, 2.0, 1.0) for r in rows],
        "tweet_id string, symbol string, user_id string, created_at timestamp, "
        "engagement_score bigint, influence_score double, author_weight double")
    kinds = spark.createDataFrame(
        [("BTC", "L1"), ("ETH", "L1"), ("ETH", "DeFi"), ("FET", "AI")], "symbol string, category string")
    got = market.category_mentions(mentions, kinds).collect()
    assert sorted((r.tweet_id, r.symbol) for r in got) == [
        ("1", "AI"), ("1", "DeFi"), ("1", "L1"), ("2", "DeFi"), ("2", "L1")]


def test_prices_and_correlation(spark):
    ticks = []
    for i, change in enumerate([0.1, 0.2, 0.3]):
        at = START + 5 * i * MINUTE
        ticks += [("BTC", at, 100.0), ("BTC", at + MINUTE, 7.0), ("BTC", at + 2 * MINUTE, 100 * (1 + change)),
                  ("ETH", at, 5.0)]
    prices = market.price_windows(
        spark.createDataFrame(ticks, "symbol string, timestamp timestamp, price double"), 5 * MINUTE)
    first = prices.where("symbol = 'BTC'").orderBy("window_start").first()
    assert (first.open_price, first.close_price) == (100.0, pytest.approx(110.0))
    trends = spark.createDataFrame(
        [(s, START + 5 * i * MINUTE, n) for s in ("BTC", "ETH") for i, n in enumerate([5, 7, 9])],
        "symbol string, window_start timestamp, mention_count bigint")
    got = {r.symbol: (r.windows, r.correlation) for r in market.market_correlation(trends, prices).collect()}
    assert got["BTC"] == (3, pytest.approx(1.0))
    assert got["ETH"] == (3, None)
