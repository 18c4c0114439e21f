"""Schemas of the records that enter and leave the engine."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()
_D = T.DoubleType()
_TS = T.TimestampType()
_TAGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# Both vendor dialects in one record.  Every scalar is text because vendors mix
# bare and quoted numbers, and the two tag lists are text as well: a JSON array
# arrives as its JSON text and a lone scalar as itself, so a wrongly typed list
# cannot spoil the rest of the record.
RAW_POST = _struct(
    tweet_id=_S,
    id=_S,
    user_id=_S,
    author_id=_S,
    created_at=_S,
    username=_S,
    author=_S,
    content=_S,
    text=_S,
    target_coin=_S,
    hashtags=_S,
    cashtags=_S,
    like_count=_S,
    retweet_count=_S,
    reply_count=_S,
    lang=_S,
    author_type=_S,
    author_weight=_S,
)

# Typed posts of one dialect, for JSON directories whose writer is trusted.
TYPED_POST = _struct(
    tweet_id=_S,
    user_id=_S,
    created_at=_S,
    username=_S,
    content=_S,
    hashtags=_TAGS,
    cashtags=_TAGS,
    like_count=_L,
    retweet_count=_L,
    reply_count=_L,
    lang=_S,
)

COLLECTOR_RECORD = _struct(id=_S, text=_S, created_at=_S, author=_S, target_coin=_S)

CLEAN_POST = _struct(
    tweet_id=_S,
    user_id=_S,
    created_at=_TS,
    username=_S,
    content=_S,
    hashtags=_TAGS,
    cashtags=_TAGS,
    like_count=_L,
    retweet_count=_L,
    reply_count=_L,
    lang=_S,
    engagement_score=_L,
    author_type=_S,
    author_weight=_D,
    influence_score=_D,
)

TREND_WINDOW_ROW = _struct(
    window_start=_TS,
    window_end=_TS,
    symbol=_S,
    mention_count=_L,
    unique_authors=_L,
    influencer_authors=_L,
    engagement_score=_L,
    influence_score=_D,
    max_author_weight=_D,
    trend_score=_D,
    last_seen=_TS,
)

BAD_RECORD_ROW = _struct(
    window_start=_TS, window_end=_TS, invalid_reason=_S, bad_record_count=_L
)

SENTIMENT_METRIC = _struct(
    coin=_S,
    bullish_ratio=_D,
    bearish_ratio=_D,
    neutral_ratio=_D,
    fear_greed_score=_D,
    window_start=_TS,
    window_end=_TS,
    created_at=_TS,
)

TREND_SPIKE = _struct(
    keyword=_S,
    mention_count=_L,
    baseline_count=_D,
    z_score=_D,
    related_coins=_TAGS,
    detected_at=_TS,
    created_at=_TS,
)

ALERT = _struct(
    alert_type=_S,
    severity=_S,
    message=_S,
    payload=T.MapType(_S, _S),
    status=_S,
    created_at=_TS,
)

HASHTAG_HOUR = _struct(hashtag=_S, count=_L, sentiment=_D, timestamp=_TS, lat=_D, lon=_D)
