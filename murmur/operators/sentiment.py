"""Lexicon sentiment as a distributed join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import scores, text
from murmur.operators.lookup import small_side

#: Letters of any script with their marks, and apostrophes between letters.
TOKEN_PATTERN = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*"


def tokens(col: Column) -> Column:
    """Lower-case words, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def sentiment_scores(
    posts: DataFrame, lexicon: DataFrame, keys: list[str], text_col: str = "text"
) -> DataFrame:
    """Compound score in [-1, 1] per post: ``keys`` + matched tokens, valence sum, score.

    ``keys`` must identify a post; further columns to keep may be listed with
    them.  ``lexicon`` has unique ``token`` and a ``valence``.  Tokens meet the
    lexicon in a map-side join and are summed in the task that split the post,
    so what travels is one short row per post, never its text.  Posts without a
    known token score 0, posts without text NULL.
    """
    split = posts.select(
        *keys,
        F.col(text_col).isNotNull().alias("_has_text"),
        tokens(F.col(text_col)).alias("_tokens"),
    )
    words = split.select(*keys, "_has_text", F.explode_outer("_tokens").alias("token"))
    rated = lexicon.select("token", F.col("valence").cast("decimal(8,4)").alias("_valence"))
    sums = (
        words.join(small_side(rated), "token", "left")
        .groupBy(*keys, "_has_text")
        .agg(
            F.count("_valence").alias("matched_tokens"),
            F.coalesce(F.sum("_valence"), F.lit(0)).cast("double").alias("valence_sum"),
        )
    )
    score = F.when(F.col("_has_text"), scores.compound(F.col("valence_sum")))
    return sums.select(*keys, "matched_tokens", "valence_sum", score.alias("sentiment_score"))


def _share(kind: str) -> Column:
    label = scores.sentiment_class(F.col("sentiment_score"))
    hits = F.count_if(label == kind).cast("double")
    return F.coalesce(hits / F.nullif(F.count("sentiment_score"), F.lit(0)), F.lit(0.0))


def coin_sentiment(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean sentiment, post count, class shares and fear-and-greed score per coin.

    ``keys`` may add a window to the coin.
    """
    mean = F.sum(F.col("sentiment_score").cast("decimal(18,9)")).cast("double") / F.nullif(
        F.count("sentiment_score"), F.lit(0)
    )
    grouped = scored.groupBy(*(keys or ["coin"])).agg(
        mean.alias("avg_sentiment"),
        F.count("sentiment_score").alias("mention_count"),
        _share("positive").alias("bullish_ratio"),
        _share("negative").alias("bearish_ratio"),
        _share("neutral").alias("neutral_ratio"),
    )
    return grouped.withColumn("fear_greed_score", scores.fear_greed(F.col("avg_sentiment")))


def with_coin(posts: DataFrame, coin: str) -> DataFrame:
    return posts.withColumn("coin", text.normalize_coin(F.col(coin)))
