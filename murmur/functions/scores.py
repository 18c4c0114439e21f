"""Scores and classes computed from already aggregated or cleaned columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class borders of a sentiment score, and the normalising
# constant of the published compound score.
POSITIVE_FROM = 0.1
NEGATIVE_BELOW = -0.1
COMPOUND_ALPHA = 15.0


def engagement(likes: Column, retweets: Column, replies: Column) -> Column:
    return likes + retweets + replies


def influence(weight: Column, engagement_score: Column) -> Column:
    return weight * engagement_score


def trend_score(
    mentions: Column,
    authors: Column,
    engagement_score: Column,
    influence_score: Column,
    influencers: Column,
) -> Column:
    """2·mentions + authors + engagement/10 + influence/20 + 3·influencers, 2 dp.

    The terms are put over the common divisor 20 and summed as decimals, so the
    only rounding is the last one and ties round the same way everywhere.
    """
    wide = engagement_score.cast("decimal(20,0)") * 2
    whole = ((mentions * 40 + authors * 20 + influencers * 60).cast("decimal(20,0)") + wide).cast("decimal(22,0)")
    twentieths = whole + influence_score.try_cast("decimal(33,8)")
    return F.round(twentieths * F.lit("0.05").cast("decimal(3,2)"), 2).cast("double")


def trend_score_short(mentions: Column, authors: Column, engagement_score: Column) -> Column:
    """2·mentions + authors + engagement/10, 2 dp."""
    tenths = ((mentions * 20 + authors * 10).cast("decimal(20,0)") + engagement_score).cast("decimal(22,0)")
    return F.round(tenths * F.lit("0.1").cast("decimal(2,1)"), 2).cast("double")


def fear_greed(avg_sentiment: Column) -> Column:
    """Map a mean sentiment in [-1, 1] to 0..100."""
    return (avg_sentiment + 1) * 50


def compound(valence_sum: Column) -> Column:
    """Squash a valence sum into [-1, 1], 4 dp."""
    raw = valence_sum / F.sqrt(valence_sum * valence_sum + COMPOUND_ALPHA)
    bounded = F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0))
    return F.round(bounded.cast("decimal(18,14)"), 4).cast("double")


def sentiment_class(score: Column) -> Column:
    return (
        F.when(score >= POSITIVE_FROM, "positive")
        .when(score < NEGATIVE_BELOW, "negative")
        .when(score.isNotNull(), "neutral")
    )


def sentiment_sign(score: Column) -> Column:
    return F.when(score >= 0, "Positive").when(score < 0, "Negative")


def bar_percent(score: Column) -> Column:
    """Position of a score in [-1, 1] on a 0..100 bar."""
    return F.floor((score + 1) / 2 * 100)
