"""Trend metrics per symbol, overall and per event-time window."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import scores
from murmur.settings import BAD_RECORD_WINDOW, TREND_SLIDE, TREND_WINDOW, interval


def _is_influencer(weight: Column) -> Column:
    return weight > 1.0


def _author_facts() -> list[Column]:
    """Additive facts of one author's mentions of one symbol."""
    return [
        F.count("*").alias("mentions"),
        F.try_sum("engagement_score").alias("engagement"),
        F.sum("influence_score").alias("influence"),
        F.max("author_weight").alias("weight"),
        F.max("created_at").alias("last_seen"),
    ]


def _symbol_metrics(authors: Column, influencers: Column) -> list[Column]:
    """Metrics of a symbol from the facts of its authors."""
    return [
        F.sum("mentions").alias("mention_count"),
        authors.alias("unique_authors"),
        influencers.alias("influencer_authors"),
        F.try_sum("engagement").alias("engagement_score"),
        F.sum("influence").alias("_influence"),
        F.max("weight").alias("max_author_weight"),
        F.max("last_seen").alias("last_seen"),
    ]


def _scored(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.select(
        *keys,
        "mention_count",
        "unique_authors",
        "influencer_authors",
        "engagement_score",
        F.round("_influence", 2).alias("influence_score"),
        "max_author_weight",
        scores.trend_score(
            F.col("mention_count"),
            F.col("unique_authors"),
            F.col("engagement_score"),
            F.col("_influence"),
            F.col("influencer_authors"),
        ).alias("trend_score"),
        "last_seen",
    )


def trend_totals(mentions: DataFrame) -> DataFrame:
    """Metrics per symbol over all rows.

    Grouping by (symbol, author) first turns both distinct counts into plain
    counts: no row is expanded per distinct aggregate, and a symbol with a third
    of all mentions is spread over its authors before it meets in one group.
    An author is an influencer if any of their mentions has a weight above 1.
    """
    per_author = mentions.groupBy("symbol", "user_id").agg(*_author_facts())
    known = F.col("user_id").isNotNull()
    metrics = per_author.groupBy("symbol").agg(
        *_symbol_metrics(
            F.count("user_id"), F.count_if(known & _is_influencer(F.col("weight")))
        )
    )
    return _scored(metrics, ["symbol"]).withColumn(
        "max_author_weight", F.greatest("max_author_weight", F.lit(1.0))
    )


def ranked_trends(totals: DataFrame) -> DataFrame:
    return totals.orderBy(F.desc("trend_score"), F.desc("engagement_score"), "symbol")


def trend_totals_short(mentions: DataFrame) -> DataFrame:
    """Mentions, exact authors, engagement and the short score per symbol."""
    per_author = mentions.groupBy("symbol", "user_id").agg(
        F.count("*").alias("mentions"),
        F.try_sum("engagement_score").alias("engagement"),
        F.max("created_at").alias("seen"),
    )
    return _short(
        per_author.groupBy("symbol").agg(
            F.sum("mentions").alias("mention_count"),
            F.count("user_id").alias("unique_authors"),
            F.try_sum("engagement").alias("engagement_score"),
            F.max("seen").alias("last_seen"),
        )
    )


def trend_totals_approx(mentions: DataFrame, rsd: float = 0.05) -> DataFrame:
    """As ``trend_totals_short`` with sketched author counts; also runs on streams."""
    return _short(
        mentions.groupBy("symbol").agg(
            F.count("*").alias("mention_count"),
            F.approx_count_distinct("user_id", rsd).alias("unique_authors"),
            F.try_sum("engagement_score").alias("engagement_score"),
            F.max("created_at").alias("last_seen"),
        )
    )


def _short(metrics: DataFrame) -> DataFrame:
    score = scores.trend_score_short(
        F.col("mention_count"), F.col("unique_authors"), F.col("engagement_score")
    )
    return metrics.select(
        "symbol",
        "mention_count",
        "unique_authors",
        "engagement_score",
        score.alias("trend_score"),
        "last_seen",
    )


def windowed_trends(
    mentions: DataFrame, size: timedelta = TREND_WINDOW, slide: timedelta = TREND_SLIDE
) -> DataFrame:
    """Batch metrics per (window, symbol) with exact distinct counts."""
    if size % slide == timedelta(0):
        return _scored(_by_panes(mentions, size, slide), ["window_start", "window_end", "symbol"])
    window = F.window("created_at", interval(size), interval(slide))
    per_author = mentions.groupBy(window.alias("w"), "symbol", "user_id").agg(*_author_facts())
    known = F.col("user_id").isNotNull()
    metrics = per_author.groupBy(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "symbol"
    ).agg(
        *_symbol_metrics(
            F.count("user_id"), F.count_if(known & _is_influencer(F.col("weight")))
        )
    )
    return _scored(metrics, ["window_start", "window_end", "symbol"])


def _by_panes(mentions: DataFrame, size: timedelta, slide: timedelta) -> DataFrame:
    """Sliding metrics without shuffling each mention once per window.

    Mentions are summed per (pane, symbol, author), a pane being one slide long.
    A pane belongs to size/slide windows, but its author is new only in those
    that start after the author's previous pane; marking them turns the distinct
    counts into sums, so the multiplied rows are combined by (window, symbol)
    inside the task that makes them and never travel with an author in the key.
    """
    panes = size // slide
    step = F.expr(f"INTERVAL '{slide.total_seconds():.6f}' SECOND")
    length = F.expr(f"INTERVAL '{size.total_seconds():.6f}' SECOND")
    per_author = mentions.groupBy(
        F.window("created_at", interval(slide)).start.alias("pane"), "symbol", "user_id"
    ).agg(*_author_facts())
    influencer = _is_influencer(F.col("weight"))
    if panes == 1:
        spread = per_author.withColumns(
            {
                "window_start": F.col("pane"),
                "new_author": F.col("user_id").isNotNull(),
                "new_influencer": F.col("user_id").isNotNull() & influencer,
            }
        )
    else:
        earlier = (
            Window.partitionBy("symbol", "user_id")
            .orderBy("pane")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        marked = per_author.withColumns(
            {
                "seen_pane": F.last("pane").over(earlier),
                "influencer_pane": F.last(F.when(influencer, F.col("pane")), True).over(earlier),
            }
        )
        starts = F.array(*[F.col("pane") - step * i for i in range(panes)])

        def first_after(previous: str) -> Column:
            before = F.col(previous).isNull() | (F.col("window_start") > F.col(previous))
            return F.col("user_id").isNotNull() & before

        spread = marked.withColumn("window_start", F.explode(starts)).withColumns(
            {
                "new_author": first_after("seen_pane"),
                "new_influencer": first_after("influencer_pane") & influencer,
            }
        )
    metrics = spread.groupBy("window_start", "symbol").agg(
        *_symbol_metrics(
            F.count_if(F.col("new_author")), F.count_if(F.col("new_influencer"))
        )
    )
    return metrics.withColumn("window_end", F.col("window_start") + length)


def streaming_trends(
    mentions: DataFrame,
    size: timedelta = TREND_WINDOW,
    slide: timedelta = TREND_SLIDE,
    rsd: float = 0.05,
) -> DataFrame:
    """Streaming metrics per (window, symbol) for update mode.

    Streams allow no distinct aggregates, so authors are counted with sketches
    of fixed size; state grows with windows and symbols, not with authors.
    """
    window = F.window("created_at", interval(size), interval(slide))
    metrics = mentions.groupBy(window.alias("w"), "symbol").agg(
        F.count("*").alias("mention_count"),
        F.approx_count_distinct("user_id", rsd).alias("unique_authors"),
        F.approx_count_distinct(
            F.when(_is_influencer(F.col("author_weight")), F.col("user_id")), rsd
        ).alias("influencer_authors"),
        F.try_sum("engagement_score").alias("engagement_score"),
        F.sum("influence_score").alias("_influence"),
        F.max("author_weight").alias("max_author_weight"),
        F.max("created_at").alias("last_seen"),
    )
    flat = metrics.withColumns(
        {"window_start": F.col("w.start"), "window_end": F.col("w.end")}
    )
    return _scored(flat, ["window_start", "window_end", "symbol"])


def streaming_trends_exact(
    mentions: DataFrame, size: timedelta = TREND_WINDOW, slide: timedelta = TREND_SLIDE
) -> DataFrame:
    """Streaming metrics with exact distinct counts, for append mode.

    Two aggregates in a row need append mode: a window appears once, when the
    watermark has passed its end.  Author state is one small row per (window,
    symbol, author), spread over all state partitions.
    """
    window = F.window("created_at", interval(size), interval(slide))
    per_author = mentions.groupBy(window.alias("w"), "symbol", "user_id").agg(*_author_facts())
    known = F.col("user_id").isNotNull()
    metrics = per_author.groupBy("w", "symbol").agg(
        *_symbol_metrics(
            F.count("user_id"), F.count_if(known & _is_influencer(F.col("weight")))
        )
    )
    flat = metrics.withColumns(
        {"window_start": F.col("w.start"), "window_end": F.col("w.end")}
    )
    return _scored(flat, ["window_start", "window_end", "symbol"])


def rejected_by_window(
    rejected: DataFrame, time: str = "observed_at", size: timedelta = BAD_RECORD_WINDOW
) -> DataFrame:
    """Rejected posts per (tumbling window, reason); batch and streaming."""
    window = F.window(time, interval(size))
    counts = rejected.groupBy(window.alias("w"), "invalid_reason").agg(
        F.count("*").alias("bad_record_count")
    )
    return counts.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "invalid_reason",
        "bad_record_count",
    )
