"""Exploration queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from murmur.operators import views as V
from murmur.plans import adapters as A
from murmur.plans.registry import query

_MEAN = "cast(sum(cast(sentiment AS DECIMAL(18, 9))) AS DOUBLE) / count(sentiment)"
_TOTALS = f"""totals AS (SELECT hashtag, cast(sum(count) AS BIGINT) AS total_count, {_MEAN} AS avg_sentiment
            FROM hours GROUP BY hashtag)"""
RANKED_SQL = f"""{A.HOURS_SQL}, {_TOTALS}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY total_count DESC, hashtag) AS rank FROM totals)"""


@query(
    A.HOURS_SQL
    + f""", per_tag AS (SELECT hashtag, sum(count) AS total FROM hours GROUP BY hashtag)
      SELECT cast(sum(count) AS BIGINT) AS total_tweets, count(DISTINCT hashtag) AS num_trends,
             {_MEAN} AS avg_sentiment,
             (SELECT hashtag FROM per_tag ORDER BY total DESC, hashtag LIMIT 1) AS top_hashtag
      FROM hours"""
)
def kpi_row(spark, sf_dir):
    return V.kpi_row(A.hashtag_hours(spark, sf_dir))


@query("SELECT cast(0 AS BIGINT) AS total_tweets, cast(0 AS BIGINT) AS num_trends, cast(0 AS DOUBLE) AS avg_sentiment, '—' AS top_hashtag FROM (SELECT count(*) FROM events WHERE event_type = 'no such tag') none")
def kpi_row_empty(spark, sf_dir):
    """The row for filters that match nothing."""
    return V.kpi_row(V.apply_filters(A.hashtag_hours(spark, sf_dir), tags=["no such tag"]))


@query(f"{A.HOURS_SQL}, {_TOTALS} SELECT * FROM totals")
def tag_totals(spark, sf_dir):
    return V.tag_totals(A.hashtag_hours(spark, sf_dir))


@query(
    f"""{RANKED_SQL} SELECT *, CASE WHEN avg_sentiment >= 0.1 THEN 'positive'
           WHEN avg_sentiment < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_class,
           CASE WHEN avg_sentiment >= 0 THEN 'Positive' ELSE 'Negative' END AS sentiment_sign,
           cast(floor((avg_sentiment + 1) / 2 * 100) AS BIGINT) AS bar_percent FROM ranked"""
)
def hashtag_table(spark, sf_dir):
    return V.sentiment_labels(V.ranked_table(A.hashtag_hours(spark, sf_dir)))


@query(
    f"""{RANKED_SQL} SELECT * FROM ranked WHERE contains(lower(hashtag), 'click1')
        ORDER BY rank LIMIT 5 OFFSET 5"""
)
def hashtag_page(spark, sf_dir):
    """Second page of the tags that contain a text."""
    table = V.ranked_table(A.hashtag_hours(spark, sf_dir))
    return V.page(V.search_tags(table, " CLICK1", regex=False), 2, 5)


@query(
    f"""{RANKED_SQL} SELECT greatest(1, cast(ceil(count(*) / 10.0) AS BIGINT)) AS pages FROM ranked
        WHERE regexp_matches(lower(hashtag), '(click|view)1\\d')"""
)
def page_count(spark, sf_dir):
    table = V.tag_totals(A.hashtag_hours(spark, sf_dir))
    return V.page_count(V.search_tags(table, r"(click|view)1\d"))


@query(
    A.HOURS_SQL
    + """ SELECT * FROM hours WHERE hashtag IN ('#click1', '#view2', '#error7')
       AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21' AND sentiment < 0"""
)
def view_filters(spark, sf_dir):
    return V.apply_filters(
        A.hashtag_hours(spark, sf_dir),
        ["#click1", "#view2", "#error7"],
        (date(2024, 1, 5), date(2024, 1, 20)),
        "negative",
    )


@query(
    A.HOURS_SQL
    + """ SELECT hashtag, count(*) AS rows FROM hours
       WHERE hashtag IN (SELECT hashtag FROM hours GROUP BY hashtag ORDER BY hashtag LIMIT 10)
         AND sentiment >= 0 GROUP BY hashtag"""
)
def default_selection(spark, sf_dir):
    """The first ten tags in the alphabet as the selection."""
    hours = A.hashtag_hours(spark, sf_dir)
    chosen = V.apply_filters(hours, V.default_tags(hours), sign="positive")
    return chosen.groupBy("hashtag").agg(F.count("*").alias("rows"))


@query(A.HOURS_SQL + " SELECT DISTINCT hashtag FROM hours ORDER BY hashtag")
def tag_list(spark, sf_dir):
    return V.tag_list(A.hashtag_hours(spark, sf_dir))


@query(
    A.HOURS_SQL
    + " SELECT cast(min(timestamp) AS DATE) AS first_day, cast(max(timestamp) AS DATE) AS last_day FROM hours"
)
def day_bounds(spark, sf_dir):
    return V.day_bounds(A.hashtag_hours(spark, sf_dir))


@query(f"{A.HOURS_SQL}, {_TOTALS} SELECT hashtag, total_count FROM totals ORDER BY total_count DESC, hashtag LIMIT 15")
def top_tags(spark, sf_dir):
    return V.top_tags(A.hashtag_hours(spark, sf_dir))


@query(f"{A.HOURS_SQL}, {_TOTALS} SELECT hashtag, avg_sentiment FROM totals ORDER BY avg_sentiment DESC, hashtag LIMIT 15")
def top_sentiment(spark, sf_dir):
    return V.top_by_sentiment(A.hashtag_hours(spark, sf_dir))


@query(
    f"""{A.HOURS_SQL}, {_TOTALS} SELECT timestamp, hashtag, cast(sum(count) AS BIGINT) AS count FROM hours
       WHERE hashtag IN (SELECT hashtag FROM totals ORDER BY total_count DESC, hashtag LIMIT 8)
       GROUP BY ALL"""
)
def top8_series(spark, sf_dir):
    return V.top_series(A.hashtag_hours(spark, sf_dir))


@query(
    A.HOURS_SQL
    + """ SELECT cast(least(greatest(floor((sentiment + 1) * 50 / 2), 0), 49) AS BIGINT) AS bin,
              count(*) AS rows
       FROM hours WHERE sentiment BETWEEN -1 AND 1 GROUP BY ALL"""
)
def sentiment_histogram(spark, sf_dir):
    return V.sentiment_histogram(A.hashtag_hours(spark, sf_dir))


@query(
    A.HOURS_SQL
    + """ SELECT cast(least(greatest(floor((sentiment + 0.5::DOUBLE) * 10), 0), 9) AS BIGINT) AS bin,
              count(*) AS rows
       FROM hours WHERE sentiment IS NOT NULL GROUP BY ALL"""
)
def sentiment_histogram_narrow(spark, sf_dir):
    """A range narrower than the scores: those beyond it are in the first and last bin."""
    return V.sentiment_histogram(A.hashtag_hours(spark, sf_dir), bins=10, low=-0.5, high=0.5)


@query(
    A.HOURS_SQL
    + """ SELECT cast(floor(lat / 5) AS BIGINT) AS lat_cell, cast(floor(lon / 5) AS BIGINT) AS lon_cell,
              cast(sum(count) AS BIGINT) AS weight
       FROM hours WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL"""
)
def geo_grid(spark, sf_dir):
    return V.geo_grid(A.hashtag_hours(spark, sf_dir))


@query(
    A.HOURS_SQL
    + """, cells AS (
        SELECT cast(floor(lat / 5) AS BIGINT) AS lat_cell, cast(floor(lon / 5) AS BIGINT) AS lon_cell, sum(count) AS weight
        FROM hours WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY ALL)
      SELECT lat_cell + north AS lat_cell, (lon_cell + east + 36 + 72) % 72 - 36 AS lon_cell,
             cast(sum(weight * (3 - abs(north)) * (3 - abs(east))) AS BIGINT) AS density
      FROM cells, range(-2, 3) n(north), range(-2, 3) e(east)
      WHERE lat_cell + north BETWEEN -18 AND 17 GROUP BY ALL"""
)
def geo_density(spark, sf_dir):
    return V.geo_density(A.hashtag_hours(spark, sf_dir))


@query(
    A.HOURS_SQL
    + """, newest AS (SELECT max(timestamp) AS t FROM hours),
      sums AS (
        SELECT hashtag,
               cast(coalesce(sum(count) FILTER (WHERE timestamp > t - INTERVAL 24 HOUR), 0) AS BIGINT) AS last_24h,
               cast(coalesce(sum(count) FILTER (WHERE timestamp <= t - INTERVAL 24 HOUR), 0) AS BIGINT) AS previous_24h
        FROM hours, newest WHERE timestamp > t - INTERVAL 48 HOUR GROUP BY hashtag)
      SELECT *, (cast(last_24h AS DOUBLE) / nullif(previous_24h, 0) - 1) * 100 AS change_24h FROM sums"""
)
def change_24h(spark, sf_dir):
    return V.change_24h(A.hashtag_hours(spark, sf_dir))
