"""Queries on trends and spikes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from murmur.functions.parse import iso_text
from murmur.operators import market
from murmur.operators import spikes as S
from murmur.operators import trends as T
from murmur.operators.dedupe import dedupe_latest
from murmur.operators.posts import explode_symbols, strict_posts
from murmur.operators.views import latest_per_key
from murmur.plans import adapters as A
from murmur.plans.registry import query
from murmur.settings import SpikeRule
from murmur.sinks.documents import alert_documents, spike_documents
from murmur.sources.files import find

HOUR = timedelta(hours=1)
# Hourly windows of these tables hold few mentions, so the spike queries ask for
# fewer mentions than the default rule.
RULE = SpikeRule(min_mentions=4, min_growth=2.0)

# Decimal arithmetic, so that both engines round the same exact value.
_METRICS = """count(*) AS mention_count,
       count(DISTINCT user_id) AS unique_authors,
       count(DISTINCT user_id) FILTER (WHERE weight > 1) AS influencer_authors,
       cast(sum(engagement_score) AS BIGINT) AS engagement_score,
       cast(sum(weight * engagement_score) AS DOUBLE) AS influence_score,
       cast({max_weight} AS DOUBLE) AS max_author_weight,
       cast(round(2 * count(*) + count(DISTINCT user_id)
                  + cast(sum(engagement_score) AS DECIMAL(18, 0)) * 0.1
                  + cast(sum(weight * engagement_score) AS DECIMAL(18, 1)) * 0.05
                  + 3 * count(DISTINCT user_id) FILTER (WHERE weight > 1), 2) AS DOUBLE) AS trend_score,
       max(created_at) AS last_seen"""
METRICS_SQL = _METRICS.format(max_weight="max(weight)")
TOTALS_SQL = _METRICS.format(max_weight="greatest(max(weight), 1.0)")


def windows_sql(source: str, hours: int) -> str:
    """Windows of ``hours`` length every hour."""
    return f"""windows AS (
  SELECT date_trunc('hour', created_at) - to_hours(back) AS window_start,
         date_trunc('hour', created_at) - to_hours(back) + to_hours({hours}) AS window_end,
         cashtags AS symbol, {METRICS_SQL}
  FROM {source}, range({hours}) backs(back) GROUP BY ALL)"""


SPIKES_SQL = f"""history AS (
  SELECT *, coalesce(round(avg(mention_count) OVER (PARTITION BY symbol ORDER BY window_end
              ROWS BETWEEN {RULE.history} PRECEDING AND 1 PRECEDING), 2), 0.0::DOUBLE) AS baseline_mention_count
  FROM windows),
flagged AS (
  SELECT *, round(mention_count / greatest(baseline_mention_count, 1.0::DOUBLE), 2) AS growth_rate,
         mention_count >= {RULE.min_mentions}
         AND mention_count / greatest(baseline_mention_count, 1.0::DOUBLE) >= {RULE.min_growth} AS is_spike
  FROM history)"""


def _with(*ctes: str) -> str:
    return ", ".join((A.posts_sql(),) + ctes)


@query(A.posts_sql() + f" SELECT cashtags AS symbol, {TOTALS_SQL} FROM deduped GROUP BY ALL")
def trend_totals(spark, sf_dir):
    totals = T.trend_totals(A.mentions(spark, sf_dir))
    return A.naive(T.ranked_trends(totals), "last_seen")


@query(
    A.posts_sql()
    + """, strict AS (SELECT * FROM facts WHERE is_a AND k % 4 = 0
                     QUALIFY row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts DESC, event_id) = 1),
      mentions AS (SELECT *, unnest(['#' || sym, '$' || sym, '']) AS symbol FROM strict)
      SELECT symbol, count(*) AS mention_count, count(DISTINCT uid) AS unique_authors,
             cast(sum(k + v) AS BIGINT) AS engagement_score,
             cast(round(2 * count(*) + count(DISTINCT uid)
                        + cast(sum(k + v) AS DECIMAL(18, 0)) * 0.1, 2) AS DOUBLE) AS trend_score,
             max(ts) AS last_seen
      FROM mentions GROUP BY symbol"""
)
def trend_totals_short(spark, sf_dir):
    """The strict batch job: exact authors, short score."""
    posts = dedupe_latest(strict_posts(A.raw_posts(spark, sf_dir)))
    totals = T.trend_totals_short(explode_symbols(posts))
    return A.naive(totals.orderBy(F.desc("trend_score"), "symbol"), "last_seen")


def close_to(approximate, exact, rsd=0.05):
    """Is a sketched count within three standard deviations of the exact one?"""
    return F.abs(F.col(approximate) - F.col(exact)) <= F.ceil(F.col(exact) * 3 * rsd)


@query(
    A.posts_sql()
    + """ SELECT cashtags AS symbol, count(*) AS mention_count,
              cast(sum(engagement_score) AS BIGINT) AS engagement_score,
              max(created_at) AS last_seen, true AS authors_close
       FROM deduped GROUP BY ALL"""
)
def trend_totals_approx(spark, sf_dir):
    """Exact columns, and whether the sketched author counts are close to the exact ones."""
    mentions = A.mentions(spark, sf_dir)
    exact = T.trend_totals(mentions).select("symbol", F.col("unique_authors").alias("authors"))
    totals = T.trend_totals_approx(mentions).join(exact, "symbol")
    close = close_to("unique_authors", "authors").alias("authors_close")
    rows = totals.select("symbol", "mention_count", "engagement_score", "last_seen", close)
    return A.naive(rows, "last_seen")


@query(_with(windows_sql("deduped", 6)) + " SELECT * FROM windows")
def trend_sliding(spark, sf_dir):
    """Six-hour windows every hour."""
    windows = T.windowed_trends(A.mentions(spark, sf_dir), 6 * HOUR, HOUR)
    return A.naive(windows, "window_start", "window_end", "last_seen")


@query(_with(windows_sql("deduped", 1)) + " SELECT * FROM windows")
def trend_tumbling(spark, sf_dir):
    return A.naive(_hourly(spark, sf_dir), "window_start", "window_end", "last_seen")


def _hourly(spark, sf_dir):
    return T.windowed_trends(A.mentions(spark, sf_dir), HOUR, HOUR)


@query(
    _with(windows_sql("deduped", 1), SPIKES_SQL)
    + " SELECT symbol, window_end, mention_count, baseline_mention_count FROM history"
)
def spike_baseline(spark, sf_dir):
    rows = S.with_baseline(_hourly(spark, sf_dir), RULE)
    return A.naive(
        rows.select("symbol", "window_end", "mention_count", "baseline_mention_count"), "window_end"
    )


@query(_with(windows_sql("deduped", 1), SPIKES_SQL) + " SELECT * FROM flagged")
def spike_flags(spark, sf_dir):
    flagged = S.flag_spikes(_hourly(spark, sf_dir), RULE)
    return A.naive(flagged, "window_start", "window_end", "last_seen")


@query(
    _with(windows_sql("deduped", 1), SPIKES_SQL)
    + f""" SELECT 'mention_spike' AS alert_type, 'high' AS severity, 'open' AS status,
              symbol || ' mentions ' || mention_count AS message, symbol AS payload_symbol
       FROM flagged WHERE is_spike"""
)
def spike_alerts(spark, sf_dir):
    alerts = alert_documents(S.spike_alerts(S.flag_spikes(_hourly(spark, sf_dir), RULE)))
    return alerts.select(
        "alert_type", "severity", "status", "message",
        F.col("payload")["symbol"].alias("payload_symbol"),
    )


@query(
    _with(windows_sql("deduped", 1))
    + f""", scored AS (
      SELECT *, avg(mention_count) OVER w AS mean, stddev_samp(mention_count) OVER w AS spread
      FROM windows WINDOW w AS (PARTITION BY symbol ORDER BY window_end
                                ROWS BETWEEN {RULE.history} PRECEDING AND 1 PRECEDING))
      SELECT symbol AS keyword, window_end AS detected_at, mention_count,
             cast(round(cast((mention_count - mean) / nullif(spread, 0) AS DECIMAL(18, 10)), 6) AS DOUBLE) AS z_score,
             symbol AS related
      FROM scored"""
)
def spike_zscores(spark, sf_dir):
    """Standard scores as spike documents."""
    scored = S.with_zscore(S.with_baseline(_hourly(spark, sf_dir), RULE), RULE)
    documents = spike_documents(
        scored.select(
            F.col("symbol").alias("keyword"),
            "mention_count",
            F.col("baseline_mention_count").alias("baseline_count"),
            F.round(F.col("z_score").cast("decimal(18,10)"), 6).cast("double").alias("z_score"),
            F.array(F.concat(F.lit("$"), F.lower("symbol"))).alias("related_coins"),
            F.col("window_end").alias("detected_at"),
        )
    )
    return A.naive(
        documents.select(
            "keyword", "detected_at", "mention_count", "z_score",
            F.array_join("related_coins", ",").alias("related"),
        ),
        "detected_at",
    )


@query(
    _with(windows_sql("deduped", 1))
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY window_end DESC) AS n FROM windows)
      SELECT symbol, strftime(window_end, '%Y-%m-%dT%H:%M:%SZ') AS window_end, mention_count
      FROM ranked WHERE n <= 6"""
)
def latest_windows(spark, sf_dir):
    """The six newest windows of each symbol, with times as text."""
    newest = latest_per_key(_hourly(spark, sf_dir), "symbol", "window_end", 6)
    return newest.select("symbol", iso_text(F.col("window_end")).alias("window_end"), "mention_count")


@query(
    _with(windows_sql("deduped", 1))
    + """ SELECT window_end, mention_count FROM windows
       WHERE symbol = 'CLICK' AND window_end < TIMESTAMP '2024-01-20' ORDER BY window_end DESC LIMIT 6"""
)
def window_lookup(spark, sf_dir):
    """Filtered, projected, sorted and limited lookup."""
    rows = find(
        _hourly(spark, sf_dir),
        "symbol = 'CLICK' AND window_end < TIMESTAMP '2024-01-20'",
        ["window_end", "mention_count"],
        "window_end",
        6,
    )
    return A.naive(rows, "window_end")


_CATEGORIES = {"CLICK": ["VISIT", "ACTION"], "VIEW": ["VISIT"], "PURCHASE": ["ACTION"]}
_CATEGORY_ROWS = [(symbol, name) for symbol, names in _CATEGORIES.items() for name in names]
_CATEGORY_VALUES = ", ".join(f"('{symbol}', '{name}')" for symbol, name in _CATEGORY_ROWS)


@query(
    _with(
        f"categories(sym, category) AS (VALUES {_CATEGORY_VALUES})",
        "grouped AS (SELECT deduped.* REPLACE (category AS cashtags)"
        " FROM deduped JOIN categories ON sym = cashtags)",
        windows_sql("grouped", 1),
        SPIKES_SQL,
    )
    + " SELECT symbol AS category, window_start, mention_count, growth_rate, is_spike FROM flagged"
)
def category_spikes(spark, sf_dir):
    """Spikes of groups of symbols."""
    categories = spark.createDataFrame(_CATEGORY_ROWS, "symbol string, category string")
    grouped = market.category_mentions(A.mentions(spark, sf_dir), categories)
    flagged = S.flag_spikes(T.windowed_trends(grouped, HOUR, HOUR), RULE)
    rows = flagged.select(
        F.col("symbol").alias("category"), "window_start", "mention_count", "growth_rate", "is_spike"
    )
    return A.naive(rows, "window_start")


@query(
    _with(
        windows_sql("deduped", 1),
        """ticks AS (
          SELECT upper(event_type) AS symbol, date_trunc('hour', ts) AS window_start,
                 first(value ORDER BY ts, value) AS opened, last(value ORDER BY ts, value) AS closed
          FROM events GROUP BY ALL)""",
    )
    + """ SELECT symbol, count(*) AS windows,
              cast(round(cast(covar_pop(cast(mention_count AS DOUBLE), closed / opened - 1)
                   / nullif(stddev_pop(mention_count) * stddev_pop(closed / opened - 1), 0) AS DECIMAL(18, 12)), 8) AS DOUBLE) AS correlation
       FROM windows JOIN ticks USING (symbol, window_start) GROUP BY symbol"""
)
def market_correlation(spark, sf_dir):
    """Mentions against the price change of the same hour; event values serve as prices."""
    prices = A.table(spark, sf_dir, "events").select(
        F.upper("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("price"),
    )
    result = market.market_correlation(_hourly(spark, sf_dir), market.price_windows(prices, HOUR))
    exact = F.round(F.col("correlation").cast("decimal(18,12)"), 8).cast("double")
    return result.withColumn("correlation", exact)
