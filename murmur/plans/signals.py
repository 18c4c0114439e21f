"""Queries on related symbols, alert episodes, table versions and the one-pass stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from murmur.operators import alerts, comentions
from murmur.operators import spikes as S
from murmur.operators.posts import explode_symbols, valid_posts
from murmur.operators.trends import windowed_trends
from murmur.plans import adapters as A
from murmur.plans import streams
from murmur.plans import trends as T
from murmur.plans.registry import query
from murmur.session import scratch_path
from murmur.sinks.documents import spike_documents
from murmur.sinks.upsert import TrendTable
from murmur.streaming import alerts as alert_stream
from murmur.streaming import pipeline, runner
from murmur.streaming.one_pass import OnePass

HOUR = timedelta(hours=1)
COOL_DOWN = 2 * HOUR


def _related_sql(symbol: str, top: int) -> str:
    return f"""basket AS (SELECT DISTINCT uid, date_trunc('day', ts) AS day, {symbol} AS symbol FROM facts),
total AS (SELECT count(*) AS n FROM (SELECT DISTINCT uid, day FROM basket)),
single AS (SELECT symbol, count(*) AS posts FROM basket GROUP BY symbol),
pairs AS (SELECT x.symbol, y.symbol AS related, count(*) AS posts_together
          FROM basket x JOIN basket y USING (uid, day) WHERE x.symbol <> y.symbol GROUP BY ALL HAVING count(*) >= 2),
scored AS (SELECT p.symbol, related, posts_together,
                  round(posts_together * cast(n AS DOUBLE) / (cast(a.posts AS DOUBLE) * b.posts), 6) AS lift
           FROM pairs p JOIN single a ON a.symbol = p.symbol JOIN single b ON b.symbol = p.related, total),
related AS (SELECT *, cast(row_number() OVER (PARTITION BY symbol ORDER BY lift DESC, posts_together DESC, related) AS INTEGER) AS rank
            FROM scored QUALIFY rank <= {top})"""


@query(A.posts_sql() + ", " + _related_sql("sym || (k % 7)", 5) + " SELECT * FROM related")
def related_coins(spark, sf_dir):
    """For each symbol the five symbols that stand out most in posts that mention it."""
    return comentions.related_symbols(A.basket_posts(spark, sf_dir, kinds=7))


@query(
    A.posts_sql()
    + f""", {T.windows_sql('deduped', 1)}, {T.SPIKES_SQL}, {_related_sql("sym", 3)}
      SELECT f.symbol AS keyword, mention_count, f.window_end AS detected_at,
             coalesce(string_agg(related, ',' ORDER BY rank), '') AS related_coins
      FROM flagged f LEFT JOIN related r ON r.symbol = f.symbol WHERE is_spike GROUP BY ALL"""
)
def spike_related_documents(spark, sf_dir):
    """Spikes as documents with their related symbols."""
    windows = windowed_trends(A.mentions(spark, sf_dir), HOUR, HOUR)
    spikes = S.with_zscore(S.flag_spikes(windows, T.RULE), T.RULE).where("is_spike").select(
        F.col("symbol").alias("keyword"), "mention_count",
        F.col("baseline_mention_count").alias("baseline_count"), "z_score", F.col("window_end").alias("detected_at"),
    )
    related = comentions.related_symbols(A.basket_posts(spark, sf_dir), top=3)
    documents = spike_documents(comentions.with_related_coins(spikes, related))
    listed = documents.withColumn("related_coins", F.array_join("related_coins", ","))
    return A.naive(listed.select("keyword", "mention_count", "detected_at", "related_coins"), "detected_at")


_EPISODES_SQL = """spiking AS (
  SELECT *, max(window_end) OVER (PARTITION BY symbol ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far
  FROM flagged WHERE is_spike),
numbered AS (
  SELECT *, sum(CASE WHEN so_far IS NULL OR window_start > so_far + INTERVAL 2 HOUR THEN 1 ELSE 0 END)
              OVER (PARTITION BY symbol ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS episode
  FROM spiking),
episodes AS (
  SELECT symbol, min(window_start) AS opened_at, max(window_end) AS last_spike_end, count(*) AS spike_windows,
         max(mention_count) AS peak_mentions
  FROM numbered GROUP BY symbol, episode)"""


@query(
    A.posts_sql()
    + f""", {T.windows_sql('deduped', 1)}, {T.SPIKES_SQL}, {_EPISODES_SQL},
      timed AS (SELECT *, last_spike_end + INTERVAL 2 HOUR AS ends, (SELECT max(window_end) FROM windows) AS newest FROM episodes)
      SELECT symbol, opened_at, last_spike_end, spike_windows, peak_mentions,
             CASE WHEN ends < newest THEN 'closed' WHEN spike_windows > 1 THEN 'ongoing' ELSE 'open' END AS status,
             CASE WHEN ends < newest THEN ends END AS closed_at
      FROM timed"""
)
def alert_lifecycle(spark, sf_dir):
    """Spikes that follow each other as one alert, with its state at the newest window."""
    flagged = S.flag_spikes(windowed_trends(A.mentions(spark, sf_dir), HOUR, HOUR), T.RULE)
    states = alerts.with_status(alerts.alert_episodes(flagged, COOL_DOWN), flagged, COOL_DOWN)
    return A.naive(states, "opened_at", "last_spike_end", "closed_at")


@query(
    A.posts_sql(unique_ids=True, json=True)
    + f""", every AS ({T.windows_sql('valid', 1).split("AS (", 1)[1].rsplit(")", 1)[0]}),
      windows AS (SELECT * FROM every WHERE window_end <= (SELECT max(created_at) - INTERVAL 10 MINUTE FROM valid)),
      {T.SPIKES_SQL}, {_EPISODES_SQL} SELECT * FROM episodes"""
)
def stream_alert_lifecycle(spark, sf_dir):
    """Alerts of a message stream, from keyed state: the last row of each."""
    windows = pipeline.trend_stream(streams._messages(spark, sf_dir), HOUR, HOUR, exact=True)
    root = scratch_path(spark, "closed_windows")
    runner.run_available(
        runner.start_append(windows, f"{root}/rows", f"{root}/checkpoint", "closed_windows", "append", streams.NOW)
    )
    closed = alert_stream.closed_windows(spark, f"{root}/rows")
    changes = alert_stream.alert_changes(closed, T.RULE, COOL_DOWN)
    rows = streams._appended(changes, spark, "stream_alert_lifecycle", "append")
    return A.naive(alerts.latest_state(rows), "opened_at", "last_spike_end")


@query(
    A.posts_sql()
    + f""", {T.windows_sql('deduped', 1)}, versions AS (
      SELECT 0 AS version, * FROM windows WHERE hour(window_start) % 2 = 0
      UNION ALL SELECT 1, * FROM windows
      UNION ALL SELECT 2, * REPLACE (mention_count + CASE WHEN hour(window_start) % 6 = 0 THEN 10 ELSE 0 END AS mention_count)
      FROM windows),
    based AS (
      SELECT *, greatest(coalesce(round(avg(mention_count) OVER (PARTITION BY version, symbol ORDER BY window_end
                  ROWS BETWEEN {T.RULE.history} PRECEDING AND 1 PRECEDING), 2), 0.0), 1.0::DOUBLE) AS base
      FROM versions)
    SELECT version, symbol, count(*) AS windows, cast(sum(mention_count) AS BIGINT) AS mentions,
           count(*) FILTER (mention_count >= {T.RULE.min_mentions} AND mention_count / base >= {T.RULE.min_growth}) AS spikes
    FROM based GROUP BY ALL"""
)
def trend_versions(spark, sf_dir):
    """The trend table after each of three batches: even hours, odd hours, corrections."""
    windows = windowed_trends(A.mentions(spark, sf_dir), HOUR, HOUR)
    hour = F.hour("window_start")
    raised = windows.where(hour % 6 == 0).withColumn("mention_count", F.col("mention_count") + 10)
    table = TrendTable(scratch_path(spark, "trend_versions"), rule=T.RULE, horizon=HOUR, by_hour=False)
    for batch_id, batch in enumerate((windows.where(hour % 2 == 0), windows.where(hour % 2 == 1), raised)):
        table.write_batch(batch, batch_id)
    found = None
    for batch_id in range(3):
        one = table.read_batch(spark, batch_id).groupBy(F.lit(batch_id).alias("version"), "symbol").agg(
            F.count("*").alias("windows"), F.sum("mention_count").alias("mentions"), F.count_if("is_spike").alias("spikes")
        )
        found = one if found is None else found.union(one)
    return found


def _one_pass(spark, sf_dir, name, late):
    root = scratch_path(spark, name)
    sinks = OnePass(f"{root}/rows", pane=HOUR)
    started = runner.start_one_pass(streams.message_lines(spark, sf_dir, late), sinks, f"{root}/checkpoint", trigger=streams.NOW)
    runner.run_available(started)
    return sinks


@query(
    A.posts_sql(unique_ids=True, json=True)
    + """, early AS (SELECT * FROM tagged WHERE ts < (SELECT min(ts) FROM tagged) + INTERVAL 1 DAY AND k % 11 = 3 AND k < 96)
      SELECT coalesce(invalid_reason, outcome) AS outcome, count(*) AS posts FROM (
        SELECT invalid_reason, 'kept' AS outcome FROM tagged
        UNION ALL SELECT invalid_reason, 'late' FROM early
        UNION ALL SELECT NULL, 'repeated' FROM tagged WHERE is_a AND k % 6 = 4)
      GROUP BY ALL"""
)
def stream_one_pass_outcomes(spark, sf_dir):
    """What became of every message: kept, repeated, late, or rejected and why."""
    return _one_pass(spark, sf_dir, "stream_one_pass_outcomes", late=True).outcomes(spark).select("outcome", "posts")


@query(
    A.posts_sql(unique_ids=True, json=True)
    + f""", {T.windows_sql('valid', 6)}
       SELECT window_start, window_end, symbol, mention_count, engagement_score, influence_score, max_author_weight,
              last_seen, true AS authors_close FROM windows"""
)
def stream_pane_trends(spark, sf_dir):
    """Six-hour windows from hourly panes with sketches, and whether their author counts are close."""
    windows = _one_pass(spark, sf_dir, "stream_pane_trends", late=False).windows(spark, 6 * HOUR)
    posts = valid_posts(pipeline.normalized_stream(A.messages(spark, sf_dir, unique_ids=True)))
    exact = windowed_trends(explode_symbols(posts), 6 * HOUR, HOUR).select(
        "window_start", "symbol", F.col("unique_authors").alias("authors"), F.col("influencer_authors").alias("influencers")
    )
    close = T.close_to("unique_authors", "authors") & T.close_to("influencer_authors", "influencers")
    rows = windows.join(exact, ["window_start", "symbol"]).select(
        "window_start", "window_end", "symbol", "mention_count", "engagement_score", "influence_score",
        "max_author_weight", "last_seen", close.alias("authors_close"),
    )
    return A.naive(rows, "window_start", "window_end", "last_seen")
