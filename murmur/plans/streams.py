"""Streaming queries, run over all that is available and then read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmur.operators.posts import explode_symbols, normalize_posts, parse_posts, valid_posts
from murmur.operators.trends import windowed_trends
from murmur.plans import adapters as A
from murmur.plans import trends as T
from murmur.plans.registry import query
from murmur.session import scratch_path
from murmur.sinks import storage
from murmur.sinks.upsert import TrendTable
from murmur.sources.files import stream_lines
from murmur.streaming import pipeline, runner

HOUR, FILES = timedelta(hours=1), 4
FILE_ROWS = 100_000
NOW = {"availableNow": True}

_CLOSED = "(SELECT max(created_at) - INTERVAL 10 MINUTE FROM valid)"


def _normalized(spark, sf_dir):
    return normalize_posts(A.posts_of(A.event_stream(spark, sf_dir), unique_ids=True))


def _messages(spark, sf_dir, late=False):
    """The posts of :func:`message_lines`, normalised."""
    return pipeline.normalized_stream(message_lines(spark, sf_dir, late))


def message_lines(spark, sf_dir, late=False):
    """Messages in ``FILES`` parts, each later in time than the one before, a part per batch.

    A part is as many files as any other, about ``FILE_ROWS`` messages each in the largest.
    A sixth of the first dialect's posts is sent twice; all of these are valid.  ``late``: with the
    last part, some posts of the first day come in under new ids.
    """
    folder = scratch_path(spark, "stream_messages")
    posts = A.raw_posts(spark, sf_dir, unique_ids=True)
    first, last = posts.agg(F.min("observed_at"), F.max("observed_at")).first()
    span = (last - first) / FILES
    ends = [first + span * i for i in range(1, FILES)]
    place = sum((F.col("observed_at") >= F.lit(end)).cast("int") for end in ends)
    most = max((r["count"] for r in posts.groupBy(place.alias("part")).count().collect()), default=0)
    files = max(1, -(-most // FILE_ROWS))
    for low, high in zip([None, *ends], [*ends, None]):
        part = posts if low is None else posts.where(F.col("observed_at") >= F.lit(low))
        part = part if high is None else part.where(F.col("observed_at") < F.lit(high))
        twice = part.where("tweet_id IS NOT NULL AND k % 6 = 4")
        sent = part.union(twice)
        if late and high is None:
            early = posts.where((F.col("observed_at") < F.lit(first + timedelta(days=1))) & (F.col("k") % 11 == 3))
            renamed = {c: F.concat(F.lit("late-"), c) for c in ("tweet_id", "id")}
            sent = sent.union(early.where("k < 96").withColumns(renamed))
        write_part(A.messages_of(sent), folder, files)
    return stream_lines(spark, folder, files_per_trigger=files)


def write_part(messages, folder, files):
    """Add exactly so many files with the messages to a folder, by as many tasks.

    A reader that takes that many files at a time then has one part in a batch, never some of the next.
    """
    spark = messages.sparkSession

    def parts():
        return sum(name.startswith("part-") for name in storage.children(spark, folder))

    before = parts()
    dealt = messages.coalesce(1) if files == 1 else messages.repartition(files, "arrival")
    dealt.select("value").write.mode("append").text(folder)
    # A task without messages leaves no file.
    for _ in range(before + files - parts()):
        messages.select("value").limit(0).coalesce(1).write.mode("append").text(folder)


def _appended(df, spark, name, mode):
    root = scratch_path(spark, name)
    query_ = runner.start_append(
        df, f"{root}/rows", f"{root}/checkpoint", name, mode=mode, trigger=NOW
    )
    runner.run_available(query_)
    return spark.read.parquet(f"{root}/rows")


@query(
    A.posts_sql(unique_ids=True)
    + f", {T.windows_sql('valid', 6)} SELECT * FROM windows WHERE window_end <= {_CLOSED}"
)
def stream_trends(spark, sf_dir):
    """Windows that the watermark has closed, with exact author counts."""
    trends = pipeline.trend_stream(_normalized(spark, sf_dir), 6 * HOUR, HOUR, exact=True)
    rows = _appended(trends, spark, "stream_trends", "append").drop("batch_id")
    return A.naive(rows, "window_start", "window_end", "last_seen")


@query(
    A.posts_sql(unique_ids=True, json=True)
    + f""", {T.windows_sql('valid', 6)}
       SELECT window_start, window_end, symbol, mention_count, engagement_score, influence_score,
              last_seen, true AS authors_close FROM windows"""
)
def stream_trends_approx(spark, sf_dir):
    """Update mode over several files: each window's last row, and whether its sketched counts are close."""
    trends = pipeline.trend_stream(_messages(spark, sf_dir), 6 * HOUR, HOUR)
    rows = _appended(trends, spark, "stream_trends_approx", "update")
    newest = Window.partitionBy("window_start", "symbol").orderBy(F.desc("batch_id"))
    last = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    posts = valid_posts(normalize_posts(parse_posts(A.messages(spark, sf_dir, unique_ids=True))))
    exact = windowed_trends(explode_symbols(posts), 6 * HOUR, HOUR).select(
        "window_start", "symbol", F.col("unique_authors").alias("authors"),
        F.col("influencer_authors").alias("influencers"),
    )
    close = T.close_to("unique_authors", "authors") & T.close_to("influencer_authors", "influencers")
    checked = last.join(exact, ["window_start", "symbol"]).select(
        "window_start", "window_end", "symbol", "mention_count", "engagement_score", "influence_score",
        "last_seen", close.alias("authors_close"),
    )
    return A.naive(checked, "window_start", "window_end", "last_seen")


@query(
    A.posts_sql(unique_ids=True, json=True)
    + f", {T.windows_sql('valid', 1)} SELECT * FROM windows WHERE window_end <= {_CLOSED}"
)
def stream_message_trends(spark, sf_dir):
    """JSON messages from several files, with repeated posts, to closed windows."""
    trends = pipeline.trend_stream(_messages(spark, sf_dir), HOUR, HOUR, exact=True)
    rows = _appended(trends, spark, "stream_message_trends", "append").drop("batch_id")
    return A.naive(rows, "window_start", "window_end", "last_seen")


@query(
    A.posts_sql(unique_ids=True, json=True)
    + """ SELECT invalid_reason, count(*) AS bad_record_count FROM tagged
       WHERE invalid_reason IS NOT NULL GROUP BY ALL"""
)
def stream_message_rejects(spark, sf_dir):
    """Rejected messages per reason, unreadable ones among them."""
    bad = pipeline.bad_record_stream(_messages(spark, sf_dir))
    rows = _appended(bad, spark, "stream_message_rejects", "update")
    last = rows.groupBy("window_start", "invalid_reason").agg(F.max("bad_record_count").alias("n"))
    return last.groupBy("invalid_reason").agg(F.sum("n").alias("bad_record_count"))


@query(
    A.posts_sql(unique_ids=True, json=True)
    + f", {T.windows_sql('valid', 1)}, {T.SPIKES_SQL} SELECT * FROM flagged WHERE window_end <= {_CLOSED}"
)
def stream_message_spikes(spark, sf_dir):
    """Closed hourly windows of several batches, upserted with their spike fields."""
    root = scratch_path(spark, "stream_message_spikes")
    trends = pipeline.trend_stream(_messages(spark, sf_dir), HOUR, HOUR, exact=True)
    table = TrendTable(
        f"{root}/trends", rule=T.RULE, horizon=timedelta(minutes=10) + HOUR, by_hour=False
    )
    started = runner.start_trend_upsert(
        trends, table, f"{root}/checkpoint", "stream_message_spikes", mode="append", trigger=NOW
    )
    runner.run_available(started)
    rows = table.read(spark).drop("updated_at", "window_date")
    return A.naive(rows, "window_start", "window_end", "last_seen")


@query(
    A.posts_sql(unique_ids=True)
    + """ SELECT invalid_reason, count(*) AS bad_record_count FROM tagged
       WHERE invalid_reason IS NOT NULL GROUP BY ALL"""
)
def stream_bad_records(spark, sf_dir):
    """Rejected posts per reason; the processing-time windows are summed up."""
    bad = pipeline.bad_record_stream(_normalized(spark, sf_dir))
    rows = _appended(bad, spark, "stream_bad_records", "update")
    last = rows.groupBy("window_start", "invalid_reason").agg(F.max("bad_record_count").alias("n"))
    return last.groupBy("invalid_reason").agg(F.sum("n").alias("bad_record_count"))


@query(
    A.posts_sql(unique_ids=True)
    + """, mentions AS (SELECT *, unnest(['#' || sym, '$' || sym, '']) AS symbol
                       FROM facts WHERE is_a AND k % 4 = 0)
      SELECT symbol, count(*) AS mention_count, cast(sum(k + v) AS BIGINT) AS engagement_score,
             max(ts) AS last_seen FROM mentions GROUP BY symbol"""
)
def stream_running_totals(spark, sf_dir):
    """Running totals in complete mode, without the sketched columns."""
    posts = A.posts_of(A.event_stream(spark, sf_dir), unique_ids=True)
    rows = _appended(pipeline.running_totals(posts), spark, "stream_running_totals", "complete")
    newest = rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar())
    return A.naive(
        newest.select("symbol", "mention_count", "engagement_score", "last_seen"), "last_seen"
    )


@query(
    A.posts_sql(unique_ids=True)
    + f", {T.windows_sql('valid', 1)}, {T.SPIKES_SQL} SELECT * FROM flagged WHERE window_end <= {_CLOSED}"
)
def stream_spike_upsert(spark, sf_dir):
    """Closed hourly windows upserted with their spike fields."""
    root = scratch_path(spark, "stream_spike_upsert")
    trends = pipeline.trend_stream(_normalized(spark, sf_dir), HOUR, HOUR, exact=True)
    table = TrendTable(
        f"{root}/trends", rule=T.RULE, horizon=timedelta(minutes=10) + HOUR, by_hour=False
    )
    started = runner.start_trend_upsert(
        trends, table, f"{root}/checkpoint", "stream_spike_upsert", mode="append", trigger=NOW
    )
    runner.run_available(started)
    rows = table.read(spark).drop("updated_at", "window_date")
    return A.naive(rows, "window_start", "window_end", "last_seen")
