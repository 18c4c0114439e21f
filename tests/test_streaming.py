import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmur.operators import dedupe, spikes, trends
from murmur.operators import posts as P
from murmur.settings import SpikeRule
from murmur.sinks.upsert import TrendTable
from murmur.sources.files import read_lines, stream_lines, stream_posts
from murmur.streaming import pipeline, runner
from tests import sample

START = datetime(2026, 4, 18, 8)
MINUTE = timedelta(minutes=1)
NOW = {"availableNow": True}


def write_files(folder, batches):
    """One file per batch, in the order of their modification times."""
    folder.mkdir()
    then = time.time() - 1000
    for i, lines in enumerate(batches):
        path = folder / f"{i:04d}.jsonl"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (then + i, then + i))
    return str(folder)


def post(post_id, at, symbol, user, likes):
    return json.dumps({"tweet_id": str(post_id), "user_id": user, "username": user, "content": f"${symbol}",
                       "created_at": at.isoformat() + "Z", "like_count": likes})


def random_batches(seed, minutes=60, per_minute=6):
    rng = random.Random(seed)
    batches, n = [], 0
    for minute in range(0, minutes, 4):
        lines = []
        for _ in range(4 * per_minute):
            at = START + timedelta(seconds=rng.randrange(minute * 60, (minute + 4) * 60))
            lines.append(post(n, at, rng.choice(["BTC", "BTC", "ETH"]), f"u{rng.randrange(8)}", rng.randrange(9)))
            n += rng.random() < 0.9
        batches.append(lines)
    return batches


def first_arrivals(spark, path):
    """Clean posts of the files, first arrival per id."""
    lines = read_lines(spark, path, arrival=True)
    posts = P.valid_posts(P.normalize_posts(P.parse_posts(lines)))
    return dedupe.dedupe_latest(posts.withColumn("_same", F.lit(0)), time="_same")


COLUMNS = ["symbol", "window_start", "mention_count", "unique_authors", "influencer_authors",
           "engagement_score", "trend_score", "last_seen"]


def as_set(df, columns=COLUMNS):
    return {tuple(r) for r in df.select(columns).collect()}


def test_exact_stream_equals_batch(spark, tmp_path):
    path = write_files(tmp_path / "in", random_batches(1))
    normalized = pipeline.normalized_stream(stream_lines(spark, path))
    trends_out = pipeline.trend_stream(normalized, exact=True)
    runner.run_available(
        runner.start_append(trends_out, str(tmp_path / "out"), str(tmp_path / "cp"), "exact", "append", NOW))
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = trends.windowed_trends(P.explode_symbols(first_arrivals(spark, path)))
    newest = expected.agg(F.max("last_seen")).first()[0]
    closed = expected.where(F.col("window_end") <= F.lit(newest - 10 * MINUTE))
    assert as_set(got) == as_set(closed)
    assert got.select("batch_id").distinct().count() > 3


def test_upsert_stream_equals_batch(spark, tmp_path):
    path = write_files(tmp_path / "in", random_batches(2, minutes=40))
    rule = SpikeRule(min_mentions=8, min_growth=1.2)
    table = TrendTable(str(tmp_path / "table"), rule=rule)
    out = pipeline.trend_stream(pipeline.normalized_stream(stream_lines(spark, path, files_per_trigger=3)))
    runner.run_available(runner.start_trend_upsert(out, table, str(tmp_path / "cp"), "upsert", trigger=NOW))
    windows = trends.windowed_trends(P.explode_symbols(first_arrivals(spark, path)))
    expected = spikes.flag_spikes(windows, rule)
    columns = ["symbol", "window_start", "mention_count", "engagement_score", "baseline_mention_count",
               "growth_rate", "is_spike"]
    rows = table.read(spark)
    assert as_set(rows, columns) == as_set(expected, columns)
    assert rows.count() == expected.count()
    assert rows.where("is_spike").count() > 0


def test_late_posts_and_duplicates(spark, tmp_path):
    late = START - timedelta(hours=1)
    batches = [
        [post(1, START, "BTC", "a", 1), post(1, START + MINUTE, "BTC", "a", 5)],
        [post(1, START + MINUTE, "BTC", "b", 9), post(2, START + 30 * MINUTE, "BTC", "c", 2)],
        [post(3, late, "BTC", "d", 3), post(4, START + 31 * MINUTE, "BTC", "c", 2)],
        [post(5, START + 90 * MINUTE, "ETH", "c", 2)],
    ]
    path = write_files(tmp_path / "in", batches)
    out = pipeline.trend_stream(
        pipeline.normalized_stream(stream_lines(spark, path)), 5 * MINUTE, 5 * MINUTE, exact=True)
    runner.run_available(
        runner.start_append(out, str(tmp_path / "out"), str(tmp_path / "cp"), "late", "append", NOW))
    rows = {(r.window_start, r.mention_count, r.unique_authors)
            for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(START, 1, 1), (START + 30 * MINUTE, 2, 1)}


def test_two_queries_from_one_source(spark, tmp_path):
    path = write_files(tmp_path / "in", [sample.LINES[:9], sample.LINES[9:] + ["not json"]])
    jobs = runner.start_jobs(
        stream_lines(spark, path), str(tmp_path / "cp"), str(tmp_path / "out"), trigger=NOW)
    for job in jobs:
        runner.run_available(job)
    table = TrendTable(str(tmp_path / "out" / "trends")).read(spark)
    window = {r.symbol: sample.metrics(r) for r in table.where(F.col("window_start") == F.lit(sample.START)).collect()}
    assert window == sample.FIRST_WINDOW
    assert table.count() == sample.ALL_WINDOW_ROWS
    bad = spark.read.parquet(str(tmp_path / "out" / "bad_records"))
    last = bad.groupBy("window_start", "invalid_reason").agg(F.max("bad_record_count").alias("n"))
    counts = {r[0]: r[1] for r in last.groupBy("invalid_reason").agg(F.sum("n")).collect()}
    assert counts == {**sample.REJECTED, "bad_json": 1}
    assert sorted(os.listdir(tmp_path / "cp")) == ["bad_records", "trend_metrics"]


def test_running_totals(spark, tmp_path):
    path = write_files(tmp_path / "in", [sample.LINES[:8], sample.LINES[8:]])
    totals = pipeline.running_totals(stream_posts(spark, path))
    runner.run_available(
        runner.start_append(totals, str(tmp_path / "out"), str(tmp_path / "cp"), "totals", "complete", NOW))
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).first()[0])
    got = {r.symbol: (r.mention_count, r.unique_authors, r.engagement_score, r.trend_score) for r in last.collect()}
    assert got == sample.STRICT_TYPED


def test_console_queries_start(spark, tmp_path):
    path = write_files(tmp_path / "in", [sample.LINES])
    for job in runner.start_jobs(stream_lines(spark, path), str(tmp_path / "cp"), trigger=NOW):
        runner.run_available(job)
        assert job.exception() is None and job.recentProgress
    totals = pipeline.running_totals(stream_posts(spark, path))
    job = runner.start_totals_console(totals, str(tmp_path / "totals"))
    job.processAllAvailable()
    job.stop()
    assert sum(p.sink.numOutputRows for p in job.recentProgress) == len(sample.STRICT_TOTALS)


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    batches = [[post(h * 10 + i, START + timedelta(hours=h), "BTC", "a", 1) for i in range(5)] for h in range(4)]
    path = write_files(tmp_path / "in", batches)
    posts = P.valid_posts(pipeline.normalized_stream(stream_lines(spark, path)))
    kept = dedupe.dedupe_first_in_stream(posts).select("tweet_id")
    job = runner.start_append(kept, str(tmp_path / "out"), str(tmp_path / "cp"), "state", "append", NOW)
    runner.run_available(job)
    sizes = [s.numRowsTotal for p in job.recentProgress for s in p.stateOperators]
    assert max(sizes) <= 10 and sizes[-1] <= 5


def test_exact_counts_need_append_mode(spark, tmp_path):
    path = write_files(tmp_path / "in", [sample.LINES])
    out = pipeline.trend_stream(pipeline.normalized_stream(stream_lines(spark, path)), exact=True)
    with pytest.raises(Exception, match="(?i)append|update"):
        runner.start_append(out, str(tmp_path / "out"), str(tmp_path / "cp"), "bad", "update", NOW)


@pytest.mark.parametrize("spread", [True, False])
def test_hot_id_in_one_batch(spark, tmp_path, spread):
    batches = [
        [post("hot", START, "BTC", "a", 1)] * 50 + [post(f"{f}-{i}", START, "ETH", "b", 1) for i in range(20)]
        for f in range(6)
    ]
    path = write_files(tmp_path / "in", batches)
    normalized = pipeline.normalized_stream(stream_lines(spark, path, files_per_trigger=None))
    posts = dedupe.dedupe_first_in_stream(P.valid_posts(normalized), spread=spread).select("tweet_id")
    runner.run_available(
        runner.start_append(posts, str(tmp_path / "out"), str(tmp_path / "cp"), f"hot{spread}", "append", NOW))
    ids = [r.tweet_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(ids) == len(set(ids)) == 121
