import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from murmur.operators import alerts, comentions
from murmur.operators import spikes as S
from murmur.settings import SpikeRule
from murmur.streaming import alerts as alert_stream
from murmur.streaming import runner
from murmur.streaming.one_pass import OnePass
from murmur.sources.files import stream_lines
from tests.test_streaming import MINUTE, NOW, START, post, random_batches, write_files
from tests.test_streaming import first_arrivals
from murmur.operators import trends
from murmur.operators import posts as P


def plain_related(posts, top, least):
    posts = [sorted({s for s in p if s}) for p in posts if p]
    posts = [p for p in posts if p]
    single, pairs = Counter(s for p in posts for s in p), Counter(c for p in posts for c in combinations(p, 2))
    out = []
    for symbol in single:
        found = [(o, n) for (a, b), n in pairs.items() if n >= least and symbol in (a, b) for o in ({a, b} - {symbol})]
        scored = [(-round(n * len(posts) / (single[symbol] * single[o]), 6), -n, o) for o, n in found]
        out += [(symbol, o, -n, -lift, i + 1) for i, (lift, n, o) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_related_symbols(spark, block):
    rng = random.Random(block)
    posts = [[f"S{rng.randrange(9)}" for _ in range(rng.randrange(6))] + ["HOT"] * (i % 3 == 0) for i in range(200)]
    posts += [None, [], [None], ["", "S1"], [f"L{i}" for i in range(40)], [f"L{i}" for i in range(35)]]
    df = spark.createDataFrame([(p,) for p in posts], "cashtags array<string>")
    clean = [[s for s in p if s] for p in posts if p]
    got = sorted(tuple(r) for r in comentions.related_symbols(df, top=3, block=block).collect())
    assert got == plain_related(clean, 3, 2)
    pairs = comentions.symbol_pairs(df, block=block)
    assert pairs.count() == sum(len(set(p)) * (len(set(p)) - 1) // 2 for p in clean)


def test_spikes_with_related_coins(spark):
    spikes = spark.createDataFrame([("A",), ("Z",)], "keyword string")
    related = spark.createDataFrame([("A", "C", 2), ("A", "B", 1)], "symbol string, related string, rank int")
    rows = {r.keyword: r.related_coins for r in comentions.with_related_coins(spikes, related).collect()}
    assert rows == {"A": ["B", "C"], "Z": []}


WINDOW = "symbol string, window_start timestamp, window_end timestamp, mention_count bigint"
RULE = SpikeRule(min_mentions=5, min_growth=2.0)
COOL = timedelta(minutes=6)


def made_windows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for symbol in ("BTC", "ETH", "RARE"):
        for i in range(n):
            if rng.random() < (0.2 if symbol == "RARE" else 0.9):
                rows.append((symbol, START + i * MINUTE, START + (i + 5) * MINUTE, rng.choice([1, 1, 2, 2, 3, 9, 14])))
    return rows


def plain_episodes(rows):
    """By a walk over each symbol's windows."""
    out = []
    for symbol in sorted({r[0] for r in rows}):
        recent, current = [], None
        for _, start, end, n in sorted(r for r in rows if r[0] == symbol):
            base = int(sum(recent) / len(recent) * 100 + 0.5) / 100 if recent else 0.0
            recent = [*recent, n][-6:]
            if n < 5 or n / max(base, 1.0) < 2.0:
                continue
            if current is None or start > current[2] + COOL:
                if current:
                    out.append(tuple(current))
                current = [symbol, start, end, 0, 0]
            current[2:] = [max(current[2], end), current[3] + 1, max(current[4], n)]
        if current:
            out.append(tuple(current))
    return sorted(out)


def test_alert_episodes_and_status(spark):
    rows = made_windows(3)
    flagged = S.flag_spikes(spark.createDataFrame(rows, WINDOW), RULE)
    episodes = alerts.alert_episodes(flagged, COOL)
    assert sorted(tuple(r) for r in episodes.select(*alerts.FIELDS).collect()) == plain_episodes(rows)
    newest = max(r[2] for r in rows)
    for r in alerts.with_status(episodes, flagged, COOL).collect():
        over = r.last_spike_end + COOL < newest
        assert r.status == ("closed" if over else "ongoing" if r.spike_windows > 1 else "open")
        assert r.closed_at == (r.last_spike_end + COOL if over else None)
    assert alerts.with_status(alerts.alert_episodes(flagged.limit(0)), flagged.limit(0)).count() == 0


def test_alert_stream_equals_batch(spark, tmp_path):
    rows = sorted(made_windows(8), key=lambda r: r[2])
    rows_folder = tmp_path / "windows"
    for batch, part in enumerate((rows[:70], rows[70:150], rows[150:])):
        # Whole window ends only: a batch closes all windows up to a time.
        spark.createDataFrame(part, WINDOW).repartition(3).write.parquet(str(rows_folder / f"batch_id={batch}"))
        changes = alert_stream.alert_changes(alert_stream.closed_windows(spark, str(rows_folder)), RULE, COOL)
        runner.run_available(
            runner.start_append(changes, str(tmp_path / "out"), str(tmp_path / "cp"), f"alerts{batch}", "append", NOW))
    got = alerts.latest_state(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(tuple(r) for r in got.collect()) == plain_episodes(rows)


def outcomes(sinks, spark):
    return {r.outcome: r.posts for r in sinks.outcomes(spark).collect()}


def test_one_pass_outcomes(spark, tmp_path):
    batches = [
        [post(1, START, "BTC", "a", 1), post(1, START + MINUTE, "BTC", "a", 5), "not json"],
        [post(1, START + MINUTE, "BTC", "b", 9), post(2, START + 30 * MINUTE, "BTC", "c", 2)],
        [post(3, START - 60 * MINUTE, "BTC", "d", 3), post(4, START + 31 * MINUTE, "BTC", "c", 2), post(2, START + 31 * MINUTE, "XY", "c", 2)],
        [post(5, START + 90 * MINUTE, "ETH", "c", 2)],
    ]
    path = write_files(tmp_path / "in", batches)
    sinks = OnePass(str(tmp_path / "rows"))
    runner.run_available(runner.start_one_pass(stream_lines(spark, path), sinks, str(tmp_path / "cp"), trigger=NOW))
    # Post 1 came again in the second batch, post 2 in the third.
    assert outcomes(sinks, spark) == {"kept": 4, "repeated": 3, "late": 1, "bad_json": 1}
    late = sinks.late_posts(spark).collect()
    # Behind the third batch's watermark, ten minutes before post 2.
    assert [(r.tweet_id, r.seconds_late) for r in late] == [("3", 80 * 60.0)]
    # Ids behind two delays are dropped, and so is what was parsed for earlier batches.
    assert sinks._batches(spark, "incoming") == [3] and 0 not in sinks._batches(spark, "ids")


def test_one_pass_windows_equal_batch(spark, tmp_path):
    path = write_files(tmp_path / "in", random_batches(4, minutes=40))
    sinks = OnePass(str(tmp_path / "rows"))
    job = runner.start_one_pass(stream_lines(spark, path), sinks, str(tmp_path / "cp"), trigger=NOW)
    runner.run_available(job)
    mentions = P.explode_symbols(first_arrivals(spark, path))
    for size, slide in ((5 * MINUTE, MINUTE), (10 * MINUTE, 5 * MINUTE)):
        want = trends.windowed_trends(mentions, size, slide)
        columns = ["symbol", "window_start", "window_end", "mention_count", "engagement_score", "influence_score",
                   "max_author_weight", "last_seen", "unique_authors", "influencer_authors"]
        # Eight authors are few enough for the sketches to be exact.
        assert {tuple(r) for r in sinks.windows(spark, size, slide).select(columns).collect()} == {
            tuple(r) for r in want.select(columns).collect()}
    with pytest.raises(ValueError):
        sinks.windows(spark, 90 * MINUTE / 60)


def test_one_pass_repeats_a_batch(spark, tmp_path):
    """A batch that stops half-way is finished by the next run; nothing counts twice."""
    columns = "tweet_id string, cashtags array<string>, user_id string, created_at timestamp, engagement_score bigint, influence_score double, author_weight double, invalid_reason string"
    first = spark.createDataFrame([("1", ["A"], "u", START, 1, 1.0, 1.0, None), (None, [], None, None, 0, 0.0, 1.0, "missing_id")], columns)
    second = spark.createDataFrame([("1", ["A"], "u", START, 1, 1.0, 1.0, None), ("2", ["A"], "v", START, 1, 1.0, 2.0, None)], columns)
    sinks = OnePass(str(tmp_path / "rows"))
    sinks.write_batch(first, 0)
    broken = OnePass(str(tmp_path / "rows"))
    object.__setattr__(broken, "_panes", lambda kept: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.write_batch(second, 1)
    for _ in range(2):
        sinks.write_batch(second, 1)
    assert outcomes(sinks, spark) == {"kept": 2, "missing_id": 1, "repeated": 1}
    row = sinks.windows(spark, MINUTE).collect()
    assert [(r.mention_count, r.unique_authors, r.influencer_authors) for r in row] == [(2, 2, 1)]


def test_one_pass_parses_once(spark, tmp_path):
    """The sinks read the stored posts: no plan but the first one parses."""
    path = write_files(tmp_path / "in", [[post(1, START, "BTC", "a", 1)]])
    sinks = OnePass(str(tmp_path / "rows"))
    runner.run_available(runner.start_one_pass(stream_lines(spark, path), sinks, str(tmp_path / "cp"), trigger=NOW))
    kept = spark.read.parquet(sinks._path("incoming", 0)).where("outcome = 'kept'")
    plan = sinks._panes(kept)._jdf.queryExecution().toString()
    assert "from_json" not in plan and "ReadSchema" in plan


def test_old_posts_are_late_only_behind_the_watermark(spark, tmp_path):
    at = datetime(2026, 4, 18, 12)
    batches = [[post(1, at, "BTC", "a", 1)], [post(2, at - 10 * MINUTE, "BTC", "a", 1), post(3, at - 9 * MINUTE, "BTC", "a", 1)]]
    path = write_files(tmp_path / "in", batches)
    sinks = OnePass(str(tmp_path / "rows"))
    runner.run_available(runner.start_one_pass(stream_lines(spark, path), sinks, str(tmp_path / "cp"), trigger=NOW))
    assert outcomes(sinks, spark) == {"kept": 2, "late": 1}
    assert sinks.late_posts(spark).agg(F.max("seconds_late")).first()[0] == 0.0
