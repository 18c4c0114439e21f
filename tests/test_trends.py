import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmur.operators import dedupe
from murmur.operators import posts as P
from murmur.operators import trends as T
from murmur.schemas import BAD_RECORD_ROW, TREND_WINDOW_ROW
from murmur.sources.files import read_lines, read_posts
from tests import sample

MINUTE = timedelta(minutes=1)
START = datetime(2026, 4, 18, 8)


@pytest.fixture(scope="module")
def sample_posts(spark, tmp_path_factory):
    path = sample.write_lines(tmp_path_factory.mktemp("sample") / "in")
    lines = read_lines(spark, path, arrival=True)
    return P.valid_posts(P.normalize_posts(P.parse_posts(lines))).cache()


def test_latest_totals(spark, sample_posts):
    mentions = P.explode_symbols(dedupe.dedupe_latest(sample_posts))
    rows = T.ranked_trends(T.trend_totals(mentions)).collect()
    assert {r.symbol: sample.metrics(r) for r in rows} == sample.LATEST_TOTALS
    assert [r.trend_score for r in rows] == sorted((r.trend_score for r in rows), reverse=True)


def test_first_arrival_windows(spark, sample_posts):
    # Reversing the order of time turns "latest" into "first arrival" here.
    first = dedupe.dedupe_latest(
        sample_posts.withColumn("_back", -F.unix_micros("created_at")), time="_back"
    )
    windows = T.windowed_trends(P.explode_symbols(first))
    assert set(windows.dtypes) == set(spark.createDataFrame([], TREND_WINDOW_ROW).dtypes)
    rows = windows.collect()
    assert len(rows) == sample.ALL_WINDOW_ROWS
    window = {r.symbol: sample.metrics(r) for r in rows if r.window_start == sample.START}
    assert window == sample.FIRST_WINDOW


def test_strict_totals(spark, tmp_path):
    raw = read_posts(spark, sample.write_lines(tmp_path / "in"), schema=None)
    posts = dedupe.dedupe_latest(P.strict_posts(raw).withColumn("arrival", F.lit(0)))
    rows = T.trend_totals_short(P.explode_symbols(posts)).collect()
    got = {r.symbol: (r.mention_count, r.unique_authors, r.engagement_score, r.trend_score) for r in rows}
    assert got == sample.STRICT_TOTALS


def test_sketched_totals_agree_on_few_authors(spark, sample_posts):
    mentions = P.explode_symbols(dedupe.dedupe_latest(sample_posts))
    exact = {r.symbol: r.unique_authors for r in T.trend_totals_short(mentions).collect()}
    sketched = {r.symbol: r.unique_authors for r in T.trend_totals_approx(mentions, 0.01).collect()}
    assert sketched == exact


def _random_mentions(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        user = rng.choice([None, "u1", "u1", "u1"] + [f"u{i}" for i in range(12)])
        weight = rng.choice([1.0, 1.0, 1.5, 5.0])
        engagement = rng.randrange(50)
        at = START + timedelta(seconds=rng.randrange(-900, 3600))
        rows.append((rng.choice(["BTC", "BTC", "ETH"]), user, at, engagement, weight, weight * engagement))
    schema = ("symbol string, user_id string, created_at timestamp, engagement_score bigint, "
              "author_weight double, influence_score double")
    return rows, spark.createDataFrame(rows, schema).repartition(4)


def _expected_windows(rows, size, slide):
    """Brute force: every window that contains a post, from the definition."""
    groups = defaultdict(list)
    epoch = datetime(1970, 1, 1)
    for row in rows:
        start = epoch + (row[2] - epoch) // slide * slide
        while start + size > row[2]:
            groups[(row[0], start)].append(row)
            start -= slide
    out = {}
    for (symbol, start), posts in groups.items():
        authors = {p[1] for p in posts if p[1]}
        influencers = {p[1] for p in posts if p[1] and p[4] > 1}
        out[(symbol, start, start + size)] = (
            len(posts), len(authors), len(influencers), sum(p[3] for p in posts),
            sum(p[5] for p in posts), max(p[4] for p in posts), max(p[2] for p in posts),
        )
    return out


@pytest.mark.parametrize("size, slide", [(5, 1), (6, 2), (5, 5), (5, 2), (1, 1)])
def test_windows_match_brute_force(spark, size, slide):
    rows, mentions = _random_mentions(spark, size * 10 + slide)
    got = T.windowed_trends(mentions, size * MINUTE, slide * MINUTE).collect()
    found = {
        (r.symbol, r.window_start, r.window_end): (
            r.mention_count, r.unique_authors, r.influencer_authors, r.engagement_score,
            r.influence_score, r.max_author_weight, r.last_seen,
        )
        for r in got
    }
    assert found == _expected_windows(rows, size * MINUTE, slide * MINUTE)
    assert len(got) == len(found)


def test_sliding_windows_do_not_shuffle_authors_per_window(spark):
    _, mentions = _random_mentions(spark, 1)
    plan = T.windowed_trends(mentions)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 3
    assert "user_id" not in exchanges[0]
    assert "Expand" not in plan


def test_totals_need_no_expand(spark):
    _, mentions = _random_mentions(spark, 1)
    plan = T.trend_totals(mentions)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_rejected_per_window(spark):
    rows = [(START, "bad_json"), (START + 4 * MINUTE, "bad_json"), (START + 5 * MINUTE, "bad_json")]
    df = spark.createDataFrame(rows, "observed_at timestamp, invalid_reason string")
    assert T.rejected_by_window(df).dtypes == spark.createDataFrame([], BAD_RECORD_ROW).dtypes
    got = {(r.window_start, r.bad_record_count) for r in T.rejected_by_window(df).collect()}
    assert got == {(START, 2), (START + 5 * MINUTE, 1)}
