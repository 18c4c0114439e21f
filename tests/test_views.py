from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmur.operators import views as V
from murmur.operators.ranking import global_rank

HOUR = timedelta(hours=1)
START = datetime(2026, 4, 18)
SCHEMA = "hashtag string, count bigint, sentiment double, timestamp timestamp, lat double, lon double"


@pytest.fixture(scope="module")
def hours(spark):
    rows = [
        ("#btc", 10, 0.5, START, 1.0, 2.0),
        ("#btc", 30, -0.1, START + 25 * HOUR, 1.5, 2.5),
        ("#eth", 25, 1.0, START + HOUR, None, 2.0),
        ("#eth", 15, -1.0, START + 26 * HOUR, -3.0, -7.0),
        ("#sol", 7, 0.0, START + 47 * HOUR, 1.0, None),
        (None, 3, None, START + 47 * HOUR, 0.0, 0.0),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_kpi_row(hours):
    row = V.kpi_row(hours).first()
    assert (row.total_tweets, row.num_trends, row.top_hashtag) == (90, 3, "#btc")
    assert row.avg_sentiment == pytest.approx(0.08)
    assert tuple(V.kpi_row(hours.where("false")).first()) == (0, 0, 0.0, "—")


def test_filters(hours):
    assert V.filter_tags(hours, []).count() == 6
    assert V.filter_tags(hours, ["#btc", "#sol"]).count() == 3
    assert V.filter_tags(hours, hours.where("count > 20").select("hashtag")).count() == 4
    assert V.filter_days(hours, date(2026, 4, 18), date(2026, 4, 18)).count() == 2
    assert V.filter_sign(hours, "positive").count() == 3
    assert V.filter_sign(hours, "negative").count() == 2
    assert V.apply_filters(hours, ["#eth"], (date(2026, 4, 19), date(2026, 4, 20)), "negative").count() == 1
    with pytest.raises(ValueError):
        V.filter_sign(hours, "other")


def test_day_filter_reaches_the_scan(spark, hours, tmp_path):
    hours.write.parquet(str(tmp_path / "hours"))
    stored = spark.read.parquet(str(tmp_path / "hours"))
    kept = V.apply_filters(stored, ["#btc"], (date(2026, 4, 18), date(2026, 4, 18)), "positive")
    plan = kept.select("count")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed
    assert "EqualTo(hashtag" in pushed and "GreaterThanOrEqual(sentiment" in pushed
    assert "lat" not in pushed[pushed.index("ReadSchema"):]


def test_search(hours):
    table = V.tag_totals(hours)
    assert V.search_tags(table, " ").count() == 3
    assert V.search_tags(table, " BT").count() == 1
    assert V.search_tags(table, "^#(btc|sol)$").count() == 2
    assert V.search_tags(table, "^#", regex=False).count() == 0


def test_ranked_table_and_pages(hours):
    table = V.sentiment_labels(V.ranked_table(hours))
    rows = table.orderBy("rank").collect()
    assert [(r.rank, r.hashtag, r.total_count) for r in rows] == [
        (1, "#btc", 40), (2, "#eth", 40), (3, "#sol", 7)]
    assert [(r.sentiment_class, r.bar_percent) for r in rows] == [
        ("positive", 60), ("neutral", 50), ("neutral", 50)]
    assert [r.rank for r in V.page(table, 2, 2).collect()] == [3]
    assert V.page(table, 9, 2).collect() == []
    assert V.page_count(table, 2).first().pages == 2
    assert V.page_count(table.where("false"), 2).first().pages == 1
    with pytest.raises(ValueError):
        V.page(table, 0)


def test_global_rank_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("g"))
    ranked = global_rank(df, [F.desc("g"), F.asc("v")]).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 5001))
    keys = [(-r.g, r.v) for r in ranked]
    assert keys == sorted(keys)


def test_lists_and_bounds(hours):
    assert [r.hashtag for r in V.tag_list(hours).collect()] == ["#btc", "#eth", "#sol"]
    assert [r.hashtag for r in V.default_tags(hours, 2).collect()] == ["#btc", "#eth"]
    assert tuple(V.day_bounds(hours).first()) == (date(2026, 4, 18), date(2026, 4, 19))


def test_tops(hours):
    assert [r.hashtag for r in V.top_tags(hours, 2).collect()] == ["#btc", "#eth"]
    assert [r.hashtag for r in V.top_by_sentiment(hours, 2).collect()] == ["#btc", "#eth"]
    series = V.top_series(hours, 1).collect()
    assert sorted((r.timestamp, r["count"]) for r in series) == [(START, 10), (START + 25 * HOUR, 30)]


def test_histogram_edges(spark):
    rows = [(-1.0,), (-0.961,), (0.0,), (0.999,), (1.0,), (None,)]
    df = spark.createDataFrame(rows, "sentiment double")
    got = {r.bin: r.rows for r in V.sentiment_histogram(df).collect()}
    assert got == {0: 2, 25: 1, 49: 2}


def test_geo_grid_needs_both_coordinates(hours):
    cells = {(r.lat_cell, r.lon_cell): r.weight for r in V.geo_grid(hours, 5.0).collect()}
    assert cells == {(0, 0): 43, (-1, -2): 15}


def test_change_over_a_day(hours):
    rows = {r.hashtag: r for r in V.change_24h(hours).collect()}
    assert (rows["#btc"].last_24h, rows["#btc"].previous_24h, rows["#btc"].change_24h) == (30, 10, 200.0)
    assert rows["#eth"].change_24h == pytest.approx(-40.0)
    assert rows["#sol"].change_24h is None
    earlier = V.change_24h(hours, F.lit(START + 24 * HOUR))
    assert {r.hashtag: r.last_24h for r in earlier.collect()} == {"#btc": 0, "#eth": 25}


def test_latest_per_key(hours):
    rows = V.latest_per_key(hours.dropna(subset=["hashtag"]), "hashtag", "timestamp").collect()
    assert sorted((r.hashtag, r["count"]) for r in rows) == [("#btc", 30), ("#eth", 15), ("#sol", 7)]
