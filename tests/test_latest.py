from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmur.operators.dedupe import dedupe_latest
from murmur.sinks import indexed
from murmur.streaming import runner
from murmur.streaming.latest import latest_changes, latest_posts

START = datetime(2026, 4, 18, 8)
SCHEMA = "tweet_id string, created_at timestamp, arrival bigint, likes bigint, score double, tags array<string>"


def post(post_id, minute, arrival, likes):
    at = None if minute is None else START + timedelta(minutes=minute, microseconds=arrival)
    return (post_id, at, arrival, likes, likes / 3, [f"#{post_id}", None, "é"])


def run(spark, tmp_path, batches, horizon=None):
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "posts"))
    posts = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "posts"))
    query = runner.start_append(
        latest_changes(posts, horizon=horizon), str(tmp_path / "changes"), str(tmp_path / "state"), "latest",
        mode="append", trigger={"availableNow": True},
    )
    runner.run_available(query)
    return spark.read.parquet(str(tmp_path / "changes"))


def test_changes_give_the_latest_posts(spark, tmp_path):
    batches = [
        [post("a", 5, 1, 10), post("a", 4, 2, 99), post("b", 1, 3, 7), post(None, None, 4, 1), post("c", None, 5, 3)],
        [post("b", 2, 6, 8), post("a", 4, 7, 50), post("c", 0, 8, 4), post("a", 5, 1, 10)],
        [post("b", 1, 9, 70), post("a", 9, 10, 11), post(None, 3, 11, 2)] + [post("hot", i % 60, 100 + i, i) for i in range(3_000)],
    ]
    changes = run(spark, tmp_path, batches).drop("batch_id").cache()
    want = dedupe_latest(spark.createDataFrame([r for b in batches for r in b], SCHEMA))
    assert sorted(map(repr, latest_posts(changes).collect())) == sorted(map(repr, want.collect()))
    # What was taken back is gone from signed sums, and each taken-back row was there.
    sums = changes.groupBy("tweet_id").agg(F.sum("change").alias("n"), F.sum(F.col("change") * F.col("likes")).alias("likes"))
    assert {(r["tweet_id"], r["n"], r["likes"]) for r in sums.collect()} == {
        (r["tweet_id"], 1, r["likes"]) for r in want.collect()
    }
    assert changes.where("tweet_id = 'hot'").count() == 1
    assert changes.where("change = -1").count() == 4


def test_ids_are_forgotten_behind_the_horizon(spark, tmp_path):
    batches = [[post("a", 0, 1, 1)], [post("b", 60, 2, 2)], [post("b", 61, 3, 6)], [post("a", 1, 4, 5)], [post("a", 70, 5, 9)]]
    changes = run(spark, tmp_path, batches, timedelta(minutes=10))
    held = {r["tweet_id"]: r["likes"] for r in latest_posts(changes.drop("batch_id")).collect()}
    # The second "a" is too late; the third is new to a state that has forgotten the first.
    assert held == {"a": 9, "b": 6}
    assert changes.where("tweet_id = 'a' AND likes = 5").count() == 0
    assert changes.where("tweet_id = 'a' AND change = -1").count() == 0


def test_lookup_opens_few_files(spark, tmp_path):
    rows = spark.range(4_000).selectExpr("concat('s', lpad(id % 200, 3, '0')) AS symbol", "id AS n", "if(id % 7 = 0, null, id) AS v")
    root = str(tmp_path / "t")
    with pytest.raises(ValueError):
        indexed.read_range(spark, root, "symbol", "s000", "s001")
    indexed.write_indexed(rows, root, "symbol", "n", file_rows=100)
    files = indexed.index(spark, root).count()
    found = indexed.read_range(spark, root, "symbol", "s017", "s017")
    assert files >= 40 and len(found.inputFiles()) <= files // 10
    assert sorted(found.collect()) == sorted(rows.where("symbol = 's017'").collect())
    assert indexed.read_range(spark, root, "symbol", "t", "u").count() == 0


def test_pages_are_read_without_ranking(spark, tmp_path):
    rows = spark.range(1_003).selectExpr("concat('t', id) AS hashtag", "id % 50 AS total")
    order = [F.desc("total"), F.asc("hashtag")]
    root = str(tmp_path / "p")
    indexed.write_pages(rows, root, order, file_rows=64)
    want = [r["hashtag"] for r in rows.orderBy(*order).collect()]
    for number, size in ((1, 10), (2, 10), (13, 64), (101, 10), (102, 10)):
        page = indexed.read_page(spark, root, number, size)
        assert [r["hashtag"] for r in page.collect()] == want[(number - 1) * size : number * size]
        assert len(page.inputFiles()) <= 4
    assert indexed.page_count(spark, root, 10).first()["pages"] == 101
    indexed.write_pages(rows.where("false"), str(tmp_path / "none"), order)
    assert indexed.read_page(spark, str(tmp_path / "none"), 1).count() == 0
    assert indexed.page_count(spark, str(tmp_path / "none"), 10).first()["pages"] == 1


def test_state_is_a_row_per_bucket_not_per_id(spark, tmp_path):
    batches = [[post(f"i{n}", n % 60, 1000 * turn + n, n + turn) for n in range(turn * 100, 600)] for turn in range(3)]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "posts"))
    posts = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "posts"))
    query = runner.start_append(
        latest_changes(posts, buckets=5), str(tmp_path / "changes"), str(tmp_path / "state"), "buckets",
        mode="append", trigger={"availableNow": True},
    )
    runner.run_available(query)
    # The merge is called once a bucket and batch, however many ids there are.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 5
    changes = spark.read.parquet(str(tmp_path / "changes")).drop("batch_id")
    want = dedupe_latest(spark.createDataFrame([r for b in batches for r in b], SCHEMA))
    assert sorted(map(repr, latest_posts(changes).collect())) == sorted(map(repr, want.collect()))
    assert changes.agg(F.sum("change")).first()[0] == 600
