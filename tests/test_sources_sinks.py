import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from murmur.operators.posts import normalize_posts
from murmur.schemas import ALERT, COLLECTOR_RECORD, SENTIMENT_METRIC, TREND_SPIKE
from murmur.session import build_session, scratch_path, shared_dir
from murmur.sinks import documents as D
from murmur.sinks import files, storage
from murmur.sinks.console import show_stages
from murmur.sources import kafka, payloads
from murmur.sources import files as sources

START = datetime(2026, 4, 18, 15, 30)


def test_kafka_options_with_pem_files(tmp_path):
    files = [tmp_path / f"{n}.pem" for n in range(3)]
    for file in files:
        file.write_text(f"-- {file.name} --")
    options = kafka.source_options(kafka.connection_options("b1:1,b2:2", "SASL_SSL", *map(str, files)), "t")
    assert (options["kafka.bootstrap.servers"], options["kafka.security.protocol"]) == ("b1:1,b2:2", "SASL_SSL")
    stores = {k: v for k, v in options.items() if k.startswith("kafka.ssl.")}
    assert sorted(v for v in stores.values() if v != "PEM") == [f"-- {n}.pem --" for n in range(3)]
    assert stores.pop("kafka.ssl.truststore.type") == stores.pop("kafka.ssl.keystore.type") == "PEM"
    assert stores["kafka.ssl.truststore.certificates"] == "-- 0.pem --" and len(stores) == 3


def test_kafka_options_without_tls(tmp_path):
    (tmp_path / "cert").write_text("x")
    connection = kafka.connection_options("host:9092", cert_file=str(tmp_path / "cert"))
    options = kafka.source_options(connection, "one", max_offsets_per_trigger=5)
    assert options == {
        "kafka.bootstrap.servers": "host:9092", "subscribe": "one", "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "5"}
    with pytest.raises(ValueError):
        kafka.source_options(connection, starting_offsets="middle")


def test_keyed_messages_and_preview(spark):
    rows = spark.createDataFrame([("$BTC", "a\nb" * 50), ("$ETH", None)], "coin string, text string")
    sent = kafka.to_messages(rows, "coin").collect()
    assert sent[0].key == "$BTC" and json.loads(sent[0].value)["text"].startswith("a\nb")
    messages = spark.createDataFrame(
        [(bytearray(b'{"author":"x","text":"one\\ntwo"}'),), (bytearray(b'{"text":"t"}'),)], "value binary")
    shown = [tuple(r) for r in kafka.message_preview(messages, 5).collect()]
    assert shown == [("x", "one t"), ("unknown", "t")]


def test_payload_records(spark):
    item = {"id_str": "1", "id": 1, "full_text": "full", "text": "short", "created_at": "t1", "user_id_str": "9"}
    rows = [
        ({"data": [item, {"id": 2, "text": "two", "timestamp": "t2"}, {"id": 3, "text": ""}]},),
        ({"data": [], "results": [{"id_str": "", "id": 4, "text": "four"}]},),
        ({"data": None, "timeline": [{"id": 5, "text": "five", "user_id_str": ""}]},),
        ({"data": {"error": "x"}, "results": [item]},),
        ({"data": ["stray", {"id": 6, "text": "six"}, 7, None, [item]]},),
        ({"other": 1},),
    ]
    landed = spark.createDataFrame([(json.dumps(r[0]), "$BTC", "ann") for r in rows],
                                   "payload string, coin string, name string")
    market = payloads.market_records(landed)
    assert market.columns == COLLECTOR_RECORD.names
    assert sorted(tuple(r) for r in market.collect()) == [
        ("1", "full", "t1", "ID_9", "$BTC"),
        ("2", "two", "t2", "unknown", "$BTC"),
        ("4", "four", None, "unknown", "$BTC"),
        ("5", "five", None, "unknown", "$BTC"),
        ("6", "six", None, "unknown", "$BTC"),
    ]
    assert {(r.author, r.target_coin) for r in payloads.whale_records(landed).collect()} == {
        ("ann", "WHALE_SIGNAL")}
    bad = spark.createDataFrame([("oops", "$BTC"), (None, "$BTC")], "payload string, coin string")
    assert payloads.market_records(bad).count() == 0


def test_partitioned_posts(spark, tmp_path):
    root = str(tmp_path / "raw")
    rows = [("1", "$btc", START), ("2", "$BTC", START.replace(hour=16)), ("3", "eth", START), ("4", "007", None)]
    posts = spark.createDataFrame(rows, "id string, target_coin string, at timestamp")
    files.store_raw_posts(posts, root, F.col("target_coin"), F.col("at"))
    assert (tmp_path / "raw" / "coin=BTC" / "date=2026-04-18" / "hour=15").is_dir()
    stored = sources.read_partitioned_posts(spark, root, COLLECTOR_RECORD)
    assert dict(stored.dtypes)["coin"] == "string"
    assert sorted((r.coin, r.id) for r in stored.collect()) == [("007", "4"), ("BTC", "1"), ("BTC", "2"), ("ETH", "3")]
    one = stored.where((F.col("coin") == "BTC") & (F.col("date") == date(2026, 4, 18)) & (F.col("hour") == 15))
    assert [r.id for r in one.collect()] == ["1"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(coin" in plan
    tagged = normalize_posts(stored, where="coin = 'BTC' AND hour = 15")
    assert [(r.tweet_id, r.coin) for r in tagged.collect()] == [("1", "BTC")]
    assert "PartitionFilters: [isnotnull(coin" in tagged._jdf.queryExecution().executedPlan().toString()
    globbed = sources.read_partitioned_posts(spark, root, COLLECTOR_RECORD, f"{root}/coin=ETH/*/*")
    assert [(r.coin, r.id) for r in globbed.collect()] == [("ETH", "3")]
    files.store_raw_posts(posts.limit(1), root, F.col("target_coin"), F.col("at"))
    assert sources.read_partitioned_posts(spark, root, COLLECTOR_RECORD).count() == 5


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    df = spark.range(3).withColumn("note", F.lit("é"))
    files.append_json(df.where("false"), path)
    files.write_json(df, path)
    files.append_json(df, path)
    assert spark.read.json(path).count() == 6
    files.write_json(df, path)
    assert sources.read_posts(spark, path, df.schema).count() == 3
    with pytest.raises(Exception, match="already exists"):
        files.write_json(df, path, overwrite=False)


def test_replacing_partitions_leaves_others(spark, tmp_path):
    root = str(tmp_path / "t")
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), root, "p")
    files.replace_partitions(spark.createDataFrame([(3, "b")], "v int, p string"), root, "p")
    assert {tuple(r) for r in spark.read.parquet(root).collect()} == {(1, "a"), (3, "b")}


def test_documents(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("$btc", 0.5, 0.25, 0.25, 60.0, START, START)],
        "coin string, bullish_ratio double, bearish_ratio double, neutral_ratio double, "
        "fear_greed_score double, window_start timestamp, window_end timestamp")
    stored = D.sentiment_documents(metrics)
    assert stored.columns == SENTIMENT_METRIC.names and stored.first().coin == "BTC"
    spikes = spark.createDataFrame(
        [("ai", 5, 1.0, 2.0, ["$fet", "Rndr"])],
        "keyword string, mention_count bigint, baseline_count double, z_score double, related_coins array<string>")
    row = D.spike_documents(spikes).first()
    assert row.related_coins == ["FET", "RNDR"] and row.detected_at is not None
    assert D.spike_documents(spikes).columns == TREND_SPIKE.names
    alerts = spark.createDataFrame([("spike", "high", "m")], "alert_type string, severity string, message string")
    opened = D.alert_documents(alerts)
    assert opened.columns == ALERT.names
    assert (opened.first().status, opened.first().payload) == ("open", {})
    path = str(tmp_path / "alerts")
    D.append_documents(opened.where("false"), path)
    D.append_documents(opened, path)
    D.append_documents(opened, path)
    assert sources.read_documents(spark, path, time="created_at").count() == 2


def test_stored_collection_is_read_back(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("x", "#btc", "2026-04-18T15:30:00Z")], "_id string, hashtag string, timestamp string"
                          ).write.json(path)
    df = sources.read_documents(spark, path, "json")
    assert df.columns == ["hashtag", "timestamp"] and df.first().timestamp == START


def test_lookup_and_union(spark):
    df = spark.createDataFrame([("A", i, i * 10) for i in range(9)], "symbol string, t int, n int")
    assert [r.n for r in sources.find(df, "t < 5", ["n"], "t", 2).collect()] == [40, 30]
    both = sources.union_topics(df.select("symbol"), df.select("t"), df)
    assert both.columns == ["symbol", "t", "n"] and both.count() == 27


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(shared_dir(spark))
    assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"


def test_stage_preview(spark, capsys):
    show_stages(2, clean=spark.range(3), trends=spark.range(1))
    printed = capsys.readouterr().out
    assert "=== clean ===" in printed and "only showing top 2 rows" in printed and "=== trends ===" in printed
