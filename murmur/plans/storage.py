"""Round trips through the sinks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from murmur.functions.text import normalize_coin
from murmur.operators import sentiment as S
from murmur.operators.posts import normalize_posts, valid_posts
from murmur.plans import adapters as A
from murmur.plans.registry import query
from murmur.plans.sentiment import LEXICON_SQL, SCORES_SQL, scored_documents
from murmur.plans.sentiment import METRICS_SQL as SENTIMENT_SQL
from murmur.schemas import COLLECTOR_RECORD
from murmur.session import scratch_path
from murmur.sinks import documents as D
from murmur.sinks import compaction, files
from murmur.sources.files import read_documents, read_partitioned_posts, read_posts


@query(
    """SELECT upper(source) AS coin, to_timestamp(1704067200 + doc_id)::TIMESTAMP::DATE AS date,
              cast(hour(to_timestamp(1704067200 + doc_id)::TIMESTAMP) AS INTEGER) AS hour,
              count(*) AS posts, cast(sum(length(text)) AS BIGINT) AS characters
       FROM documents WHERE upper(source) <> 'SRC3' GROUP BY ALL"""
)
def raw_partitioned_roundtrip(spark, sf_dir):
    """Store posts by coin, date and hour, read them back with a directory filter."""
    root = scratch_path(spark, "raw_posts")
    posts = A.document_posts(spark, sf_dir)
    files.store_raw_posts(
        posts.select("doc_id", "text", "created_at", "target_coin"),
        root,
        F.col("target_coin"),
        F.col("created_at"),
    )
    stored = read_partitioned_posts(spark, root, COLLECTOR_RECORD)
    return (
        stored.where("coin <> 'SRC3'")
        .groupBy("coin", "date", "hour")
        .agg(F.count("*").alias("posts"), F.sum(F.length("text")).alias("characters"))
    )


@query(
    """SELECT upper(source) AS coin, to_timestamp(1704067200 + doc_id)::TIMESTAMP::DATE AS date,
              cast(hour(to_timestamp(1704067200 + doc_id)::TIMESTAMP) AS INTEGER) AS hour,
              cast(2 * count(*) AS BIGINT) AS posts, cast(0 AS BIGINT) AS crowded
       FROM documents GROUP BY ALL"""
)
def compacted_posts(spark, sf_dir):
    """Posts appended twice, their small files joined; ``crowded`` counts folders that are left to join."""
    root = scratch_path(spark, "compacted_posts")
    posts = A.document_posts(spark, sf_dir).select("doc_id", "text", "created_at", "target_coin")
    for _ in range(2):
        files.store_raw_posts(posts, root, F.col("target_coin"), F.col("created_at"))
    after = date(2024, 12, 31)
    compaction.compact(spark, root, after)
    left = compaction.crowded_folders(spark, root, after).count()
    stored = read_partitioned_posts(spark, root, COLLECTOR_RECORD)
    counts = stored.groupBy("coin", "date", "hour").agg(F.count("*").alias("posts"))
    return counts.withColumn("crowded", F.lit(left).cast("bigint"))


@query(
    r"""SELECT date, hour, count(*) AS posts FROM (
         SELECT (to_timestamp(1704067200 + doc_id)::TIMESTAMP)::DATE AS date,
                cast(hour(to_timestamp(1704067200 + doc_id)::TIMESTAMP) AS INTEGER) AS hour
         FROM documents WHERE upper(source) = 'SRC3' AND regexp_matches(text, '\S')) posts
       WHERE date = DATE '2024-01-01' GROUP BY ALL"""
)
def cleaned_partition(spark, sf_dir):
    """Stored posts of one coin and day, cleaned; other directories are not read."""
    root = scratch_path(spark, "cleaned_partition")
    posts = A.document_posts(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    files.store_raw_posts(
        posts.select("id", "text", "created_at", "target_coin"),
        root,
        F.col("target_coin"),
        F.col("created_at"),
    )
    stored = read_partitioned_posts(spark, root, COLLECTOR_RECORD)
    tagged = normalize_posts(stored, where="coin = 'SRC3' AND date = DATE '2024-01-01'")
    return valid_posts(tagged).groupBy("date", "hour").agg(F.count("*").alias("posts"))


@query(
    """SELECT cast(event_id AS VARCHAR) AS id, '$' || upper(event_type) AS target_coin,
              'note ' || user_id AS text FROM events
       UNION ALL
       SELECT 'r' || r_regionkey, '$REGION', r_name FROM region"""
)
def json_lines_roundtrip(spark, sf_dir):
    """Overwrite a JSON-lines folder, append twice (once nothing), read it back."""
    path = scratch_path(spark, "json_lines")
    posts = A.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("$"), F.upper("event_type")).alias("target_coin"),
        F.concat(F.lit("note "), "user_id").alias("text"),
    )
    regions = A.table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"),
        F.lit("$REGION").alias("target_coin"),
        F.col("r_name").alias("text"),
    )
    files.write_json(posts, path)
    files.append_json(regions, path)
    files.append_json(regions.where("false"), path)
    return read_posts(spark, path, COLLECTOR_RECORD).select("id", "target_coin", "text")


@query(
    f"""WITH {LEXICON_SQL}, {SCORES_SQL}
       SELECT coin, bullish_ratio, bearish_ratio, neutral_ratio, fear_greed_score, window_start, window_end
       FROM (SELECT coin, {SENTIMENT_SQL}, min(created_at) AS window_start, max(created_at) AS window_end
             FROM scores GROUP BY coin)"""
)
def sentiment_documents(spark, sf_dir):
    """Sentiment metrics appended as documents and read back."""
    path = scratch_path(spark, "sentiment_metrics")
    scored = scored_documents(spark, sf_dir)
    spans = scored.groupBy("coin").agg(
        F.min("created_at").alias("window_start"), F.max("created_at").alias("window_end")
    )
    metrics = S.coin_sentiment(scored).join(spans, "coin")
    D.append_documents(D.sentiment_documents(metrics), path)
    stored = read_documents(spark, path, time="created_at").drop("created_at")
    return A.naive(stored, "window_start", "window_end")


@query(
    """SELECT upper(source) AS coin, count(*) AS posts, cast(sum(n_chars) AS BIGINT) AS characters
       FROM documents GROUP BY ALL"""
)
def stored_posts(spark, sf_dir):
    """Posts appended as documents, counted per coin."""
    path = scratch_path(spark, "posts")
    posts = A.table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", normalize_coin(F.col("source")).alias("coin")
    )
    D.append_documents(posts, path)
    D.append_documents(posts.where("false"), path)
    return (
        spark.read.parquet(path)
        .groupBy("coin")
        .agg(F.count("*").alias("posts"), F.sum("n_chars").alias("characters"))
    )
