"""The given tables as posts, messages, hashtag hours and a lexicon.

The tables hold no posts, so posts are derived row by row from ``events``.  The
derivation plants what the operators must deal with: two dialects, symbols in
tag lists, text or target, whales, explicit weights, unreadable counts, repeated
ids and every kind of invalid record.  ``*_SQL`` state the same facts for the
checking queries, but give the cleaned values directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.dedupe import dedupe_latest
from murmur.operators.posts import explode_symbols, normalize_posts, valid_posts
from murmur.operators.sentiment import tokens
from murmur.settings import MARKET_TOPIC, WHALE_TOPIC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The tables' timestamps have no zone and mean UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def naive(df: DataFrame, *columns: str) -> DataFrame:
    """Instants as zone-less UTC timestamps, the form the tables use."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def raw_posts(spark: SparkSession, sf_dir: str, unique_ids: bool = False) -> DataFrame:
    return posts_of(table(spark, sf_dir, "events"), unique_ids)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files; the glob takes a file or a folder."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def posts_of(events: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Events as raw posts of both dialects, with ``arrival`` and ``observed_at``."""
    events = events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.floor("value").alias("v"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    post_id = "event_id" if unique_ids else "event_id div 3"
    a, b = "user_id % 2 = 0", "user_id % 2 = 1"
    handle = "if(user_id % 25 = 0, '@Saylor', concat('user_', user_id))"
    return events.selectExpr(
        "event_id AS arrival",
        "ts AS observed_at",
        "k",
        f"if({a}, if(k = 98, ' ', cast({post_id} AS string)), null) AS tweet_id",
        f"if({b}, if(k = 98, null, cast({post_id} AS string)), null) AS id",
        f"if({a}, cast(user_id AS string), null) AS user_id",
        "if(k = 97, 'bad-date', concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"),"
        " if(k % 2 = 0, 'Z', ''))) AS created_at",
        f"if({a}, {handle}, null) AS username",
        f"if({b}, {handle}, null) AS author",
        f"if({a}, if(k = 99, ' \\t ', concat('  $', event_type, '\\n and  $',"
        " upper(event_type), ' at ', k)), null) AS content",
        f"if({b}, if(k = 99, '', if(k % 5 = 0, concat('plain post ', k),"
        " concat('$', event_type, ' from  feed'))), null) AS text",
        f"if({b}, if(k % 7 = 0, 'Whale_Signal', concat('$', event_type)), null) AS target_coin",
        f"if({a}, concat('[\"#Tag', k % 5, '\"]'), null) AS hashtags",
        f"if({a}, case k % 4 when 0 then concat('[\"#', event_type, '\",\"$',"
        " upper(event_type), '\",\"\"]') when 1 then concat('$', event_type)"
        " when 2 then '[]' end, null) AS cashtags",
        "cast(k AS string) AS like_count",
        "concat(' ', v) AS retweet_count",
        "if(v % 4 = 3, '9223372036854775807', 'n/a') AS reply_count",
        f"if({a}, 'EN', null) AS lang",
        "case user_id % 10 when 5 then '1.5' when 3 then '1e300' end AS author_weight",
    )


def messages(spark: SparkSession, sf_dir: str, unique_ids: bool = False) -> DataFrame:
    return messages_of(raw_posts(spark, sf_dir, unique_ids))


def messages_of(posts: DataFrame) -> DataFrame:
    """Raw posts as JSON messages with topic; some are no JSON at all.

    Posts with a tag list have bare counts: a whole number, one with a fraction, false.
    """
    counts = ("like_count", "retweet_count", "reply_count")
    fields = [
        c for c in posts.columns
        if c not in ("arrival", "observed_at", "k", "hashtags", "cashtags", *counts)
    ]
    tags = F.from_json("hashtags", "array<string>").alias("hashtags")
    retweets = F.col("retweet_count").cast("double")
    listed = F.to_json(
        F.struct(
            *fields, tags, F.from_json("cashtags", "array<string>").alias("cashtags"),
            F.col("like_count").cast("bigint").alias("like_count"),
            (retweets + F.when(retweets < 0, -0.5).otherwise(0.5)).alias("retweet_count"),
            F.lit(False).alias("reply_count"),
        )
    )
    scalar = F.to_json(F.struct(*fields, tags, "cashtags", *counts))
    body = (
        F.when(F.col("k") == 96, F.lit("not json"))
        .when(F.col("cashtags").startswith("["), listed)
        .otherwise(scalar)
    )
    topic = F.when(F.col("target_coin") == "Whale_Signal", WHALE_TOPIC).otherwise(MARKET_TOPIC)
    return posts.select("arrival", "observed_at", topic.alias("topic"), body.alias("value"))


def clean_posts(spark: SparkSession, sf_dir: str, unique_ids: bool = False) -> DataFrame:
    return valid_posts(normalize_posts(raw_posts(spark, sf_dir, unique_ids)))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated clean posts, one row per symbol."""
    return explode_symbols(dedupe_latest(clean_posts(spark, sf_dir)))


def basket_posts(spark: SparkSession, sf_dir: str, kinds: int = 1) -> DataFrame:
    """A post for each user and day, tagged with all that the user did; ``kinds`` symbols per event type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    symbol = F.upper("event_type") if kinds == 1 else F.concat(F.upper("event_type"), k % kinds)
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    return days.agg(F.collect_list(symbol).alias("cashtags"))


def hashtag_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the hashtag-hour table."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    score = "least(greatest(cast(value AS decimal(12,2)) * 0.01BD - 1BD, -1BD), 1BD)"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("#"), F.col("event_type"), F.floor(k / 5).cast("string")).alias("hashtag"),
        k.alias("count"),
        F.expr(score).cast("double").alias("sentiment"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
        F.expr("if(user_id % 11 = 0, null, cast(user_id * 37 % 1800 AS double) / 10 - 90)").alias("lat"),
        F.expr("if(user_id % 13 = 0, null, cast(user_id * 53 % 3600 AS double) / 10 - 180)").alias("lon"),
    )


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: one second apart, with the source as their coin."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.concat(F.lit("$"), F.col("source")).alias("target_coin"),
        F.expr("timestamp_seconds(1704067200 + doc_id)").alias("created_at"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of the words of ``benchmark``, with a valence made from each word."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("token"))
    return (
        words.distinct()
        .withColumn("valence", F.expr("((length(token) * 5 + ascii(token)) % 17 - 8) / 2D"))
        .where("valence <> 0")
    )


# --- the same facts for the checking SQL ------------------------------------

POSTS_SQL = """
facts AS (
  SELECT event_id, ts, user_id AS uid, event_type AS et, upper(event_type) AS sym,
         cast(floor(value) AS BIGINT) AS v,
         cast(json_extract_string(props, '$.k') AS BIGINT) AS k,
         user_id % 2 = 0 AS is_a
  FROM events
),
all_posts AS (
  SELECT event_id, ts, k, is_a,
         CASE WHEN k <> 98 THEN cast(event_id // {id_div} AS VARCHAR) END AS tweet_id,
         CASE WHEN is_a THEN cast(uid AS VARCHAR)
              WHEN uid % 25 = 0 THEN '@Saylor' ELSE 'user_' || uid END AS user_id,
         CASE WHEN uid % 25 = 0 THEN '@Saylor' ELSE 'user_' || uid END AS username,
         CASE WHEN k <> 97 THEN ts END AS created_at,
         CASE WHEN k = 99 THEN ''
              WHEN is_a THEN '$' || et || ' and $' || sym || ' at ' || k
              WHEN k % 5 = 0 THEN 'plain post ' || k
              ELSE '$' || et || ' from feed' END AS content,
         CASE WHEN is_a THEN 'TAG' || (k % 5) ELSE '' END AS hashtags,
         CASE WHEN is_a AND (k <> 99 OR k % 4 < 2) THEN sym
              WHEN NOT is_a AND (k % 5 <> 0 AND k <> 99 OR k % 7 <> 0) THEN sym
              ELSE '' END AS cashtags,
         CASE WHEN is_a THEN 'en' ELSE 'und' END AS lang,
         k AS like_count, v AS retweet_count, cast(0 AS BIGINT) AS reply_count,
         k + v AS engagement_score,
         cast(CASE WHEN uid % 10 = 5 THEN 1.5
                   WHEN uid % 25 = 0 OR (NOT is_a AND k % 7 = 0) THEN 5.0
                   ELSE 1.0 END AS DECIMAL(4, 1)) AS weight,
         NOT is_a AND k % 7 = 0 AS from_whales
  FROM facts
),
tagged AS (
  SELECT *, CASE WHEN k = 96 AND {json} THEN 'bad_json' WHEN tweet_id IS NULL THEN 'missing_id'
                 WHEN created_at IS NULL THEN 'bad_timestamp'
                 WHEN content = '' THEN 'missing_content'
                 WHEN cashtags = '' THEN 'missing_symbol' END AS invalid_reason
  FROM all_posts
),
valid AS (SELECT * FROM tagged WHERE invalid_reason IS NULL),
deduped AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY created_at DESC, event_id) = 1
)"""


def posts_sql(unique_ids: bool = False, json: bool = False) -> str:
    """CTEs up to ``deduped``; ``json``: the posts went through messages."""
    return "WITH " + POSTS_SQL.format(id_div=1 if unique_ids else 3, json=str(json).lower())


HOURS_SQL = """WITH hours AS (
  SELECT '#' || event_type || (cast(json_extract_string(props, '$.k') AS BIGINT) // 5) AS hashtag,
         cast(json_extract_string(props, '$.k') AS BIGINT) AS count,
         cast(least(greatest(cast(value AS DECIMAL(12, 2)) * 0.01 - 1, -1), 1) AS DOUBLE) AS sentiment,
         date_trunc('hour', ts) AS timestamp,
         CASE WHEN user_id % 11 <> 0
              THEN cast(user_id * 37 % 1800 AS DOUBLE) / cast(10 AS DOUBLE) - 90 END AS lat,
         CASE WHEN user_id % 13 <> 0
              THEN cast(user_id * 53 % 3600 AS DOUBLE) / cast(10 AS DOUBLE) - 180 END AS lon
  FROM events
)"""
