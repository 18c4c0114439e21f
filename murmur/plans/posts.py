"""Queries on cleaning, rejecting and deduplicating posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import dedupe, lookup
from murmur.operators import posts as P
from murmur.operators.trends import rejected_by_window
from murmur.plans import adapters as A
from murmur.plans.registry import query
from murmur.settings import WHALE_AUTHORS
from murmur.sources import kafka, payloads
from murmur.sources.files import union_topics

_CLEAN = (
    "tweet_id", "user_id", "created_at", "username", "content", "hashtags", "cashtags",
    "like_count", "retweet_count", "reply_count", "lang", "engagement_score",
    "author_type", "author_weight", "influence_score",
)

CLEAN_SQL = """tweet_id, user_id, created_at, username, content, hashtags, cashtags, like_count,
       retweet_count, reply_count, lang, engagement_score,
       CASE WHEN weight >= 5 THEN 'whale' ELSE 'market' END AS author_type,
       cast(weight AS DOUBLE) AS author_weight,
       cast(weight * engagement_score AS DOUBLE) AS influence_score"""


def flat(posts):
    joined = posts.withColumns(
        {"hashtags": F.array_join("hashtags", ","), "cashtags": F.array_join("cashtags", ",")}
    )
    return A.naive(joined.select(*_CLEAN), "created_at")


@query(A.posts_sql(unique_ids=True, json=True) + f" SELECT {CLEAN_SQL} FROM valid")
def clean_posts(spark, sf_dir):
    parsed = P.parse_posts(A.messages(spark, sf_dir, unique_ids=True))
    return flat(P.valid_posts(P.normalize_posts(parsed)))


@query(
    A.posts_sql(json=True)
    + """ SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start,
              time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
              invalid_reason, count(*) AS bad_record_count
       FROM tagged WHERE invalid_reason IS NOT NULL GROUP BY ALL"""
)
def rejected_by_reason(spark, sf_dir):
    tagged = P.normalize_posts(P.parse_posts(A.messages(spark, sf_dir)))
    return rejected_by_window(P.rejected_posts(tagged))


@query(
    A.posts_sql(json=True)
    + """ SELECT count(*) AS raw_messages,
              count(*) FILTER (WHERE NOT coalesce(invalid_reason = 'bad_json', false)) AS parsed_messages,
              count(*) FILTER (WHERE invalid_reason IS NULL) AS clean_messages,
              count(DISTINCT tweet_id) FILTER (WHERE invalid_reason IS NULL) AS deduplicated_messages
       FROM tagged"""
)
def stage_funnel(spark, sf_dir):
    return P.stage_funnel(P.normalize_posts(P.parse_posts(A.messages(spark, sf_dir))))


@query(
    A.posts_sql(unique_ids=True, json=True)
    + " SELECT cast(event_id AS BIGINT) AS arrival, k FROM all_posts WHERE k <> 96"
)
def parsed_messages(spark, sf_dir):
    parsed = P.parsed_only(P.parse_posts(A.messages(spark, sf_dir, unique_ids=True)))
    return parsed.select("arrival", F.col("like_count").cast("bigint").alias("k"))


@query(
    A.posts_sql()
    + """ SELECT CASE WHEN from_whales THEN 'raw-tweets-whales' ELSE 'raw-tweets-market' END AS topic,
              count(*) FILTER (WHERE invalid_reason IS NULL) AS valid_posts,
              count(*) FILTER (WHERE invalid_reason IS NOT NULL) AS rejected_posts
       FROM tagged GROUP BY ALL
       UNION ALL
       SELECT 'conversations', count(*) FILTER (WHERE regexp_matches(text, '\\S')), count(*) FILTER (WHERE NOT regexp_matches(coalesce(text, ''), '\\S'))
       FROM conversations"""
)
def topic_union(spark, sf_dir):
    """Two topics and a third input of other shape in one plan, split by validity."""
    posts = A.raw_posts(spark, sf_dir)
    whales = posts.where(F.col("target_coin") == "Whale_Signal").withColumn(
        "topic", F.lit("raw-tweets-whales")
    )
    market = posts.where(
        ~F.coalesce(F.col("target_coin") == "Whale_Signal", F.lit(False))
    ).withColumn("topic", F.lit("raw-tweets-market"))
    talk = A.table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("topic"),
        F.concat("conv_id", F.lit("-"), "turn").alias("id"),
        "text",
        F.lit("2024-01-01").alias("created_at"),
        F.lit("$TALK").alias("target_coin"),
    )
    tagged = P.normalize_posts(union_topics(market, whales, talk))
    return tagged.groupBy("topic").agg(
        F.count_if(F.col("invalid_reason").isNull()).alias("valid_posts"),
        F.count_if(F.col("invalid_reason").isNotNull()).alias("rejected_posts"),
    )


@query(
    A.posts_sql(unique_ids=True)
    + """ SELECT event_id AS arrival,
              CASE WHEN username = '@Saylor' OR from_whales THEN 'whale' ELSE 'market' END AS author_type,
              CASE WHEN username = '@Saylor' OR from_whales THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS author_weight,
              username = '@Saylor' AS known_whale
       FROM all_posts"""
)
def author_class(spark, sf_dir):
    """Class by rule, and membership by a join with a table of names."""
    posts = A.raw_posts(spark, sf_dir).select(
        "arrival", F.coalesce("username", "author").alias("author"), "target_coin"
    )
    names = spark.createDataFrame([(n,) for n in WHALE_AUTHORS], "handle string")
    handles = P.classify_authors(posts).withColumn(
        "handle", F.ltrim(F.lower("author"), F.lit("@"))
    )
    tagged = lookup.tag_members(handles, names, "handle", "known_whale")
    return tagged.select("arrival", "author_type", "author_weight", "known_whale")


@query(
    """SELECT DISTINCT 'user_' || user_id AS name, cast(c_custkey AS VARCHAR) AS account_id
       FROM events JOIN customer ON c_custkey = user_id"""
)
def account_directory(spark, sf_dir):
    """Names with their id from a directory; unknown names are left out."""
    names = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), "user_id").alias("name")
    ).distinct()
    return lookup.active_directory(names, _directory(spark, sf_dir))


@query(
    """SELECT DISTINCT 'order_' || o_orderkey AS name FROM orders
       WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)"""
)
def unknown_accounts(spark, sf_dir):
    names = A.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order_"), "o_orderkey").alias("name")
    ).distinct()
    directory = _directory(spark, sf_dir).withColumn("name", F.replace("name", F.lit("user"), F.lit("order")))
    return lookup.unknown_names(names, directory)


def _directory(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user_"), "c_custkey").alias("name"),
        F.col("c_custkey").cast("string").alias("account_id"),
    )


@query(
    A.posts_sql()
    + f""", hourly AS (SELECT * REPLACE (date_trunc('hour', created_at) AS created_at) FROM valid),
      kept AS (SELECT * FROM hourly QUALIFY row_number() OVER
               (PARTITION BY tweet_id ORDER BY created_at DESC, event_id) = 1)
      SELECT {CLEAN_SQL} FROM kept"""
)
def dedupe_latest(spark, sf_dir):
    """Latest per id at hour resolution, so that most ids have ties."""
    posts = A.clean_posts(spark, sf_dir).withColumn("created_at", F.date_trunc("hour", "created_at"))
    return flat(dedupe.by_time(dedupe.dedupe_latest(posts)))


@query(
    A.posts_sql()
    + """, strict AS (SELECT * FROM facts WHERE is_a AND k % 4 = 0
                     QUALIFY row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts DESC, event_id) = 1)
      SELECT cast(event_id // 3 AS VARCHAR) AS tweet_id, cast(uid AS VARCHAR) AS user_id,
             ts AS created_at, k + v AS engagement_score,
             '#' || sym || ',$' || sym || ',' AS cashtags
      FROM strict"""
)
def dedupe_strict(spark, sf_dir):
    """The strict batch rule: only posts of the first dialect with a tag array."""
    posts = P.strict_posts(A.raw_posts(spark, sf_dir))
    kept = dedupe.dedupe_latest(posts).select(
        "tweet_id", "user_id", "created_at", "engagement_score",
        F.array_join("cashtags", ",").alias("cashtags"),
    )
    return A.naive(kept, "created_at")


def _payloads(spark, sf_dir):
    """Each event as an API response of two items, wrapped in one of four ways."""
    item = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("id_str"),
            F.col("event_id").alias("id"),
            F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("full "), "event_type")).alias("full_text"),
            F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("short "), "event_type"))
            .otherwise(F.lit(""))
            .alias("text"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).alias("user_id_str"),
        )
    )
    empty = '{"id":1,"text":""}'
    lists = F.concat(F.lit("["), item, F.lit(',"no item",'), item, F.lit(f",7,{empty}]"))
    kind = F.col("event_id") % 4
    wrapped = (
        F.when(kind == 0, F.concat(F.lit('{"data":'), lists, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"data":[ ],"results":'), lists, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"data":null,"results":"","timeline":'), lists, F.lit("}")))
        .otherwise(F.concat(F.lit('{"data":{"error":1},"results":'), lists, F.lit("}")))
    )
    return A.table(spark, sf_dir, "events").select(
        wrapped.alias("payload"), F.concat(F.lit("$"), F.upper("event_type")).alias("coin"),
        F.col("event_type").alias("name"),
    )


_RECORDS_SQL = """
  SELECT cast(event_id AS VARCHAR) AS id,
         CASE user_id % 3 WHEN 0 THEN 'full ' ELSE 'short ' END || event_type AS text,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at,
         {author} AS author, {target} AS target_coin
  FROM events, range(2) copies(c) WHERE event_id % 4 <> 3 AND user_id % 3 <> 2"""


@query(
    _RECORDS_SQL.format(
        author="CASE WHEN user_id % 2 = 0 THEN 'ID_' || user_id ELSE 'unknown' END",
        target="'$' || upper(event_type)",
    )
    + " UNION ALL "
    + _RECORDS_SQL.format(author="event_type", target="'WHALE_SIGNAL'")
)
def collector_records(spark, sf_dir):
    """Records of keyword searches and of whale accounts from landed payloads."""
    landed = _payloads(spark, sf_dir)
    return payloads.market_records(landed).unionByName(payloads.whale_records(landed))


@query(
    """SELECT cast(source AS VARCHAR) AS author, substr(replace(text, chr(10), ' '), 1, 80) AS text
       FROM documents"""
)
def message_preview(spark, sf_dir):
    """Author and first 80 characters of JSON messages."""
    sent = A.table(spark, sf_dir, "documents").select(
        F.to_json(F.struct(F.col("source").alias("author"), "text")).cast("binary").alias("value")
    )
    return kafka.message_preview(sent)


@query(
    """SELECT event_type AS key,
              '{"id":"' || event_id || '","author":"ID_' || user_id || '"}' AS value
       FROM events"""
)
def keyed_messages(spark, sf_dir):
    """Rows as keyed JSON messages."""
    records = A.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("ID_"), "user_id").alias("author"),
        "event_type",
    )
    keyed = kafka.to_messages(records.select("id", "author", "event_type"), "event_type")
    body = F.from_json("value", "id string, author string")
    return keyed.select("key", F.to_json(body).alias("value"))
