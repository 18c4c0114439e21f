"""Sentiment queries over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import sentiment as S
from murmur.operators.valence_rules import rule_scores
from murmur.plans import adapters as A
from murmur.plans.registry import query

_TOKENS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+(?:[''’][\p{L}\p{M}]+)*'))"
LEXICON_SQL = f"""lexicon AS (
  SELECT token, cast(((length(token) * 5 + ascii(token)) % 17 - 8) / 2.0 AS DECIMAL(8, 4)) AS valence
  FROM (SELECT DISTINCT {_TOKENS} AS token FROM benchmark)
  WHERE (length(token) * 5 + ascii(token)) % 17 <> 8)"""
SCORES_SQL = f"""words AS (SELECT doc_id, {_TOKENS} AS token FROM documents),
sums AS (SELECT doc_id, count(*) AS n, sum(valence) AS s FROM words JOIN lexicon USING (token) GROUP BY doc_id),
scores AS (
  SELECT doc_id, upper(source) AS coin, to_timestamp(1704067200 + doc_id)::TIMESTAMP AS created_at,
         coalesce(n, 0) AS matched_tokens, cast(coalesce(s, 0) AS DOUBLE) AS valence_sum,
         cast(round(cast(cast(coalesce(s, 0) AS DOUBLE)
              / sqrt(cast(coalesce(s, 0) AS DOUBLE) * cast(coalesce(s, 0) AS DOUBLE) + 15) AS DECIMAL(18, 14)), 4)
              AS DOUBLE) AS sentiment_score
  FROM documents LEFT JOIN sums USING (doc_id))"""
METRICS_SQL = """cast(sum(cast(sentiment_score AS DECIMAL(18, 9))) AS DOUBLE) / count(sentiment_score) AS avg_sentiment,
       count(sentiment_score) AS mention_count,
       cast(count(*) FILTER (WHERE sentiment_score >= 0.1::DOUBLE) AS DOUBLE) / count(*) AS bullish_ratio,
       cast(count(*) FILTER (WHERE sentiment_score < -0.1::DOUBLE) AS DOUBLE) / count(*) AS bearish_ratio,
       cast(count(*) FILTER (WHERE sentiment_score >= -0.1::DOUBLE AND sentiment_score < 0.1::DOUBLE) AS DOUBLE) / count(*) AS neutral_ratio,
       (cast(sum(cast(sentiment_score AS DECIMAL(18, 9))) AS DOUBLE) / count(sentiment_score) + 1) * 50 AS fear_greed_score"""


def scored_documents(spark, sf_dir, keys=("doc_id", "coin", "created_at")):
    posts = S.with_coin(A.document_posts(spark, sf_dir), "target_coin")
    return S.sentiment_scores(posts, A.lexicon(spark, sf_dir), list(keys))


@query(
    f"""WITH {LEXICON_SQL}, {SCORES_SQL}
       SELECT doc_id, matched_tokens, valence_sum, sentiment_score,
              CASE WHEN sentiment_score >= 0.1::DOUBLE THEN 'positive'
                   WHEN sentiment_score < -0.1::DOUBLE THEN 'negative' ELSE 'neutral' END AS sentiment_class
       FROM scores"""
)
def sentiment_scores(spark, sf_dir):
    scored = scored_documents(spark, sf_dir, ["doc_id"])
    return scored.withColumn("sentiment_class", S.scores.sentiment_class(F.col("sentiment_score")))


@query(f"WITH {LEXICON_SQL}, {SCORES_SQL} SELECT coin, {METRICS_SQL} FROM scores GROUP BY coin")
def coin_fear_greed(spark, sf_dir):
    return S.coin_sentiment(scored_documents(spark, sf_dir, ["doc_id", "coin"]))


@query(
    f"""WITH {LEXICON_SQL}, {SCORES_SQL}
       SELECT coin, time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start,
              time_bucket(INTERVAL 5 MINUTE, created_at) + INTERVAL 5 MINUTE AS window_end, {METRICS_SQL}
       FROM scores GROUP BY ALL"""
)
def coin_sentiment_windows(spark, sf_dir):
    """Shares and score per coin and window."""
    scored = scored_documents(spark, sf_dir)
    window = F.window("created_at", "5 minutes")
    placed = scored.withColumns({"window_start": window.start, "window_end": window.end})
    metrics = S.coin_sentiment(placed, ["coin", "window_start", "window_end"])
    return A.naive(metrics, "window_start", "window_end")


@query()
def coin_fear_greed_rules(spark, sf_dir):
    """Fear-and-greed score from scores with all context rules."""
    posts = S.with_coin(A.document_posts(spark, sf_dir), "target_coin")
    scored = rule_scores(posts, A.lexicon(spark, sf_dir), ["doc_id", "coin"])
    return S.coin_sentiment(scored)
