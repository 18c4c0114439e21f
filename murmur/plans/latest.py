"""Queries on the latest post of every id in a stream, and on tables that are read by their index."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from murmur.operators import views as V
from murmur.operators.posts import normalize_posts, valid_posts
from murmur.operators.trends import windowed_trends
from murmur.plans import adapters as A
from murmur.plans import posts as P
from murmur.plans import trends as T
from murmur.plans.registry import query
from murmur.plans.streams import NOW
from murmur.plans.views import RANKED_SQL
from murmur.session import scratch_path
from murmur.sinks import indexed, storage
from murmur.streaming import runner
from murmur.streaming.latest import latest_changes, latest_posts

HOUR, BATCHES = timedelta(hours=1), 3


def _changes(spark, sf_dir):
    """The log of changes of posts in three batches, each with other posts of the same ids."""
    root = scratch_path(spark, "stream_latest")
    posts = A.raw_posts(spark, sf_dir)
    for turn in range(BATCHES):
        # The newest posts of an id may come first, in the middle or last.
        posts.where(F.col("arrival") % BATCHES == turn).write.mode("append").parquet(f"{root}/posts")
    files = [n for n in storage.children(spark, f"{root}/posts") if n.startswith("part-")]
    reader = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", max(1, len(files) // BATCHES))
    valid = valid_posts(normalize_posts(reader.parquet(f"{root}/posts")))
    changes = latest_changes(valid)
    started = runner.start_append(
        changes, f"{root}/changes", f"{root}/checkpoint", "stream_latest", mode="append", trigger=NOW
    )
    runner.run_available(started)
    return spark.read.parquet(f"{root}/changes").drop("batch_id")


@query(A.posts_sql() + f" SELECT {P.CLEAN_SQL} FROM deduped")
def stream_latest_posts(spark, sf_dir):
    """The latest post of every id, whatever the order in which they came."""
    return P.flat(latest_posts(_changes(spark, sf_dir)))


@query(
    A.posts_sql()
    + """ SELECT cashtags AS symbol, count(*) AS mention_count,
                cast(sum(engagement_score) AS BIGINT) AS engagement_score FROM deduped GROUP BY ALL"""
)
def stream_latest_totals(spark, sf_dir):
    """Totals per symbol as signed sums over the log of changes: what was taken back counts no more."""
    changes = _changes(spark, sf_dir).withColumn("symbol", F.explode("cashtags"))
    totals = changes.groupBy("symbol").agg(
        F.sum(F.col("change").cast("bigint")).alias("mention_count"),
        F.sum(F.col("change") * F.col("engagement_score")).alias("engagement_score"),
    )
    return totals.where("mention_count > 0")


def _pages(spark, sf_dir):
    root = scratch_path(spark, "pages")
    totals = V.tag_totals(A.hashtag_hours(spark, sf_dir))
    indexed.write_pages(totals, root, [F.desc("total_count"), F.asc("hashtag")])
    return root


@query(f"{RANKED_SQL} SELECT hashtag, total_count, avg_sentiment FROM ranked WHERE rank BETWEEN 11 AND 20")
def stored_page(spark, sf_dir):
    """Second page of a table that was ranked when it was written."""
    return indexed.read_page(spark, _pages(spark, sf_dir), 2)


@query(f"{RANKED_SQL} SELECT cast(ceil(count(*) / 7.0) AS BIGINT) AS pages FROM ranked")
def stored_page_count(spark, sf_dir):
    """Number of pages, from the index of the table's files."""
    return indexed.page_count(spark, _pages(spark, sf_dir), 7)


@query(
    A.posts_sql()
    + f", {T.windows_sql('deduped', 1)} SELECT window_end, mention_count FROM windows WHERE symbol = 'CLICK'"
)
def indexed_windows(spark, sf_dir):
    """All windows of a symbol, from the files that hold it."""
    root = scratch_path(spark, "indexed_windows")
    windows = windowed_trends(A.mentions(spark, sf_dir), HOUR, HOUR)
    indexed.write_indexed(windows, root, "symbol", "window_end")
    rows = indexed.read_range(spark, root, "symbol", "CLICK", "CLICK")
    return A.naive(rows.select("window_end", "mention_count"), "window_end")
