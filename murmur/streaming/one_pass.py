"""All outputs of a message stream from one reading of it.

Every batch is parsed once, stored, and dealt out to its sinks from there: counts of every outcome,
posts behind the watermark, and panes.  A pane holds the sums of one slide and symbol, and sketches
of its authors that can be united, so windows of any size follow later without the posts.

Layout below ``root``; a folder is written whole or not at all, and a batch that is run again skips
what it has finished::

    incoming/batch_id=N   the batch's posts, parsed, with their outcome
    ids/batch_id=N        ids of kept posts, while a repeat may still come
    progress/batch_id=N   the newest times, one row
    outcomes/batch_id=N   posts per outcome: kept, repeated, late, or the reason of the rejection
    late/batch_id=N       late posts with how late they are
    panes/batch_id=N      sums and sketches
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.operators.posts import explode_symbols
from murmur.settings import TREND_SLIDE, TREND_WINDOW, WATERMARK_DELAY, interval
from murmur.sinks import storage

POST = ("tweet_id", "cashtags", "user_id", "created_at", "engagement_score", "influence_score", "author_weight")
#: Two to this power registers: a standard error of 1.6 % in 2 kB a sketch.
SKETCH_POWER = 12


@dataclass(frozen=True)
class OnePass:
    """The sinks below ``root``; ``write_batch`` is the ``foreachBatch`` function for normalised posts."""

    root: str
    pane: timedelta = TREND_SLIDE
    delay: timedelta = WATERMARK_DELAY

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        floor = self._floor(spark, batch_id)
        if not self._has(spark, "incoming", batch_id):
            self._incoming(batch, batch_id, floor).write.mode("overwrite").parquet(self._path("incoming", batch_id))
        posts = spark.read.parquet(self._path("incoming", batch_id))
        kept = posts.where("outcome = 'kept'")
        behind = F.when(F.col("outcome") == "late", (F.lit(floor).cast("bigint") - F.unix_micros("created_at")) / 1e6)
        self._write("ids", batch_id, lambda: kept.select("tweet_id", "created_at"))
        self._write("panes", batch_id, lambda: self._panes(kept))
        self._write("late", batch_id, lambda: posts.where("outcome = 'late'").withColumn("seconds_late", behind))
        self._write("outcomes", batch_id, lambda: posts.groupBy("outcome").agg(
            F.count("*").alias("posts"), F.max(behind).alias("max_seconds_late")))
        at = F.unix_micros("created_at")
        self._write("progress", batch_id, lambda: posts.agg(
            F.max(F.when(F.col("outcome").isin("kept", "late", "repeated"), at)).alias("newest"),
            F.max(F.when(F.col("outcome") == "kept", at)).alias("newest_kept")))
        self._forget(spark, batch_id)

    # -- reading --------------------------------------------------------------

    def outcomes(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(f"{self.root}/outcomes")
        return rows.groupBy("outcome").agg(F.sum("posts").alias("posts"), F.max("max_seconds_late").alias("max_seconds_late"))

    def late_posts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/late").drop("outcome")

    def windows(self, spark: SparkSession, size: timedelta = TREND_WINDOW, slide: timedelta | None = None) -> DataFrame:
        """Metrics per (window, symbol) with sketched author counts, for any multiple of the panes' length.

        Only rows of one symbol and pane are copied to the windows that they belong to, never posts.
        """
        slide = slide or self.pane
        if size % slide or slide % self.pane:
            raise ValueError("size, slide and pane must be multiples of each other")
        starts = F.transform(
            F.sequence(F.lit(0), F.lit(size // slide - 1)),
            lambda i: F.timestamp_micros(F.col("first") - i * (slide // timedelta(microseconds=1))),
        )
        first = F.unix_micros(F.window("pane", interval(slide)).start)
        panes = spark.read.parquet(f"{self.root}/panes").withColumn("first", first)
        spread = panes.withColumn("window_start", F.explode(starts))

        def united(column: str) -> Column:
            return F.hll_sketch_estimate(F.hll_union_agg(column, F.lit(True)))

        length = F.expr(f"INTERVAL '{size.total_seconds():.6f}' SECOND")
        metrics = spread.groupBy("window_start", "symbol").agg(
            F.sum("mention_count").alias("mention_count"),
            united("authors").alias("unique_authors"),
            united("influencers").alias("influencer_authors"),
            F.try_sum("engagement_score").alias("engagement_score"),
            F.round(F.sum("influence"), 2).alias("influence_score"),
            F.max("max_author_weight").alias("max_author_weight"),
            F.max("last_seen").alias("last_seen"),
        )
        return metrics.withColumn("window_end", F.col("window_start") + length)

    # -- steps ----------------------------------------------------------------

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/batch_id={batch_id}"

    def _has(self, spark: SparkSession, kind: str, batch_id: int) -> bool:
        return storage.complete(spark, self._path(kind, batch_id))

    def _write(self, kind: str, batch_id: int, make) -> None:
        spark = SparkSession.active()
        if not self._has(spark, kind, batch_id):
            make().write.mode("overwrite").parquet(self._path(kind, batch_id))

    def _batches(self, spark: SparkSession, kind: str) -> list[int]:
        names = storage.children(spark, f"{self.root}/{kind}")
        found = [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]
        return sorted(b for b in found if self._has(spark, kind, b))

    def _progress(self, spark: SparkSession, before: int) -> list:
        """(batch_id, newest, newest_kept) of the earlier batches that are remembered."""
        paths = [self._path("progress", b) for b in self._batches(spark, "progress") if b < before]
        if not paths:
            return []
        return spark.read.option("basePath", f"{self.root}/progress").parquet(*paths).collect()

    @property
    def _delay(self) -> int:
        return self.delay // timedelta(microseconds=1)

    def _floor(self, spark: SparkSession, batch_id: int) -> int | None:
        """The watermark of a batch in microseconds, from the batches before it; None for the first."""
        newest = [r["newest"] for r in self._progress(spark, batch_id) if r["newest"] is not None]
        return max(newest) - self._delay if newest else None

    def _incoming(self, batch: DataFrame, batch_id: int, floor: int | None) -> DataFrame:
        """The batch with an outcome for every post.

        A post's first arrival is kept.  Repeats in the batch are found by a row number, those of earlier
        batches by their remembered ids.  Rejected and late posts go through as keys of their own, so
        that the batch is read and parsed once.
        """
        spark = batch.sparkSession
        late = F.when(F.unix_micros("created_at") <= F.lit(floor).cast("bigint"), "late")
        rows = batch.select(*POST, F.coalesce("invalid_reason", late).alias("outcome"))
        # Where a post stands in the batch tells the order of arrival.
        rows = rows.withColumn("_at", F.monotonically_increasing_id())
        alone = F.concat(F.lit("-"), F.col("_at").cast("string"))
        keyed = rows.withColumn("_key", F.when(F.col("outcome").isNull(), F.concat(F.lit("+"), "tweet_id")).otherwise(alone))
        numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_at")))
        seen = self._seen(spark, batch_id, floor)
        if seen is not None:
            known = seen.select(F.concat(F.lit("+"), "tweet_id").alias("_key"), F.lit(True).alias("_seen"))
            numbered = numbered.join(known, "_key", "left")
        else:
            numbered = numbered.withColumn("_seen", F.lit(None).cast("boolean"))
        repeated = (F.col("_n") > 1) | F.coalesce("_seen", F.lit(False))
        judged = F.coalesce("outcome", F.when(repeated, "repeated").otherwise("kept"))
        return numbered.select(*POST, judged.alias("outcome"))

    def _seen(self, spark: SparkSession, batch_id: int, floor: int | None) -> DataFrame | None:
        """Ids whose repeats are still recognised: kept no longer than the delay behind the watermark."""
        paths = [self._path("ids", b) for b in self._batches(spark, "ids") if b < batch_id]
        if not paths or floor is None:
            return None
        ids = spark.read.parquet(*paths)
        return ids.where(F.unix_micros("created_at") > F.lit(floor - self._delay)).select("tweet_id").distinct()

    def _panes(self, kept: DataFrame) -> DataFrame:
        strong = F.when(F.col("author_weight") > 1, F.col("user_id"))
        panes = explode_symbols(kept).groupBy(F.window("created_at", interval(self.pane)).start.alias("pane"), "symbol")
        return panes.agg(
            F.count("*").alias("mention_count"),
            F.hll_sketch_agg("user_id", F.lit(SKETCH_POWER)).alias("authors"),
            F.hll_sketch_agg(strong, F.lit(SKETCH_POWER)).alias("influencers"),
            F.try_sum("engagement_score").alias("engagement_score"),
            F.sum("influence_score").alias("influence"),
            F.max("author_weight").alias("max_author_weight"),
            F.max("created_at").alias("last_seen"),
        )

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Drop what no later batch, nor this one if it is run again, can need."""
        progress = self._progress(spark, batch_id)
        floor = self._floor(spark, batch_id)
        newest = max((r["newest"] for r in progress if r["newest"] is not None), default=None)
        for old in self._batches(spark, "incoming"):
            if old < batch_id:
                storage.delete(spark, self._path("incoming", old))
        for row in progress:
            expired = row["newest_kept"] is None or (floor is not None and row["newest_kept"] <= floor - self._delay)
            if expired:
                storage.delete(spark, self._path("ids", row["batch_id"]))
                if row["newest"] != newest:
                    storage.delete(spark, self._path("progress", row["batch_id"]))
