"""Exploration queries over the hashtag-hour table.

Input columns: hashtag, count, sentiment, timestamp, lat, lon.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import scores
from murmur.operators.ranking import global_rank

EMPTY_MARK = "—"


def _exact_sum(col: str) -> Column:
    """A sum that does not depend on the order in which partitions are added."""
    return F.sum(F.col(col).cast("decimal(18,9)"))


def _ratio(total: str, rows: str) -> Column:
    return F.col(total).cast("double") / F.nullif(F.col(rows), F.lit(0))


# --- filters ---------------------------------------------------------------


def filter_tags(df: DataFrame, tags: list[str] | DataFrame | None) -> DataFrame:
    """Rows whose hashtag is selected; no selection keeps all.

    A DataFrame of tags is a semi join, for selections too large for a list.
    """
    if isinstance(tags, DataFrame):
        return df.join(tags.select("hashtag"), "hashtag", "left_semi")
    return df.where(F.col("hashtag").isin(*tags)) if tags else df


def filter_days(df: DataFrame, first: date | None, last: date | None) -> DataFrame:
    """Inclusive day range, as bare comparisons so that it reaches the scan."""
    if first is None or last is None:
        return df
    kind = df.schema["timestamp"].dataType
    bound = lambda day: F.lit(datetime.combine(day, time()).isoformat(" ")).cast(kind)
    ts = F.col("timestamp")
    return df.where((ts >= bound(first)) & (ts < bound(last + timedelta(days=1))))


def filter_sign(df: DataFrame, sign: str = "all") -> DataFrame:
    if sign == "all":
        return df
    if sign not in ("positive", "negative"):
        raise ValueError("sign must be all, positive or negative")
    score = F.col("sentiment")
    return df.where(score >= 0 if sign == "positive" else score < 0)


def apply_filters(
    df: DataFrame,
    tags: list[str] | DataFrame | None = None,
    days: tuple[date, date] | None = None,
    sign: str = "all",
) -> DataFrame:
    first, last = days if days and len(days) == 2 else (None, None)
    return filter_sign(filter_days(filter_tags(df, tags), first, last), sign)


def search_tags(df: DataFrame, query: str, regex: bool = True) -> DataFrame:
    """Hashtags that contain ``query`` in any case; a blank query keeps all.

    By default the query is a regular expression; ``regex=False`` takes it literally.
    """
    wanted = query.strip().lower()
    if not wanted:
        return df
    lowered = F.lower("hashtag")
    return df.where(lowered.rlike(wanted) if regex else lowered.contains(wanted))


def located(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["lat", "lon"])


# --- aggregates ------------------------------------------------------------


def tag_totals(df: DataFrame) -> DataFrame:
    """Total volume and mean sentiment per hashtag."""
    grouped = df.where(F.col("hashtag").isNotNull()).groupBy("hashtag")
    return grouped.agg(
        F.sum("count").alias("total_count"),
        _exact_sum("sentiment").alias("_sum"),
        F.count("sentiment").alias("_rows"),
    ).select("hashtag", "total_count", _ratio("_sum", "_rows").alias("avg_sentiment"))


def kpi_row(df: DataFrame) -> DataFrame:
    """Total volume, number of hashtags, mean sentiment and the top hashtag.

    Works on per-tag sums, so the distinct count is a row count.  The smallest
    tag wins a tie.
    """
    per_tag = df.groupBy("hashtag").agg(
        F.sum("count").alias("_total"),
        _exact_sum("sentiment").alias("_sum"),
        F.count("sentiment").alias("_rows"),
    )
    contender = F.when(
        F.col("hashtag").isNotNull(), F.struct((-F.col("_total")).alias("order"), "hashtag")
    )
    totals = per_tag.agg(
        F.sum("_total").alias("_total"),
        F.count("hashtag").alias("num_trends"),
        F.sum("_sum").alias("_sum"),
        F.sum("_rows").alias("_rows"),
        F.min(contender).alias("_top"),
    )
    return totals.select(
        F.coalesce("_total", F.lit(0)).alias("total_tweets"),
        "num_trends",
        F.coalesce(_ratio("_sum", "_rows"), F.lit(0.0)).alias("avg_sentiment"),
        F.coalesce("_top.hashtag", F.lit(EMPTY_MARK)).alias("top_hashtag"),
    )


def tag_list(df: DataFrame) -> DataFrame:
    return df.select("hashtag").where("hashtag IS NOT NULL").distinct().orderBy("hashtag")


def default_tags(df: DataFrame, n: int = 10) -> DataFrame:
    return tag_list(df).limit(n)


def day_bounds(df: DataFrame) -> DataFrame:
    return df.agg(
        F.to_date(F.min("timestamp")).alias("first_day"),
        F.to_date(F.max("timestamp")).alias("last_day"),
    )


def sentiment_histogram(
    df: DataFrame, bins: int = 50, low: float = -1.0, high: float = 1.0
) -> DataFrame:
    """Rows per equal-width bin; scores outside the range belong to the first and last bin."""
    score = F.col("sentiment")
    raw = F.floor((score - low) * bins / (high - low))
    bin_no = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    return (
        df.where(score.isNotNull())
        .groupBy(bin_no.alias("bin"))
        .agg(F.count("*").alias("rows"))
    )


def geo_grid(df: DataFrame, cell: float = 5.0) -> DataFrame:
    """Volume per grid cell of ``cell`` degrees."""
    return (
        located(df)
        .groupBy(
            F.floor(F.col("lat") / cell).alias("lat_cell"),
            F.floor(F.col("lon") / cell).alias("lon_cell"),
        )
        .agg(F.sum("count").alias("weight"))
    )


def geo_density(df: DataFrame, cell: float = 5.0, radius: int = 2) -> DataFrame:
    """The grid smoothed with a kernel that falls evenly to nothing beyond ``radius`` cells.

    The kernel is a product of one for each axis, so two passes of 2 * radius + 1 neighbours do
    instead of their square.  Copies are summed in their tasks, and there are no more cells than the
    globe has.  Longitudes go round; what lies beyond a pole is lost, as it is outside of the map.
    """
    around, top = round(360 / cell), round(90 / cell)
    falling = F.lit(radius + 1) - F.abs(F.col("d"))

    def spread(grid: DataFrame, axis: str, moved: Column, other: str) -> DataFrame:
        steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d")
        copies = grid.select(axis, other, "weight", steps)
        copies = copies.select(moved.alias(axis), other, (F.col("weight") * falling).alias("weight"))
        return copies.groupBy("lat_cell", "lon_cell").agg(F.sum("weight").alias("weight"))

    half = F.lit(around // 2).cast("bigint")
    east = F.pmod(F.col("lon_cell") + F.col("d") + half, F.lit(around).cast("bigint")) - half
    wide = spread(geo_grid(df, cell), "lon_cell", east, "lat_cell")
    high = spread(wide, "lat_cell", F.col("lat_cell") + F.col("d"), "lon_cell")
    return high.where(F.col("lat_cell").between(-top, top - 1)).withColumnRenamed("weight", "density")


# --- ranks, top-k, pages ---------------------------------------------------


def ranked_table(df: DataFrame) -> DataFrame:
    """Per-tag totals with their rank by volume (equal volumes: tag order)."""
    return global_rank(tag_totals(df), [F.desc("total_count"), F.asc("hashtag")])


def sentiment_labels(table: DataFrame) -> DataFrame:
    """Class, sign and bar position of each tag's mean sentiment."""
    mean = F.col("avg_sentiment")
    return table.withColumns(
        {
            "sentiment_class": scores.sentiment_class(mean),
            "sentiment_sign": scores.sentiment_sign(mean),
            "bar_percent": scores.bar_percent(mean),
        }
    )


def page(table: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 1) of a ranked table, by rank.

    Rows are found by their position, so a deep page costs no more than the first:
    an offset would bring all rows before it to the driver.
    """
    if number < 1:
        raise ValueError("pages are numbered from 1")
    placed = global_rank(table, [F.asc("rank")], "_position")
    first = (number - 1) * size + 1
    wanted = placed.where(F.col("_position").between(first, first + size - 1))
    return wanted.drop("_position").orderBy("rank")


def page_count(table: DataFrame, size: int = 10) -> DataFrame:
    pages = F.ceil(F.count("*") / size)
    return table.agg(F.greatest(F.lit(1).cast("bigint"), pages).alias("pages"))


def top_tags(df: DataFrame, n: int = 15) -> DataFrame:
    totals = df.where(F.col("hashtag").isNotNull()).groupBy("hashtag")
    return (
        totals.agg(F.sum("count").alias("total_count"))
        .orderBy(F.desc("total_count"), "hashtag")
        .limit(n)
    )


def tag_sentiment(df: DataFrame) -> DataFrame:
    return tag_totals(df).select("hashtag", "avg_sentiment")


def top_by_sentiment(df: DataFrame, n: int = 15) -> DataFrame:
    return tag_sentiment(df).orderBy(F.desc("avg_sentiment"), "hashtag").limit(n)


def top_series(df: DataFrame, n: int = 8) -> DataFrame:
    """Volume per time and hashtag, for the ``n`` busiest hashtags.

    The busiest tags are found on the per-time sums, so the table is read once.
    They are unique, so an inner join selects; a semi join would be moved below
    the sums and read the table again.  That side has ``n`` rows by its limit.
    """
    series = df.groupBy("timestamp", "hashtag").agg(F.sum("count").alias("count"))
    busiest = top_tags(series, n).select("hashtag")
    return series.join(F.broadcast(busiest), "hashtag").select("timestamp", "hashtag", "count")


def change_24h(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Volume of the last 24 hours against the 24 before, in percent per tag.

    ``as_of`` defaults to the newest timestamp; the span is (as_of - 24 h, as_of].
    No earlier volume gives NULL.
    """
    now = df.agg(F.max("timestamp")).scalar() if as_of is None else as_of
    day = F.expr("INTERVAL '24' HOUR")
    ts, volume = F.col("timestamp"), F.col("count")
    recent = (ts > now - day) & (ts <= now)
    earlier = (ts > now - day - day) & (ts <= now - day)
    sums = (
        df.where((ts > now - day - day) & (ts <= now) & F.col("hashtag").isNotNull())
        .groupBy("hashtag")
        .agg(
            F.coalesce(F.sum(F.when(recent, volume)), F.lit(0)).alias("last_24h"),
            F.coalesce(F.sum(F.when(earlier, volume)), F.lit(0)).alias("previous_24h"),
        )
    )
    growth = (F.col("last_24h") / F.nullif(F.col("previous_24h"), F.lit(0)) - 1) * 100
    return sums.withColumn("change_24h", growth)


def latest_per_key(df: DataFrame, key: str, time: str, n: int = 1, tie: str | None = None) -> DataFrame:
    """The ``n`` newest rows per key, cut per map partition before the shuffle."""
    order = [F.col(time).desc()] + ([F.col(tie).asc()] if tie else [])
    newest = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")
