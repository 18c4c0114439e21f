"""Symbols that are mentioned together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def symbol_pairs(posts: DataFrame, symbols: str = "cashtags", block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b for every two symbols of a post.

    A post's symbols are cut into blocks, and every two blocks are a row of their own before they
    become pairs, spread over the cluster: a post with thousands of symbols is not one task's work.
    """
    clean = F.array_sort(F.array_distinct(F.filter(symbols, lambda s: s.isNotNull() & (s != ""))))
    # Also safe on the short lists that the filter drops: the optimizer may look at them first.
    last = F.greatest(F.floor((F.size("s") - 1) / block).cast("int"), F.lit(0))
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.slice("s", i * block + 1, block),
    )
    blocks = posts.select(clean.alias("s")).where(F.size("s") > 1).select(cut.alias("blocks"))
    first = blocks.select("blocks", F.posexplode("blocks").alias("i", "low"))
    rest = F.expr("slice(blocks, i + 1, size(blocks) - i)")
    both = first.select("low", F.explode(rest).alias("high"))
    spread = both.where(F.size("low") < block).union(
        both.where(F.size("low") == block).repartition(F.xxhash64("low", "high"))
    )
    pairs = spread.select("high", F.explode("low").alias("a")).select("a", F.explode("high").alias("b"))
    return pairs.where("a < b")


def related_symbols(
    posts: DataFrame, top: int = 5, min_posts: int = 2, symbols: str = "cashtags", block: int = BLOCK
) -> DataFrame:
    """(symbol, related, posts_together, lift, rank): the ``top`` symbols by lift for each symbol.

    lift = n_ab * n / (n_a * n_b) with n posts that mention a symbol, rounded to six digits; ties go
    to the pair in more posts, then by name.  Pairs are counted in their tasks before they are
    shuffled, so a symbol in a third of all posts costs a row per partner and task; what remains of
    its skew is split by adaptive execution.  Each symbol keeps ``top`` rows per task before the
    last shuffle.
    """
    clean = F.array_distinct(F.filter(symbols, lambda s: s.isNotNull() & (s != "")))
    listed = posts.select(clean.alias("s")).where(F.size("s") > 0)
    total = listed.agg(F.count("*").alias("n"))  # one row
    single = listed.select(F.explode("s").alias("symbol")).groupBy("symbol").agg(F.count("*").alias("posts"))
    counted = symbol_pairs(posts, symbols, block).groupBy("a", "b").agg(F.count("*").alias("posts_together"))
    counted = counted.where(F.col("posts_together") >= min_posts)
    scored = (
        counted.join(single.select(F.col("symbol").alias("a"), F.col("posts").alias("n_a")), "a")
        .join(single.select(F.col("symbol").alias("b"), F.col("posts").alias("n_b")), "b")
        .crossJoin(F.broadcast(total))
    )
    # Each factor as a double first: the product of counts may pass 64 bits.
    lift = F.round(F.col("posts_together") * F.col("n").cast("double") / (F.col("n_a").cast("double") * F.col("n_b")), 6)
    scored = scored.select("a", "b", "posts_together", lift.alias("lift"))
    # Both directions come from one row, so pairs are counted and joined once.
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("symbol"), F.col("b").alias("related")),
        F.struct(F.col("b").alias("symbol"), F.col("a").alias("related")),
    ))
    both = scored.select(sides.alias("x"), "posts_together", "lift").select("x.*", "posts_together", "lift")
    order = Window.partitionBy("symbol").orderBy(F.desc("lift"), F.desc("posts_together"), "related")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def with_related_coins(spikes: DataFrame, related: DataFrame, symbol: str = "keyword") -> DataFrame:
    """Spikes with ``related_coins``: the related symbols of each, best first; an empty list without any."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "related")))
    lists = related.groupBy(F.col("symbol").alias(symbol)).agg(F.transform(ranked, lambda x: x["related"]).alias("related_coins"))
    joined = spikes.join(lists, symbol, "left")
    return joined.withColumn("related_coins", F.coalesce("related_coins", F.array().cast("array<string>")))
