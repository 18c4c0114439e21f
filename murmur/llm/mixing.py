"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue in a shuffled order, once per epoch.  A copy's virtual
finish time is the source's tokens up to and with it, divided by the source's target.
Copies are taken by finish time over all sources until the next would exceed the budget.
As every source meets its target at time 1, each gets its target but for about one
document.  DataFrame functions only.

Defined results: a null text has size 0; documents of size 0 are never taken, for they
add nothing.  A null source is a source of its own, the last.  Repeated rows are
documents of their own and, being alike, may stand for each other.  Repeated ids with
other texts are put in order by size and text.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.running import block_of, running_total
from murmur.llm.storage import stored

#: The order of the shuffle depends on the document id and this alone.
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget_share: float, epochs: int) -> DataFrame:
    """Per source: ``rank``, ``source_size`` and ``target``, from (source, source_size).

    A source is full at ``epochs`` times its size.  Shares rise together, in proportion
    to weight, until the budget is spent; a source stops when it is full.  It is full
    just if the budget lasts until its own level, ``full / weight``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    level = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("full", F.col("source_size") * epochs)
        .withColumn("level", F.col("full") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * budget_share)
    )
    spent = F.sum("full").over(level) + F.col("level") * (F.sum("weight").over(every) - F.sum("weight").over(level))
    marked = ranked.withColumn("is_full", spent <= F.col("budget"))
    left = F.col("budget") - F.sum(F.when(F.col("is_full"), F.col("full")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("is_full"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("is_full"), F.col("full")).otherwise(left / F.nullif(open_weight, F.lit(0)) * F.col("weight"))
    return marked.select("source", "rank", "source_size", target.cast("double").alias("target"))


def queues(rows: DataFrame, targets: DataFrame, block_rows: int, n_rows: int) -> DataFrame:
    """Rows (doc, key, source, size) with ``queued``: tokens of the source up to the row."""
    known = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    blocked = joined.withColumn("block", block_of(F.col("key"), max(1, -(-n_rows // block_rows))))
    return running_total(blocked, "rank", "block", ["key", "size", "tie"], "size", "queued")


def copies(queued: DataFrame, epochs: int) -> DataFrame:
    """One row per document and epoch, with its virtual ``finish`` time."""
    each = queued.where("size > 0 AND target > 0").withColumn(
        "epoch", F.explode(F.array(*(F.lit(e) for e in range(epochs))))
    )
    return each.withColumn("finish", (F.col("queued") + F.col("epoch") * F.col("source_size")) / F.col("target"))


def cut(taken_from: DataFrame, budget: float, bins: int) -> tuple[float, int]:
    """Finish time and rank of the last copy within the budget.

    Finish times are dealt to ``bins`` ranges a unit of time; the range in which the
    budget ends is found from the ranges' sums, and only its rows are put in order.
    """
    binned = taken_from.select("finish", "rank", "size", F.floor(F.col("finish") * bins).alias("bin"))
    ordered = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = binned.groupBy("bin").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(ordered))
    first = sums.where(F.col("upto") > budget).orderBy("bin").limit(1).collect()
    if not first:
        return float("inf"), 0
    before = first[0]["upto"] - first[0]["size"]
    exact = Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        binned.where(F.col("bin") == first[0]["bin"])
        .withColumn("upto", F.sum("size").over(exact) + before)
        .where(F.col("upto") <= budget)
        .agg(F.max(F.struct("finish", "rank")).alias("last"))
        .first()["last"]
    )
    # None: the first copy of this range is already too much, so all before the range is taken.
    return (last["finish"], last["rank"]) if last else (first[0]["bin"] / bins, -1)


def taken(finish: Column, rank: Column, last: tuple[float, int]) -> Column:
    return (finish < F.lit(last[0])) | ((finish == F.lit(last[0])) & (rank <= F.lit(last[1])))


class Mix:
    """A mix of ``docs``; ``copies()`` are its rows, ``plan()`` what it takes of each."""

    def __init__(
        self,
        docs: DataFrame,
        doc_id: str = "doc_id",
        source: str = "source",
        text: str = "text",
        weights: tuple[int, ...] = (3, 1, 2),
        budget_share: float = 1.5,
        epochs: int = 2,
        block_rows: int = 2000,
    ):
        self._docs, self._epochs, self._block_rows = docs, epochs, block_rows
        key = F.md5(F.concat_ws(":", F.lit(SEED), F.col(doc_id).cast("string")).cast("binary"))
        self._columns = {
            "key": key,
            "source": F.col(source),
            "size": word_count(text),
            "tie": F.xxhash64(F.col(text)),
        }
        slim = stored(docs.select(F.col(doc_id).alias("doc"), *(c.alias(n) for n, c in self._columns.items())), "mix-sizes")
        sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        sizes = stored(sizes, "mix-sources")
        self._rows, total = sizes.agg(F.sum("rows"), F.sum("source_size")).first()
        self._rows = self._rows or 0
        self._targets = stored(source_targets(sizes.drop("rows"), weights, budget_share, epochs), "mix-targets")
        self._queued = stored(queues(slim, self._targets, block_rows, self._rows), "mix-queues")
        bins = max(1, -(-self._rows // block_rows))
        self._last = cut(copies(self._queued, epochs), (total or 0) * budget_share, bins)

    def plan(self) -> DataFrame:
        """Per document: doc, size, source_size, target and ``taken``, its tokens in the mix."""
        times = [
            (F.col("queued") + e * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0)) for e in range(self._epochs)
        ]
        often = sum((F.when(taken(t, F.col("rank"), self._last), 1).otherwise(0) for t in times), F.lit(0))
        return self._queued.select(
            "doc", "size", "source_size", "target", (F.col("size") * often).cast("bigint").alias("taken")
        )

    def copies(self) -> DataFrame:
        """The taken documents with all their columns, a row per copy."""
        rows = self._docs.select(F.struct("*").alias("doc"), *(c.alias(n) for n, c in self._columns.items()))
        queued = queues(rows, self._targets, self._block_rows, self._rows)
        chosen = copies(queued, self._epochs).where(taken(F.col("finish"), F.col("rank"), self._last))
        return chosen.select("doc.*")
