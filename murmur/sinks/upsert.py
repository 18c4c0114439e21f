"""Keyed upsert of window metrics into partitioned Parquet, for ``foreachBatch``.

Layout below ``root``::

    log, data                           the metrics, one row per key, as a table of snapshots
    keyless/query=Q/batch_id=N          rows without a full key, appended
    work/query=Q/incoming/batch_id=N    the batch as it arrived
    work/query=Q/changed/batch_id=N     the rows that are new or get new spike fields
    work/query=Q/tail/batch_id=N        the windows later batches may still need

Q is the streaming query's id, so another query on the same root takes no part
of this one's batches.  Every step writes a folder named after the batch, and
reads only finished ones, and a snapshot tells the last batch of every query in it,
so a batch that is run again after a failure gives the same table.  The new content
of the touched partitions is written once, straight to its place among the data, and
seen by readers from one moment to the next; earlier batches can be read as well.  The batch itself is always evaluated, as its stateful operators must
commit whenever a batch is run.  A query without a tail starts from the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.functions.parse import utc
from murmur.operators.spikes import KEY, history_tail, refresh_spikes, stamp
from murmur.settings import TREND_WINDOW, WATERMARK_DELAY, SpikeRule
from murmur.sinks import storage
from murmur.sinks.snapshots import Snapshot, SnapshotTable, replace_partitions


@dataclass(frozen=True)
class TrendTable:
    """A table of trend windows with spike fields, kept up to date batch by batch.

    ``horizon`` is how far behind the newest window end a window may still
    change: watermark delay plus window length.  A batch rewrites the table
    partitions it touches, so minute windows are kept ``by_hour``; windows of an
    hour or more are few enough for one partition per day.  The last
    ``keep_versions`` snapshots stay readable (None: all).
    """

    root: str
    rule: SpikeRule = field(default_factory=SpikeRule)
    horizon: timedelta = WATERMARK_DELAY + TREND_WINDOW
    by_hour: bool = True
    keep_versions: int | None = 100

    @property
    def parts(self) -> list[str]:
        return ["window_date", "window_hour"] if self.by_hour else ["window_date"]

    @property
    def table(self) -> SnapshotTable:
        return SnapshotTable(self.root, tuple(self.parts))

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return self.table.read(spark, version)

    def read_batch(self, spark: SparkSession, batch_id: int, query: str = "none") -> DataFrame:
        """The table as it was after a batch of a query."""
        return self.table.read(spark, self.table.version_of(spark, query, batch_id))

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function."""
        spark = batch.sparkSession
        incoming = self._path(spark, "incoming", batch_id)
        batch.write.mode("overwrite").parquet(incoming)
        rows = spark.read.parquet(incoming)
        if rows.isEmpty():
            return
        keyless = rows.where(~has_key())
        if not keyless.isEmpty():
            append_batch(stamp(keyless), batch_id, f"{self.root}/keyless/query={query_id(spark)}")
        keyed = one_per_key(rows.where(has_key()))
        history = self._history(spark, keyed, batch_id)
        changed = self._path(spark, "changed", batch_id)
        if not storage.complete(spark, changed):
            stamp(refresh_spikes(keyed, history, self.rule)).write.mode("overwrite").parquet(changed)
        tail = self._path(spark, "tail", batch_id)
        if not storage.complete(spark, tail):
            untouched = history.join(keyed.select(*KEY), list(KEY), "left_anti")
            windows = keyed.unionByName(untouched.select(*keyed.columns))
            kept = history_tail(windows, self.horizon, self.rule)
            kept.write.mode("overwrite").parquet(tail)
        self._publish(spark, spark.read.parquet(changed), batch_id)
        self._forget(spark, batch_id)

    # -- steps --------------------------------------------------------------

    def _folder(self, spark: SparkSession, kind: str) -> str:
        return f"{self.root}/work/query={query_id(spark)}/{kind}"

    def _path(self, spark: SparkSession, kind: str, batch_id: int) -> str:
        return f"{self._folder(spark, kind)}/batch_id={batch_id}"

    def _finished(self, spark: SparkSession, kind: str) -> list[int]:
        names = storage.children(spark, self._folder(spark, kind))
        ids = [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]
        return sorted(i for i in ids if storage.complete(spark, self._path(spark, kind, i)))

    def _history(self, spark: SparkSession, rows: DataFrame, batch_id: int) -> DataFrame:
        """Stored windows that bear on ``rows``: the tail, or all if some rows are older."""
        earlier = [i for i in self._finished(spark, "tail") if i < batch_id]
        if not earlier:
            if self.table.snapshot(spark) is None:
                return rows.limit(0)
            return self.read(spark).select(*rows.columns)
        tail = spark.read.parquet(self._path(spark, "tail", earlier[-1]))
        floor = tail.agg(F.max("window_end")).scalar() - F.expr(
            f"INTERVAL '{self.horizon.total_seconds():.6f}' SECOND"
        )
        if rows.where(F.col("window_end") <= floor).isEmpty():
            return tail
        return self.read(spark).select(*rows.columns)

    def _publish(self, spark: SparkSession, changed: DataFrame, batch_id: int) -> None:
        """Make the snapshot with ``changed`` rows, on what others have published meanwhile too."""
        start = utc(F.col("window_start"))
        columns = {"window_date": F.to_date(start), "window_hour": F.hour(start)}
        placed = changed.withColumns({name: columns[name] for name in self.parts})
        query, table = query_id(spark), self.table
        while True:
            base = table.snapshot(spark)
            if base and base.done.get(query, -1) >= batch_id:
                return
            merged = self._merged(placed, base)
            if replace_partitions(spark, table, base, merged, query, batch_id):
                if self.keep_versions:
                    table.expire(spark, self.keep_versions)
                return

    def _merged(self, placed: DataFrame, base: Snapshot | None) -> DataFrame:
        """New content of every partition that holds a changed row."""
        if base is None:
            return placed
        # One row for each partition that the batch touches.
        touched = [SnapshotTable.folder_name(row, self.parts) for row in placed.select(*self.parts).distinct().collect()]
        old = self.table.read_parts(placed.sparkSession, base, touched)
        if old is None:
            return placed
        return placed.unionByName(old.join(placed.select(*KEY), list(KEY), "left_anti"))

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Drop work folders of batches that can no longer be run again."""
        for kind in ("incoming", "changed"):
            for old in self._finished(spark, kind):
                if old < batch_id:
                    storage.delete(spark, self._path(spark, kind, old))
        for old in self._finished(spark, "tail")[:-2]:
            storage.delete(spark, self._path(spark, "tail", old))


def query_id(spark: SparkSession) -> str:
    """The id of the streaming query that runs this batch; ``none`` outside of one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def has_key() -> Column:
    return (
        F.col("symbol").isNotNull()
        & F.col("window_start").isNotNull()
        & F.col("window_end").isNotNull()
    )


def one_per_key(keyed: DataFrame) -> DataFrame:
    """The most complete row of each key."""
    fullest = Window.partitionBy(*KEY).orderBy(F.desc("mention_count"), F.desc("last_seen"))
    return keyed.withColumn("_rn", F.row_number().over(fullest)).where("_rn = 1").drop("_rn")


def append_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Append a batch in its own folder, so that running it again replaces it."""
    batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
