"""Starting and running streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from murmur.sinks.upsert import TrendTable, append_batch
from murmur.streaming.one_pass import OnePass
from murmur.streaming.pipeline import normalized_stream, stream_outputs

# The console queries' trigger and row counts.
TOTALS_TRIGGER = "3 seconds"
CONSOLE_ROWS = 20
TOTALS_ROWS = 30


def _started(writer, checkpoint: str, name: str, trigger: dict | None) -> StreamingQuery:
    writer = writer.queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def start_console(
    df: DataFrame,
    checkpoint: str,
    name: str,
    mode: str = "update",
    rows: int = CONSOLE_ROWS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Print every batch in full width."""
    writer = (
        df.writeStream.outputMode(mode)
        .format("console")
        .option("truncate", False)
        .option("numRows", rows)
    )
    return _started(writer, checkpoint, name, trigger)


def start_totals_console(df: DataFrame, checkpoint: str, name: str = "running_totals") -> StreamingQuery:
    """Print the whole running table every three seconds."""
    return start_console(
        df, checkpoint, name, "complete", TOTALS_ROWS, {"processingTime": TOTALS_TRIGGER}
    )


def start_foreach(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str,
    mode: str = "update",
    trigger: dict | None = None,
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(write)
    return _started(writer, checkpoint, name, trigger)


def start_trend_upsert(
    trends: DataFrame,
    table: TrendTable,
    checkpoint: str,
    name: str = "trend_metrics",
    mode: str = "update",
    trigger: dict | None = None,
) -> StreamingQuery:
    return start_foreach(trends, table.write_batch, checkpoint, name, mode, trigger)


def start_append(
    df: DataFrame,
    root: str,
    checkpoint: str,
    name: str,
    mode: str = "update",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append each batch's rows below ``root``; a repeated batch replaces itself."""
    return start_foreach(
        df, lambda batch, batch_id: append_batch(batch, batch_id, root), checkpoint, name, mode, trigger
    )


def start_one_pass(
    messages: DataFrame, sinks: OnePass, checkpoint: str, name: str = "one_pass", trigger: dict | None = None
) -> StreamingQuery:
    """All outputs from one query that reads and parses every message once."""
    return start_foreach(normalized_stream(messages), sinks.write_batch, checkpoint, name, "append", trigger)


def start_jobs(
    messages: DataFrame,
    checkpoint_root: str,
    output_root: str | None = None,
    trigger: dict | None = None,
) -> list[StreamingQuery]:
    """Both outputs as concurrent queries, each with its own checkpoint.

    Without ``output_root`` they print to the console; with it, trends are
    upserted and rejected-record counts appended there.
    """
    trends, bad = stream_outputs(messages)
    trend_state, bad_state = (f"{checkpoint_root}/{n}" for n in ("trend_metrics", "bad_records"))
    if output_root is None:
        return [
            start_console(trends, trend_state, "trend_metrics", trigger=trigger),
            start_console(bad, bad_state, "bad_records", trigger=trigger),
        ]
    return [
        start_trend_upsert(
            trends, TrendTable(f"{output_root}/trends"), trend_state, trigger=trigger
        ),
        start_append(bad, f"{output_root}/bad_records", bad_state, "bad_records", trigger=trigger),
    ]


def run_until_any_stops(spark: SparkSession) -> None:
    spark.streams.awaitAnyTermination()


def run_available(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query to finish its input."""
    query.awaitTermination()
