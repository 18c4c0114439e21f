"""Kafka as source and sink.  Needs the public spark-sql-kafka package at run time."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.text import preview
from murmur.settings import MARKET_TOPIC, WHALE_TOPIC


# The client's option names.
STORES = {
    "truststore": {"certificates": "ca_file"},
    "keystore": {"certificate.chain": "cert_file", "key": "key_file"},
}


def connection_options(
    servers: str,
    protocol: str | None = None,
    ca_file: str | None = None,
    cert_file: str | None = None,
    key_file: str | None = None,
) -> dict[str, str]:
    """Broker and TLS options from PEM files.

    A store is set only if all files that it is made of are given and hold something.
    """
    pem_files = {"ca_file": ca_file, "cert_file": cert_file, "key_file": key_file}
    held = {name: Path(path).read_text(encoding="utf-8") for name, path in pem_files.items() if path}
    options = {"kafka.bootstrap.servers": servers, "kafka.security.protocol": protocol}
    for store, entries in STORES.items():
        if all(held.get(name) for name in entries.values()):
            filled = {entry: held[name] for entry, name in entries.items()}
            options |= {f"kafka.ssl.{store}.{entry}": value for entry, value in (filled | {"type": "PEM"}).items()}
    return {name: value for name, value in options.items() if value}


def source_options(
    connection: dict[str, str],
    topics: str = f"{MARKET_TOPIC},{WHALE_TOPIC}",
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of a subscription to one or more topics."""
    if starting_offsets not in ("latest", "earliest"):
        raise ValueError("starting_offsets must be latest or earliest")
    options = {**connection, "subscribe": topics, "startingOffsets": starting_offsets}
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def stream_topics(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load()


def read_topics(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Bounded read of the topics from their beginning."""
    return spark.read.format("kafka").options(**{**options, "startingOffsets": "earliest"}).load()


def message_preview(messages: DataFrame, width: int = 80) -> DataFrame:
    """Author and the first characters of each JSON message."""
    record = F.from_json(F.col("value").cast("string"), "author string, text string")
    return messages.select(record.alias("r")).select(
        F.coalesce("r.author", F.lit("unknown")).alias("author"),
        preview(F.col("r.text"), width).alias("text"),
    )


def to_messages(df: DataFrame, key: Column | str) -> DataFrame:
    """Rows as keyed JSON messages.  All columns go into the value."""
    key_col = F.col(key) if isinstance(key, str) else key
    return df.select(
        key_col.cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")
    )


def write_topic(messages: DataFrame, topic: str, connection: dict[str, str]) -> None:
    messages.write.format("kafka").options(**connection).option("topic", topic).save()


def start_topic_writer(
    messages: DataFrame, topic: str, connection: dict[str, str], checkpoint: str
):
    return (
        messages.writeStream.format("kafka")
        .options(**connection)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )
