"""Web API payloads that were landed as JSON text, one response per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.schemas import COLLECTOR_RECORD
from murmur.settings import WHALE_SIGNAL

# Where the API puts its items, and the item fields in use.
_LISTS = ("data", "results", "timeline")
_ITEM = (
    "id_str string, id string, full_text string, text string, "
    "created_at string, timestamp string, user_id_str string"
)
_ENVELOPE = ", ".join(f"{name} string" for name in _LISTS)
_EMPTY = r"^\s*(\[\s*\]|\{\s*\}|null|false|0)?\s*$"


def _filled(col: Column) -> Column:
    """The JSON text of a value, or NULL if the value is empty.

    The pattern gives up at the first character of a filled list.
    """
    return F.when(~col.rlike(_EMPTY), col)


def _or(first: str, second: str) -> Column:
    return F.coalesce(
        F.nullif(F.col(f"item.{first}"), F.lit("")), F.nullif(F.col(f"item.{second}"), F.lit(""))
    )


def payload_items(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per item of the first non-empty list of each payload.

    A payload whose first non-empty member is not a list gives no rows.  Items are
    read one by one, so an item that is no object costs only itself.
    """
    envelope = F.from_json(F.col(payload), _ENVELOPE)
    kept = [c for c in payloads.columns if c != payload]
    chosen = payloads.select(*kept, envelope.alias("e")).select(
        *kept, F.coalesce(*[_filled(F.col(f"e.{n}")) for n in _LISTS]).alias("items")
    )
    lists = chosen.where(F.ltrim("items").startswith("["))
    each = lists.select(*kept, F.explode(F.from_json("items", "array<string>")).alias("body"))
    objects = each.where(F.ltrim("body").startswith("{"))
    return objects.select(*kept, F.from_json("body", _ITEM).alias("item"))


def market_records(payloads: DataFrame, payload: str = "payload", coin: str = "coin") -> DataFrame:
    """Records of a keyword search: the author is an id, the coin is the keyword."""
    user = F.nullif(F.col("item.user_id_str"), F.lit(""))
    author = F.coalesce(F.concat(F.lit("ID_"), user), F.lit("unknown"))
    return _records(payload_items(payloads, payload), author, F.col(coin))


def whale_records(payloads: DataFrame, payload: str = "payload", name: str = "name") -> DataFrame:
    """Records of an account's own posts: the author is the account."""
    return _records(payload_items(payloads, payload), F.col(name), F.lit(WHALE_SIGNAL))


def _records(items: DataFrame, author: Column, target: Column) -> DataFrame:
    records = items.select(
        _or("id_str", "id").alias("id"),
        _or("full_text", "text").alias("text"),
        _or("created_at", "timestamp").alias("created_at"),
        author.alias("author"),
        target.alias("target_coin"),
    )
    return records.where(F.col("text").isNotNull()).select(*COLLECTOR_RECORD.names)
