"""The latest post of every id in a stream, as a log of changes.

A stream cannot take back a row, but it can say that a row no longer holds: each change is a row with
``change`` +1 or -1.  Signed sums over the log are sums over the latest posts, and the posts
themselves are the newest added ones of each id.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from murmur.operators.dedupe import dedupe_latest
from murmur.settings import interval

_STATE = "held binary"
_CHANGE = "change int, body string"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_BEFORE_ALL = -(1 << 63)
_COLUMNS = ["id", "time_us", "arrival", "body"]
_TABLE = pa.schema([("id", pa.string()), ("time_us", pa.int64()), ("arrival", pa.int64()), ("body", pa.string())])
#: Ids are dealt to so many buckets; a bucket's latest posts are one row of state.
BUCKETS = 2_048


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """The first row of each id by (time descending, arrival)."""
    ordered = rows.sort_values(["time_us", "arrival"], ascending=[False, True], kind="stable")
    return ordered.drop_duplicates("id")


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as a compressed Arrow file."""
    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows[_COLUMNS], _TABLE, preserve_index=False)
    with pa.ipc.new_file(out, _TABLE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_file(held).read_all().to_pandas()


def latest_changes(
    posts: DataFrame,
    key: str = "tweet_id",
    time: str = "created_at",
    arrival: str = "arrival",
    horizon: timedelta | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The posts' columns and ``change``: +1 for a row that is the latest of its id from now on, -1 for one that was.

    The order is that of ``dedupe_latest``: the newest time, then the first arrival (a whole number), so
    the outcome does not depend on how the posts fall into batches.

    State is the latest post of every id, compressed, in one row for each of the ``buckets`` that ids are
    dealt to by hash: a batch calls the merge once a bucket, not once an id.  A batch rewrites the
    rows of the buckets it touches, so a bucket should hold no more than some ten thousand ids; the number
    is part of a query's checkpoint.  With a ``horizon``, posts behind the watermark of the batch before are dropped, and an id is forgotten once
    the watermark has passed its post: a later post of it is added, with none taken back.  Without, ids
    are kept for good.  Before the shuffle every Arrow batch is
    cut down to one row per id, so an id that holds a third of the posts does not meet in one task.
    """
    fields = posts.schema
    moment = F.coalesce(F.unix_micros(time), F.lit(_BEFORE_ALL))
    body = F.to_json(F.struct(*posts.columns), _JSON)
    columns = [F.col(key).cast("string").alias("id"), moment.alias("time_us"), F.col(arrival).cast("bigint").alias("arrival"), body.alias("body")]
    keep = horizon is not None
    timeout = GroupStateTimeout.EventTimeTimeout if keep else GroupStateTimeout.NoTimeout

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _newest(part)

    def follow(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # None of a timed-out state's parts has rows.
        came = pd.concat([part[_COLUMNS] for part in parts if len(part)] or [pd.DataFrame(columns=_COLUMNS)])
        held = _unpacked(state.get[0]) if state.exists else None
        before = 0 if held is None else len(held)
        # Of equal rows the one that is held stays, as it is the first.
        rows = came if held is None else held if came.empty else pd.concat([held, came])
        rows = rows.assign(new=[False] * before + [True] * (len(rows) - before))
        best = _newest(rows)
        added = best[best["new"]]
        left = best
        if keep:
            now = state.getCurrentWatermarkMs()
            lapsed = (best["time_us"] // 1000 + 1 < now) & ~best["id"].isin(came["id"])
            left = best[~lapsed]
        if left.empty:
            state.remove()
        else:
            if len(added) or len(left) != before:
                state.update((_packed(left),))
            if keep:
                state.setTimeoutTimestamp(max(int(left["time_us"].min()) // 1000, now) + 1)
        if len(added):
            gone = held[held["id"].isin(added["id"])] if before else added[:0]
            out = pd.DataFrame({"change": [-1] * len(gone) + [1] * len(added), "body": [*gone["body"], *added["body"]]})
            yield out.astype({"change": "int32"})

    rows = posts.select(F.col(time).alias("at"), *columns)
    schema = "at timestamp, id string, time_us bigint, arrival bigint, body string"
    rows = rows.mapInPandas(cut, schema)
    if keep:
        # After the cut, which would lose the watermark.
        rows = rows.withWatermark("at", interval(horizon))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    changes = dealt.groupBy("bucket").applyInPandasWithState(follow, _CHANGE, _STATE, "append", timeout)
    parsed = changes.select("change", F.from_json("body", fields, _JSON).alias("post"))
    return parsed.select("post.*", "change")


def latest_posts(
    changes: DataFrame, key: str = "tweet_id", time: str = "created_at", arrival: str = "arrival"
) -> DataFrame:
    """The posts that hold after all changes."""
    return dedupe_latest(changes.where("change = 1").drop("change"), key, time, arrival)
