"""WARC archives and their globally ordered index.

Pages are written as WARC records, one gzip member a record, by the tasks that hold
them.  Reading an archive back gives its capture run, sorted by URL key and time.  The
runs are dealt to key ranges, and each range merges its pieces of runs with a loser
tree, so the output is ordered over all partitions.

Defined results: a null payload is an empty one, a null URL has the key ``""``, and a
null time sorts first.  Repeated rows are records of their own.  Of equal payloads the
record(s) with the largest key are responses; records without a key never are, unless
no record of that payload has one.  An empty table gives no archive and an empty index.
Other columns are not read, whatever their names.  A payload of any length is one record,
and is held whole by the task that writes or checks it.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.storage import filesystem, stored
from murmur.session import scratch_path

MANIFEST_SCHEMA = "file string, records bigint, payload_bytes bigint"
INDEX_SCHEMA = (
    "url_key string, captured_at bigint, record_key string, payload_bytes bigint,"
    " payload_digest string, record_type string, refers_to string,"
    " file string, offset bigint, length bigint"
)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:capture:"
_EPOCH = dt.datetime(1970, 1, 1)


def url_key(url: str | None) -> str:
    """A sort key with the host's labels reversed: ``com,example)/path?query``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    place = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{place}){(parts.path or '/').lower()}{query.lower()}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(
    key: str, url: str | None, captured_at: int | None, payload: bytes, record_type: str, refers_to: str | None
) -> bytes:
    """One record; a revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_URN}{key}>"]
    if captured_at is not None:
        head.append(f"WARC-Date: {_date(captured_at)}")
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if record_type == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _date(seconds: int) -> str:
    return (_EPOCH + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _seconds(date: str) -> int:
    return int((dt.datetime.strptime(date, "%Y-%m-%dT%H:%M:%SZ") - _EPOCH).total_seconds())


def with_record_types(
    pages: DataFrame, key: str, url: str, payload: str, captured_at: str | None, revisit_bytes: int
) -> DataFrame:
    """(key, url, time, payload, type, refers_to) per page, decided by equal payloads.

    Only digests are grouped.  Payloads met once need no class, so the class table is
    small; it is stored first, which lets the join split a payload with very many pages.
    """
    time = F.col(captured_at).cast("bigint") if captured_at else F.lit(None).cast("bigint")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), time.alias("time"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    classes = stored(
        rows.where(F.octet_length("payload") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.max("key").alias("last"), F.count("*").alias("copies"))
        .where("copies > 1 AND last IS NOT NULL")
        .select("digest", "last"),
        "warc-classes",
    )
    joined = rows.join(classes, "digest", "left")
    revisits = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return joined.select(
        F.col("key").cast("string").alias("key"),
        "url",
        "time",
        "payload",
        F.when(revisits, "revisit").otherwise("response").alias("type"),
        F.when(revisits, F.col("last").cast("string")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    captured_at: str | None = None,
    revisit_bytes: int = 0,
    file_bytes: int = 32 << 20,
) -> DataFrame:
    """Write one record a page below ``folder``; return the list of files.

    ``captured_at`` names a column of seconds since 1970.  A file is closed after
    ``file_bytes`` of records, heads included, so pages without a payload close files, too.  File names hold the task attempt, so a repeated task
    writes files of its own; the list, stored by Spark, names those that count.
    """
    records = with_record_types(pages, key, url, payload, captured_at, revisit_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = filesystem(folder)
        system.create_dir(place, recursive=True)
        task = TaskContext.get()
        names, counts, sizes, out, filled = [], [], [], None, 0
        for batch in batches:
            for row in range(batch.num_rows):
                name, link, at, body, kind, refers = (batch.column(c)[row].as_py() for c in range(6))
                if out is None or filled >= file_bytes:
                    if out is not None:
                        out.close()
                    filled = 0
                    names.append(f"captures-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz")
                    counts.append(0)
                    sizes.append(0)
                    out = system.open_output_stream(f"{place}/{names[-1]}", compression=None)
                record = record_bytes(name or "", link, at, body, kind, refers)
                out.write(gzip.compress(record, 4, mtime=0))
                filled += len(record)
                counts[-1] += 1
                sizes[-1] += len(body)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            ["file", "records", "payload_bytes"],
        )

    return stored(records.mapInArrow(write, MANIFEST_SCHEMA), "warc-files")


def members(stream, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member, reading ``chunk`` bytes at a time."""
    start, rest = 0, b""
    while True:
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if used:
                    raise ValueError(f"the member at {start} is cut off")
                return
            parts.append(inflate.decompress(data))
            used += len(data)
        rest = inflate.unused_data
        length = used - len(rest)
        yield start, length, b"".join(parts)
        start += length


def parse_record(data: bytes) -> dict:
    """A record's fields; the payload is checked against its digest."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    name = lambda x: x and x.strip("<>").removeprefix(_URN)
    return {
        "url_key": url_key(fields.get("WARC-Target-URI")),
        "captured_at": _seconds(fields["WARC-Date"]) if "WARC-Date" in fields else None,
        "record_key": name(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": name(fields.get("WARC-Refers-To")),
        "payload": payload,
    }


def read_runs(files: DataFrame, folder: str) -> DataFrame:
    """The archives' records without payloads: one sorted run a file."""
    names = [field.split()[0] for field in INDEX_SCHEMA.split(",")]
    kinds = [pa.int64() if n in ("captured_at", "payload_bytes", "offset", "length") else pa.string() for n in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = filesystem(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                run = []
                with system.open_input_stream(f"{place}/{file}", compression=None) as stream:
                    for offset, length, data in members(stream):
                        record = parse_record(data)
                        del record["payload"]  # checked, and too large to hold for a whole run
                        run.append(record | {"file": file, "offset": offset, "length": length})
                run.sort(key=lambda r: _order(r["url_key"], r["captured_at"], r["file"], r["offset"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in run], k) for n, k in zip(names, kinds)], names)

    spread = files.select("file").repartition(max(1, min(files.count(), 100_000)))
    return spread.mapInArrow(read, INDEX_SCHEMA)


def _order(key: str, time: int | None, file: str, offset: int) -> tuple:
    return (key, time is not None, time or 0, file, offset)


class LoserTree:
    """Merge sorted cursors; each step replays one path of the tournament.

    Inner node ``n`` keeps the loser of its match, node 0 the overall winner.
    """

    def __init__(self, keys: list[list[tuple]]):
        self._keys = keys
        self._next = [0] * len(keys)
        size = max(1, len(keys))
        self._nodes = [-1] * size
        for cursor in range(len(keys)):
            self._play(cursor, filling=True)

    def _head(self, cursor: int) -> tuple | None:
        at = self._next[cursor]
        return self._keys[cursor][at] if at < len(self._keys[cursor]) else None

    def _wins(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, cursor: int, filling: bool = False) -> None:
        node = (cursor + len(self._keys)) // 2
        while node:
            rival = self._nodes[node]
            if rival < 0:
                if filling:
                    self._nodes[node] = cursor
                    return
            elif self._wins(rival, cursor):
                self._nodes[node], cursor = cursor, rival
            node //= 2
        self._nodes[0] = cursor

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(cursor, position) in order."""
        if not self._keys:
            return
        while self._head(winner := self._nodes[0]) is not None:
            yield winner, self._next[winner]
            self._next[winner] += 1
            self._play(winner)


def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs' pieces that reached this range.

    A piece ends wherever the key falls, so the merge is right in whatever order the
    shuffle delivers the pieces.
    """
    pieces = [b for b in batches if b.num_rows]
    if not pieces:
        return
    held = pa.Table.from_batches(pieces)
    keys = [_order(*k) for k in zip(*(held.column(c).to_pylist() for c in ("url_key", "captured_at", "file", "offset")))]
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    tree = LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:])])
    order = [cuts[cursor] + at for cursor, at in tree]
    for batch in held.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=10_000):
        yield batch


def merge_runs(runs: DataFrame, range_rows: int = 20_000) -> DataFrame:
    """All runs as one index, ordered by URL key, time and place over all partitions.

    A range holds about ``range_rows`` captures; file and offset end the range key, so
    captures of one URL spread over as many ranges as they fill.
    """
    runs = stored(runs, "warc-runs")
    ranges = max(1, -(-runs.count() // range_rows))
    keys = [F.col(c).asc_nulls_first() for c in ("url_key", "captured_at", "file", "offset")]
    return runs.repartitionByRange(ranges, *keys).mapInArrow(merge_range, INDEX_SCHEMA)


def capture_index(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the archives, read them back and merge their runs."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return merge_runs(read_runs(write_archives(pages, folder, **options), folder))
