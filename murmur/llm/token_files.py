"""Token-id files: one concatenated id array, with Elias-Fano coded document boundaries.

A file holds the ids of a range of documents in ascending order of their ids, and the
boundaries between them as an Elias-Fano sequence: the low bits packed, the high bits as a
bit vector in which the i-th one tells boundary i, and the position of every 256th one.
``select`` finds a boundary from the nearest such position, so no table of 64-bit offsets
is needed; for documents of about 1,000 ids a boundary takes about 12 bits.

Layout of a file, little-endian: the magic ``TOKEF001``; eight 64-bit numbers (documents,
ids, documents without an id, bytes per token id, low bits, bytes of the high bit vector,
samples, 0); token ids; document ids as signed 64-bit numbers; low bits; high bits;
samples as 32-bit numbers.

Defined results: a null or empty text has the end id only.  Documents without an id come
first.  Rows with one id follow each other by their text's hash; equal rows are documents
of their own.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import array
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.chunks import ChunkMemory
from murmur.llm.storage import filesystem, partitions_for, stored
from murmur.llm.texts import rows_of

MAGIC = b"TOKEF001"
SAMPLE = 256
#: Documents whose boundaries a reader has at once.
READ_DOCS = 1000


class EliasFano:
    """A rising sequence of numbers below 2 ** 32 times the number of entries."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self._n, self._low_bits = n, low_bits
        self._low = np.frombuffer(low, np.uint8)
        self._high = np.frombuffer(high, np.uint8)
        self._samples = np.frombuffer(samples, "<u4")

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """Low bits per value, and the three byte strings of the sequence."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
        return low_bits, pack(low), pack(high), ones[::SAMPLE].astype("<u4").tobytes()

    def _low_parts(self, first: int, count: int) -> np.ndarray:
        width, start = self._low_bits, first * self._low_bits
        if not width:
            return np.zeros(count, np.int64)
        bits = np.unpackbits(self._low[start // 8 : (start + count * width + 7) // 8], bitorder="little")
        own = bits[start % 8 : start % 8 + count * width].reshape(count, width)
        return own @ (1 << np.arange(width, dtype=np.int64))

    def select(self, i: int) -> int:
        """Entry ``i``, from the nearest sampled one on."""
        return int(self.selects(i, 1)[0])

    def selects(self, first: int, count: int) -> np.ndarray:
        """``count`` entries from ``first`` on; only these, and fewer than ``SAMPLE`` more, are looked at."""
        if not 0 <= first <= first + count <= self._n:
            raise IndexError((first, count))
        if not count:
            return np.zeros(0, np.int64)
        start = int(self._samples[first // SAMPLE])
        skipped, byte, window = first % SAMPLE, start // 8, 64 + count // 4
        while True:
            bits = np.unpackbits(self._high[byte : byte + window], bitorder="little")
            bits[: start % 8] = 0
            ones = np.flatnonzero(bits)
            if len(ones) >= skipped + count:
                break
            window *= 2
        high = byte * 8 + ones[skipped : skipped + count] - np.arange(first, first + count)
        return (high << self._low_bits) | self._low_parts(first, count)

    def all(self) -> np.ndarray:
        """Every entry."""
        return self.selects(0, self._n)


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> list[bytes]:
    """The sections of a file; ``ids`` are token ids of ``width`` bytes."""
    boundaries = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
    low_bits, low, high, samples = EliasFano.parts(boundaries)
    missing = sum(d is None for d in doc_ids)
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    head = struct.pack("<8q", len(doc_ids), int(boundaries[-1]), missing, width, low_bits, len(high), len(samples) // 4, 0)
    return [MAGIC, head, ids, names, low, high, samples]


class TokenFile:
    """A file in memory: documents by position."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if view[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, missing, width, low_bits, high, samples, _ = struct.unpack("<8q", view[8:72])
        sizes = [self.n_ids * width, self.n_docs * 8, ((self.n_docs + 1) * low_bits + 7) // 8, high, samples * 4]
        ends = np.cumsum([72, *sizes]).tolist()
        ids, names, low, upper, places = (view[a:b] for a, b in zip(ends, ends[1:]))
        self.ids = np.frombuffer(ids, f"<u{width}")
        self.doc_ids = [None] * missing + np.frombuffer(names, "<i8")[missing:].tolist()
        self.boundaries = EliasFano(self.n_docs + 1, low_bits, bytes(low), bytes(upper), bytes(places))

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.boundaries.select(i) : self.boundaries.select(i + 1)]


def cuts_are_safe(tokenizer: dict) -> bool:
    """Whether a text may be cut before single spaces: no added token can reach over such a
    place, and the text is split as byte-level tokenizers do and not changed before."""
    split = tokenizer.get("pre_tokenizer") or {}
    return (
        tokenizer.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space", True)
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
            for t in tokenizer.get("added_tokens", [])
        )
    )


def check_width(ids: Iterable[int], width: int) -> None:
    """An error if some id does not fit into ``width`` bytes."""
    if (largest := max(ids, default=0)) >= 1 << 8 * width:
        raise ValueError(f"ids of up to {largest} do not fit into {width} bytes")


@lru_cache(maxsize=2)
def encoder(path: str, width: int = 4) -> Callable[[str], list]:
    """Texts to lists of strings of ids of ``width`` bytes, by the tokenizers library.

    The library encodes chunks, which are remembered, or the whole text if its tokenizer
    may join what lies on both sides of a cut.  A text's unknown chunks go to it as one text, and the
    ids are dealt to them by their tokens' bytes.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    kind = {2: "H", 4: "I"}[width]
    check_width(tokenizer.get_vocab(with_added_tokens=True).values(), width)

    def encode(chunks: list[str]) -> list[bytes]:
        return [array.array(kind, e.ids).tobytes() for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    # A byte-level token has a character for each byte, an added one is as it is.
    lengths = {i: len(token) for token, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    lengths |= {i: len(token.content.encode()) for i, token in tokenizer.get_added_tokens_decoder().items()}
    sizes = np.zeros(max(lengths, default=0) + 1, np.int64)
    sizes[list(lengths)] = list(lengths.values())

    def encode_apart(chunks: list[str]) -> list[bytes]:
        led = [chunk for chunk in chunks if chunk[:1] == " "]
        if not led:
            return encode(chunks)
        ids = np.array(tokenizer.encode_batch_fast(["".join(led)], add_special_tokens=False)[0].ids, f"<u{width}")
        ends = np.cumsum(sizes[ids])
        wanted = np.cumsum([len(chunk.encode()) for chunk in led])
        after = np.searchsorted(ends, wanted) + 1
        # Bytes that the vocabulary lacks have no ids.
        if after[-1] != len(ids) or not np.array_equal(ends[after - 1], wanted):
            return encode(chunks)
        data, cuts = ids.tobytes(), (after * width).tolist()
        out = [data[a:b] for a, b in zip([0, *cuts], cuts)]
        if len(led) < len(chunks):
            for i, chunk in enumerate(chunks):
                if chunk[:1] != " ":
                    out.insert(i, encode([chunk])[0])
        return out

    safe = cuts_are_safe(json.loads(tokenizer.to_str()))
    return ChunkMemory(encode, encode_apart) if safe else lambda text: encode([text])


MANIFEST = "part bigint, file string, docs bigint, ids bigint"


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: int = 1 << 32,
    file_ids: int = 1 << 24,
) -> DataFrame:
    """Write the files below ``folder``; return their list with the number of ids before each.

    Documents are range-partitioned by id; ties are split by the text's hash.  A task
    closes a file at ``file_ids`` ids.  Ids take two bytes if ``vocabulary`` allows it.
    The tokenizer splits texts itself; ``pattern`` is not needed and has no effect.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    check_width([end_id], width)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(partitions_for(docs), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path, width), TaskContext.get()
        system, place = filesystem(folder)
        system.create_dir(place, recursive=True)
        end = end_id.to_bytes(width, "little")
        written: list[tuple] = []
        names: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []

        def close() -> None:
            file = f"ids-{task.partitionId():06d}-{len(written):04d}-{task.taskAttemptId()}.tok"
            with system.open_output_stream(f"{place}/{file}", compression=None) as out:
                for section in file_bytes(names, lengths, b"".join(held), width):
                    out.write(section)
            written.append((task.partitionId() * 1_000_000 + len(written), file, len(names), sum(lengths)))
            for x in (names, lengths, held):
                x.clear()

        for batch in rows_of(batches):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = b"".join([*encode(body or ""), end])
                names.append(name)
                lengths.append(len(ids) // width)
                held.append(ids)
            if sum(lengths) >= file_ids:
                close()
        if names:
            close()
        columns = [pa.array([w[c] for w in written], pa.string() if c == 1 else pa.int64()) for c in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "file", "docs", "ids"])

    files = stored(ranged.mapInArrow(write, MANIFEST), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return stored(files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), "token-index")


def read_token_files(files: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files.

    ``ids`` are 32-bit little-endian numbers, ``ids_crc32`` is their checksum.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = filesystem(folder)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{place}/{file}", compression=None) as stream:
                    held = TokenFile(stream.read())
                for first in range(0, held.n_docs, READ_DOCS):
                    own = min(READ_DOCS, held.n_docs - first)
                    ends = held.boundaries.selects(first, own + 1)
                    ids = [held.ids[a:b].astype("<u4").tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]
                    columns = [
                        pa.array(held.doc_ids[first : first + own], pa.int64()),
                        pa.array(base + ends[:-1], pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        *([pa.array(ids, pa.binary())] if with_ids else []),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    spread = files.select("file", "base").repartition(max(1, min(files.count(), 100_000)))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return spread.mapInArrow(read, schema)
