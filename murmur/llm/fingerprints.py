"""Bottom-k fingerprints of documents.

A fingerprint keeps the k smallest hashes of a document's shingles of five words, and thus
stands for the set of all shingles: the fingerprint of a whole follows from those of its
parts, and two fingerprints tell resemblance, containment and the number of different
shingles.  Up to k shingles it is exact.  As text it is base64 of the hashes in ascending
order, eight bytes each, behind ``=`` if it holds all shingles and ``<`` otherwise.

Defined results: a null or empty text has the fingerprint ``=`` of the empty set; two empty
sets are alike (1.0), an empty and another are not (0.0).  Fewer than five words make one
shingle.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.storage import partitions_for
from murmur.llm.texts import SpanHasher, rows_of, shingles, spaces, utf8, word_spans

SIZE = 128
WORDS = 5


@dataclass(frozen=True)
class Sketch:
    """Ascending hashes; ``complete`` if no shingle is left out."""

    hashes: np.ndarray
    complete: bool

    @staticmethod
    def of(text: str | None, k: int = SIZE) -> Sketch:
        chars = utf8(text or "")
        found = np.unique(shingles(SpanHasher(chars)(*word_spans(spaces(chars))), WORDS))
        return Sketch(found[:k], len(found) <= k)

    @staticmethod
    def parse(written: str) -> Sketch:
        return Sketch(np.frombuffer(base64.b64decode(written[1:]), ">u8").astype(np.uint64), written[0] == "=")

    def __str__(self) -> str:
        return ("=" if self.complete else "<") + base64.b64encode(self.hashes.astype(">u8").tobytes()).decode()

    def merge(self, other: Sketch, k: int = SIZE) -> Sketch:
        """The sketch of both documents' shingles together."""
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(both[:k], self.complete and other.complete and len(both) <= k)

    def count(self) -> float:
        """Different shingles: exact, or from how dense the smallest hashes lie."""
        n = len(self.hashes)
        return float(n) if self.complete else (n - 1) * 2.0**64 / float(self.hashes[-1])

    def _shared(self, other: Sketch) -> tuple[int, int]:
        """How many of the union's smallest hashes that both sketches can vouch for lie in both."""
        both = np.union1d(self.hashes, other.hashes)
        for one in (self, other):
            if not one.complete:
                both = both[both <= one.hashes[-1]]
        return int((np.isin(both, self.hashes) & np.isin(both, other.hashes)).sum()), len(both)

    def resemblance(self, other: Sketch) -> float:
        """Shared shingles as a share of all of both."""
        if not len(self.hashes) or not len(other.hashes):
            return float(len(self.hashes) == len(other.hashes))
        shared, of = self._shared(other)
        return shared / of

    def containment(self, other: Sketch) -> float:
        """Share of this document's shingles that the other has too."""
        if not len(self.hashes):
            return 1.0
        both = self.merge(other, max(len(self.hashes), len(other.hashes)))
        return min(1.0, self.resemblance(other) * both.count() / self.count()) if len(other.hashes) else 0.0


def merged(df: DataFrame, group: str, sketch: str = "fingerprint", salts: int = 64) -> DataFrame:
    """One fingerprint per group: (group, fingerprint).

    Merging is associative, so each task merges its share of a group first; a group with
    very many parts reaches its last task as one part from each of ``salts`` tasks.  The
    group may be null.
    """

    @F.pandas_udf(T.StringType())
    def merge(parts: pd.Series) -> str:
        whole = Sketch(np.zeros(0, np.uint64), True)
        for part in parts.dropna():
            whole = whole.merge(Sketch.parse(part))
        return str(whole)

    salt = F.pmod(F.xxhash64(sketch), F.lit(salts)).alias("_salt")
    first = df.select(F.col(group).alias("group"), F.col(sketch).alias("part"), salt).distinct()
    first = first.groupBy("group", "_salt").agg(merge("part").alias("part"))
    return first.groupBy("group").agg(merge("part").alias("fingerprint")).withColumnRenamed("group", group)


def with_fingerprints(docs: DataFrame, text: str = "text", k: int = SIZE) -> DataFrame:
    """(doc, fingerprint): the document's columns as a struct, and its fingerprint."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [str(Sketch.of(t, k)) for t in batch.column(0).field(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc", "fingerprint"])

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(sketch, T.StructType([rows.schema["doc"], T.StructField("fingerprint", T.StringType())]))


def smallest_ids(rows: DataFrame, near: list[float]) -> np.ndarray:
    """The smallest ``doc_id`` of each range between the bounds, which need not be ids themselves."""
    ends = np.iinfo(np.int64)
    cuts = np.unique(np.array([min(max(int(x), ends.min), ends.max) for x in near], np.int64))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            home = np.maximum(np.searchsorted(cuts, ids, side="right") - 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), batch.column(0)], ["range", "doc_id"])

    if not len(cuts):
        return cuts
    ids = rows.select("doc_id").where("doc_id IS NOT NULL").mapInArrow(number, "range bigint, doc_id bigint")
    least = ids.groupBy("range").agg(F.min("doc_id").alias("doc_id")).collect()
    return np.sort(np.array([r["doc_id"] for r in least], np.int64))


def next_documents(docs: DataFrame, pair: Callable, schema: str, doc_id: str, text: str, bucket_rows: int = 1000) -> DataFrame:
    """Rows that ``pair(doc_id, text, next_text)`` makes of each document and the next by id.

    Bounds between id ranges are ids of the table, kept as 64-bit integers.  The documents on a bound go to their
    own range and, as its last successor, to the range before; the first documents also go
    to the last range.  So each range can be read in order by itself and texts move once.
    A null id stands before all others, equal ids are in order of their text's hash.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    n_rows, n_null = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, -(-n_rows // bucket_rows))
    steps = [i / ranges for i in range(ranges)]
    bounds = rows.stat.approxQuantile("doc_id", steps, 0.25 / ranges) if n_rows > n_null else []
    bounds = smallest_ids(rows, bounds)
    last = max(0, len(bounds) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            home = np.where(null, 0, np.maximum(np.searchsorted(bounds, values, side="right") - 1, 0))
            on_bound = ~null & (bounds[home] == values) if len(bounds) else np.zeros(len(null), bool)
            first = null if n_null else on_bound & (home == 0)
            guard = first | (on_bound & (home > 0))
            order = np.concatenate([np.arange(len(null)), np.flatnonzero(guard)])
            before = np.where(first, last, home - 1)[guard]
            columns = [
                pa.array(np.concatenate([home, before]), pa.int64()),
                pa.array(np.repeat([False, True], [len(null), int(guard.sum())])),
                *batch.take(pa.array(order)).columns,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["range", "guard", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "range bigint, guard boolean, doc_id bigint, text string")
    order = ["range", "guard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    in_order = dealt.repartition(partitions_for(docs), "range").sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its successor
        names = [f.split()[0] for f in schema.split(",")]
        for batch in rows_of(batches):
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] == row[0]:
                    out.append(pair(held[2], held[3], row[3]))
                held = None if row[1] else row
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], pa.schema(_arrow(schema)))

    return in_order.mapInArrow(walk, schema)


def _arrow(schema: str) -> list[pa.Field]:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return [pa.field(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(","))]


EDITS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, containment_edited double, distinct_shingles double"
)


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of ``following``'s beginning as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SIZE) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are."""

    def pair(name: int | None, own: str | None, following: str | None) -> tuple:
        own, following = own or "", following or ""
        changed = edited(own, following)
        one, other, third = Sketch.of(own, k), Sketch.of(changed, k), Sketch.of(following, k)
        likeness = (one.resemblance(other), one.resemblance(third), one.containment(other), one.count())
        return (name, len(own), sha256(changed.encode()).hexdigest(), str(one), str(other), *likeness)

    return next_documents(docs, pair, EDITS, doc_id, text)
