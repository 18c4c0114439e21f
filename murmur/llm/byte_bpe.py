"""Byte-level BPE by backtracking over longest matches.

A text's bytes are mapped to the characters of Latin-1, so that an Aho-Corasick automaton
over the vocabulary finds the longest token at every position of a piece in one pass.  The
encoder takes longest matches from the left.  A token may follow another only if the
merges, applied to the two tokens' bytes, would leave exactly these two; this test is
memoised for each pair.  Where a token cannot follow, its next shorter prefix is tried,
and where none can, the position is marked as a dead end and the token before it is taken
back.  Each position is given up at most once, so a piece takes linear time, and the result
is the one the merges give.

Defined results: a null or empty text has no tokens; repeated rows give equal rows, and an empty
table an empty one.  Other columns pass in the struct ``doc``, so no name can clash.  What the split
pattern does not match has no tokens.  Ids outside the vocabulary cannot be decoded and raise an error.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.chunks import ChunkMemory
from murmur.llm.texts import rows_of

#: Token pairs whose test is kept in memory by a task; beyond that the store is emptied.
MEMO = 400_000
#: Fixed value: the split pattern of byte-level BPE, whose matches never reach over the cuts of ``chunks``.
CHUNK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NO_LIMIT = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 token and rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._pattern = regex.compile(pattern)
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._sizes = {rank: len(token) for token, rank in ranks.items()}
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self._automaton.make_automaton()
        self._shorter = {rank: self._longest_prefix(token, ranks) for token, rank in ranks.items()}
        self._halves: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            halves = self._split(token, rank, ranks)
            self._halves[rank] = halves or (rank, rank)
            if halves:
                self._merged[halves] = rank
        self._compatible: dict[tuple[int, int], bool] = {}
        if pattern == CHUNK_PATTERN:
            self._parts = ChunkMemory(lambda chunks: [self._encode_chunk(c) for c in chunks])
        else:
            # Another pattern may match over any cut, so its texts are split whole.
            self._parts = lambda text: [self._encode_chunk(text)]

    @staticmethod
    def _longest_prefix(token: bytes, ranks: dict[bytes, int]) -> int | None:
        return next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None)

    @staticmethod
    def _split(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two parts whose merge makes the token; None for single bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(ranks.get(a + b, _NO_LIMIT), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, at = min(pairs)
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side; memoised."""
        known = self._compatible.get((left, right))
        if known is None:
            if len(self._compatible) >= MEMO:
                self._compatible.clear()
            known = self._compatible[left, right] = self._undisturbed(left, right)
        return known

    def _undisturbed(self, left: int, right: int) -> bool:
        """Undo merges from the last to the first; a merge across the border that would
        have come before the one undone last rules the pair out."""
        undone = _NO_LIMIT
        while True:
            across = self._merged.get((left, right), _NO_LIMIT)
            if across < undone:
                return False
            inner_left, inner_right = self._halves[left], self._halves[right]
            whole_left, whole_right = inner_left[0] == inner_left[1] == left, inner_right[0] == inner_right[1] == right
            if whole_left and whole_right:
                return True
            # Of equal ranks the left one merges first, so the right one is undone first
            # and a merge of its own rank across the border still comes before it.
            if whole_left or (not whole_right and right >= left):
                undone, right = right + 1, inner_right[0]
            else:
                undone, left = left, inner_left[1]

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids as a string of 32-bit numbers, the smallest form to remember."""
        ids = array("I")
        for match in self._pattern.finditer(chunk):
            ids.extend(self._backtrack(match[0].encode("utf-8", "surrogatepass").decode("latin-1")))
        return ids.tobytes()

    def _backtrack(self, data: str) -> list[int]:
        n, sizes, shorter, compatible = len(data), self._sizes, self._shorter, self._compatible
        longest: list[int | None] = [None] * (n + 1)
        for end, (rank, length) in self._automaton.iter(data):
            longest[end + 1 - length] = rank  # matches come by their end, so the longest comes last
        dead = bytearray(n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = tokens[-1] if tokens else None
            while token is not None:
                end = at + sizes[token]
                if not dead[end]:
                    if last is None:
                        break
                    fits = compatible.get((last, token))
                    if fits or (fits is None and self.follows(last, token)):
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                at, token = end, longest[end]
                continue
            if last is None:
                raise ValueError("the vocabulary cannot spell this text")
            dead[at] = 1
            token = tokens.pop()
            at -= sizes[token]
        return tokens

    def encode(self, text: str | None) -> list[int]:
        ids = array("I")
        ids.frombytes(b"".join(self._parts(text or "")))
        return ids.tolist()

    def decode(self, ids) -> bytes:
        spell = self._bytes
        return b"".join([spell[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec per worker process."""
    return ByteBpe(read_ranks(path), pattern)


#: What ``encode_documents`` can return for a text, from its ids and the codec.
OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda ids, own: ids),
    "n_tokens": (T.LongType(), pa.int64(), lambda ids, own: len(ids)),
    "ids_sha256": (T.StringType(), pa.string(), lambda ids, own: sha256(",".join(map(str, ids)).encode()).hexdigest()),
    "decoded": (T.BinaryType(), pa.binary(), lambda ids, own: own.decode(ids)),
    "decoded_sha256": (T.StringType(), pa.string(), lambda ids, own: sha256(own.decode(ids)).hexdigest()),
}


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("ids",)
) -> DataFrame:
    """(doc, ...): the document's columns as a struct, and the chosen ``OUTPUTS`` of its text."""
    chosen = [(name, *OUTPUTS[name]) for name in outputs]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in rows_of(batches):
            doc = batch.column(0)
            ids = [own.encode(t) for t in doc.field(text).to_pylist()]
            columns = [pa.array([make(i, own) for i in ids], kind) for _, _, kind, make in chosen]
            yield pa.RecordBatch.from_arrays([doc, *columns], ["doc", *outputs])

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(encode, T.StructType([rows.schema["doc"], *(T.StructField(n, t) for n, t, _, _ in chosen)]))


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """(doc, decoded): the columns as a struct, and the bytes that ``ids`` spell."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in rows_of(batches):
            spelt = [own.decode(i or ()) for i in batch.column(0).field(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelt, pa.binary())], ["doc", "decoded"])

    rows = encoded.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(decode, T.StructType([rows.schema["doc"], T.StructField("decoded", T.BinaryType())]))
