"""Vectorised helpers over one text: words, spans, shingles and their hashes.

Hashes are 64-bit.  A span's hash is a polynomial in the powers of an odd base, so
the hash of any span follows from prefix sums without looking at the span again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for slot, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[slot] = np.cumprod(factors)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the usual shift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def utf8(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def spaces(chars: np.ndarray) -> np.ndarray:
    """Where white space stands: space and the characters 9 to 13."""
    return (chars == 32) | ((chars >= 9) & (chars <= 13))


def word_spans(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between blanks."""
    padded = np.ones(len(blank) + 2, np.int8)
    padded[1:-1] = blank
    edges = np.flatnonzero(np.diff(padded))
    return edges[::2], edges[1::2]


def prefix_sums(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums up to each position, and the factors that make them independent of the position."""
    power, inverse = _power_tables(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _STEP * power[: len(chars)], out=sums[1:])
    return sums, inverse


class SpanHasher:
    """Hashes of spans of one character array."""

    def __init__(self, chars: np.ndarray):
        self._sums, self._inverse = prefix_sums(chars)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes; fewer words make one shingle, none none."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        out = out * np.uint64(_BASE) + words[j : j + n]
    return mix(out)


def occurrences(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    position = np.arange(len(values))
    out = np.empty(len(values), np.int64)
    out[order] = position - np.maximum.accumulate(np.where(new, position, 0))
    return out


@lru_cache(maxsize=1)
def letters_and_digits() -> np.ndarray:
    """For every code point, whether it is a letter or a digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def normal_words(text: str | None) -> np.ndarray:
    """Word hashes in lower case and without punctuation.

    A text without any letter or digit keeps its words as they are.
    """
    chars = code_points((text or "").lower())
    blank = spaces(chars)
    kept = letters_and_digits()[chars] | blank
    if not (kept & ~blank).any():
        kept = np.ones(len(chars), bool)
    chars, blank = chars[kept], blank[kept]
    return SpanHasher(chars)(*word_spans(blank))


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts in ``column`` have about ``size`` bytes, or one row each."""
    for batch in batches:
        _, bounds = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size)) - 1)
            yield batch.slice(first, min(last, batch.num_rows) - first)
            first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins and the last ends; null is empty."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]
