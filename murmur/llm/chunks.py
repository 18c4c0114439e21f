"""Encoding a text chunk by chunk, remembering the chunks.

The split pattern of byte-level BPE never lets a match run over the place before a single
space that stands between two other characters that are not white space.  Cut there, a text
falls into chunks that can be encoded on their own, in about one word each, and words recur.
"""

from __future__ import annotations

from collections.abc import Callable

#: Chunks and characters that one generation of the memory holds; there are two.
GENERATION, GENERATION_CHARS = 400_000, 10_000_000


def _cut(text: str) -> list[str]:
    if "\0" in text:
        first, *rest = text.split(" ")
        return [first, *(" " + part for part in rest)]
    return text.replace(" ", "\0 ").split("\0")


def _joins(chunk: str) -> bool:
    """Whether the chunk has white space at an end, besides its leading space."""
    inner = chunk[1:] if chunk[:1] == " " else chunk
    return chunk == " " or inner[-1:].isspace() or (chunk[:1] == " " and inner[:1].isspace())


def safe_chunks(text: str) -> list[str]:
    """The chunks, with those that white space ties together put together again."""
    out: list[str] = []
    for chunk in _cut(text):
        tied = chunk == " " or chunk[1:2].isspace()
        if out and (tied or out[-1][-1:].isspace()):
            out[-1] += chunk
        else:
            out.append(chunk)
    return out


class ChunkMemory:
    """Encodes texts as lists of their chunks' values.

    Chunks that white space ties to a neighbour have no value of their own (None); such a run of
    chunks is encoded, and remembered, as one.  ``encode_apart`` is used for chunks without white space at
    an end, which give the same values if those with a leading space are put together again.
    """

    def __init__(self, encode_all: Callable[[list[str]], list], encode_apart: Callable[[list[str]], list] | None = None):
        self._encode_all = encode_all
        self._encode_apart = encode_apart or encode_all
        self._young: dict[str, object] = {}
        self._old: dict[str, object] = {}
        self._chars = 0
        self._runs: dict[str, object] = {}
        self._run_chars = 0

    def _learn(self, missing: set[str]) -> bool:
        """Whether a new generation has begun, which knows the missing chunks only."""
        begun = len(self._young) >= GENERATION or self._chars >= GENERATION_CHARS
        if begun:
            self._old, self._young, self._chars = self._young, {}, 0
        young, old = self._young, self._old
        again = [chunk for chunk in missing if chunk in old]
        young.update((chunk, old[chunk]) for chunk in again)
        new = missing.difference(again)
        self._chars += sum(map(len, new))
        young.update(dict.fromkeys(new))
        told = [chunk for chunk in new if not _joins(chunk)]
        if told:
            young.update(zip(told, self._encode_apart(told)))
        return begun

    def _tied(self, chunks: list[str], values: list) -> list:
        """The values with one for each run of tied chunks."""
        out: list = []
        runs: list[tuple[int, str]] = []
        at = 0
        while True:
            try:
                i = values.index(None, at)
            except ValueError:
                break
            chunk = chunks[i]
            # What ends in white space was taken up by the run before.
            first = i - 1 if i > at and (chunk == " " or chunk[1:2].isspace()) else i
            last = i + 1
            while last < len(chunks) and (chunks[last - 1][-1:].isspace() or chunks[last] == " " or chunks[last][1:2].isspace()):
                last += 1
            out += values[at:first]
            runs.append((len(out), "".join(chunks[first:last])))
            out.append(None)
            at = last
        out += values[at:]
        known = self._runs
        missing = list({run for _, run in runs if run not in known})
        if missing:
            if len(known) >= GENERATION or self._run_chars >= GENERATION_CHARS:
                # Those of this text are learnt anew.
                self._runs = known = {}
                self._run_chars, missing = 0, list({run for _, run in runs})
            self._run_chars += sum(map(len, missing))
            known.update(zip(missing, self._encode_all(missing)))
        for place, run in runs:
            out[place] = known[run]
        return out

    def __call__(self, text: str) -> list:
        chunks = _cut(text)
        try:
            values = list(map(self._young.__getitem__, chunks))
        except KeyError:
            if self._learn(set(chunks).difference(self._young)) and (missing := set(chunks).difference(self._young)):
                self._learn(missing)
            values = list(map(self._young.__getitem__, chunks))
        return self._tied(chunks, values) if None in values else values
