"""Line dedup by pairwise alignment.

A text's lines are its ``\n``-split lines, cut further after words that end a sentence, for
passages also begin and end inside long lines.  A line with enough words that stands once in
its document, and a shortest run of lines with enough words for a block, link the documents
that have them to the first of them by id, so what stands in thousands of documents gives
one link each, not all pairs.  A linked pair is aligned by patience diff: over the shortest
runs that both have, each taken where it stands first, so that all are unique.  An aligned run
grows to the block of equal lines around it, and blocks are deleted from the later document.
Runs that the alignment leaves out, because they repeat or stand in other order, are aligned
again until none is left; so all blocks in common are found, and only by alignment.

Defined results: a null or empty text has no lines and stays as it is.  Rows with one id
never lose lines to each other; towards later documents the one with the smallest text hash
stands for them.  A null id is the first.  A document that loses all its lines has an empty
text.  Texts without a deletion are returned unchanged.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.storage import stored
from murmur.llm.texts import SpanHasher, mix, rows_of, spaces, text_bytes, text_pieces, utf8, word_spans

#: Words that a line needs to link documents, and that a block needs to be deleted.
LINK_WORDS, BLOCK_WORDS = 4, 25
SENTENCE_ENDS = b".!?"


def line_spans(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line in the text's UTF-8 bytes, and its number of words."""
    starts, ends = word_spans(spaces(chars))
    if not len(starts):
        return starts, ends, starts
    closing = np.isin(chars[ends - 1], np.frombuffer(SENTENCE_ENDS, np.uint8))
    breaks = np.concatenate([[0], np.cumsum(chars == 10)])
    closing[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    closing[-1] = True
    last = np.flatnonzero(closing)
    first = np.concatenate([[0], last[:-1] + 1])
    return starts[first], ends[last], last - first + 1


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Matching blocks (start in a, start in b, length) of two sequences.

    Common heads and tails match; between them, values that are unique on both sides are
    kept where they rise on both, and the gaps are aligned in turn.
    """
    pairs: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        anchors = _rising(_unique_pairs(a, b, a0, a1, b0, b1))
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if not anchors:
            continue
        pairs += anchors
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(pairs):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _unique_pairs(a, b, a0, a1, b0, b1) -> list[tuple[int, int]]:
    def once(x, start, end):
        seen: dict[int, int] = {}
        for at in range(start, end):
            seen[x[at]] = -1 if x[at] in seen else at
        return seen

    left, right = once(a, a0, a1), once(b, b0, b1)
    return [(i, right[value]) for value, i in left.items() if i >= 0 and right.get(value, -1) >= 0]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises on both sides; pairs rise on the first."""
    tops: list[int] = []
    tails: list[int] = []
    back: list[int] = []
    for at, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(tails[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            tails.append(at)
        else:
            tops[pile], tails[pile] = j, at
    out, at = [], tails[-1] if tails else -1
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def block_runs(lines: np.ndarray, words: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the shortest runs of enough words that begin, or end, at each line.

    Each line of a block of enough words lies in one of them that is inside the block.
    """
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n = len(lines)
    ends = np.searchsorted(sums, sums[:-1] + block_words)
    starts = np.searchsorted(sums, sums[1:] - block_words, side="right") - 1
    ahead, back = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    first = np.concatenate([ahead, starts[back]])
    last = np.concatenate([ends[ahead], back + 1])
    if not len(first):
        return first, last, np.zeros(0, np.int64)
    return first, last, _run_hashes(lines, first, last)


def _run_hashes(lines: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    halves = (lines.view(np.uint64) & np.uint64(0xFFFFFFFF), lines.view(np.uint64) >> np.uint64(32))
    low, high = (SpanHasher(half)(first, last) for half in halves)
    return mix(low + mix(high)).view(np.int64)


def repeated_lines(own: list[int], words: list[int], other: list[int], other_words: list[int], block_words: int) -> list[int]:
    """Numbers of the own lines that lie in aligned blocks of enough words."""
    first, last, runs = (x.tolist() for x in block_runs(np.array(own, np.int64), np.array(words, np.int64), block_words))
    places: dict[int, int] = {}
    other_first, _, other_runs = block_runs(np.array(other, np.int64), np.array(other_words, np.int64), block_words)
    for at in np.argsort(other_first, kind="stable").tolist():
        places.setdefault(int(other_runs[at]), int(other_first[at]))
    rest = sorted((a, b, run) for a, b, run in zip(first, last, runs) if run in places)
    found: set[int] = set()
    while rest:
        starts: dict[int, int] = {}
        for a, _, run in rest:
            starts.setdefault(run, a)
        here, there = list(starts), sorted(starts, key=places.__getitem__)
        blocks = []
        for i, _, length in patience(here, there):
            for run in here[i : i + length]:
                if not blocks or starts[run] >= blocks[-1][1] or starts[run] - places[run] != blocks[-1][2]:
                    blocks.append(_grown(own, other, starts[run], places[run]))
        for start, end, _ in blocks:
            found.update(range(start, end))
        spans = sorted((start, end) for start, end, _ in blocks)
        left = [run for run in rest if not _inside(run[0], run[1], spans)]
        if len(left) == len(rest):
            break
        rest = left
    return sorted(found)


def _grown(own: list[int], other: list[int], i: int, j: int) -> tuple[int, int, int]:
    """The block of equal lines around line i of one and j of the other: start, end, and i - j."""
    start, end, shift = i, i, i - j
    while start and start - shift and own[start - 1] == other[start - shift - 1]:
        start -= 1
    while end < len(own) and end - shift < len(other) and own[end] == other[end - shift]:
        end += 1
    return start, end, shift


def _inside(first: int, last: int, spans: list[tuple[int, int]]) -> bool:
    """Whether one of the sorted spans holds the run; spans may overlap."""
    at = bisect_left(spans, (first + 1,)) - 1
    while at >= 0:
        if spans[at][1] >= last:
            return True
        at -= 1
    return False


LINES = "id bigint, tie bigint, lines array<bigint>, words array<int>, linking array<boolean>, runs array<bigint>"
FIRST_ID = -(1 << 63)


def key_columns(doc_id: str, text: str) -> list[Column]:
    """The order of documents: by id, rows of one id by their text's hash."""
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(FIRST_ID)).alias("id"),
        F.xxhash64(text).alias("tie"),
    ]


def batch_spans(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and words of each line of many texts that lie one after the other, and each text's first line.

    Text k has the bytes from ``bounds[k]`` to ``bounds[k + 1]``; no line reaches into the next text.
    """
    solid = np.zeros(len(chars) + 2, bool)
    solid[1:-1] = ~spaces(chars)
    inner = bounds[(bounds > 0) & (bounds < len(chars))]
    begins, ends_here = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    begins[inner] = solid[1:-1][inner]
    ends_here[inner - 1] = solid[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends_here) + 1
    if not len(starts):
        return starts, ends, starts, np.zeros(len(bounds), np.int64)
    closing = np.isin(chars[ends - 1], np.frombuffer(SENTENCE_ENDS, np.uint8))
    breaks = np.concatenate([[0], np.cumsum(chars == 10)])
    closing[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    # The last word of each text.
    words_before = np.searchsorted(starts, bounds)
    closing[words_before[1:][np.diff(words_before) > 0] - 1] = True
    last = np.flatnonzero(closing)
    first = np.concatenate([[0], last[:-1] + 1])
    return starts[first], ends[last], last - first + 1, np.searchsorted(first, words_before)


def batch_runs(lines: np.ndarray, words: np.ndarray, firsts: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of :func:`block_runs` for many texts at once, and the text of each.

    Text k has the lines from ``firsts[k]`` to ``firsts[k + 1]``.
    """
    n, text_of = len(lines), np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    low, high = firsts[text_of], firsts[text_of + 1]
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends = np.searchsorted(sums, sums[:-1] + block_words)
    starts = np.searchsorted(sums, sums[1:] - block_words, side="right") - 1
    ahead = np.flatnonzero(ends <= high)
    back = np.flatnonzero(starts >= low)
    # Those that also begin at their first line are there already.
    back = back[ends[starts[back]] != back + 1]
    first, last = np.concatenate([ahead, starts[back]]), np.concatenate([ends[ahead], back + 1])
    if not n or not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(text_of[first], kind="stable")
    first, last = first[order], last[order]
    return _run_hashes(lines, first, last), text_of[first]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """``values`` cut into lists of these lengths."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def document_lines(docs: DataFrame, doc_id: str, text: str, link_words: int, block_words: int) -> DataFrame:
    """Hashes and word counts of each document's lines, which of them link, and the runs that link."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, 2):
            chars, bounds = text_bytes(batch.column(2))
            starts, ends, words, firsts = batch_spans(chars, bounds)
            lines = SpanHasher(chars)(starts, ends).view(np.int64)
            sizes = np.diff(firsts)
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            # A text's number keeps its lines apart from equal ones of other texts.
            own = mix(lines.view(np.uint64) ^ mix(text_of.astype(np.uint64)))
            _, which, times = np.unique(own, return_inverse=True, return_counts=True)
            runs, run_of = batch_runs(lines, words, firsts, block_words)
            columns = [
                _lists(lines, sizes, pa.int64()), _lists(words.astype(np.int32), sizes, pa.int32()),
                _lists((words >= link_words) & (times[which] == 1), sizes, pa.bool_()),
                _lists(runs, np.bincount(run_of, minlength=len(sizes)), pa.int64()),
            ]
            names = ["id", "tie", "lines", "words", "linking", "runs"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return docs.select(*key_columns(doc_id, text), F.col(text)).mapInArrow(cut, LINES)


def links(lines: DataFrame, block_words: int) -> DataFrame:
    """(id, tie, earlier): documents that share enough words in lines, or a run, first seen in ``earlier``."""
    each = (
        lines.select("id", "tie", F.explode(F.arrays_zip("lines", "words", "linking")).alias("line"))
        .where("line.linking")
        .select("id", "tie", F.col("line.lines").alias("line"), F.col("line.words").alias("words"))
    )
    # Salted, so that a run of one line is not taken for the line.
    runs = lines.select("id", "tie", F.explode("runs").alias("line"))
    each = each.union(runs.select("id", "tie", F.xxhash64("line").alias("line"), F.lit(block_words).alias("words")))
    first = each.groupBy("line").agg(F.min("id").alias("earlier"), F.max("id").alias("last")).where("earlier < last")
    # Stored, so that the join below can split a line with very many documents.
    first = stored(first.select("line", "earlier"), "first-lines")
    return (
        each.join(first, "line")
        .where("earlier < id")
        .groupBy("id", "tie", "earlier")
        .agg(F.sum("words").alias("words"))
        .where(F.col("words") >= block_words)
        .select("id", "tie", "earlier")
    )


def deletions(lines: DataFrame, block_words: int) -> DataFrame:
    """(id, tie, deleted, partners): line numbers to delete, and the documents that keep them."""
    pairs = stored(links(lines, block_words), "line-links")
    linked = pairs.select(F.explode(F.array("id", "earlier")).alias("id")).distinct()
    linked = stored(lines.drop("linking", "runs").join(linked, "id", "left_semi").dropDuplicates(["id", "tie"]), "linked-lines")
    stands = linked.groupBy("id").agg(F.min("tie").alias("tie"))
    earlier = linked.join(stands, ["id", "tie"]).select(F.col("id").alias("earlier"), F.col("lines").alias("other"), F.col("words").alias("other_words"))
    earlier = stored(earlier, "earlier-lines")
    own = linked.select("id", "tie", F.col("lines").alias("own"), "words")
    both = pairs.join(own, ["id", "tie"]).join(earlier, "earlier").select("id", "tie", "earlier", "own", "words", "other", "other_words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            lists = (batch.column(c).to_pylist() for c in (3, 4, 5, 6))
            found = [repeated_lines(*each, block_words) for each in zip(*lists)]
            columns = [*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "tie", "earlier", "deleted"])

    aligned = both.mapInArrow(align, "id bigint, tie bigint, earlier bigint, deleted array<int>")
    return (
        aligned.where(F.size("deleted") > 0)
        .groupBy("id", "tie")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"),
            F.array_sort(F.collect_set("earlier")).alias("partners"),
        )
    )


def without_lines(text: str, deleted: list[int]) -> str:
    """The text without the lines of these numbers, each with the white space before it.

    If the first line goes, so does the white space before the first that stays.
    """
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends, _ = line_spans(np.frombuffer(raw, np.uint8))
    gone = set(deleted)
    out, at = [], 0
    for number, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        if number not in gone:
            out.append(raw[start if number and not out else at : end])
        at = end
    return b"".join(out).decode("utf-8", "surrogatepass")


RESULT = T.StructType(
    [
        T.StructField("n_lines", T.LongType()),
        T.StructField("removed_lines", T.ArrayType(T.IntegerType())),
        T.StructField("removed_words", T.LongType()),
        T.StructField("partners", T.ArrayType(T.LongType())),
        T.StructField("text", T.StringType()),
    ]
)


def deduplicate_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", link_words: int = LINK_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc, result): the document's columns as they were, and what is left of its text."""
    lines = stored(document_lines(docs, doc_id, text, link_words, block_words), "lines")
    gone = deletions(lines, block_words)
    # Rows of one id and one text have the same lines.
    counts = lines.groupBy("id", "tie").agg(F.max(F.size("lines")).alias("n_lines"))
    judged = stored(counts.join(gone, ["id", "tie"], "left"), "line-deletions")
    rows = docs.select(F.struct("*").alias("doc"), *key_columns(doc_id, text))
    joined = rows.join(judged, ["id", "tie"], "left").select("doc", "n_lines", "deleted", "partners")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            doc = batch.column(0)
            bodies = doc.field(text)
            # Most texts stay as they are, and never become Python objects.
            touched = pc.indices_nonzero(pc.is_valid(batch.column(2))).to_pylist()
            gone_words, kept = np.zeros(batch.num_rows, np.int64), []
            for row in touched:
                body, deleted = bodies[row].as_py(), batch.column(2)[row].as_py()
                _, _, words = line_spans(utf8(body))
                gone_words[row] = words[deleted].sum()
                kept.append(without_lines(body, deleted))
            mask = np.zeros(batch.num_rows, bool)
            mask[touched] = True
            texts = pc.replace_with_mask(bodies, pa.array(mask), pa.array(kept, pa.string())) if kept else bodies
            nothing = lambda kind: pa.scalar([], pa.list_(kind))
            columns = [
                batch.column(1).cast(pa.int64()),
                pc.if_else(pa.array(mask), batch.column(2), nothing(pa.int32())),
                pa.array(gone_words),
                pc.if_else(pa.array(mask), batch.column(3), nothing(pa.int64())),
                texts,
            ]
            yield pa.RecordBatch.from_arrays([doc, pa.StructArray.from_arrays(columns, RESULT.names)], ["doc", "result"])

    return joined.mapInArrow(cut, T.StructType([rows.schema["doc"], T.StructField("result", RESULT)]))
