"""Quality rules: base counts, and the distance of a text's make-up to its language.

A document's histogram of character classes and its histogram of common words are held
against the mean histograms of its language with the Jensen-Shannon distance.  The
references are computed from all documents.  A word is common if a given share of the
language's documents have it.  Such a word has that share in at least one part of the
documents, so each task proposes the words that are common in its own rows, and a second
pass counts the proposed words exactly.

A histogram of many words over few draws is far from any reference by chance alone, a good
text's as far as one without a single common word.  So the common words are put into bins of
equal shares, frequent words first, one for every ``words_per_bin`` words of the text; what
remains of chance is measured by drawing as many words from the reference itself.

Defined results: a null or empty text has no words and fails the base rules.  A document
whose language is null, or has fewer than ``min_language_docs`` documents, is held against
all references, and the nearest counts; with no reference at all, base rules alone decide.
Texts below ``min_chars`` characters or ``min_words`` words are not held against
histograms.  Repeated rows count each time.  Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.texts import SpanHasher, code_points, mix, rows_of, spaces, word_spans

#: The symbols that the base counts and the symbol class look for, and other classes.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other_ascii", "other")


def _class_table() -> np.ndarray:
    table = np.full(129, CLASSES.index("other_ascii"), np.int8)
    table[128] = CLASSES.index("other")
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[[32, *range(9, 14)]] = CLASSES.index("space")
    table[[ord(c) for c in PUNCTUATION]] = CLASSES.index("punctuation")
    table[[ord(c) for c in SYMBOLS]] = CLASSES.index("symbol")
    return table


CLASS_OF = _class_table()


@dataclass
class Limits:
    """Base rules and thresholds of the distances (base 2, from 0 to 1).

    The class threshold is class_distance + class_noise / root(n_words).  The word threshold is
    word_distance, or what the ``word_quantile`` of texts drawn from the reference reach plus
    ``word_slack`` if that is more, but at most ``word_cap`` times the distance of a text
    without any common word.
    """

    base_words: int = 50
    repeat_percent: int = 50
    min_chars: int = 200
    min_words: int = 50
    class_distance: float = 0.14
    class_noise: float = 0.9
    words_per_bin: int = 6
    max_bins: int = 200
    word_distance: float = 0.36
    word_quantile: float = 0.999
    word_slack: float = 0.04
    word_cap: float = 0.7
    common_share: float = 0.05
    min_language_docs: int = 30


@dataclass
class Reference:
    """Mean histograms of a language; the last bin of ``words`` is for all other words."""

    classes: np.ndarray
    hashes: np.ndarray
    words: np.ndarray


@dataclass
class Measured:
    """What one text shows."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    n_chars: int = 0
    classes: np.ndarray = field(default_factory=lambda: np.zeros(len(CLASSES)))
    lowered: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def lowered_words(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words with A to Z in lower case."""
    upper = (chars >= 65) & (chars <= 90)
    return SpanHasher(np.where(upper, chars + np.uint32(32), chars))(starts, ends)


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, window: int = 3) -> int:
    """Words inside a window that stands in the text twice or more."""
    if len(words) <= window:
        return 0
    n = len(words) - window + 1
    hashes = np.zeros(n, np.uint64)
    for j in range(window):
        hashes = mix(hashes + words[j : j + n])
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    repeated = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for j in range(window):
        covered[j : j + n] |= repeated
    return int(covered.sum())


def measure(text: str | None) -> Measured:
    text = text or ""
    chars = code_points(text)
    starts, ends = word_spans(spaces(chars))
    if not len(starts):
        return Measured(n_chars=len(chars))
    classes = np.bincount(CLASS_OF[np.minimum(chars, 128)], minlength=len(CLASSES))
    return Measured(
        n_words=len(starts),
        word_chars=int((ends - starts).sum()),
        n_symbols=int(classes[CLASSES.index("symbol")]),
        n_dup_lines=duplicate_lines(text),
        n_repeat_words=repeated_words(SpanHasher(chars)(starts, ends)),
        n_chars=len(chars),
        classes=classes / len(chars),
        lowered=lowered_words(chars, starts, ends),
    )


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that sum to 1."""
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / middle), 0.0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """As :func:`distance` for each row."""
    middle = (rows + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / middle), 0.0).sum(axis=1) for x in (rows, np.broadcast_to(q, rows.shape))]
    return np.sqrt(np.maximum(0.0, (parts[0] + parts[1]) / 2))


def common_histogram(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Shares of the common words (``hashes`` ascending) and of all others."""
    out = np.zeros(len(hashes) + 1)
    if len(hashes):
        at = np.searchsorted(hashes, words)
        at[at == len(hashes)] = 0
        hit = hashes[at] == words
        out[:-1] = np.bincount(at[hit], minlength=len(hashes))
    out /= max(1, len(words))
    out[-1] = 1 - out[:-1].sum()
    return out


DRAWS = 400


@dataclass
class WordBins:
    """A reference's common words in ``bins`` groups of equal shares, and the threshold that goes with them."""

    group: np.ndarray
    shares: np.ndarray
    threshold: float

    def histogram(self, shares: np.ndarray) -> np.ndarray:
        """``shares`` of the common words and of all others, by group."""
        return np.append(np.bincount(self.group, shares[:-1], len(self.shares) - 1), shares[-1])


def word_bins(reference: Reference, bins: int, limits: Limits) -> WordBins:
    """Groups of words from the most frequent on; equal shares are ordered by hash."""
    own = reference.words[:-1]
    order = np.argsort(-own, kind="stable")
    middle = np.cumsum(own[order]) - own[order] / 2
    group = np.empty(len(own), np.int64)
    total = max(float(own.sum()), 1e-12)
    group[order] = np.minimum((middle / total * bins).astype(np.int64), bins - 1)
    shares = np.append(np.bincount(group, own, bins), reference.words[-1])
    # Texts of the fewest words that get so many bins.
    n_words = max(limits.min_words, bins * limits.words_per_bin)
    drawn = np.random.default_rng(bins).multinomial(n_words, shares / shares.sum(), DRAWS) / n_words
    chance = float(np.quantile(distances(drawn, shares), limits.word_quantile))
    nothing = np.zeros(len(shares))
    nothing[-1] = 1
    most = limits.word_cap * distance(nothing, shares)
    return WordBins(group, shares, min(most, max(limits.word_distance, chance + limits.word_slack)))


_BINS: dict = {}


class Judge:
    """The rules with the references of all languages; bins are made when they are first needed."""

    def __init__(self, known: dict[str, Reference], limits: Limits):
        self.known, self.limits = known, limits
        # Shared by the tasks of a worker: made from the same references, bins are the same.
        said = sha256(repr(limits).encode())
        for lang in sorted(known):
            said.update(lang.encode() + known[lang].hashes.tobytes() + known[lang].words.tobytes())
        if _BINS.get("of") != said.digest():
            _BINS.clear()
            _BINS["of"] = said.digest()
        self._bins = _BINS

    def bins(self, lang: str, n_words: int) -> WordBins:
        number = max(2, min(n_words // self.limits.words_per_bin, self.limits.max_bins))
        if (lang, number) not in self._bins:
            self._bins[lang, number] = word_bins(self.known[lang], number, self.limits)
        return self._bins[lang, number]

    def __call__(self, one: Measured, lang: str | None) -> tuple[bool, bool, float | None, float | None]:
        """base_failed, kept and the two distances."""
        limits = self.limits
        failed = one.n_words < limits.base_words or 100 * one.n_repeat_words > limits.repeat_percent * one.n_words
        if one.n_chars < limits.min_chars or one.n_words < limits.min_words or not self.known:
            return failed, not failed, None, None
        found = []
        for name in [lang] if lang in self.known else sorted(self.known):
            reference, bins = self.known[name], self.bins(name, one.n_words)
            words = distance(bins.histogram(common_histogram(one.lowered, reference.hashes)), bins.shares)
            found.append((words, distance(one.classes, reference.classes), bins.threshold))
        words, classes, threshold = min(found)
        alike = classes <= limits.class_distance + limits.class_noise / np.sqrt(one.n_words)
        return failed, not failed and bool(alike and words <= threshold), classes, words


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def proposed_words(docs: DataFrame, lang: str, text: str, share: float) -> DataFrame:
    """(lang, word, docs) with word null for the number of documents: words common in some task's rows."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs: dict[str, int] = defaultdict(int)
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        n_waiting: dict[str, int] = defaultdict(int)

        def settle(name: str) -> None:
            words, times = counts.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            every = np.concatenate([words, *waiting[name]])
            weights = np.concatenate([times, np.ones(len(every) - len(words), np.int64)])
            found, which = np.unique(every, return_inverse=True)
            counts[name] = found, np.bincount(which, weights, len(found)).astype(np.int64)
            waiting[name], n_waiting[name] = [], 0

        for batch in rows_of(batches):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name is None:
                    continue
                n_docs[name] += 1
                chars = code_points(body or "")
                own = np.unique(lowered_words(chars, *word_spans(spaces(chars))))
                waiting[name].append(own)
                n_waiting[name] += len(own)
                if n_waiting[name] > 1 << 20:
                    settle(name)
        for name, n in n_docs.items():
            settle(name)
            words, times = counts[name]
            often = times >= share * n
            yield _table([name], [None], [n])
            yield _table([name] * int(often.sum()), _signed(words[often]), times[often])

    def _table(langs, words, numbers) -> pa.RecordBatch:
        columns = [pa.array(langs, pa.string()), pa.array(words, pa.int64()), pa.array(numbers, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "word", "docs"])

    return docs.select(lang, text).mapInArrow(propose, "lang string, word bigint, docs bigint")


def references(
    docs: DataFrame, limits: Limits, lang: str = "lang", text: str = "text"
) -> dict[str, Reference]:
    """Mean histograms of the languages.

    What reaches the driver is one row per language and proposed word; the words of a
    language that a task proposes are at most 1 / ``common_share`` times the mean number
    of different words in a document.
    """
    proposed = proposed_words(docs, lang, text, limits.common_share).groupBy("lang", "word").agg(F.sum("docs").alias("docs"))
    n_docs: dict[str, int] = {}
    words: dict[str, list[int]] = defaultdict(list)
    for row in proposed.collect():
        if row["word"] is None:
            n_docs[row["lang"]] = row["docs"]
        else:
            words[row["lang"]].append(row["word"])
    kept = {name for name, n in n_docs.items() if n >= limits.min_language_docs}
    hashes = {name: np.sort(np.array(words[name], np.int64).view(np.uint64)) for name in kept}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in rows_of(batches):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in hashes:
                    continue
                one = measure(body)
                if not one.n_words:
                    continue
                shares = common_histogram(one.lowered, hashes[name])
                total = sums.setdefault(name, [0, np.zeros(len(CLASSES)), np.zeros(len(shares)), np.zeros(len(shares), np.int64)])
                total[0] += 1
                total[1] += one.classes
                total[2] += shares
                total[3] += shares > 0
        for name, (n, classes, shares, having) in sums.items():
            # Kind 0: classes and their number of documents; kind 1: common words.
            kinds = [0] * len(classes) + [1] * len(shares)
            items = [*range(len(classes)), *range(len(shares))]
            numbers = [n] * len(classes) + having.tolist()
            columns = [pa.array([name] * len(kinds)), pa.array(kinds), pa.array(items), pa.array([*classes, *shares]), pa.array(numbers)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "kind", "item", "shares", "docs"])

    summed = (
        docs.select(lang, text)
        .mapInArrow(count, "lang string, kind bigint, item bigint, shares double, docs bigint")
        .groupBy("lang", "kind", "item")
        .agg(F.sum("shares").alias("shares"), F.sum("docs").alias("docs"))
    )
    rows: dict[str, dict] = defaultdict(dict)
    for row in summed.collect():
        rows[row["lang"]][row["kind"], row["item"]] = row["shares"], row["docs"]
    found = {}
    for name, cells in rows.items():
        n = cells[0, 0][1]
        common = [i for i in range(len(hashes[name])) if cells[1, i][1] >= limits.common_share * n]
        shares = np.array([cells[1, i][0] / n for i in common])
        classes = np.array([cells[0, i][0] / n for i in range(len(CLASSES))])
        found[name] = Reference(classes, hashes[name][common], np.append(shares, 1 - shares.sum()))
    return found


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = T.StructType(
    [T.StructField(name, T.LongType()) for name in COUNTS]
    + [T.StructField(name, T.BooleanType()) for name in ("base_failed", "kept")]
    + [T.StructField(name, T.DoubleType()) for name in ("class_distance", "word_distance")]
)


def with_verdicts(docs: DataFrame, limits: Limits | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """(doc, verdict): the document's columns and the rules' results, each as a struct."""
    limits = limits or Limits()
    known = references(docs, limits, lang, text)
    kinds = [*[pa.int64()] * 5, *[pa.bool_()] * 2, *[pa.float64()] * 2]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(known, limits)
        for batch in rows_of(batches):
            doc, results = batch.column(0), []
            for name, body in zip(doc.field(lang).to_pylist(), doc.field(text).to_pylist()):
                one = measure(body)
                counts = (getattr(one, name) for name in COUNTS)
                results.append((*counts, *judge(one, name)))
            columns = [pa.array(c, k) for c, k in zip(zip(*results), kinds)]
            verdict = pa.StructArray.from_arrays(columns, VERDICTS.names)
            yield pa.RecordBatch.from_arrays([doc, verdict], ["doc", "verdict"])

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(decide, T.StructType([rows.schema["doc"], T.StructField("verdict", VERDICTS)]))
