"""Toxicity by subword-bag embeddings.

A text is read in passages of ``PASSAGE`` words.  A passage is the bag of the character
n-grams of its words, marked at word borders; the n-grams' vectors are averaged and go into
a linear softmax of two classes.  Vectors and softmax are trained jointly in numpy, on
documents: a document's evidence is the soft maximum over its passages, as one toxic passage
makes a document toxic.  A word never seen shares n-grams, and so vectors, with the words it
was made from.  A text's score is the toxic probability of its most toxic passage.

Training takes a sample of labelled rows with a documented bound: up to ``SAMPLE`` toxic and
``SAMPLE`` other documents, chosen by a hash of their id, so the driver's memory does not
grow with the number of documents.  Training and scoring read whole texts.

Defined results: a null or empty text scores as a passage without n-grams, by the softmax's
bias alone.  Without labelled documents of both classes every score is next to 0.  Rows
whose label or id is null are left out of training, repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm.texts import code_points, prefix_sums, rows_of, spaces, word_spans

PASSAGE, GRAMS = 24, (4, 5, 6)
BUCKETS, DIMENSIONS = 1 << 20, 8
SAMPLE = 1500
EPOCHS, RATE, DECAY = 60, 0.03, 2e-6
#: Pseudo-documents that pull an n-gram's starting evidence to none, and the least to be kept.
PRIOR, LEAST = 10.0, 0.5
#: N-grams of the documents that a training step holds at once.
STEP_GRAMS = 1 << 21
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Passages:
    """A text's characters with one blank before and after, and where its passages begin."""

    def __init__(self, text: str | None):
        chars = code_points(f" {(text or '').lower()} ")
        blank = spaces(chars)
        starts, _ = word_spans(blank)
        self._sums, self._inverse = prefix_sums(np.where(blank, np.uint32(32), chars))
        self._blanks = np.concatenate([[0], np.cumsum(blank)])
        self._n = len(chars)
        #: Position of the blank before each passage's first word; a passage owns what starts there or later.
        self.starts = starts[::PASSAGE] - 1 if len(starts) else np.zeros(1, np.int64)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n: the bucket at each position, and whether an n-gram of one word starts there.

        Only the first and last character may be a blank, which marks the word's border.
        """
        for n in GRAMS:
            m = self._n - n + 1
            if m <= 0:
                continue
            hashes = (self._sums[n:] - self._sums[:m]) * self._inverse[:m] * _SPREAD
            inner = self._blanks[n - 1 : n - 1 + m] == self._blanks[1 : m + 1]
            yield (hashes >> np.uint64(44)).astype(np.int64), inner


@dataclass(frozen=True)
class Model:
    """What scoring needs: each bucket's vector times the softmax's weight difference."""

    evidence: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        passages = Passages(text)
        weights = np.zeros(passages._n, np.float32)
        counts = np.zeros(passages._n, np.float32)
        for buckets, valid in passages.grams():
            weights[: len(valid)] += self.evidence[buckets] * valid
            counts[: len(valid)] += valid
        sums = np.add.reduceat(weights, passages.starts, dtype=np.float64)
        of = np.add.reduceat(counts, passages.starts, dtype=np.float64)
        margin = float((sums / np.maximum(of, 1)).max()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -60, 60))))


def _document_features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets in the order of the passages, the passage of each, and the number of passages."""
    passages = Passages(text)
    grams, within = [], []
    for buckets, valid in passages.grams():
        at = np.flatnonzero(valid)
        grams.append(buckets[at].astype(np.int32))
        within.append((np.searchsorted(passages.starts, at, side="right") - 1).astype(np.int32))
    if not grams:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), len(passages.starts)
    grams, within = np.concatenate(grams), np.concatenate(within)
    order = np.argsort(within, kind="stable")
    return grams[order], within[order], len(passages.starts)


@dataclass(frozen=True)
class _Document:
    """A training document: its n-grams that have a vector, by passage, and all n-grams of each passage."""

    grams: np.ndarray
    having: np.ndarray
    counts: np.ndarray


def starting_odds(having: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The log of how much more often toxic documents have an n-gram, shrunk.

    ``having`` are the documents of each class (0, 1) with the n-gram, ``sizes`` all of each.  Pseudo-
    documents are dealt to the classes by their sizes, so an n-gram in none has odds of 0 however
    unequal the classes are.
    """
    n = sizes.sum()
    pseudo = 1 + 2 * PRIOR * having.sum(axis=0) / n
    shares = [(having[c] + pseudo * (sizes[c] / n)) / sizes[c] for c in (0, 1)]
    return np.log(shares[1]) - np.log(shares[0])


def train(texts: list[str], toxic: list[bool], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit vectors and softmax with Adam on whole batches; the result depends on the input and seed only.

    An n-gram starts with its :func:`starting_odds`.  N-grams that start with little evidence stay
    neutral, as all do that stand in no training document: they count in the averages but have no
    vector.  A batch's gradient is summed over steps of ``STEP_GRAMS`` n-grams, which bounds memory.
    """
    labels = np.array(toxic, float)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), -60.0)
    having = np.zeros((2, BUCKETS), np.float32)
    for text, label in zip(texts, toxic):
        having[int(label), np.unique(_document_features(text)[0])] += 1
    odds = starting_odds(having, np.array([(labels == 0).sum(), labels.sum()]))
    used = np.flatnonzero((np.abs(odds) >= LEAST) & (having.sum(axis=0) > 0))
    index = np.full(BUCKETS, -1, np.int32)
    index[used] = np.arange(len(used))
    documents = []
    for text in texts:
        found, within, n = _document_features(text)
        kept = index[found] >= 0
        having_own = np.bincount(within[kept], minlength=n)
        documents.append(_Document(index[found[kept]], having_own, np.maximum(np.bincount(within, minlength=n), 1)))
    steps = _steps(documents)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (len(used), DIMENSIONS)).astype(np.float32)
    vectors[:, 0] = odds[used]
    weights = rng.normal(0, 0.05, (DIMENSIONS, 2)).astype(np.float32)
    weights[0] = -10, 10
    bias = np.zeros(2, np.float32)
    share = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, weights, bias)]
    for epoch in range(1, epochs + 1):
        gradients = [DECAY * vectors, np.zeros_like(weights), np.zeros_like(bias)]
        for first, last in steps:
            own = slice(first, last)
            _add_gradients(gradients, documents[own], labels[own], share[own], vectors, weights, bias)
        for parameter, gradient, (mean, square) in zip((vectors, weights, bias), gradients, state):
            mean += 0.1 * (gradient - mean)
            square += 0.02 * (gradient * gradient - square)
            scale = np.sqrt(1 - 0.98**epoch) / (1 - 0.9**epoch)
            parameter -= RATE * scale * mean / (np.sqrt(square) + 1e-8)
    evidence = np.zeros(BUCKETS, np.float32)
    evidence[used] = vectors @ (weights[:, 1] - weights[:, 0])
    return Model(evidence, float(bias[1] - bias[0]))


def _steps(documents: list[_Document]) -> list[tuple[int, int]]:
    """Runs of documents with about ``STEP_GRAMS`` n-grams each."""
    ends = np.cumsum([len(d.grams) for d in documents])
    cuts = np.flatnonzero(np.diff(ends // STEP_GRAMS)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(documents)]))


def _add_gradients(
    gradients: list[np.ndarray], documents: list[_Document], labels: np.ndarray, share: np.ndarray,
    vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray,
) -> None:
    """Add what a run of documents gives to the gradients of vectors, weights and bias."""
    grams = np.concatenate([d.grams for d in documents])
    counts = np.concatenate([d.counts for d in documents]).astype(np.float32)
    passage_of = np.repeat(np.arange(len(counts)), np.concatenate([d.having for d in documents]))
    sizes = [len(d.counts) for d in documents]
    starts = np.cumsum([0, *sizes])[:-1]
    doc_of = np.repeat(np.arange(len(documents)), sizes)
    means = _sums(vectors, grams, passage_of, len(counts)) / counts[:, None]
    logits = means @ weights + bias
    margin = (logits[:, 1] - logits[:, 0]).astype(np.float64)
    # Soft maximum of a document's passages; the gradient goes to each by its part in it.
    top = np.maximum.reduceat(margin, starts)
    raised = np.exp(margin - top[doc_of])
    total = np.add.reduceat(raised, starts)
    document = np.add.reduceat(raised * margin, starts) / total
    error = share * (1 / (1 + np.exp(-np.clip(document, -60, 60))) - labels)
    slope = (error / total)[doc_of] * raised
    d_logits = np.stack([-slope, slope], axis=1).astype(np.float32)
    gradients[0] += _sums((d_logits @ weights.T) / counts[:, None], passage_of, grams, len(vectors))
    gradients[1] += means.T @ d_logits
    gradients[2] += d_logits.sum(axis=0)


def _sums(rows: np.ndarray, source: np.ndarray, goal: np.ndarray, n: int) -> np.ndarray:
    """Row ``source[i]`` added to row ``goal[i]`` of the result, for every i."""
    out = np.empty((n, rows.shape[1]), np.float32)
    for d in range(rows.shape[1]):
        out[:, d] = np.bincount(goal, rows[:, d][source], n)
    return out


def training_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SAMPLE
) -> tuple[list[str], list[bool]]:
    """Texts and labels of up to ``size`` documents of each class.

    The labels alone choose them, those with the smallest hashes of their ids, so only the
    chosen texts leave the table.  An id with several labels has the highest, an id with
    several texts the first.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    by_hash = [F.md5(F.col("id").cast("string").cast("binary")), "id"]
    chosen = known.where("label = 1").orderBy(*by_hash).limit(size)
    chosen = F.broadcast(chosen.union(known.where("label = 0").orderBy(*by_hash).limit(size)))  # 2 * size rows
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(chosen, "id")
    rows = texts.groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id").collect()
    return [row["text"] for row in rows], [row["label"] == 1 for row in rows]


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc, score): the document's columns as a struct, and its score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # four megabytes, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in rows_of(batches):
            scores = [own.score(t) for t in batch.column(0).field(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc", "score"])

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(score, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))
