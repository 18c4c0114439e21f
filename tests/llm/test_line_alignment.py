"""Line dedup of whole tables against all pairs, and what the alignment decides."""

import random

import numpy as np
import pyarrow as pa
import pytest

from murmur.llm import line_dedup as L
from murmur.llm import texts as T


def sentence(rng, pool=10**6, words=None):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(words or rng.randrange(1, 14))) + "."


def made(seed):
    """Documents of passages from a small stock, in any order, some changed or repeated."""
    rng = random.Random(seed)
    stock = [[sentence(rng) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            passage = list(rng.choice(stock))
            if rng.random() < 0.3:
                passage[rng.randrange(len(passage))] = sentence(rng)
            parts += passage + [sentence(rng) for _ in range(rng.randrange(3))]
        docs.append((i * 3 % 41, rng.choice([" ", "\n"]).join(parts)))
    return docs + [(50, None), (51, ""), (52, docs[0][1])]


def lines_of(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, words = L.line_spans(raw)
    return [raw[a:b].tobytes() for a, b in zip(starts, ends)], words.tolist()


def plain_common(own, words, other):
    """Lines in any block that both have, of 25 words or more."""
    found = set()
    for i in range(len(own)):
        for j in range(len(other)):
            if own[i] == other[j] and (not i or not j or own[i - 1] != other[j - 1]):
                k = 0
                while i + k < len(own) and j + k < len(other) and own[i + k] == other[j + k]:
                    k += 1
                if sum(words[i : i + k]) >= L.BLOCK_WORDS:
                    found.update(range(i, i + k))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_table_equals_all_pairs(spark, seed):
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r["doc"]["doc_id"]: r["result"] for r in L.deduplicate_lines(df).collect()}
    cut = {i: lines_of(t) for i, t in docs}
    removed = 0
    for i, (own, words) in cut.items():
        want = set()
        for j, (other, _) in cut.items():
            if j < i:
                want |= plain_common(own, words, other)
        assert got[i]["removed_lines"] == sorted(want), i
        assert got[i]["n_lines"] == len(own) and got[i]["removed_words"] == sum(words[x] for x in want)
        text = dict(docs)[i]
        assert got[i]["text"] == (L.without_lines(text, sorted(want)) if want else text)
        removed += len(want)
    assert removed > 50


def test_alignment_decides(monkeypatch):
    rng = random.Random(3)
    a, b = [rng.randrange(10**6) for _ in range(20)], [rng.randrange(10**6) for _ in range(5)]
    moved = b[:2] + a[10:] + b[2:] + a[:10]
    words = [9] * 25
    assert L.repeated_lines(moved, words, a, [9] * 20, 25) == [*range(2, 12), *range(15, 25)]
    monkeypatch.setattr(L, "patience", lambda x, y: [])
    assert L.repeated_lines(moved, words, a, [9] * 20, 25) == []


def test_batches_are_cut_as_single_texts():
    rng = random.Random(5)
    pieces = ["a", "bc.", "d! ", "\n", " ", "é?", "x\n\ny", "漢字.", "\t", ""]
    for _ in range(300):
        texts = [rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(1, 8))]
        array = pa.array(["zz"] + texts, pa.string()).slice(1)
        chars, bounds = T.text_bytes(array)
        starts, ends, words, firsts = L.batch_spans(chars, bounds)
        lines = T.SpanHasher(chars)(starts, ends).view(np.int64)
        runs, run_of = L.batch_runs(lines, words, firsts, 4)
        for k, text in enumerate(texts):
            own = T.utf8(text or "")
            a, b, n = L.line_spans(own)
            mine = slice(firsts[k], firsts[k + 1])
            assert (starts[mine] - bounds[k]).tolist() == a.tolist() and (ends[mine] - bounds[k]).tolist() == b.tolist()
            assert words[mine].tolist() == n.tolist()
            hashes = T.SpanHasher(own)(a, b).view(np.int64)
            assert lines[mine].tolist() == hashes.tolist()
            assert set(runs[run_of == k].tolist()) == set(L.block_runs(hashes, n, 4)[2].tolist())


def test_pieces_hold_all_rows():
    rng = random.Random(6)
    for _ in range(100):
        texts = [rng.choice([None, "", "x" * rng.randrange(50)]) for _ in range(rng.randrange(12))]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["i", "t"])
        pieces = list(T.text_pieces(iter([batch]), 1, size=40))
        assert [t for p in pieces for t in p.column(1).to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 40 for p in pieces)
