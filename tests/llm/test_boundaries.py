"""Boundaries are read a few at a time; widths are checked; runs of tied chunks are remembered."""

import random

import numpy as np
import public_tokenizers
import pytest

from murmur.llm import chunks as C
from murmur.llm import token_files as K


def coded(values):
    return K.EliasFano(len(values), *K.EliasFano.parts(np.array(values, np.int64)))


def test_selects_are_the_entries():
    rng = random.Random(1)
    for n in (1, 2, 255, 256, 257, 1000, 3000):
        values = np.cumsum([rng.choice([0, 0, 1, 700, 10**6]) for _ in range(n)]).tolist()
        held = coded(values)
        for _ in range(30):
            first = rng.randrange(n)
            count = rng.randrange(min(n - first, 600) + 1)
            assert held.selects(first, count).tolist() == values[first : first + count]
        assert held.select(n - 1) == values[-1]
        with pytest.raises(IndexError):
            held.selects(n - 1, 2)
        with pytest.raises(IndexError):
            held.select(-1)


def test_reading_never_has_all_boundaries(spark, tmp_path, monkeypatch):
    """The reader's code in one task: no call asks for more than its documents and one."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(90)], "doc_id bigint, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = K.write_token_files(docs.coalesce(1), str(tmp_path / "t"), path, 2, vocabulary=50_257)
    asked, real = [], K.EliasFano.selects
    monkeypatch.setattr(K.EliasFano, "selects", lambda self, first, count: asked.append(count) or real(self, first, count))
    monkeypatch.setattr(K.EliasFano, "all", lambda self: 1 / 0)
    for row in files.collect():
        held = K.TokenFile((tmp_path / "t" / row["file"]).read_bytes())
        for i in range(held.n_docs):
            assert held.document(i)[-1] == 2
    assert max(asked) == 1
    rows = K.read_token_files(files, str(tmp_path / "t")).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(90)) and K.READ_DOCS == 1000


def test_ids_must_fit(spark, tmp_path, no_docs):
    K.check_width([65_535], 2), K.check_width([], 2)
    with pytest.raises(ValueError):
        K.check_width([3, 65_536], 2)
    with pytest.raises(ValueError):
        K.write_token_files(no_docs, str(tmp_path / "t"), "", end_id=70_000, vocabulary=50_257)


def test_runs_of_tied_chunks(monkeypatch):
    """Any text gives its safe chunks in order, each encoded once while it is remembered."""
    rng = random.Random(2)
    told = []
    memory = C.ChunkMemory(lambda chunks: told.extend(chunks) or [f"<{c}>" for c in chunks])
    parts = ["a", "bb", "c\n", "\nd", "é", "\t", " ", "  ", "\n\n", "x.\n y", "\0"]
    for trial in range(3000):
        if trial == 1500:
            monkeypatch.setattr(C, "GENERATION", 5)
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(9))) + rng.choice(["", " ", "\n"])
        assert memory(text) == [f"<{c}>" for c in C.safe_chunks(text)], repr(text)
    monkeypatch.setattr(C, "GENERATION", 10**6)
    memory("end. \n again"), told.clear()
    memory("end. \n again")
    assert told == []
