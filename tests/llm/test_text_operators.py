"""Operators that look at one text, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmur.llm import byte_bpe, fingerprints, quality, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_base_counts(hard_docs, small_docs):
    for docs in (hard_docs, small_docs):
        rows = quality.with_verdicts(docs).select("doc.text", "verdict.*").collect()
        assert len(rows) == docs.count()
        for row in rows:
            want = plain_counts(row["text"])
            # Blank texts have no words, and so no symbols inside words.
            assert tuple(row[c] for c in quality.COUNTS) == want
            assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (row["base_failed"] and row["kept"])


def test_distance_is_a_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert quality.distance(p, p) == 0
    assert quality.distance(p, q) == pytest.approx(1)
    assert 0 < quality.distance(p, np.array([0.4, 0.4, 0.2])) < 1


def test_references_are_means_over_all_documents(spark):
    rows = [(i, "alpha beta gamma " * 20 + f"own{i}", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(7)
    known = quality.references(docs, quality.Limits())
    assert list(known) == ["en"]
    assert len(known["en"].hashes) == 3
    assert known["en"].words[:3] == pytest.approx([20 / 61] * 3)
    assert known["en"].classes.sum() == pytest.approx(1)


def test_odd_text_is_rejected_and_plain_text_kept(spark):
    rng = random.Random(9)

    def words(n):
        rare = lambda: "w" + "".join(rng.choices("abcdefgh", k=4))
        return " ".join(rng.choice("the of and to in".split()) if rng.random() < 0.5 else rare() for _ in range(n))

    rows = [(i, words(300), "en") for i in range(60)] + [(99, re.sub(r"(\S+)", r"\1%%%$$$", words(300)), "en")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.with_verdicts(docs).select("doc.doc_id", "verdict.kept").collect()}
    assert not kept.pop(99)
    assert all(kept.values())


def test_empty_tables(no_docs):
    assert quality.with_verdicts(no_docs).count() == 0
    assert fingerprints.edit_report(no_docs).count() == 0
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.encode_documents(no_docs, path, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={}
    )
    return byte_bpe.codec(path, public_tokenizers.PATTERN), library


def test_bpe_equals_the_library(bpe, hard_docs):
    own, library = bpe
    random.seed(5)
    letters = "ab cde the ing\n\t  !!??''s're123é漢字🙂\x85%%**$$ZZx.,-"
    texts = ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(3000)]
    texts += [r["text"] or "" for r in hard_docs.select("text").collect()]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_round_trip_as_tables(bpe, hard_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(hard_docs, path, public_tokenizers.PATTERN, outputs=("ids", "n_tokens"))
    flat = encoded.select("doc.text", "ids", "n_tokens")
    rows = byte_bpe.decode_documents(flat, path, public_tokenizers.PATTERN).select("doc.*", "decoded").collect()
    assert len(rows) == hard_docs.count()
    for row in rows:
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
        assert len(row["ids"]) == row["n_tokens"]


def plain_shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edit_report(hard_docs, small_docs):
    for docs in (small_docs, hard_docs):
        rows = fingerprints.edit_report(docs).collect()
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h")).collect()
        texts = sorted(texts, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
        assert len(rows) == len(texts)
        by_edit = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
        found = {(r["doc_id"], r["edited_sha256"]): r for r in rows}
        for own, following in zip(texts, texts[1:] + texts[:1]):
            changed = fingerprints.edited(own["text"], following["text"])
            digest = hashlib.sha256(changed.encode()).hexdigest()
            by_edit[own["doc_id"], len(own["text"]), digest] -= 1
            row = found[own["doc_id"], digest]
            sets = [plain_shingles(t) for t in (own["text"], changed, following["text"])]
            assert abs(row["near_edited"] - likeness(sets[0], sets[1])) < 0.2
            assert abs(row["near_next"] - likeness(sets[0], sets[2])) < 0.2
        assert not any(by_edit.values())


def test_sketches_merge_and_estimate(spark):
    from tests.llm.conftest import prose

    left, right = prose(3000, 1), prose(3000, 2)
    a, b = fingerprints.Sketch.of(left), fingerprints.Sketch.of(right)
    exact = len(plain_shingles(left) | plain_shingles(right))
    assert abs(a.merge(b).count() / exact - 1) < 0.3
    assert str(fingerprints.Sketch.parse(str(a))) == str(a)
    part = fingerprints.Sketch.of(prose(600, 1))
    assert part.containment(a) > 0.8
    parts = [("g", str(x)) for x in (a, b, a)] * 50 + [(None, str(part))]
    df = spark.createDataFrame(parts, "kind string, fingerprint string")
    rows = {r["kind"]: r["fingerprint"] for r in fingerprints.merged(df, "kind").collect()}
    assert rows == {"g": str(a.merge(b)), None: str(part)}


@pytest.mark.parametrize("n", [1, 2, 5, 300, 5000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    values = np.cumsum(rng.integers(0, 3000, n) * (rng.random(n) < 0.8))
    low_bits, low, high, samples = token_files.EliasFano.parts(values)
    coded = token_files.EliasFano(n, low_bits, low, high, samples)
    assert coded.all().tolist() == values.tolist()
    for i in {0, n - 1, n // 2, *rng.integers(0, n, 20).tolist()}:
        assert coded.select(i) == values[i]
    if n == 5000:
        assert len(low) + len(high) + len(samples) < 2 * n


def test_token_files(hard_docs, small_docs, no_docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for at, docs in enumerate((small_docs, hard_docs)):
        for pattern in (public_tokenizers.PATTERN, None):
            folder = str(tmp_path / f"{at}{pattern is None}")
            files = token_files.write_token_files(docs, folder, path, 2, pattern, vocabulary=50_257, file_ids=5_000)
            rows = token_files.read_token_files(files, folder).orderBy("start").collect()
            assert len(rows) == docs.count()
            assert [r["doc_id"] or -1 for r in rows] == sorted(r["doc_id"] or -1 for r in rows)
            want = Counter()
            for r in docs.select("doc_id", "text").collect():
                ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
                want[r["doc_id"], zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)] += 1
            assert want == Counter((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in rows)
            position = 0
            for r in rows:
                assert r["start"] == position
                position += r["n_tokens"]
    empty = token_files.write_token_files(no_docs, str(tmp_path / "none"), path, 2)
    assert token_files.read_token_files(empty, str(tmp_path / "none")).count() == 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    texts, toxic = toxicity.training_sample(docs, labels.where(~held), size=250)
    assert 0 < sum(toxic) <= 250 and len(toxic) <= 500
    model = toxicity.train(texts, toxic)
    test = docs.join(labels.where(held), "doc_id")
    rows = toxicity.with_scores(test, model).select("doc.toxic", "score").collect()
    hits = [r["score"] >= 0.7 for r in rows if r["toxic"] == 1]
    false = [r["score"] >= 0.7 for r in rows if r["toxic"] == 0]
    assert sum(hits) / len(hits) > 0.6
    assert sum(false) / len(false) < 0.03
    # Misspellings share n-grams with the words they come from.
    assert model.score("the stuupid idiott said this to them") > model.score("the river said this to them")


def test_toxicity_of_odd_input(spark, hard_docs, no_docs):
    model = toxicity.train(["bad words here", "fine words here"], [True, False])
    scores = [r["score"] for r in toxicity.with_scores(hard_docs, model).collect()]
    assert len(scores) == hard_docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.with_scores(no_docs, model).count() == 0
    assert toxicity.train([], []).score("anything") < 0.01
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    assert toxicity.training_sample(hard_docs, labels)[1] == [True]
