"""Verdicts against a plain version, and what they catch in short texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from murmur.llm import quality as Q

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(SF).select("doc_id", "lang", "text")
    rows = [(r["doc"]["lang"], r["doc"]["text"], r["verdict"]) for r in Q.with_verdicts(docs).collect()]
    known = Q.references(docs, Q.Limits())
    return rows, known


def plain_words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(low) for w in re.findall("[^\x20\x09-\x0D]+", text or "")]


def plain_distance(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, total / 2))


def plain_references(rows):
    """lang: (class shares, {word: share}) by the definition."""
    out = {}
    for lang in {r[0] for r in rows if r[0] is not None}:
        texts = [t or "" for l, t, _ in rows if l == lang]
        if len(texts) < 30:
            continue
        words = [plain_words(t) for t in texts]
        having = Counter(w for ws in words for w in set(ws))
        common = [w for w, n in having.items() if n >= 0.05 * sum(1 for ws in words if ws)]
        full = [ws for ws in words if ws]
        shares = {w: sum(ws.count(w) / len(ws) for ws in full) / len(full) for w in common}
        classes = np.mean([plain_classes(t) for t, ws in zip(texts, words) if ws], axis=0)
        out[lang] = classes, shares
    return out


def plain_classes(text):
    kinds = [str.islower, str.isupper, str.isdigit]
    counts = [0] * 8
    for c in text:
        if ord(c) > 127:
            counts[7] += 1
        elif c in " \t\n\v\f\r":
            counts[3] += 1
        elif c in Q.SYMBOLS:
            counts[5] += 1
        elif c in Q.PUNCTUATION:
            counts[4] += 1
        else:
            counts[next((i for i, k in enumerate(kinds) if k(c)), 6)] += 1
    return np.array(counts) / max(1, len(text))


def test_verdicts_equal_a_plain_version(judged):
    rows, known = judged
    references = plain_references(rows)
    assert set(references) == set(known)
    for lang, (classes, shares) in references.items():
        assert np.allclose(classes, known[lang].classes) and len(shares) == len(known[lang].hashes)
        assert np.isclose(1 - sum(shares.values()), known[lang].words[-1])
    rng = random.Random(1)
    for lang, text, verdict in rng.sample(rows, 150):
        words = plain_words(text)
        failed = verdict["base_failed"]
        if len(words) < 50 or len(text or "") < 200:
            assert verdict["kept"] == (not failed) and verdict["word_distance"] is None
            continue
        classes, shares = references[lang]
        bins = max(2, min(len(words) // 6, 200))
        # Words by share; the operator orders equal shares by hash, so its own bins are taken.
        held = Q.word_bins(known[lang], bins, Q.Limits())
        chars = Q.code_points(" ".join(shares))
        hashes = Q.lowered_words(chars, *Q.word_spans(Q.spaces(chars)))
        group = {w: int(held.group[np.searchsorted(known[lang].hashes, h)]) for w, h in zip(shares, hashes)}
        own, reference = [0.0] * (bins + 1), [0.0] * (bins + 1)
        for w in words:
            own[group.get(w, bins)] += 1 / len(words)
        for w, share in shares.items():
            reference[group[w]] += share
        reference[bins] = 1 - sum(shares.values())
        far = plain_distance(own, reference)
        apart = plain_distance(plain_classes(text), classes)
        assert math.isclose(far, verdict["word_distance"], abs_tol=1e-6)
        assert math.isclose(apart, verdict["class_distance"], abs_tol=1e-6)
        alike = apart <= 0.14 + 0.9 / math.sqrt(len(words))
        assert verdict["kept"] == (not failed and alike and far <= held.threshold)


@pytest.mark.parametrize("n", [60, 100, 150, 200])
def test_short_gibberish_and_other_languages_go(judged, n):
    rows, known = judged
    judge, rng = Q.Judge(known, Q.Limits()), random.Random(n)
    kept = lambda text, lang: judge(Q.measure(text), lang)[1]
    noise = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for _ in range(100)]
    assert sum(kept(t, lang) for t in noise for lang in known) <= 0.01 * 100 * len(known)
    # Only texts that are kept whole: others may be junk in any language.
    cut = [(lang, " ".join(text.split()[:n])) for lang, text, v in rows if v["kept"] and v["n_words"] >= n]
    foreign = [kept(t, other) for lang, t in cut for other in known if other != lang]
    own = [kept(t, lang) for lang, t in cut]
    assert sum(foreign) <= 0.05 * len(foreign)
    assert sum(own) >= 0.97 * len(own)


def test_good_documents_stay(judged):
    rows, _ = judged
    assert sum(v["kept"] for _, _, v in rows) > 0.6 * len(rows)
