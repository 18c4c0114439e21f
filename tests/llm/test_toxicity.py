"""Training on unequal classes, unseen words, whole texts, and scores by their definition."""

import random

import numpy as np

from murmur.llm import texts as T
from murmur.llm import toxicity as X

PLAIN = "river house table garden window morning letter street people winter summer village".split()
NASTY = "grotlin vexmaw durgash".split()


def word(rng, letters="bcdfghklmnprstvwaeiou"):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(4, 9)))


def made(n_toxic, n_other, seed=1):
    rng = random.Random(seed)
    text = lambda bad: " ".join(rng.choice(PLAIN) for _ in range(60)) + (" " + " ".join(rng.choices(NASTY, k=6)) if bad else "")
    return [text(True) for _ in range(n_toxic)] + [text(False) for _ in range(n_other)], [True] * n_toxic + [False] * n_other


def bucket(gram):
    total, power = 0, 1
    for c in gram:
        total += (ord(c) + 1) * int(T._STEP) * power
        power = power * T._BASE % 2**64
    return ((total * int(X._SPREAD)) % 2**64) >> 44


def plain_score(model, text):
    words = (text or "").lower().split()
    passages = [words[i : i + X.PASSAGE] for i in range(0, len(words), X.PASSAGE)] or [[]]
    margins = []
    for passage in passages:
        grams = [f" {w} "[i : i + n] for w in passage for n in X.GRAMS for i in range(len(w) + 3 - n)]
        found = [float(model.evidence[bucket(g)]) for g in grams]
        margins.append(sum(found) / max(1, len(found)))
    return 1 / (1 + np.exp(-(max(margins) + model.bias)))


def test_scores_are_the_plain_ones():
    rng = np.random.default_rng(3)
    model = X.Model(rng.normal(0, 3, X.BUCKETS).astype(np.float32), -0.4)
    words = random.Random(2)
    for text in (None, "", " a ", "Ab c", *(" ".join(word(words) for _ in range(n)) for n in (1, 23, 24, 25, 90))):
        assert abs(model.score(text) - plain_score(model, text)) < 1e-5


def test_unseen_words_are_neutral_whatever_the_classes():
    rng = random.Random(9)
    unseen = [" ".join(word(rng, "qxzjyw") for _ in range(60)) for _ in range(40)]
    for n_toxic, n_other in ((20, 200), (200, 20), (60, 60)):
        texts, toxic = made(n_toxic, n_other)
        model = X.train(texts, toxic)
        assert not any(model.score(text) >= 0.7 for text in unseen)
        seen = set(np.unique(np.concatenate([X._document_features(t)[0] for t in texts])).tolist())
        assert set(np.flatnonzero(model.evidence).tolist()) <= seen
        held, truth = made(30, 30, seed=2)
        assert all((model.score(t) >= 0.7) == bad for t, bad in zip(held, truth))
        # A misspelling shares most of its n-grams.
        assert model.score(" ".join(PLAIN) + " grotlinn vexmaws durgashh grotlins") > model.score(" ".join(PLAIN))


def test_odds_of_unequal_classes():
    having, sizes = np.zeros((2, 4)), np.array([300.0, 30.0])
    having[:, 1] = 100, 10
    having[:, 2] = 0, 5
    having[:, 3] = 50, 0
    odds = X.starting_odds(having, sizes)
    assert abs(odds[0]) < 1e-9 and abs(odds[1]) < 1e-9 and odds[2] > 1 and odds[3] < -0.5


def test_training_reads_whole_texts():
    """What is toxic stands behind thousands of words."""
    rng = random.Random(4)
    long = lambda bad: " ".join(rng.choice(PLAIN) for _ in range(4000)) + (" grotlin vexmaw durgash" * 3 if bad else "")
    texts, toxic = [long(i % 2 == 0) for i in range(16)], [i % 2 == 0 for i in range(16)]
    model = X.train(texts, toxic)
    assert model.score("grotlin vexmaw durgash grotlin") > 0.5 > 0.1 > model.score(" ".join(PLAIN))


def test_steps_do_not_change_the_model(monkeypatch):
    texts, toxic = made(15, 40)
    whole = X.train(texts, toxic, epochs=5)
    monkeypatch.setattr(X, "STEP_GRAMS", 1500)
    parts = X.train(texts, toxic, epochs=5)
    assert np.allclose(whole.evidence, parts.evidence, atol=1e-2) and abs(whole.bias - parts.bias) < 1e-3
