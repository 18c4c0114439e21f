"""Divergences and leading terms against a plain version in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import divergence as D


def plain_terms(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [t.translate(low) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_audit(rows, least=3, top=200):
    """rows (lang, source, text)."""
    having, groups = defaultdict(Counter), defaultdict(dict)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        own = Counter(plain_terms(text))
        having[lang].update(own.keys())
        groups[lang].setdefault(source, Counter()).update(own)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in having[lang].items() if n >= least]
        whole = sum((Counter({t: c[t] for t in kept}) for c in sources.values()), Counter())

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in sources.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def test_terms():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("aZ É[`{\x7f\x80ß漢🙂_-9\n\x00") for _ in range(rng.randrange(20)))
        assert [t.decode() for t in D.terms(text)] == plain_terms(text)
    assert D.terms(None) == []


def test_shares_do_not_overflow():
    rng = random.Random(4)
    for _ in range(500):
        total = rng.randrange(1, 9 * 10**15)
        count, kept = rng.randrange(total), rng.randrange(1, 10**9)
        got = D.shares(np.array([[count]]), np.array([[total]]), kept)
        assert int(got[0, 0]) == 1 + 10**9 * (count + 1) // (total + kept)


def made(seed, n=400, sources=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None, "ü"])
        source = f"s{rng.randrange(sources)}" if i % 3 else "hot"
        words = [rng.choice(["The", "É", "x"]) + rng.choice("abcdefg") * rng.randrange(1, 4) + source[0] for _ in range(rng.randrange(12))]
        rows.append((lang, source, " ".join(words)))
    return rows + [("xx", "a", "once"), ("xx", "b", None), ("yy", None, "solo solo"), ("zz", "a", "t t t")] + [("zz", "b", "t")] * 3


@pytest.mark.parametrize("group_block,term_block,top", [(16, 8192, 200), (2, 7, 3)])
def test_equals_plain_audit(spark, group_block, term_block, top):
    rows = made(group_block)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    got = D.audit(docs, top=top, group_block=group_block, term_block=term_block).collect()
    assert sorted(map(tuple, got)) == plain_audit(rows, top=top)


def test_partial_counts_are_passed_on(spark, monkeypatch):
    rows = made(9, 1500)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    monkeypatch.setattr(D, "HELD_TERMS", 5)
    found = D.term_counts(docs)
    total = sum(len(plain_terms(t)) for _, _, t in rows)
    assert found.agg(F.sum("n")).first()[0] == total


def test_odd_input(spark, hard_docs, no_docs):
    named = hard_docs.withColumns({"term": F.lit("x"), "g": F.lit(1), "slice": F.lit(2), "n": F.lit(3)})
    # Repeated rows reach the three documents that a term needs.
    rows = [(r["lang"], r["source"], r["text"]) for r in hard_docs.collect()] * 3
    thrice = named.union(named).union(named)
    assert sorted(map(tuple, D.audit(thrice, group_block=2).collect())) == plain_audit(rows)
    assert D.audit(no_docs).count() == 0
