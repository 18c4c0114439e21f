"""Leaves, trees, proofs and folds against a plain version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from murmur.llm import merkle
from tests.llm.conftest import prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(said))


def plain_tree(leaves):
    """Root, and the partners of every leaf from the leaf upwards."""
    level, partners, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            partners[i].append((other < place, level[other]) if other < len(level) else (False, ""))
            at[i] = place // 2
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], partners


def plain_results(rows, shown):
    """For rows (doc_id, source, lang, n_chars, text): sorted results."""
    by_lang = {}
    for row, other in zip(rows, shown):
        by_lang.setdefault(row[2], []).append((row[0], plain_leaf(row), plain_leaf(other)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = plain_tree([r[1] for r in by_lang[lang]])
    root, upper = plain_tree([trees[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for (doc_id, leaf, digest), steps in zip(by_lang[lang], trees[lang][1]):
            steps = steps + upper[k]
            for left, partner in steps:
                digest = sha(partner + digest if left else digest + partner)
            proof = sha("".join(p for _, p in steps))
            out.append((doc_id, lang, leaf, trees[lang][0], root, proof, digest, digest == root))
    return sorted(out, key=repr)


COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def more(row):
    return row[3] + 1 if row[3] is not None and row[0] is not None and row[0] % 5 == 0 else row[3]


@pytest.mark.parametrize("height", [1, 3])
def test_equals_plain_trees(spark, height):
    rng = random.Random(height)
    langs = ["en"] * 70 + ["é"] * 20 + [None] * 9 + ["de"] * 3 + ["z", "", "a"]
    rows = [(rng.randrange(60) if i % 4 else 10_000 + i, rng.choice(["s", None]), lang, rng.choice([None, 5, 77]), rng.choice([None, "", "tëxt", f"t{i}"]))
            for i, lang in enumerate(langs)]
    rows += rows[:5] * 6 + [(None, "s", "en", 1, "x"), (2**62 + 1, "s", "en", 1, "x"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    presented = {"n_chars": F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    shown = [(*r[:3], more(r), r[4]) for r in rows]
    got = merkle.verified(docs, presented, height=height).collect()
    want = plain_results(rows, shown)
    # Rows that differ in nothing that is hashed may change places.
    assert sorted(map(tuple, got), key=repr) == want
    assert 0 < sum(r["verified"] for r in got) < len(rows)


def test_tree_sizes(spark):
    """One language of each size."""
    rows = [(i, "s", f"{n:02d}", 1, f"t{i}") for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33) for i in range(n)]
    got = merkle.verified(spark.createDataFrame(rows, COLUMNS), height=2).collect()
    assert sorted(map(tuple, got), key=repr) == plain_results(rows, rows)


def test_proofs_lead_to_the_root(spark):
    rows = [(i, "s", "en" if i % 3 else "de", 1, prose(30, i)) for i in range(50)]
    for r in merkle.verified(spark.createDataFrame(rows, COLUMNS), height=3, proofs=True).collect():
        steps = r["proof"].split()
        assert merkle.fold(r["leaf"], steps) == r["root"] == r["folded_root"]
        assert r["proof_sha256"] == sha("".join(step[1:] for step in steps))
        assert not steps or merkle.fold(sha("other"), steps) != r["root"]


def test_odd_input(spark, hard_docs, no_docs):
    named = hard_docs.withColumns({"pos": F.lit(1), "tree": F.lit("x"), "digest": F.lit("y"), "block": F.lit(2)})
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in hard_docs.collect()]
    got = merkle.verified(named, height=2).collect()
    assert sorted(map(tuple, got), key=repr) == plain_results(rows, rows)
    assert merkle.verified(no_docs).count() == 0
