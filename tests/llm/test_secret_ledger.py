"""The ledger reads what is unseen once, and gives every path what its content has."""

import random
import re

from pyspark.sql import functions as F

from murmur.llm import secret_ledger as S

KEY = "AKIA" + "Q7" * 8


def found(ledger, history, columns=("path", "version")):
    rows = ledger.findings(history, list(columns)).collect()
    return sorted((*r["version"], [(x["kind"], x["first"], x["end"]) for x in r["findings"]]) for r in rows)


def plain(text):
    """The base kinds by their definition."""
    text = text or ""
    spans = []
    for kind, pattern, group, least in (("assign", "(?i)" + S.ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        spans += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, re.A) if len(m.group(group)) >= least]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def scanned(batch):
    return sorted((r["blob"], tuple(sorted(r["rules"]))) for r in batch.collect())


def test_matches_are_the_plain_ones():
    rng = random.Random(5)
    parts = ["token", "secret=", "API_KEY", ": ", "=", "'", '"', " ", "abc", "0123456789abcdef" * 2, KEY, "AKIA", "é", "🙂", "\n", "password"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        got = [(r.kind, a, b) for r in S.BASE for a, b in S.matches(r, text)]
        assert sorted(got) == sorted(plain(text)), text


def test_more_kinds():
    texts = {
        "pem": "x -----BEGIN RSA PRIVATE KEY----- y", "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl",
        "forge": "ghp_" + "a1B2" * 9, "login": "see postgres://me:hunter2@db",
    }
    for kind, text in texts.items():
        assert kind in {r.kind for r in S.MORE for _ in S.matches(r, text)}


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    rows = [("a", 1, "token = abcdef1"), ("a", 2, "none"), ("b", 1, "token = abcdef1"), ("c", 1, None), ("d", 1, "")]
    history = spark.createDataFrame(rows, "path string, version int, text string")
    ledger = S.Ledger(spark, str(tmp_path / "l"), S.BASE)
    first = ledger.update(history)
    assert len(scanned(first)) == 3
    assert found(ledger, history) == [
        ("a", 1, [("assign", 0, 15)]), ("a", 2, []), ("b", 1, [("assign", 0, 15)]), ("c", 1, []), ("d", 1, []),
    ]
    assert ledger.update(history).count() == 0
    later = history.union(spark.createDataFrame([("a", 3, f"key {KEY}")], history.schema))
    assert [r["blob"] for r in ledger.update(later).collect()] == [later.where("version = 3").select(S.blob()).first()[0]]
    # A changed rule is another version: it reads all, the others nothing.
    changed = (S.Rule("assign", S.ASSIGN, group=2, least=8, any_case=True), *S.BASE[1:])
    again = S.Ledger(spark, str(tmp_path / "l"), changed)
    assert {rules for _, rules in scanned(again.update(later))} == {(changed[0].version,)}
    assert {tuple(r[:2]) for r in found(again, later) if r[2]} == {("a", 3)}
    assert {tuple(r[:2]) for r in found(ledger, later) if r[2]} == {("a", 1), ("b", 1), ("a", 3)}
    # An interrupted batch has no marker and is not read.
    (tmp_path / "l" / "batch-broken").mkdir()
    assert found(again, later) == found(S.Ledger(spark, str(tmp_path / "l"), changed), later)


def test_many_unseen_blobs_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FEW_BLOBS", 0)
    old = spark.createDataFrame([(1, "token: first1")], "id int, text string")
    new = spark.createDataFrame([(i, f"token: value{i % 7}x") for i in range(40)], old.schema)
    ledger = S.Ledger(spark, str(tmp_path / "l"))
    ledger.update(old)
    assert ledger.update(old.union(new)).count() == 7


def test_hot_content(spark, tmp_path):
    rows = [(i, f"secret={KEY}" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    history = spark.createDataFrame(rows, "id int, text string").repartition(6)
    ledger = S.Ledger(spark, str(tmp_path / "l"))
    assert ledger.update(history).count() == 4001
    rows = ledger.findings(history, ["id"]).collect()
    assert len(rows) == 6000
    assert {r["version"]["id"] for r in rows if len(r["findings"]) == 2} == set(range(0, 6000, 3))


def test_odd_input(spark, hard_docs, no_docs, tmp_path):
    ledger = S.Ledger(spark, str(tmp_path / "l"))
    unscanned = ledger.findings(hard_docs, ["doc_id"]).collect()
    assert len(unscanned) == 13 and all(r["findings"] is None for r in unscanned)
    ledger.update(hard_docs.withColumn("blob", F.lit("x")).withColumn("findings", F.lit(1)))
    named = hard_docs.withColumn("findings", F.col("doc_id"))
    rows = ledger.findings(named, ["doc_id", "findings", "rank"]).collect()
    assert len(rows) == 13 and all(r["findings"] is not None for r in rows)
    assert ledger.update(no_docs).count() == 0
    assert ledger.findings(no_docs, ["doc_id"]).count() == 0
    fresh = S.Ledger(spark, str(tmp_path / "n"))
    assert fresh.update(no_docs).count() == 0
