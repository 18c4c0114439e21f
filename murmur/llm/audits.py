"""Queries over secrets, the manifest and the sources, and SQL that gives their rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import divergence, merkle, secret_ledger
from murmur.llm.registry import query, table
from murmur.session import scratch_path


def _sql_pattern(rule: secret_ledger.Rule) -> str:
    """The pattern as a SQL string; letters of the names in either case."""
    pattern = rule.pattern
    if rule.any_case:
        names, rest = pattern.split(")", 1)
        pattern = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", names) + ")" + rest
    return pattern.replace("'", "''")


#: Characters that stand in no text, to mark matches with.
_OPEN, _CLOSE = "chr(57344)", "chr(57345)"

_FOUND = "\nUNION ALL ".join(
    f"SELECT doc_id, {i} AS number, '{rule.kind}' AS kind, {rule.least} AS least, {rule.group} AS part, "
    f"'{_sql_pattern(rule)}' AS pattern, "
    f"string_split(regexp_replace(text, '({_sql_pattern(rule)})', {_OPEN} || '\\1' || {_CLOSE}, 'g'), {_OPEN}) AS pieces FROM d"
    for i, rule in enumerate(secret_ledger.RULES)
)

_GROUP_2 = f"regexp_extract(found, '^(?:{_sql_pattern(secret_ledger.BASE[0])})$', 2)"


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), m AS ({_FOUND}
), p AS (SELECT doc_id, number, kind, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM m
), s AS (
  SELECT *, strpos(piece, {_CLOSE}) - 1 AS size,
         sum(length(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id, number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first
  FROM p
), f AS (
  SELECT doc_id, number, kind, cast(first AS BIGINT) AS first, left(piece, cast(size AS INTEGER)) AS found,
         kind || ':' || cast(first AS BIGINT) || ':' || cast(first + size AS BIGINT) AS span
  FROM s WHERE i > 1
), k AS (SELECT * FROM f WHERE number > 0 OR length({_GROUP_2}) >= 6
), g AS (
  SELECT doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access,
         count(*) FILTER (number = 2) AS n_hex,
         string_agg(span, ',' ORDER BY first, number) FILTER (number < 3) AS base,
         string_agg(span, ',' ORDER BY first, number) AS spans
  FROM k GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
""")
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the secrets that the ledger has for its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_ledger.Ledger(spark, scratch_path(spark, "secrets"))
    ledger.update(docs)
    found = ledger.findings(docs, ["doc_id"])

    def spans(kinds: tuple[secret_ledger.Rule, ...]) -> Column:
        own = F.filter("findings", lambda x: x["number"] < len(kinds))
        return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["first"], x["end"])), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("findings", lambda x: x["number"] == kind)).cast("bigint")

    return found.select(
        "version.doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(spans(secret_ledger.BASE).cast("binary"), 256).alias("base_sha256"),
        spans(secret_ledger.RULES).alias("spans"),
    )


def _field(column: str) -> str:
    text = f"cast({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
    string_split(cast(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""


@query(f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS shown
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM l
), t AS (
  SELECT lang, 0 AS level, pos, n, leaf AS digest FROM r
  UNION ALL
  SELECT a.lang, a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.digest || coalesce(b.digest, ''))
  FROM t a LEFT JOIN t b ON a.lang IS NOT DISTINCT FROM b.lang AND b.pos = a.pos + 1
  WHERE a.n > 1 AND a.pos % 2 = 0
), s AS (
  SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM s
  UNION ALL
  SELECT a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.digest || coalesce(b.digest, ''))
  FROM u a LEFT JOIN u b ON b.pos = a.pos + 1
  WHERE a.n > 1 AND a.pos % 2 = 0
), levels AS (
  SELECT DISTINCT lang, level, cast(NULL AS BIGINT) AS top FROM t WHERE n > 1
  UNION ALL SELECT s.lang, s.height + u.level, u.level FROM s JOIN (SELECT DISTINCT level FROM u WHERE n > 1) u ON true
), places AS (
  SELECT r.doc_id, r.leaf, r.lang, levels.level, top, CASE WHEN top IS NULL THEN r.pos >> levels.level ELSE s.pos >> top END AS at
  FROM r JOIN levels ON r.lang IS NOT DISTINCT FROM levels.lang JOIN s ON r.lang IS NOT DISTINCT FROM s.lang
), steps AS (
  SELECT p.doc_id, p.level, p.at % 2 = 1 AS after, coalesce(t.digest, u.digest, '') AS partner
  FROM places p
  LEFT JOIN t ON p.top IS NULL AND p.lang IS NOT DISTINCT FROM t.lang AND p.level = t.level AND t.pos = xor(p.at, 1)
  LEFT JOIN u ON p.top = u.level AND u.pos = xor(p.at, 1)
), f AS (
  SELECT doc_id, 0 AS level, shown AS digest FROM r
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(CASE WHEN after THEN partner || f.digest ELSE f.digest || partner END)
  FROM f JOIN steps ON f.doc_id = steps.doc_id AND f.level = steps.level
), proofs AS (
  SELECT doc_id, count(*) AS n_steps, string_agg(partner, '' ORDER BY level) AS proof FROM steps GROUP BY doc_id
), root AS (SELECT digest AS root FROM u WHERE n = 1)
SELECT r.doc_id, r.leaf, s.subroot, root.root, sha256(coalesce(proofs.proof, '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = root.root AS verified
FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root LEFT JOIN proofs USING (doc_id)
JOIN f ON f.doc_id = r.doc_id AND f.level = coalesce(proofs.n_steps, 0)
""")
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and the check of rows of which some were tampered with."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    shown = F.when(tampered, more.cast("string")).otherwise(F.col("n_chars").cast("string"))
    return merkle.verified(docs, {"n_chars": shown}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


@query(r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY lang, source, term
), ln AS (SELECT lang, count(*) AS kept, sum(n) AS total FROM v GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total, any_value(kept) AS kept, any_value(ln.total) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN ln USING (lang) GROUP BY lang, source
), p AS (
  SELECT lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + cast(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.total + kept) AS p,
         1 + cast(1000000000 AS HUGEINT) * (v.n + 1) // (lang_total + kept) AS q
  FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), empty AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, 0 AS value
  FROM g a JOIN g b USING (lang) WHERE a.source <> b.source AND a.kept IS NULL
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q
), every AS (FROM pairs UNION ALL FROM empty UNION ALL FROM terms
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
""")
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the leading terms of each."""
    return divergence.audit(table(spark, sf_dir, "documents"))
