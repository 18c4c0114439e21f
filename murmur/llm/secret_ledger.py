"""Secret scans over the history of files, with a ledger of what was scanned.

Every version of every path is addressed by the hash of its content.  The ledger holds, for each
content (blob), the rule versions that have read it and what they found.  An update reads only
blobs that some current rule version has not seen, each of them once however many paths have it,
and with the missing rules only; a changed rule is another version.  Findings are then joined
back to all paths.

A third of all rows may share one content.  Equal texts are united in their tasks before they are
shuffled; when findings are joined back, a blob with more than a thousandth of the rows (there are
at most a thousand) is dealt over several tasks, and its findings are copied to each.

A ledger is a folder of batches; readers take those whose write has finished.  Two updates at once
may both scan a blob, which changes nothing, as equal findings count once.

Defined results: a null text is read as an empty one; it has no findings, but is in the ledger.
Repeated rows keep their number.  An empty table adds an empty batch and gives no rows.  Texts are
read whole, whatever their length.  Only the named columns are read, and they come back in a
struct, so that no name clashes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.storage import stored
from murmur.llm.texts import rows_of
from murmur.sinks import storage as files

BATCH = "blob string, rules array<string>, findings array<struct<rule:string,first:bigint,end:bigint>>"
#: Unseen blobs that may be broadcast: 64 bytes each, so 13 MB at most.
FEW_BLOBS = 200_000
HOT_SHARE = 1000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches that do not overlap, of which some fail.

    A match passes if ``group`` has ``least`` characters or more.  Patterns are Python's, and
    letters stand for ASCII letters only where ``any_case`` is set.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def version(self) -> str:
        said = repr((self.pattern, self.group, self.least, self.any_case))
        return f"{self.kind}@{hashlib.sha256(said.encode()).hexdigest()[:16]}"


#: The base kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, group=2, least=6, any_case=True),
    # A run is matched whole, so asking for its length is the same as dropping short matches.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds by their published shapes.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("login", r"[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._~!-]{4,64}@"),
)
RULES = BASE + MORE


@lru_cache(maxsize=64)
def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def matches(rule: Rule, text: str) -> Iterator[tuple[int, int]]:
    """First and end of what the rule finds, in code points."""
    for found in _compiled(rule).finditer(text):
        if found.end(rule.group) - found.start(rule.group) >= rule.least:
            yield found.span()


def blob(text: str = "text") -> Column:
    """The address of a text: the hash of its UTF-8 bytes."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


class Ledger:
    """The ledger below ``folder`` for a set of rules."""

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES):
        if len({rule.kind for rule in rules}) != len(rules):
            raise ValueError("two rules of one kind")
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules
        self._by_version = {rule.version: rule for rule in rules}

    def batches(self) -> list[str]:
        """Folders of the finished batches."""
        named = (f"{self.folder}/{name}" for name in files.children(self.spark, self.folder))
        return sorted(path for path in named if files.complete(self.spark, path))

    def read(self) -> DataFrame:
        """(blob, rules, findings): one row for each blob in the ledger."""
        paths = self.batches()
        if not paths:
            return self.spark.createDataFrame([], BATCH)
        rows = self.spark.read.schema(BATCH).parquet(*paths)
        united = (F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("rules", "findings"))
        return rows.groupBy("blob").agg(*united)

    def unseen(self, blobs: DataFrame) -> DataFrame:
        """(blob, missing): the current rule versions that have not read a blob, where there are any."""
        current = F.array(*map(F.lit, self._by_version))
        known = self.read().select("blob", "rules")
        seen = F.coalesce("rules", F.array().cast("array<string>"))
        missing = blobs.select("blob").distinct().join(known, "blob", "left")
        return missing.select("blob", F.array_except(current, seen).alias("missing")).where(F.size("missing") > 0)

    def update(self, history: DataFrame, text: str = "text") -> DataFrame:
        """Scan what is unseen of ``history``; return the new batch (blob, rules, findings)."""
        addressed = history.select(blob(text).alias("blob"), F.coalesce(text, F.lit("")).alias("text"))
        one_each = F.first("text").alias("text")
        if self.batches():
            unseen = stored(self.unseen(addressed), "unseen-blobs")
            if unseen.count() <= FEW_BLOBS:
                # A table of checked size, so that only texts that will be scanned are moved.
                addressed = addressed.join(F.broadcast(unseen.select("blob")), "blob", "left_semi")
            todo = addressed.groupBy("blob").agg(one_each).join(unseen, "blob")
        else:
            every = F.array(*map(F.lit, self._by_version)).alias("missing")
            todo = addressed.groupBy("blob").agg(one_each).select("blob", "text", every)
        rules = self._by_version

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("rule", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))]
            for part in rows_of(batches):
                blobs, texts, missing = part.columns
                missing = missing.to_pylist()
                found = [
                    [{"rule": v, "first": a, "end": b} for v in versions for a, b in matches(rules[v], body)]
                    for body, versions in zip(texts.to_pylist(), missing)
                ]
                columns = [blobs, pa.array(missing, kinds[1]), pa.array(found, kinds[2])]
                yield pa.RecordBatch.from_arrays(columns, ["blob", "rules", "findings"])

        path = f"{self.folder}/batch-{uuid.uuid4().hex}"
        todo.select("blob", "text", "missing").mapInArrow(scan, BATCH).write.parquet(path)
        return self.spark.read.schema(BATCH).parquet(path)

    def findings(self, history: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
        """(version, blob, findings) of every row: its ``columns`` as a struct, its address, and what the
        current rules found, as sorted structs of first, the kind's number, kind and end; null if no update
        has seen the blob."""
        rows = history.select(F.struct(*columns).alias("version"), blob(text).alias("blob"))
        rows = stored(rows, "versions")
        numbers = {rule.version: i for i, rule in enumerate(self.rules)}
        order = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))
        names = F.array(*(F.lit(rule.kind) for rule in self.rules))

        def placed(x: Column) -> Column:
            number = order[x["rule"]]
            return F.struct(x["first"].alias("first"), number.alias("number"), names[number].alias("kind"), x["end"].alias("end"))

        known = F.filter("findings", lambda x: order[x["rule"]].isNotNull())
        found = self.read().select("blob", F.array_sort(F.transform(known, placed)).alias("findings"))
        # At most HOT_SHARE blobs: each has more than that part of all rows.
        most = max(1, rows.count() // HOT_SHARE)
        hot = rows.groupBy("blob").count().where(F.col("count") > most)
        hot = F.broadcast(hot.select("blob", F.ceil(F.col("count") / most).cast("int").alias("parts")))
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.floor(F.rand(11) * F.col("parts"))).cast("int")
        dealt = rows.join(hot, "blob", "left").select("version", "blob", part.alias("part"))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        copied = found.join(hot, "blob", "left").select("blob", "findings", copies.alias("part"))
        return dealt.join(copied, ["blob", "part"], "left").drop("part")
