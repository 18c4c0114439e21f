"""Source divergence audit: how far the sources of a language are apart, and by which terms.

A language keeps the terms that stand in at least ``least_docs`` of its documents.  Every group, a
source within a language, and every language give each kept term a smoothed share p in whole
billionths.  Two groups diverge by the sum over the kept terms of floor((p - q)^2 / q), in both
directions; a group's own terms are those with a larger share than in its language.

The work is a cube.  A task owns the cell (group block, group block, term block) and holds the two
slices of counts that belong to it; a slice is copied to all cells of its group block, and of two
blocks only the cell in rising order exists.  A cell computes both directions of the divergence of
its pairs over the terms that stand in its slices, and the cells on the diagonal the leading terms
of their groups.  Cells are then reduced along the term axis: partial sums are added up, what the
terms that stand in neither group add follows from their number, and leading terms are ranked again.

A cell holds at most 2 x ``group_block`` groups and about ``term_block`` terms.  Terms are counted in
their tasks before they are shuffled, so frequent terms and a source with a third of all rows arrive
as one row per task.

Shares are whole numbers and computed exactly: long division in three steps of a thousand, so that
counts of up to 9 * 10^15 do not overflow.  Sums stay below (10^9 + V)^2.

Defined results: null text, language and source are read as empty ones.  A group without kept terms
has p from the smoothing alone, and pairs of a language without kept terms have value 0.  Equal
values are ranked by the item's UTF-8 bytes.  Repeated rows count each time.  An empty table gives
no rows.  Texts of any length are read whole.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.storage import stored
from murmur.llm.texts import rows_of

BILLION = 1_000_000_000
GROUP_BLOCK, TERM_BLOCK = 16, 8192
#: Different terms of a task's groups that are held before they are passed on.
HELD_TERMS = 500_000


def _letters() -> bytes:
    """For each byte what it becomes: A to Z in lower case, a to z and all of 128 and up as they are, the rest a blank."""
    table = bytearray(b" " * 256)
    for c in (*range(97, 123), *range(128, 256)):
        table[c] = c
    for c in range(65, 91):
        table[c] = c + 32
    return bytes(table)


LETTERS = _letters()


def terms(text: str | None) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A to Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), a row or more for each; a null term for the group itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, having) in held.items():
                found = [None, *(t.decode("utf-8", "surrogatepass") for t in times)]
                columns = [
                    pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()),
                    pa.array(found, pa.string()), pa.array([0, *times.values()], pa.int64()),
                    pa.array([0, *(having[t] for t in times)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in rows_of(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                times, having = held[lang, source]
                before = len(times)
                own = Counter(terms(text))
                times.update(own)
                having.update(own.keys())
                size += len(times) - before
            if size > HELD_TERMS:
                yield from passed()
                held.clear()
                size = 0
        yield from passed()

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return read.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / (total + kept)) for whole numbers, without overflow."""
    below = total + kept
    rest = np.broadcast_to(counts + 1, np.broadcast_shapes(np.shape(counts), np.shape(below)))
    share = np.zeros(rest.shape, np.int64)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, below)
        share = share * 1000 + step
    return share + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


CELL = "lang string, g bigint, h bigint, term string, value bigint, present bigint"


def cell(rows: pd.DataFrame, on_diagonal: bool, top: int) -> pd.DataFrame:
    """What a cell gives: for each ordered pair of groups the sum over the terms that stand in the cell and
    their number, and on the diagonal the leading terms of each group.

    ``rows`` are (side, g, term, n, group_n, lang_n, lang_total, kept); a null term tells of a group only.
    """
    heads = rows[rows["term"].isna()].drop_duplicates(["side", "g"]).sort_values("g")
    body = rows[rows["term"].notna()]
    kept, lang_total = int(rows["kept"].iloc[0]), int(rows["lang_total"].iloc[0])
    codes, names = pd.factorize(body["term"])
    out = []
    sides = {}
    for side, own in heads.groupby("side"):
        at = pd.Index(own["g"])
        counts = np.zeros((len(own), len(names)), np.int64)
        mine = (body["side"] == side).to_numpy()
        counts[at.get_indexer(body["g"][mine]), codes[mine]] = body["n"][mine]
        sides[side] = own["g"].to_numpy(), counts, shares(counts, own["group_n"].to_numpy()[:, None], kept)
    lower, upper = sides[0], sides[0 if on_diagonal else 1]
    for (groups, _, p), (others, _, q) in ((lower, upper), (upper, lower))[: 1 if on_diagonal else 2]:
        for i, g in enumerate(groups):
            sums = divergence(p[i][None, :], q).sum(axis=1)
            out.append(pd.DataFrame({"g": g, "h": others, "term": None, "value": sums, "present": len(names)})[others != g])
    if on_diagonal and len(names):
        by_lang = np.zeros(len(names), np.int64)
        by_lang[codes] = body["lang_n"]
        q = shares(by_lang, np.int64(lang_total), kept)
        groups, counts, p = lower
        for i, g in enumerate(groups):
            own = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            values = divergence(p[i][own], q[own])
            if len(own) > top:
                # All that tie with the last one stay, to be told apart by their names.
                least = np.partition(values, len(values) - top)[len(values) - top]
                own, values = own[values >= least], values[values >= least]
            out.append(pd.DataFrame({"g": g, "h": None, "term": names[own], "value": values, "present": 0}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["g", "h", "term", "value", "present"])


def audit(
    docs: DataFrame, least_docs: int = 3, top: int = 200, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK
) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``part`` pair, all other sources, and term, the ``top`` leading terms."""
    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counted = counted.select(
        "lang", "source", "term", "n", F.sum("docs").over(of_term).alias("having"), F.sum("n").over(of_term).alias("lang_n")
    )
    kept = F.col("term").isNotNull() & (F.col("having") >= least_docs)
    counted = stored(counted.where(F.col("term").isNull() | kept).drop("having"), "term-counts")
    # One row for each group: what it counts, its number within the language, and the language's figures.
    in_lang = Window.partitionBy("lang")
    groups = counted.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    langs = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.first("lang_n").alias("n"))
    langs = langs.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    groups = groups.withColumns(
        {"g": F.row_number().over(in_lang.orderBy("source")).cast("bigint") - 1, "n_groups": F.count("*").over(in_lang)}
    )
    zero = F.lit(0).cast("bigint")
    groups = groups.join(langs, "lang", "left").withColumns(
        {"kept": F.coalesce("kept", zero), "lang_total": F.coalesce("lang_total", zero)}
    )
    groups = stored(groups, "term-groups")
    blocks = F.ceil(F.col("n_groups") / group_block).cast("int")
    slices = F.greatest(F.ceil(F.col("kept") / term_block), F.lit(1))
    figures = groups.select(
        "lang", "source", "g", "group_n", "lang_total", "kept", blocks.alias("blocks"), slices.alias("slices"),
        F.floor(F.col("g") / group_block).cast("int").alias("own"),
    )
    known = figures.select("lang", "source", "g", "group_n", "lang_total", "kept", "blocks", "slices", "own")
    body = counted.where("term IS NOT NULL").join(known, ["lang", "source"]).withColumn(
        "slice", F.pmod(F.xxhash64("term"), "slices")
    )
    heads = known.withColumns({"term": F.lit(None).cast("string"), "n": zero, "lang_n": zero})
    heads = heads.withColumn("slice", F.explode(F.sequence(zero, F.col("slices") - 1)))
    columns = ["lang", "g", "term", "n", "group_n", "lang_n", "lang_total", "kept", "blocks", "own", "slice"]
    replicated = body.select(columns).union(heads.select(columns)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    cells = replicated.select(
        "lang", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "slice",
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        "g", "term", "n", "group_n", "lang_n", "lang_total", "kept",
    )

    def compute(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = cell(rows, key[1] == key[2], top)
        found["lang"] = key[0]
        return found.astype({"g": "Int64", "h": "Int64", "value": "int64", "present": "int64"})[
            ["lang", "g", "h", "term", "value", "present"]
        ]

    found = stored(cells.groupBy("lang", "low", "high", "slice").applyInPandas(compute, CELL), "divergence-cells")
    return _reduced(found, groups, top)


def _reduced(found: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Cells united along the term axis, and ranked."""
    p0 = F.expr(f"CASE WHEN kept > 0 THEN 1 + {BILLION}L div (group_n + kept) END")  # a share without occurrences
    names = groups.select("lang", "g", "source", "kept", p0.alias("p0"))
    pairs = found.where("term IS NULL").groupBy("lang", "g", "h").agg(
        F.sum("value").alias("value"), F.sum("present").alias("present")
    )
    others = names.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = pairs.join(names, ["lang", "g"]).join(others, ["lang", "h"])
    absent = F.expr("CASE WHEN kept > present THEN (kept - present) * ((p0 - q0) * (p0 - q0) div q0) ELSE 0L END")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + absent).alias("value"))
    leading = found.where("term IS NOT NULL").join(names, ["lang", "g"])
    leading = leading.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, leading)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top))
