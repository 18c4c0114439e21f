"""Merkle manifest of a table: leaves, roots, and proofs folded back to the root.

A row's leaf is the hash of its fields.  The leaves of a language, in order of their ids, are
a tree: runs of two become the hash of their concatenated digests, a node without a partner
the hash of its own, until one is left, the subroot.  The subroots in order of the languages
are the leaves of one more tree, and its last node is the root.

Trees are cut into superblocks of 2 ** ``height`` consecutive nodes.  Upwards, each superblock
is reduced in one group, and the results are the nodes of the next round.  Downwards, the nodes
of a superblock and the path outside of it, from its top to the root, are cogrouped: the group
finishes its own levels again and gives every node the path that the superblock below it needs.
At the leaves the same exchange joins each proof and folds the presented leaf up to the root.
So no group holds more than one superblock and one path of at most 64 digests, however large a
language is, and what moves are digests, never texts.

Defined results: a null field is hashed as ``-``, so it differs from an empty one.  Null ids
come first, and equal ids are ordered by their leaves; repeated rows are a leaf each.  A null
language is a tree of its own, before all others.  A lone leaf is its own subroot and a lone
subroot the root; an empty proof is the hash of nothing.  An empty table gives no rows.  Texts
of any length are hashed whole.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.storage import stored, tasks_for

HEIGHT = 10
#: Bytes of a row of digests in a shuffle, for the number of its tasks.
ROW_BYTES = 200
NODE = "tree string, block bigint, digest string"
OUTER = "tree string, block bigint, path string, subroot string, root string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def sha(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def reduced(digests: list[str], height: int) -> list[list[str]]:
    """The levels of a superblock from its nodes to its top.

    Fewer nodes than the superblock holds, in a tree's first, are the whole tree and end with
    the first lone node; see :func:`whole`.  Otherwise there are ``height`` levels above.
    """
    levels = [digests]
    while len(levels) <= height:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def whole(block: int, digests: list[str], height: int) -> list[list[str]]:
    """As :func:`reduced`, for superblock number ``block`` of its tree."""
    if block == 0 and len(digests) < 1 << height:
        height = (len(digests) - 1).bit_length()
    return reduced(digests, height)


def local_path(levels: list[list[str]], at: int) -> list[str]:
    """A step for each level: the partner's digest with its side, or a dot if there is none."""
    steps = []
    for level in levels[:-1]:
        partner = at ^ 1
        steps.append("." if partner >= len(level) else ("<" if partner < at else ">") + level[partner])
        at >>= 1
    return steps


def fold(digest: str, steps: list[str]) -> str:
    """The digest at the end of a path that begins with ``digest``."""
    for step in steps:
        side, partner = step[0], step[1:]
        digest = sha(partner + digest if side == "<" else digest + partner)
    return digest


def siblings(steps: list[str]) -> str:
    return "".join(step[1:] for step in steps)


def positioned(rows: DataFrame, order: list[str], name: str, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Add ``pos``, from 0, the place within ``tree`` by ``order``; ``rows`` must be a stored table.

    The rows are sorted over range partitions; equal ones are told apart by where they stood,
    so that many of them are spread too.  One row for each partition and tree in it tells how
    many come before.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order), F.col("tie")]
    ranged = rows.repartitionByRange(tasks_for(rows, row_bytes), *keys).sortWithinPartitions(*keys)
    # Written once: later reads see the same partitions, however often a task is run again.
    placed = stored(ranged.withColumn("at", F.monotonically_increasing_id()).drop("tie"), name)
    placed = placed.withColumn("part", F.shiftright("at", 33))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = counts.select("tree", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    found = placed.join(before, ["tree", "part"])
    return found.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", height))


def _digests(nodes: pd.DataFrame) -> list[str]:
    return nodes.sort_values("pos")["digest"].tolist()


def climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (tree, pos, digest) of each round, and the last ones (tree, digest)."""

    def top(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "digest": whole(key[1], _digests(held), height)[-1]})

    rounds = []
    while True:
        rounds.append(nodes)
        groups = _blocks(nodes.select("tree", "pos", "digest"), height).groupBy("tree", "block")
        tops = stored(groups.applyInPandas(top, NODE), "merkle-nodes")
        nodes = tops.select("tree", F.col("block").alias("pos"), "digest")
        if nodes.where("pos > 0").isEmpty():
            return rounds, nodes.select("tree", "digest")


def descend(rounds: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """The paths outside of what lies below each node of ``rounds``, from those at the top."""

    def paths(key: tuple, held: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        levels = whole(key[1], _digests(held), height)
        one = above.iloc[0]
        outside = one["path"].split()
        found = [" ".join(local_path(levels, i) + outside) for i in range(len(levels[0]))]
        return pd.DataFrame(
            {"tree": key[0], "block": sorted(held["pos"]), "path": found, "subroot": one["subroot"], "root": one["root"]}
        )

    for nodes in reversed(rounds):
        groups = _blocks(nodes.select("tree", "pos", "digest"), height).groupBy("tree", "block")
        outer = groups.cogroup(outer.groupBy("tree", "block")).applyInPandas(paths, OUTER)
    return outer


def leaves(docs: DataFrame, presented: dict[str, Column] | None = None) -> DataFrame:
    """(tree, doc_id, lang, digest, presented) of every row.

    ``presented`` are fields as someone else shows them; the leaf made with these goes into
    the proof's check, the table's own leaf into the tree.
    """
    own = {name: F.col(name) for name in FIELDS}
    shown = own | (presented or {})
    return docs.select(
        # Ordered as the languages are, and never null.
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        "doc_id", "lang",
        leaf(*own.values()).alias("digest"),
        leaf(*shown.values()).alias("presented"),
    )


RESULT = (
    "doc_id string, lang string, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def verified(docs: DataFrame, presented: dict[str, Column] | None = None, height: int = HEIGHT, proofs: bool = False) -> DataFrame:
    """Leaf, subroot, root, the digest of the proof, and the root that the presented row folds to.

    ``proofs`` adds ``proof``, the path from the leaf to the root, a step for each level:
    ``<`` or ``>`` and a partner's digest to the left or right, or a dot without a partner.
    """
    held = stored(leaves(docs, presented), "merkle-leaves")
    held = positioned(held, ["doc_id", "digest"], "merkle-order")
    rounds, subroots = climb(held, height)
    trees = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    trees = positioned(trees, ["of"], "merkle-trees")
    upper, roots = climb(trees, height)
    start = roots.select("tree", F.lit(0).cast("bigint").alias("block"), F.lit("").alias("path"),
                         F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = descend(upper, start, height)
    outer = above.join(trees.select(F.col("pos").alias("block"), "of", "digest"), "block").select(
        F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path", F.col("digest").alias("subroot"), "root"
    )
    outer = descend(rounds[1:], outer, height)

    def finish(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        one = above.iloc[0]
        outside = one["path"].split()
        levels = whole(key[1], rows["digest"].tolist(), height)
        rest = siblings(outside)
        ends: dict[str, str] = {}  # what a superblock's top folds to; nearly all rows share one

        def results() -> Iterator[tuple[str, str, str]]:
            for i, shown in enumerate(rows["presented"]):
                steps = local_path(levels, i)
                top = fold(shown, steps)
                if top not in ends:
                    ends[top] = fold(top, outside)
                yield sha(siblings(steps) + rest), ends[top], " ".join(steps + outside) if proofs else ""

        proof_sha, folded, paths = zip(*results())
        out = pd.DataFrame({
            "doc_id": rows["doc_id"].to_numpy(), "lang": rows["lang"].to_numpy(), "leaf": rows["digest"].to_numpy(),
            "subroot": one["subroot"], "root": one["root"], "proof_sha256": proof_sha, "folded_root": folded,
        })
        out["verified"] = out["folded_root"] == out["root"]
        if proofs:
            out["proof"] = paths
        return out

    # As text, because pandas has no whole numbers with nulls.
    named = _blocks(held, height).withColumns({c: F.col(c).cast("string") for c in ("doc_id", "lang")})
    found = named.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        finish, RESULT + ", proof string" * proofs
    )
    kinds = dict(docs.dtypes)
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in ("doc_id", "lang")})
