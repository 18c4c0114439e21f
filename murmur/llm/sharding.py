"""Shards by extendible hashing.

The directory is indexed by the leading bits of a document's hash.  A bucket that holds
more than ``limit`` bytes splits on its next bit, others stay, so shards differ in depth.
The depths follow from the byte sums of hash prefixes, which are added up once for all
depths; documents themselves move once, to their shard.

Defined results: a null text has 0 bytes, a null id hashes like the empty text.  An empty
table has no shards, and empty buckets are not listed.  A bucket whose documents all have
one hash (one document above the limit, or repeated rows) cannot split on any bit; it
stays one shard with ``oversized`` set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.storage import partitions_for, stored

#: Bits of the hash, all within a signed 64-bit integer.
BITS = 60


def hash_bits(key: Column) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(bits: str, depth: str | int) -> Column:
    return F.expr(f"shiftright({bits}, cast({BITS} - {depth} AS int))")


def _cells(hashed: DataFrame, depth: int) -> DataFrame:
    return hashed.groupBy(_prefix("bits", depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("bits").alias("low"), F.max("bits").alias("high")
    )


def directory(hashed: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(cell, depth, prefix, shard_bytes, shard_docs, oversized) per cell of the global depth, and that depth.

    ``hashed`` has (bits, bytes).  The global depth starts four bits beyond what evenly
    filled shards need and grows until each cell fits or holds one hash only.
    """
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(0, (total // limit).bit_length()) + 4)
    while True:
        cells = stored(_cells(hashed, depth), "shard-cells")
        crowded = cells.where((F.col("bytes") > limit) & (F.col("low") < F.col("high")))
        if depth == BITS or crowded.isEmpty():
            break
        depth = min(BITS, depth + 6)
    # Each cell counts for its buckets of all depths; a bucket is a shard if it is the
    # shallowest on the cell's path that need not split.
    paths = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, cast({depth} - depth AS int))")
    )
    buckets = paths.groupBy("depth", "prefix").agg(
        F.sum("bytes").alias("shard_bytes"),
        F.sum("docs").alias("shard_docs"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    whole = buckets.where((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))).drop("low", "high")
    fits = paths.select("cell", "depth", "prefix").join(whole, ["depth", "prefix"])
    shard = F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("shard")
    found = fits.groupBy("cell").agg(shard).select("cell", "shard.*")
    return stored(found.withColumn("oversized", F.col("shard_bytes") > limit), "shard-directory"), depth


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, shard, depth, shard_bytes, shard_docs, oversized) per document.

    ``doc`` holds the document's columns.  ``shard`` is the bucket's bits as text, empty
    if one shard holds all.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    hashed = stored(docs.select(hash_bits(F.col(key)).alias("bits"), size.alias("bytes")), "shard-hashes")
    shards, depth = directory(hashed, limit)
    rows = docs.select(F.struct("*").alias("doc"), hash_bits(F.col(key)).alias("bits"))
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    joined = rows.withColumn("cell", _prefix("bits", depth)).join(shards, "cell")
    return joined.select("doc", name.alias("shard"), "depth", "shard_bytes", "shard_docs", "oversized")


def write_shards(assigned: DataFrame, folder: str) -> DataFrame:
    """Write each shard as one Parquet folder below ``folder`` and read the table back.

    A shard goes to one task, which holds it within the byte limit.
    """
    dealt = assigned.repartition(partitions_for(assigned), "shard")
    dealt.withColumn("bucket", F.concat(F.lit("b"), F.col("shard"))).write.partitionBy("bucket").parquet(folder)
    return assigned.sparkSession.read.parquet(folder).drop("bucket")
