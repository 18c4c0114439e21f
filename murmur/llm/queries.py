"""One query per operator, and SQL that gives its rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import (
    byte_bpe,
    fingerprints,
    line_dedup,
    mixing,
    near_duplicates,
    quality,
    sharding,
    token_files,
    toxicity,
    warc,
)
from murmur.llm.registry import query, table
from murmur.session import scratch_path

END_OF_TEXT = 2
SHARD_BYTES = 1 << 20
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
TOXIC_FROM = 0.7


@query("""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), last AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex)
SELECT p.page_id, cast(strlen(p.body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast(('0x' || substr(p.hex, cast(1 + 5 * (i // 4) AS BIGINT), 5)) AS BIGINT)
           >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id = last.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> last.last THEN last.last END AS refers_to
FROM p JOIN last USING (hex)
""")
def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC, read back, and merged to one ordered capture index."""
    pages = table(spark, sf_dir, "pages").withColumn("captured_at", F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    index = warc.capture_index(pages, captured_at="captured_at", revisit_bytes=0)
    return index.select(
        F.expr("try_cast(record_key AS bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = toxicity.train(*toxicity.training_sample(docs, labels.where(~held_out)))
    scored = toxicity.with_scores(docs, model).select("doc.doc_id", "score")
    predicted = F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query()
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, and whether it is the one to keep."""
    found = near_duplicates.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_rows", "keep")


@query("""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || doc_id) AS key,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
         sum(source_size) OVER () * cast(1.5 AS DOUBLE) AS budget FROM s
), w AS (
  SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS filled FROM r
), l AS (SELECT *, filled / weight AS level FROM w
), m AS (
  SELECT *, (sum(filled) OVER o + level * (sum(weight) OVER () - sum(weight) OVER o)) <= budget AS is_full
  FROM l WINDOW o AS (ORDER BY level, rank ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, rank, source_size, budget, cast(CASE WHEN is_full THEN filled ELSE
    (budget - sum(CASE WHEN is_full THEN filled ELSE 0 END) OVER ())
    / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) * weight END AS DOUBLE) AS target
  FROM m
), q AS (
  SELECT d.doc_id, d.size, t.*, sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) AS queued
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT doc_id, size, rank, budget, (queued + e * source_size) / target AS finish
  FROM q, (VALUES (0), (1)) AS epochs(e) WHERE size > 0 AND target > 0
), f AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) <= budget AS taken FROM c
), k AS (SELECT doc_id, sum(size) FILTER (taken) AS taken FROM f GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, cast(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (doc_id)
""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.Mix(docs).plan().withColumnRenamed("doc", "doc_id")


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.with_verdicts(docs).select("doc.doc_id", "verdict.*")


@query(f"""
WITH d AS (
  SELECT doc_id, cast(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
         cast(('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS bits
  FROM documents
), p AS (SELECT d.*, depth, bits >> (60 - depth) AS prefix FROM d, range(41) AS depths(depth)
), b AS (
  SELECT depth, prefix, sum(bytes) AS shard_bytes, count(*) AS shard_docs, min(bits) = max(bits) AS alone
  FROM p GROUP BY depth, prefix
), f AS (
  SELECT p.doc_id, p.depth, p.prefix, b.shard_bytes, b.shard_docs FROM p JOIN b USING (depth, prefix)
  WHERE b.shard_bytes <= {SHARD_BYTES} OR alone
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), cast(depth AS INTEGER), '0') END AS shard,
       cast(depth AS INTEGER) AS depth, cast(shard_bytes AS BIGINT) AS shard_bytes, shard_docs,
       shard_bytes > {SHARD_BYTES} AS oversized
FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
""")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to shards of bounded size, and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = sharding.write_shards(sharding.assign(docs, SHARD_BYTES), scratch_path(spark, "shards"))
    return shards.select("doc.doc_id", "shard", "depth", "shard_bytes", "shard_docs", "oversized")


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    path, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_documents(docs, path, pattern, outputs=outputs)
    return encoded.select("doc.doc_id", *outputs)


@query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the blocks that an earlier one has, and which documents those are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicate_lines(docs).select("doc.doc_id", "result.*")


@query()
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


@query()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document from the token files that hold it."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "tokens")
    files = token_files.write_token_files(
        docs, folder, public_tokenizers.path(TOKENIZER), END_OF_TEXT, vocabulary=50_257
    )
    return token_files.read_token_files(files, folder, with_ids=False)
