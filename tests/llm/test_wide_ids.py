"""Ids beyond 2 ** 53 keep all their documents."""

import random

from murmur.llm import fingerprints


def test_every_document_of_a_table_of_hash_ids_comes_out(spark):
    rng = random.Random(3)
    ids = sorted({rng.randrange(-(1 << 63), 1 << 63) | 1 for _ in range(200)} | {(1 << 63) - 1, -(1 << 63) + 1})
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "t")], "doc_id bigint, text string")
    for rows, want in ((docs, [None, *ids]), (docs.where("doc_id IS NOT NULL"), ids)):
        pairs = fingerprints.next_documents(
            rows, lambda n, own, following: (n, following), "doc_id bigint, following string", "doc_id", "text", bucket_rows=20
        )
        texts = ["t" if i is None else f"t{i}" for i in want]
        found = {r["doc_id"]: r["following"] for r in pairs.collect()}
        assert found == dict(zip(want, texts[1:] + texts[:1]))
        assert pairs.count() == len(want)
