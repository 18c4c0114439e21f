import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row string, rank int"
WORDS = "the old river runs past a quiet town where few people speak of what came before and nobody asks".split()


def prose(n: int, seed: int) -> str:
    """Sentences of ten words; other seeds give other texts."""
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)]
    return " ".join(word + ("." if i % 10 == 9 else "") for i, word in enumerate(words))


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, prose(300, 1), "en", "a", 1, "x", "y", 1),
        (2, prose(300, 2), "en", "a", 1, "x", "y", 1),
        (2, prose(300, 2), "en", "a", 1, "x", "y", 1),
        (2, prose(120, 5), "en", "b", 1, "x", "y", 1),
        (3, prose(300, 1), None, None, None, None, None, None),
        (4, None, "en", "b", 0, "x", "y", 1),
        (5, "", "de", "b", 0, "x", "y", 1),
        (6, " \n\t ", "de", "c", 0, "x", "y", 1),
        (7, "ü é 漢字 🙂 ... !!! ###", "xx", "c", 0, "x", "y", 1),
        (8, "word " * 20_000, "en", "d", 0, "x", "y", 1),
        (9, prose(4_000, 3), "fr", "d", 0, "x", "y", 1),
        (None, prose(80, 4), "fr", "é", 0, "x", "y", 1),
        (None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
