"""Archives of tables with any column names and of pages without payloads; split patterns other than the known one."""

import random

import public_tokenizers
import pytest
import tiktoken

from murmur.llm import byte_bpe, warc

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_columns_with_any_name(spark, tmp_path):
    names = "_class _last _copies _type _refers_to _body _digest digest last type payload time key".split()
    schema = "page_id bigint, url string, html string, " + ", ".join(f"{n} string" for n in names)
    extra = ["x"] * len(names)
    pages = spark.createDataFrame([(1, "u", "same", *extra), (2, "v", "same", *extra), (3, None, None, *extra)], schema)
    index = {r["record_key"]: r for r in warc.capture_index(pages, str(tmp_path / "w")).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in index.items()} == {
        "1": ("revisit", "2"), "2": ("response", None), "3": ("response", None),
    }


def test_pages_without_payload_close_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a.b/", None) for i in range(200)], "page_id bigint, url string, html string")
    files = warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), revisit_bytes=1, file_bytes=4_000)
    counts = [r["records"] for r in files.collect()]
    assert sum(counts) == 200 and len(counts) > 5 and max(counts) < 40
    assert warc.read_runs(files, str(tmp_path / "w")).count() == 200


@pytest.mark.parametrize("pattern", [r"[a-z]+ [a-z]+|[\s\S]", r"(\p{L}+ )+|[\s\S]", r"[\s\S]+", r"[a-z]+"])
def test_other_patterns_split_as_the_library_does(pattern):
    ranks = byte_bpe.read_ranks(PATH)
    library = tiktoken.Encoding("any", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own, rng = byte_bpe.codec(PATH, pattern), random.Random(5)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdeé the") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12)))
        assert own.encode(text) == library.encode_ordinary(text)


def test_the_known_pattern_is_the_one_of_the_query():
    assert byte_bpe.CHUNK_PATTERN == public_tokenizers.PATTERN
