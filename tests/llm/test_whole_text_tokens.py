"""Token files hold what the library gives for the whole text, added tokens included."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from murmur.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_are_read_as_the_library_reads_them(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n z", "<| endoftext|> it's"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    files = token_files.write_token_files(docs, str(tmp_path / "t"), PATH, 2, public_tokenizers.PATTERN, vocabulary=50_257)
    library = Tokenizer.from_file(PATH)
    for row in token_files.read_token_files(files, str(tmp_path / "t")).collect():
        want = np.array(library.encode(texts[row["doc_id"]], add_special_tokens=False).ids + [2], "<u4")
        assert row["n_tokens"] == len(want) and row["ids_crc32"] == zlib.crc32(want.tobytes())


def test_strings_of_all_of_unicode():
    library, encode, rng = Tokenizer.from_file(PATH), token_files.encoder(PATH), random.Random(1)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(points)
    # Every code point at both sides of a cut, and spaces beside it.
    for start in range(0, len(points), 40):
        text = "".join(rng.choice((" {0} ", "{0} ", " {0}", "{0}", "  {0}", "a{0} {0}b")).format(chr(c)) for c in points[start : start + 40])
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(encode(text)) == want


def test_tokenizers_that_reach_over_cuts_get_whole_texts():
    plain = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "normalizer": None}
    token = {"content": "<x>", "lstrip": False, "rstrip": False, "single_word": False}
    assert token_files.cuts_are_safe(plain | {"added_tokens": [token]})
    for other in ({"content": "a b"}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}):
        assert not token_files.cuts_are_safe(plain | {"added_tokens": [token | other]})
    assert not token_files.cuts_are_safe(plain | {"normalizer": {"type": "NFC"}})
