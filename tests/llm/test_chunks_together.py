"""The unknown chunks of a text go to the library as one text and get the same ids."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from murmur.llm import chunks, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_of_chunks_encoded_together_are_the_texts():
    library = Tokenizer.from_file(PATH)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    rng = random.Random(4)
    parts = ["a", "Word", "don't", "12", "é", "漢字", "🙂", "\0", "\n", "\t", " ", "  ", " ", " ", "...", "x\ny", *added]
    texts = ["", " ", " a", *("".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(60))) for _ in range(1500))]
    encode = token_files.encoder(PATH, 2)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(encode(text)), "<u2").tolist() == want, repr(text)


def test_unknown_chunks_are_handed_over_together(monkeypatch):
    given = []

    class Counting:
        def __init__(self, held):
            self._held = held

        def __getattr__(self, name):
            return getattr(self._held, name)

        def encode_batch_fast(self, texts, **options):
            given.append(len(texts))
            return self._held.encode_batch_fast(texts, **options)

    class Library:
        from_file = staticmethod(lambda path: Counting(Tokenizer.from_file(path)))

    monkeypatch.setattr("tokenizers.Tokenizer", Library)
    encode = token_files.encoder.__wrapped__(PATH, 2)
    encode(" ".join(f"word{i}" for i in range(500)))
    assert sum(given) <= 2


def test_a_new_generation_knows_all_chunks_of_a_text(monkeypatch):
    monkeypatch.setattr(chunks, "GENERATION", 3)
    memory = chunks.ChunkMemory(lambda found: [c.upper() for c in found])
    for text in ("a b c d", "a b x y", "c d e f a", "a  b c"):
        assert "".join(memory(text)) == text.upper()
