"""Every block of enough words that an earlier document has goes, whatever its lines do elsewhere."""

import random

from murmur.llm import line_dedup as L


def sentences(seed: int, n: int, words: int = 9) -> list:
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) + "." for _ in range(n)]


def test_runs_cover_each_block():
    rng = random.Random(2)
    for _ in range(300):
        own, other = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        size = [3, 7, 1, 12]
        want = set()
        for i in range(len(own)):
            for j in range(len(other)):
                k = 0
                while i + k < len(own) and j + k < len(other) and own[i + k] == other[j + k]:
                    k += 1
                if sum(size[x] for x in own[i : i + k]) >= 25:
                    want.update(range(i, i + k))
        args = own, [size[x] for x in own], other, [size[x] for x in other]
        assert L.repeated_lines(*args, 25) == sorted(want)


def test_blocks_behind_earlier_lines_short_lines_and_other_order(spark):
    passage, p, q = sentences(1, 7), sentences(2, 5), sentences(3, 5)
    verse = [f"v{i}." for i in range(60)]
    texts = [[line, *sentences(50 + i, 3)] for i, line in enumerate(passage)]
    texts += [sentences(10, 3) + passage, sentences(11, 3) + passage]
    texts += [verse + sentences(12, 3), sentences(13, 3) + verse]
    texts += [p + sentences(14, 2) + q, q + sentences(15, 2) + p]
    texts += [sentences(16, 4) * 2, sentences(16, 4)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r["doc"]["doc_id"]: r["result"]["removed_lines"] for r in L.deduplicate_lines(docs).collect()}
    gone = {8: [*range(3, 10)], 10: [*range(3, 63)], 12: [*range(5), *range(7, 12)], 14: [*range(4)]}
    assert found == {i: gone.get(i, []) for i in range(len(texts))}
