"""Operators over whole tables, against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import line_dedup, mixing, near_duplicates, sharding, warc
from murmur.llm.components import components
from murmur.llm.texts import normal_words
from tests.llm.conftest import prose


def test_loser_tree_merges():
    random.seed(2)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted((random.randint(0, 50), r, i) for i in range(random.randint(0, 12))) for r in range(k)]
        merged = [runs[c][i] for c, i in warc.LoserTree(runs)]
        assert merged == sorted(x for run in runs for x in run)


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=C#top") == "com,example)/a?b=c"
    assert warc.url_key(None) == "" and warc.url_key("no url") == "no url"
    assert warc.url_key("http://[bad") == "http://[bad"


def test_archives_round_trip_and_order(spark, tmp_path):
    same, long = "same\r\n\r\nbody", "x" * 300_000
    rows = [(i, f"http://h{i % 3}.org/p", same if i % 2 else f"own {i}", 10 - i % 4, "k") for i in range(60)]
    rows += [(60, None, None, None, "k"), (61, "u", "", 3, "k"), (None, "http://a.b/c", same, 1, None), (62, "http://z.y/ a\n", long, 2, "k")]
    rows += [rows[1]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, at bigint, key string").repartition(5)
    index = warc.capture_index(pages, str(tmp_path / "w"), captured_at="at", file_bytes=400)
    held = [r for part in index.rdd.glom().collect() for r in part]
    order = [(r["url_key"], r["captured_at"] is not None, r["captured_at"] or 0) for r in held]
    assert order == sorted(order) and len(held) == len(rows)
    last = defaultdict(lambda: -1)
    for page, _, html, _, _ in rows:
        last[html or ""] = max(last[html or ""], -1 if page is None else page)
    texts = {str(p): h or "" for p, _, h, _, _ in rows if p is not None}
    for r in held:
        body = texts.get(r["record_key"], same)
        assert r["payload_digest"] == warc.digest32(body.encode()) and r["payload_bytes"] == len(body.encode())
        is_last = r["record_key"] == str(last[body])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if is_last else ("revisit", str(last[body])))
    # Each entry's place holds the record.
    for r in held[:5]:
        with open(tmp_path / "w" / r["file"], "rb") as file:
            file.seek(r["offset"])
            _, length, data = next(warc.members(file))
        assert length == r["length"] and warc.parse_record(data)["record_key"] == r["record_key"]


def test_archives_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.capture_index(none, str(tmp_path / "w")).count() == 0


def test_short_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id int, url string, html string")
    index = warc.capture_index(pages, str(tmp_path / "w"), revisit_bytes=5)
    assert {r["record_key"]: r["record_type"] for r in index.collect()} == {
        "1": "response", "2": "response", "3": "revisit", "4": "response",
    }


def test_targets_fill_up_by_weight(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 500), ("z", 0)], "source string, source_size bigint")
    rows = {r["source"]: r for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    assert [rows[s]["rank"] for s in ("a", "b", "c", "z", None)] == [1, 2, 3, 4, 5]
    assert sum(r["target"] for r in rows.values()) == pytest.approx(1.5 * 1610)
    assert rows["a"]["target"] == 20 and rows["c"]["target"] == 200 and rows["z"]["target"] == 0
    # b weighs 1 and the null source, fifth in order, weighs 1: b takes what the others cannot.
    assert rows[None]["target"] == 1000 and rows["b"]["target"] == pytest.approx(1195)


def test_mix_meets_targets(spark, hard_docs, no_docs):
    rows = [(i, "w " * (1 + i * 7 % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    mix = mixing.Mix(docs, block_rows=100)
    plan = mix.plan().collect()
    assert len(plan) == 3000
    for r in plan:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for target in {r["target"] for r in plan}:
        own = [r for r in plan if r["target"] == target]
        assert abs(sum(r["taken"] for r in own) - target) <= 150
    assert sum(r["taken"] for r in plan) <= 1.5 * sum(r["size"] for r in plan)
    often = Counter(r["doc_id"] for r in mix.copies().collect())
    assert all(often[r["doc"]] * r["size"] == r["taken"] for r in plan)
    assert sorted(map(tuple, mixing.Mix(docs.repartition(3), block_rows=100).plan().collect())) == sorted(map(tuple, plan))
    hard = mixing.Mix(hard_docs, block_rows=2)
    assert hard.plan().count() == hard_docs.count()
    assert hard.copies().columns == hard_docs.columns
    assert mixing.Mix(no_docs).plan().count() == 0 and mixing.Mix(no_docs).copies().count() == 0


def test_shards_fit(spark, hard_docs, no_docs, tmp_path):
    rows = [(i, "é" * (i % 90), "s") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    found = sharding.write_shards(sharding.assign(docs, 5_000), str(tmp_path / "a")).collect()
    assert len(found) == 2000
    held = defaultdict(int)
    for r in found:
        held[r["shard"]] += 2 * (r["doc"]["doc_id"] % 90)
        assert len(r["shard"]) == r["depth"] and not r["oversized"]
    for name, size in held.items():
        assert size <= 5_000
        # The parent had to split.
        assert sum(v for n, v in held.items() if n.startswith(name[:-1])) > 5_000
    assert all(held[r["shard"]] == r["shard_bytes"] for r in found)
    assert not any(a != b and b.startswith(a) for a in held for b in held)
    odd = sharding.assign(hard_docs, 3_000)
    assert odd.count() == hard_docs.count()
    assert odd.where("oversized").select("doc.doc_id").distinct().count() >= 2
    assert sharding.assign(no_docs, 10).count() == 0


def test_patience_blocks():
    a, b = [1, 2, 3, 9, 4, 5, 6], [7, 1, 2, 3, 4, 5, 6, 8]
    assert line_dedup.patience(a, b) == [(0, 1, 3), (4, 4, 3)]
    assert line_dedup.patience([], [1]) == []
    assert line_dedup.patience([1, 1, 1], [1, 1]) == [(0, 0, 2)]


def test_lines_are_cut_and_put_together():
    text = "One two. Three four!\n\n five\nsix seven? "
    chars = line_dedup.utf8(text)
    starts, ends, words = line_dedup.line_spans(chars)
    assert [text[a:b] for a, b in zip(starts, ends)] == ["One two.", "Three four!", "five", "six seven?"]
    assert words.tolist() == [2, 2, 1, 2]
    assert line_dedup.without_lines(text, []) == "One two. Three four!\n\n five\nsix seven?"
    assert line_dedup.without_lines(text, [0]) == "Three four!\n\n five\nsix seven?"
    assert line_dedup.without_lines(text, [1, 2]) == "One two.\nsix seven?"
    assert line_dedup.without_lines(text, [0, 1, 2, 3]) == ""


def test_line_dedup(spark, hard_docs, no_docs):
    passage = prose(60, 41)
    rows = [(i, f"{prose(40, i + 1)} {passage} {prose(30, i + 200)}") for i in range(1, 12)]
    rows += [(20, prose(90, 500)), (21, prose(90, 500)), (22, "License text of seven words, version 2."), (23, "License text of seven words, version 2.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r["doc"]["doc_id"]: r["result"] for r in line_dedup.deduplicate_lines(docs).collect()}
    inner = " ".join(passage.split()[10:50])
    assert inner in found[1]["text"]
    for i in range(2, 12):
        assert inner not in found[i]["text"] and found[i]["partners"] == [1]
        assert found[i]["text"].startswith(prose(30, i + 1))
    assert found[20]["text"] == prose(90, 500) and found[21]["text"] == "" and found[21]["partners"] == [20]
    assert found[22]["text"] == found[23]["text"]
    hard = line_dedup.deduplicate_lines(hard_docs).collect()
    assert len(hard) == hard_docs.count()
    kept = {(r["doc"]["doc_id"], r["doc"]["text"]): r["result"]["text"] for r in hard}
    assert kept[1, prose(300, 1)] == prose(300, 1) and kept[3, prose(300, 1)] == ""
    assert kept[2, prose(300, 2)] == prose(300, 2) and kept[4, None] is None
    assert line_dedup.deduplicate_lines(no_docs).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    random.seed(1)
    for _ in range(1500):
        a = [random.randint(0, random.choice([3, 50])) for _ in range(random.randint(0, 25))]
        b = [x for x in a if random.random() > 0.1]
        b += [random.randint(0, 9) for _ in range(random.randint(0, 3))]
        most = random.randint(0, 10)
        want = plain_distance(a, b)
        got = near_duplicates.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), most)
        assert got == (want if want <= most else None)
        similar = near_duplicates.similar(np.array(a, np.uint32), np.array(b, np.uint32), 0.8)
        longer = max(len(a), len(b))
        assert (similar is not None) == (not longer or want <= int(0.2 * longer + 1e-9))


def test_components(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 300), (5, 5)]
    random.shuffle(edges)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


def plain_classes(texts):
    words = [normal_words(t).astype(np.uint32) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and near_duplicates.similar(words[i], words[j], 0.8) is not None:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edits(text, n, seed):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_against_all_pairs(spark, small_docs):
    base = [prose(120, 900), prose(200, 901)]
    made = [(1000 + i, edits(base[i % 2], i % 9, i)) for i in range(60)] + [(2000 + i, base[0].upper() + "!") for i in range(40)]
    docs = small_docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id bigint, text string"))
    rows = docs.orderBy("doc_id").collect()
    want = plain_classes([r["text"] for r in rows])
    found = {r["id"]: r for r in near_duplicates.classes(docs).collect()}
    assert len(found) == len(rows)
    assert [found[r["doc_id"]]["class_id"] for r in rows] == [rows[w]["doc_id"] for w in want]
    assert sum(r["keep"] for r in found.values()) == len(set(want))


def test_near_duplicates_of_odd_input(hard_docs, no_docs):
    rows = near_duplicates.classes(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["id"]].add(r["class_id"])
    assert by_id[1] == by_id[3] == {1} and by_id[4] == by_id[5] == by_id[6] == {4}
    assert by_id[None] == {4, None}
    kept = near_duplicates.one_of_each(hard_docs)
    assert kept.columns == hard_docs.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, 1, 2, 2, 4, 7, 8, 9]
    assert near_duplicates.one_of_each(no_docs).count() == 0
    assert near_duplicates.classes(no_docs).count() == 0
