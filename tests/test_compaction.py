from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from murmur.schemas import COLLECTOR_RECORD
from murmur.sinks import compaction, files, storage
from murmur.sources.files import read_partitioned_posts

TODAY = date(2026, 4, 20)


def store(spark, root, rounds):
    for turn in range(rounds):
        rows = [(f"{turn}-{i}", f"text {i} é ", datetime(2026, 4, 18 + i % 3, i % 24), ["btc", "007", "a b", "c+d", "e/f%20"][i % 5]) for i in range(60)]
        posts = spark.createDataFrame(rows, "id string, text string, created_at timestamp, target_coin string").repartition(3)
        files.store_raw_posts(posts, root, F.col("target_coin"), F.col("created_at"))


def rows_of(spark, root):
    return sorted(map(repr, read_partitioned_posts(spark, root, COLLECTOR_RECORD).collect()))


def per_folder(spark, root):
    found = compaction.stored_files(spark, root).groupBy("folder", "day").count().collect()
    return {r["folder"]: (r["day"], r["count"]) for r in found}


def test_small_files_are_joined_once(spark, tmp_path):
    root = str(tmp_path / "raw")
    store(spark, root, 3)
    want, before = rows_of(spark, root), per_folder(spark, root)
    assert compaction.compact(spark, root, TODAY) > 0
    after = per_folder(spark, root)
    assert rows_of(spark, root) == want and set(after) == set(before)
    assert all(n == 1 for day, n in after.values() if day < TODAY)
    # Folders that may still be written to are left alone.
    assert all(after[f] == before[f] for f, (day, _) in before.items() if day >= TODAY)
    assert any(n > 1 for _, n in after.values())
    assert compaction.compact(spark, root, TODAY) == 0 and per_folder(spark, root) == after
    assert storage.children(spark, f"{root}/_compaction") == []


def test_a_broken_run_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "raw")
    store(spark, root, 2)
    want = rows_of(spark, root)
    replace = compaction._replace

    def broken(spark, root, staged):
        # The worst moment: a folder is gone and the new one is not there yet.
        folder = sorted(f for f, (day, n) in per_folder(spark, root).items() if day < TODAY and n > 1)[0]
        storage.delete(spark, f"{root}/{folder}")
        raise OSError("lost")

    monkeypatch.setattr(compaction, "_replace", broken)
    try:
        compaction.compact(spark, root, TODAY)
    except OSError:
        pass
    assert rows_of(spark, root) != want
    monkeypatch.setattr(compaction, "_replace", replace)
    compaction.compact(spark, root, TODAY)
    assert rows_of(spark, root) == want
    assert all(n == 1 for day, n in per_folder(spark, root).values() if day < TODAY)


def test_joined_folders_are_moved_not_written_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "raw")
    store(spark, root, 2)
    want, move, moved = rows_of(spark, root), storage.replace, []

    def breaks(spark, source, target):
        if len(moved) == 3:
            raise OSError("lost")
        move(spark, source, target)
        moved.append((target, storage.children(spark, target)))

    monkeypatch.setattr(storage, "replace", breaks)
    try:
        compaction.compact(spark, root, TODAY)
    except OSError:
        pass
    monkeypatch.setattr(storage, "replace", move)
    compaction.compact(spark, root, TODAY)
    assert rows_of(spark, root) == want and len(moved) == 3
    assert all(storage.children(spark, folder) == names for folder, names in moved)
    assert storage.children(spark, f"{root}/_compaction") == []
