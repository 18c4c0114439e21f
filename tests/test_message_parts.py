from pyspark.sql import functions as F

from murmur.plans.streams import write_part
from murmur.sinks import storage
from murmur.streaming.one_pass import POST, OnePass


def test_every_part_has_the_same_number_of_files(spark, tmp_path):
    folder = str(tmp_path / "messages")
    messages = spark.range(1_000).select(F.col("id").alias("arrival"), F.concat(F.lit("m"), "id").alias("value"))
    # Many messages, fewer than files, none.
    for turn, rows in enumerate((messages, messages.limit(2), messages.limit(0))):
        write_part(rows, folder, 5)
        assert sum(n.startswith("part-") for n in storage.children(spark, folder)) == 5 * (turn + 1)
    assert spark.read.text(folder).count() == 1_002


def test_a_batch_is_read_once(spark, tmp_path):
    rows = spark.range(50).select(
        *[F.col("id").cast("string").alias(c) for c in POST if c != "created_at"],
        F.timestamp_seconds("id").alias("created_at"),
        F.when(F.col("id") % 7 == 0, "bad_json").alias("invalid_reason"),
    )
    rows.write.parquet(str(tmp_path / "batch"))
    judged = OnePass(str(tmp_path / "rows"))._incoming(spark.read.parquet(str(tmp_path / "batch")), 0, 10_000_000)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    counts = {r["outcome"]: r["count"] for r in judged.groupBy("outcome").count().collect()}
    assert counts == {"bad_json": 8, "late": 9, "kept": 33}
