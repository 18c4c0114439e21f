import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmur.operators import spikes as S
from murmur.settings import SpikeRule
from murmur.sinks.upsert import TrendTable

MINUTE = timedelta(minutes=1)
START = datetime(2026, 4, 18, 8)
SCHEMA = ("symbol string, window_start timestamp, window_end timestamp, mention_count bigint, "
          "last_seen timestamp")


def windows(spark, counts, symbol="BTC"):
    """One window per minute; None leaves a gap."""
    rows = [
        (symbol, START + i * MINUTE, START + (i + 5) * MINUTE, n, START + i * MINUTE)
        for i, n in enumerate(counts)
        if n is not None
    ]
    return spark.createDataFrame(rows, SCHEMA)


def judge(spark, mentions, baseline):
    fields = S.spike_fields(F.lit(mentions), F.lit(float(baseline)))
    return spark.range(1).select(*[c.alias(n) for n, c in fields.items()]).first()


@pytest.mark.parametrize(
    "mentions, baseline, expected",
    [
        (35, 3.5, (3.5, 10.0, True)),
        (4, 1, (1.0, 4.0, False)),
        (10, 0, (0.0, 10.0, True)),
        (30, -5, (0.0, 30.0, True)),
        (2996, 1000, (1000.0, 3.0, False)),
        (29, 10, (10.0, 2.9, False)),
    ],
)
def test_spike_fields(spark, mentions, baseline, expected):
    assert tuple(judge(spark, mentions, baseline)) == expected


def test_baseline_is_the_mean_of_earlier_windows(spark):
    rows = S.with_baseline(windows(spark, [3, 4, 5, 7])).orderBy("window_end").collect()
    assert [r.baseline_mention_count for r in rows] == [0.0, 3.0, 3.5, 4.0]


def test_baseline_skips_gaps_and_looks_back_six_windows(spark):
    counts = [100, 1, 2, None, 3, None, None, 4, 5, 6, 7]
    rows = S.with_baseline(windows(spark, counts)).orderBy("window_end").collect()
    assert rows[-1].baseline_mention_count == 3.5
    assert rows[-2].baseline_mention_count == round((100 + 1 + 2 + 3 + 4 + 5) / 6, 2)


def test_incomplete_rows_pass_through(spark):
    rows = [(None, START, START, 5, START), ("A", START, None, 5, START), ("B", START, START, None, START)]
    got = {r.symbol: r for r in S.flag_spikes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[None].is_spike is None and got["B"].is_spike is None
    assert (got["A"].baseline_mention_count, got["A"].growth_rate) == (0.0, 5.0)


def test_zscore(spark):
    rows = S.with_zscore(windows(spark, [1, 3, 5, 2])).orderBy("window_end").collect()
    assert [r.z_score for r in rows[:2]] == [None, None]
    assert rows[2].z_score == pytest.approx(3 / 2**0.5)
    assert S.with_zscore(windows(spark, [2, 2, 9])).where("z_score IS NOT NULL").count() == 0


def test_alerts(spark):
    alerts = S.spike_alerts(S.flag_spikes(windows(spark, [1, 1, 30]))).collect()
    assert [(a.message, a.payload["growth_rate"]) for a in alerts] == [("BTC mentions 30", "30.0")]


def _as_set(df):
    cols = ["symbol", "window_end", "mention_count", "baseline_mention_count", "growth_rate", "is_spike"]
    return {tuple(r) for r in df.select(cols).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_refresh_in_any_batches_equals_one_batch(spark, seed):
    rng = random.Random(seed)
    final = {}
    for symbol in ("BTC", "ETH"):
        for i in range(25):
            if rng.random() < 0.8:
                final[(symbol, i)] = rng.randrange(1, 60)
    steps = list(final) + rng.choices(list(final), k=10)
    rng.shuffle(steps)
    table = None
    for part in range(0, len(steps), 12):
        keys = sorted(set(steps[part:part + 12]))
        rows = [
            (s, START + i * MINUTE, START + (i + 5) * MINUTE, final[(s, i)], START) for s, i in keys
        ]
        batch = spark.createDataFrame(rows, SCHEMA)
        history = table.select(*batch.columns) if table is not None else batch.limit(0)
        changed = S.refresh_spikes(batch, history)
        if table is not None:
            changed = changed.unionByName(table.join(changed.select(*S.KEY), list(S.KEY), "left_anti"))
        table = spark.createDataFrame(changed.collect(), changed.schema)
    rows = [(s, START + i * MINUTE, START + (i + 5) * MINUTE, n, START) for (s, i), n in final.items()]
    assert _as_set(table) == _as_set(S.flag_spikes(spark.createDataFrame(rows, SCHEMA)))


def test_history_tail_keeps_open_windows_and_six_before(spark):
    kept = S.history_tail(windows(spark, range(1, 31)), 10 * MINUTE)
    assert sorted(r.mention_count for r in kept.collect()) == list(range(15, 31))
    rare = windows(spark, [1, 2], "RARE").unionByName(windows(spark, [1] * 60))
    assert S.history_tail(rare, 10 * MINUTE).where("symbol = 'RARE'").count() == 2


class TestTrendTable:
    """Batches written in order, with late updates, repeats and rows beyond the horizon."""

    def write(self, spark, table, batch_id, rows):
        table.write_batch(spark.createDataFrame(rows, SCHEMA), batch_id)

    def row(self, i, n, symbol="BTC"):
        return (symbol, START + i * MINUTE, START + (i + 5) * MINUTE, n, START + i * MINUTE)

    def expected(self, spark, final):
        return _as_set(S.flag_spikes(spark.createDataFrame([self.row(*k, *v) for k, v in final], SCHEMA)))

    def test_batches(self, spark, tmp_path):
        table = TrendTable(str(tmp_path / "t"))
        self.write(spark, table, 0, [self.row(i, 2) for i in range(50, 70)])
        self.write(spark, table, 1, [])
        # An update of an open window, a new window and a repeat of the batch.
        for _ in range(2):
            self.write(spark, table, 2, [self.row(66, 40), self.row(70, 9), self.row(70, 9, "ETH")])
        rows = {i: 2 for i in range(50, 70)} | {66: 40, 70: 9}
        expect = [((i,), (n,)) for i, n in rows.items()] + [((70,), (9, "ETH"))]
        assert _as_set(table.read(spark)) == self.expected(spark, expect)
        # A window far behind the horizon changes baselines that the tail no longer holds.
        self.write(spark, table, 3, [self.row(49, 50), self.row(120, 1)])
        rows |= {49: 50, 120: 1}
        expect = [((i,), (n,)) for i, n in rows.items()] + [((70,), (9, "ETH"))]
        assert _as_set(table.read(spark)) == self.expected(spark, expect)
        assert table.read(spark).count() == len(expect)

    def test_repeat_after_a_failure_before_publishing(self, spark, tmp_path, monkeypatch):
        table = TrendTable(str(tmp_path / "t"))
        self.write(spark, table, 0, [self.row(i, 2) for i in range(10)])
        import murmur.sinks.upsert as module

        def fail(*_args, **_kwargs):
            raise RuntimeError("lost")

        with monkeypatch.context() as patch:
            patch.setattr(module, "replace_partitions", fail)
            with pytest.raises(RuntimeError):
                self.write(spark, table, 1, [self.row(9, 30), self.row(10, 3)])
        self.write(spark, table, 1, [self.row(9, 30), self.row(10, 3)])
        rows = {i: 2 for i in range(10)} | {9: 30, 10: 3}
        expect = [((i,), (n,)) for i, n in rows.items()]
        assert _as_set(table.read(spark)) == self.expected(spark, expect)

    def test_rows_without_a_key_are_kept_apart(self, spark, tmp_path):
        table = TrendTable(str(tmp_path / "t"), SpikeRule())
        lost = (None, START, START + MINUTE, 3, START)
        self.write(spark, table, 0, [self.row(1, 5), self.row(1, 7), lost, lost])
        assert [r.mention_count for r in table.read(spark).collect()] == [7]
        assert spark.read.parquet(f"{table.root}/keyless").count() == 2
