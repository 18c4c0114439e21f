"""Every query over a small table, against its SQL where it has one, and the pipeline."""

import math

import duckdb
import pytest

import corpus_pipeline
from murmur.llm.catalog import ORACLE, QUERIES
from murmur.llm.quality import with_verdicts

SF = "/root/testdata/sf0.001"


def plain(rows):
    clean = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(clean(v) for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert plain(df.select(columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_gives_a_row_per_document(spark, name):
    df = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = df.collect()
    assert len(rows) == n and len({r["doc_id"] for r in rows}) == n
    for r in rows:
        assert not any(isinstance(v, float) and math.isnan(v) for v in r)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given = docs.columns, docs.count()
    held = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append(docs)
        if name != "encode":
            assert docs.columns == columns
    ruled, cut, single, mixed, encoded = held
    kept = with_verdicts(spark.read.parquet(f"{SF}/documents.parquet")).where("verdict.kept").count()
    assert ruled.count() == kept < given
    assert 0 < single.count() <= cut.count() <= ruled.count()
    assert single.where("n_chars <> length(text)").count() == 0
    assert encoded.count() == mixed.count() > 0
    assert encoded.where("size(ids) <> n_tokens").count() == 0


def test_pipeline_takes_odd_input(spark, hard_docs, no_docs, tmp_path):
    for at, docs in enumerate((hard_docs, no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{at}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{at}{name}"))
        assert "ids" in docs.columns
