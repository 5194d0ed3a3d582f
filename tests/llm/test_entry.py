"""The registered queries: names, oracles on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from docloom.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert {*names, "pipeline"} <= entry.queries().keys()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, spark.createDataFrame(want.df()[columns], got.select(*columns).schema).collect()))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if i < 4:
            assert out.columns == docs.columns and out.count() > 0.3 * now.count(), name
            now = spark.createDataFrame(out.collect(), docs.schema)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() >= now.select("doc_id").distinct().count()


def test_pipeline_odd(odd, spark, sf):
    now = odd
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if i < 4:
            assert out.columns == odd.columns
            now = spark.createDataFrame(out.collect(), odd.schema)
    assert out.count() > 0


def test_pipeline_empty(none, spark, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
