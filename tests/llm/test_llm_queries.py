"""Registered text queries against DuckDB where SQL can express them, and the pipeline against its parts."""

import duckdb
import pytest

import corpus_pipeline
from armspark.llm.queries import LLM_ORACLES, LLM_QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, SMALL)
    cursor = con.execute(LLM_ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))


def test_native_queries_run_no_python(spark):
    for name in ("op4_secret_ownership", "op6_fair_queue"):
        plan = LLM_QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        sizes.append(docs.count())
        assert docs.columns[: len(columns)] == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert [s[0] for s in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, SMALL).count() == sizes[-1]
