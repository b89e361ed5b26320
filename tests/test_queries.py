"""Every registered query against DuckDB on the smallest tables, and the shape of key plans."""

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from armspark.plans.oracles import oracle_queries
from armspark.plans import registry
from armspark.plans.registry import QUERIES

TABLES = ("region", "nation", "customer", "orders", "lineitem")
ORACLES = oracle_queries()
LEARNED = ("gbt_baseline", "gbt_two_model", "gbt_class_transform", "effect_forest")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_sql_except_the_tree_learners():
    assert set(QUERIES) - set(ORACLES) == set(LEARNED) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cursor.fetchall(), names)


@pytest.mark.parametrize("name", LEARNED)
def test_learned_scores(spark, name, monkeypatch):
    """Complete and in range; the sizes are cut for the test alone."""
    for size, value in {"ROUNDS": 2, "NUISANCE_ROUNDS": 2, "DEPTH": 2, "TREES": 6}.items():
        monkeypatch.setattr(registry, size, value)
    rows = QUERIES[name](spark, SMALL).collect()
    assert len({r.unit_id for r in rows}) == len(rows) == 300 and all(-9 < r.score < 9 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 12


ROW_SCALE = (
    "experiment_view", "one_hot", "stratified_split", "cell_two_model", "rank_units", "top_k_split",
    "qini_curve", "pr_curve", "unmatched_scores", "bootstrap_weights",
)


@pytest.mark.parametrize("name", ROW_SCALE)
def test_no_single_partition_exchange(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_rows_are_dealt_once_for_running_totals(spark):
    """One exchange for the rows; the others carry a row per cell, and per tied score."""
    plan = QUERIES["qini_curve"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    assert plan.count("Exchange hashpartitioning(") <= 4 and "SortMergeJoin" not in plan


def test_changed_inputs_are_read_again(spark, tmp_path):
    for table in TABLES:
        spark.read.parquet(f"{SMALL}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    before = QUERIES["arm_labels"](spark, str(tmp_path)).count()
    assert QUERIES["arm_labels"](spark, str(tmp_path)).count() == before
    half = spark.read.parquet(f"{SMALL}/orders.parquet").where("o_orderkey % 2 = 0")
    half.write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["arm_labels"](spark, str(tmp_path)).count() == half.count() < before


def test_scans_are_pruned(spark):
    plan = QUERIES["experiment_view"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "o_orderpriority" not in plan and "c_name" not in plan
    plan = QUERIES["class_weight"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<visit:int>" in plan


def test_dialect_files_do_not_grow_with_the_table(spark, monkeypatch):
    """Files that one task reads whole: their number grows, not their size; the records stay the same."""
    folder = "/root/testdata/sf0.001"
    few = sorted(map(str, registry.QUERIES["csv_dialect"](spark, folder).collect()))
    monkeypatch.setattr(registry, "ROWS_PER_FILE", 100)
    path = registry._written_dialect(spark, folder)
    sizes = spark.read.text(path).where(~F.startswith("value", F.lit("unit_id"))).groupBy(F.col("_metadata.file_path")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 250
    assert sorted(map(str, registry.QUERIES["csv_dialect"](spark, folder).collect())) == few
