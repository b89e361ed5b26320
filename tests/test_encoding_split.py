import math

import pytest
from pyspark.sql import functions as F

from armspark.operators import encoding, split
from armspark.operators.profile import stratum_counts
from armspark.spec import ExperimentSpec


def test_one_hot(units, spec):
    encoder = encoding.fit_one_hot(units, spec)
    out = encoder.transform(units, ("unit_id",))
    assert out.columns[1:6] == list(spec.numeric)
    assert "history_segment_7_1_000_" in out.columns and "zip_code_Urban" in out.columns
    zips = [c for c in out.columns if c.startswith("zip_code_")]
    assert zips == sorted(zips)
    total = sum(F.col(c) for c in zips)
    assert out.select(total.alias("s")).distinct().collect() == [(1,)]


def test_one_hot_null_and_unseen(spark):
    spec = ExperimentSpec(numeric=("x",), categorical=("c",))
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, None)], "x double, c string")
    encoder = encoding.fit_one_hot(train, spec)
    test = spark.createDataFrame([(1.0, None), (1.0, "new"), (1.0, "b")], "x double, c string")
    assert [tuple(r)[1:] for r in encoder.transform(test).collect()] == [(0, 0), (0, 0), (0, 1)]


def test_one_hot_errors(spark, units, spec):
    with pytest.raises(ValueError, match="zip_code"):
        encoding.fit_one_hot(units.drop("zip_code"), spec)
    with pytest.raises(ValueError, match="recency"):
        encoding.fit_one_hot(units.drop("recency"), spec)
    clash = spark.createDataFrame([("a b",), ("a-b",)], "c string")
    with pytest.raises(ValueError, match="collide"):
        encoding.fit_one_hot(clash, ExperimentSpec(numeric=(), categorical=("c",)))
    with pytest.raises(ValueError, match="leaked"):
        encoding.fit_one_hot(units, ExperimentSpec(numeric=("treatment",)))


def test_wide_encoding(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("c"), F.lit(1.0).alias("x"))
    spec = ExperimentSpec(numeric=("x",), categorical=("c",))
    assert len(encoding.fit_one_hot(df, spec).names) == 3001
    vector = encoding.fit_features(df, spec).transform(df).first()["features"]
    assert vector.size == 3001


def test_vector_agrees_with_columns(units, spec):
    columns = encoding.fit_one_hot(units, spec).transform(units, ("unit_id",))
    vectors = encoding.fit_features(units, spec).transform(units).select("unit_id", "features")
    by_id = {r.unit_id: r.features.toArray().tolist() for r in vectors.collect()}
    assert all(list(r)[1:] == by_id[r.unit_id] for r in columns.collect())


def test_split_is_exact_proportional_and_reproducible(units, spec):
    table = split.stratified_split(units, spec, 0.2, seed=42)
    n = units.count()
    test = table.where("split = 'test'")
    assert test.count() == math.ceil(n * 0.2) and table.count() == n
    whole = {r.stratum: r["count"] for r in stratum_counts(units, spec).collect()}
    part = {r.stratum: r["count"] for r in stratum_counts(test, spec).collect()}
    assert all(abs(part[s] - whole[s] * 0.2) < 1 for s in whole)
    ids = {r.unit_id for r in test.select("unit_id").collect()}
    again = split.stratified_split(units.repartition(9), spec, 0.2, seed=42)
    assert ids == {r.unit_id for r in again.where("split = 'test'").collect()}
    other = split.stratified_split(units, spec, 0.2, seed=7)
    assert ids != {r.unit_id for r in other.where("split = 'test'").collect()}


def test_split_with_many_bins_equals_one_bin(units, spec, monkeypatch):
    few = {r.unit_id for r in split.stratified_split(units, spec).where("split='test'").collect()}
    monkeypatch.setattr(split, "_ROWS_PER_BIN", 1)
    many = {r.unit_id for r in split.stratified_split(units, spec).where("split='test'").collect()}
    assert few == many


def test_allocation(spark):
    def allocate(sizes, share):
        df = spark.createDataFrame(sorted(sizes.items()), "stratum string, size bigint")
        return {r.stratum: r["take"] for r in split.allocate(df, share).collect()}

    assert allocate({"a": 10, "b": 10}, 0.2) == {"a": 2, "b": 2}
    got = allocate({"a": 7, "b": 5, "c": 3}, 0.3)
    assert sum(got.values()) == math.ceil(15 * 0.3) and got == {"a": 2, "b": 2, "c": 1}
    many = allocate({f"{i:05d}": 10 + i % 7 for i in range(12_000)}, 0.25)
    assert sum(many.values()) == math.ceil(sum(10 + i % 7 for i in range(12_000)) * 0.25)
    huge = allocate({"a": 3 * 10**17, "b": 10**17 + 1}, 0.5)
    assert sum(huge.values()) == 2 * 10**17 and huge["a"] == 15 * 10**16
    with pytest.raises(ValueError, match="single row"):
        allocate({"a": 1, "b": 10}, 0.2)
    with pytest.raises(ValueError, match="strata"):
        allocate({"a": 2, "b": 2, "c": 2}, 0.2)
    with pytest.raises(ValueError, match="between"):
        allocate({"a": 5}, 1.0)


def test_split_refuses_repeated_keys_and_other_values(units, spec):
    twice = units.withColumn("unit_id", F.col("unit_id") % 7)
    with pytest.raises(ValueError, match="unique"):
        split.stratified_split(twice, spec)
    with pytest.raises(ValueError, match="conversion"):
        split.stratified_split(units.withColumn("conversion", F.col("conversion") * 5), spec)
    with pytest.raises(ValueError, match="treatment"):
        split.stratified_split(units.withColumn("treatment", F.lit(None).cast("int")), spec)


def test_split_of_nothing(units, spec):
    with pytest.raises(ValueError, match="empty"):
        split.stratified_split(units.where("false"), spec)
