import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from armspark.functions import hashing
from armspark.functions.chi2 import chi2_upper_tail
from armspark.functions.columns import (
    binarize_treatment,
    column_name,
    revert_label,
    strat_key,
    threshold_label,
)


def test_binarize_and_null_arm(spark, spec):
    df = spark.createDataFrame(
        [("Mens E-Mail",), ("No E-Mail",), (None,)], "segment string"
    )
    assert [r.treatment for r in binarize_treatment(df, spec).collect()] == [1, 0, 1]
    with pytest.raises(Exception, match="NULL in arm"):
        binarize_treatment(df, spec, strict=True).collect()
    with pytest.raises(ValueError, match="segment"):
        binarize_treatment(df.withColumnRenamed("segment", "arm"), spec)


def test_names_and_labels(spark):
    assert column_name("price range", "over $2,500!") == "price_range_over_2_500_"
    assert column_name("zip_code", "Urban") == "zip_code_Urban" and column_name("é/a") == "_a"
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "t int, y int")
    got = df.select(revert_label("t", "y").alias("z"), strat_key("t", "y").alias("k")).collect()
    assert [r.z for r in got] == [1, 0, 0, 1]
    assert [r.k for r in got] == ["1_1", "1_0", "0_1", "0_0"]
    p = spark.createDataFrame([(0.5,), (0.49,)], "p double")
    assert [r[0] for r in p.select(threshold_label("p", 0.5)).collect()] == [1, 0]


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 5, 7, 30, 101])
def test_chi2_tail_against_integration(spark, dof):
    """Upper tail by numeric integration of the density."""
    for x in (0.3, 2.0, 9.5, 40.0, 120.0):
        # In u = sqrt(x) the density is finite at zero for every dof.
        u = np.linspace(0, math.sqrt(x), 400_001)
        scale = 2 / (2 ** (dof / 2) * math.gamma(dof / 2))
        inside = np.trapezoid(scale * u ** (dof - 1) * np.exp(-u * u / 2), u)
        df = spark.createDataFrame([(x, dof)], "x double, dof int")
        got = df.select(chi2_upper_tail(F.col("x"), F.col("dof"))).first()[0]
        assert got == pytest.approx(1 - inside, abs=1e-8)


def test_chi2_tail_extremes(spark):
    df = spark.createDataFrame(
        [(1e9, 1), (1e9, 4), (0.0, 3), (5.0, 0), (900.0, 2000)], "x double, dof int"
    )
    p = [r[0] for r in df.select(chi2_upper_tail(F.col("x"), F.col("dof"))).collect()]
    assert p[0] == 0.0 and p[1] == 0.0 and p[2] == 1.0 and p[3] == 1.0
    assert p[4] == pytest.approx(1.0)


def test_unit_hash_is_stable_and_uniform(spark):
    df = spark.range(20_000).withColumn("h", hashing.unit_hash("id", 42, 1))
    first = {r.id: r.h for r in df.collect()}
    again = {r.id: r.h for r in df.repartition(7).collect()}
    assert first == again
    values = np.array(list(first.values())) / 2**32
    assert abs(values.mean() - 0.5) < 0.01 and 0 <= values.min() and values.max() < 1
    other = {r.id: r.h for r in spark.range(50).withColumn("h", hashing.unit_hash("id", 43, 1)).collect()}
    assert any(other[i] != first[i] for i in other)


def test_unit_hash_stays_small_below_filters(spark):
    df = spark.range(10).withColumn("h", hashing.unit_hash("id", 42, 1)).where("h % 2 = 0")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") <= 2


def test_column_and_array_mixers_agree(spark):
    numbers = [0, 1, 2, 12345, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "h bigint")
    ours = [r[0] for r in df.select(hashing.mix_column(F.col("h"))).collect()]
    assert ours == hashing.mix_array(np.array(numbers, dtype=np.uint32)).tolist()


def test_poisson_weights_have_mean_and_variance_one():
    unit = np.random.default_rng(0).integers(-(2**63), 2**63, 4000)
    w = hashing.poisson_matrix(unit, hashing.replicate_words(200)).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    # Replicates are unrelated.
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
