import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armspark.operators import balance, profile
from armspark.spec import ExperimentSpec


def test_dataset_report(units, spec):
    rows = {(r.section, r.item): r for r in profile.dataset_report(units, spec).collect()}
    assert rows["shape", "rows"]["count"] == 1200
    assert rows["shape", "columns"]["count"] == len(units.columns)
    treated = units.where("treatment = 1").count()
    assert rows["arm", "treatment"]["count"] == treated
    assert rows["arm", "treatment"]["pct"] == round(treated / 12, 2)


def test_missing_report_counts_null_and_nan(spark):
    df = spark.createDataFrame(
        [(1, None, 1.0), (2, "x", float("nan")), (3, None, None)], "a int, b string, c double"
    )
    got = {r.column_name: (r.missing_count, r.missing_pct) for r in profile.missing_report(df).collect()}
    assert got == {"b": (2, 66.667), "c": (2, 66.667)}


def test_actual_effect_and_empty_arm(spark):
    df = spark.createDataFrame(
        [(t, y) for t, y in zip([1, 0, 1, 0, 1, 1, 0], [1, 0, 0, 1, 1, 1, 0])], "t int, y int"
    )
    row = profile.actual_effect(df, "t", "y").first()
    assert row["effect"] == pytest.approx(3 / 4 - 1 / 3) and (row["n_treated"], row["n_control"]) == (4, 3)
    row = profile.actual_effect(df.where("t = 1"), "t", "y").first()
    assert row["effect"] is None and row["n_control"] == 0


def test_rates_and_effects(units, spec):
    pdf = units.toPandas()
    got = {r.outcome: r for r in profile.outcome_rates(units, spec).collect()}
    for y in spec.outcomes:
        means = pdf.groupby("treatment")[y].mean()
        assert got[y].control_rate == pytest.approx(means[0])
        assert got[y].treatment_rate == pytest.approx(means[1])
    lonely = {r.outcome: r for r in profile.outcome_rates(units.where("treatment = 1"), spec).collect()}
    assert lonely["visit"].control_rate is None
    effect = {r.outcome: r for r in profile.naive_effect(units, spec).collect()}["visit"]
    means = pdf.groupby("treatment")["visit"].mean()
    assert effect.relative_lift_pct == round((means[1] - means[0]) / means[0] * 100, 2)


def test_histogram_matches_numpy(units, spec):
    got = profile.density_histogram(units, spec, ["recency", "history"]).toPandas()
    pdf = units.toPandas()
    for feature in ("recency", "history"):
        for arm in (0, 1):
            density, edges = np.histogram(
                pdf.loc[pdf.treatment == arm, feature], bins=30, density=True
            )
            rows = got[(got.feature == feature) & (got.treatment == arm)].sort_values("bin")
            assert np.allclose(rows.density, density) and np.allclose(rows.bin_start, edges[:-1])


def test_numeric_balance(units, spec):
    pdf = units.toPandas()
    got = {r.feature: r for r in balance.numeric_balance(units, spec).collect()}
    for f in spec.numeric:
        t, c = pdf.loc[pdf.treatment == 1, f], pdf.loc[pdf.treatment == 0, f]
        smd = (t.mean() - c.mean()) / math.sqrt((t.std() ** 2 + c.std() ** 2) / 2)
        assert got[f].smd == pytest.approx(smd, abs=6e-5)
    assert balance.numeric_balance(units, spec, []).columns == [
        "feature", "control_mean", "treatment_mean", "smd", "flag",
    ]


def test_single_row_arm_has_zero_smd(spark):
    df = spark.createDataFrame([(1, 5.0), (0, 1.0), (0, 2.0)], "treatment int, x double")
    row = balance.numeric_balance(df, ExperimentSpec(numeric=("x",))).first()
    assert (row.smd, row.flag) == (0.0, "ok")


def by_hand_chi2(table):
    table = np.asarray(table, float)
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    gap = np.abs(table - e)
    if (table.shape[0] - 1) * (table.shape[1] - 1) == 1:
        gap = gap - np.minimum(0.5, gap)
    return (gap**2 / e).sum()


def test_categorical_balance(units, spec):
    pdf = units.toPandas()
    got = {r.feature: r for r in balance.categorical_balance(units, spec).collect()}
    for f in spec.categorical:
        table = pd.crosstab(pdf[f], pdf.treatment)
        assert got[f].chi2 == pytest.approx(by_hand_chi2(table), abs=6e-4)
        assert got[f].dof == len(table) - 1
    # two values: one degree of freedom, continuity-corrected, p from the normal tail
    row = got["history_segment"]
    assert row.p_value == pytest.approx(math.erfc(math.sqrt(row.chi2 / 2)), abs=2e-3)


def test_single_arm_and_single_value_tables(units, spec):
    rows = balance.categorical_balance(units.where("treatment = 1"), spec).collect()
    assert all((r.chi2, r.p_value, r.flag) == (0.0, 1.0, "ok") for r in rows)


def test_randomization_check_passes_and_fails(spark):
    rng = np.random.default_rng(0)
    n = 2000
    t = rng.integers(0, 2, n)
    pdf = pd.DataFrame(
        {"treatment": t, "x": rng.normal(size=n), "c": rng.choice(["a", "b", "c"], n)}
    )
    spec = ExperimentSpec(numeric=("x",), categorical=("c",))
    row = balance.randomization_check(spark.createDataFrame(pdf), spec).first()
    assert row.passed and row.n_flagged == 0 and row.flagged == ""
    shifted = pdf.assign(x=pdf.x + 5 * t, c=np.where(t == 1, "a", pdf.c))
    row = balance.randomization_check(spark.createDataFrame(shifted), spec).first()
    assert not row.passed and row.flagged == "x,c"


def test_split_balance_reference(units, spec):
    table = units.withColumn("split", F.when(F.col("unit_id") % 2 == 0, "train").otherwise("test"))
    rates = {("visit", 0): 0.5, ("visit", 1): 0.5, ("conversion", 0): 0.5, ("conversion", 1): 0.5}
    reference = balance.reference_table(table, rates, 1 / 3)
    rows = balance.split_balance(table, spec, reference).collect()
    assert len(rows) == 6
    assert {r.flag for r in rows if r.metric == "visit_rate"} == {"DEVIATES"}
    assert balance.any_deviation(balance.split_balance(table, spec, reference)).first()[0]
    # an empty arm compares as ok
    lonely = balance.split_balance(table.where("treatment = 1"), spec, reference, ["visit"]).collect()
    assert {r.control for r in lonely if r.metric == "visit_rate"} == {None}


def test_null_arm_is_on_neither_side(spark, spec):
    df = spark.createDataFrame([(0,), (1,), (None,)], f"{spec.treatment} int")
    assert sorted((r["treatment"], r["count"]) for r in profile.treatment_split(df, spec).collect()) == [(0, 1), (1, 1)]
