"""Was the assignment random? Mean differences, chi-square tests, split balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chi2 import chi2_upper_tail
from ..functions.columns import ratio
from ..session import materialize
from ..spec import ExperimentSpec, require_columns
from .profile import rows_from_columns

FLAGGED = "IMBALANCED"
OK = "ok"
DEVIATES = "DEVIATES"

_NUMERIC_COLUMNS = "feature string, control_mean double, treatment_mean double, smd double, flag string"
_CATEGORICAL_COLUMNS = "feature string, chi2 double, dof int, p_value double, flag string"


def standardized_differences(df: DataFrame, spec: ExperimentSpec, features: Sequence[str]) -> DataFrame:
    """(pos, feature, control_mean, treatment_mean, smd), unrounded, all features in one pass.

    smd is 0 unless the pooled deviation is positive (a one-row arm has no deviation).
    """
    require_columns(df, (*features, spec.treatment))
    t = F.col(spec.treatment)
    parts = []
    for i, name in enumerate(features):
        for arm in (0, 1):
            value = F.when(t == arm, F.col(name).cast("double"))
            parts.append(F.avg(value).alias(f"mean_{i}_{arm}"))
            parts.append(F.stddev_samp(value).alias(f"sd_{i}_{arm}"))
    rows = []
    for i, name in enumerate(features):
        m0, m1 = F.col(f"mean_{i}_0"), F.col(f"mean_{i}_1")
        s0, s1 = F.col(f"sd_{i}_0"), F.col(f"sd_{i}_1")
        pooled = F.sqrt((s1 * s1 + s0 * s0) / 2.0)
        rows.append(
            {
                "pos": F.lit(i),
                "feature": F.lit(name),
                "control_mean": m0,
                "treatment_mean": m1,
                "smd": F.when(pooled > 0, (m1 - m0) / pooled).otherwise(0.0),
            }
        )
    return rows_from_columns(df.agg(*parts), rows)


def numeric_balance(
    df: DataFrame,
    spec: ExperimentSpec,
    features: Sequence[str] | None = None,
    smd_threshold: float = 0.1,
) -> DataFrame:
    """Means per arm, smd and flag; the flag looks at the unrounded smd."""
    names = spec.numeric if features is None else tuple(features)
    if not names:
        return df.sparkSession.createDataFrame([], _NUMERIC_COLUMNS)
    flag = F.when(F.abs("smd") > smd_threshold, FLAGGED).otherwise(OK)
    return standardized_differences(df, spec, names).select(
        "feature",
        F.round("control_mean", 4).alias("control_mean"),
        F.round("treatment_mean", 4).alias("treatment_mean"),
        F.round("smd", 4).alias("smd"),
        flag.alias("flag"),
    )


def contingency(df: DataFrame, spec: ExperimentSpec, features: Sequence[str]) -> DataFrame:
    """(feature, value, n_control, n_treated) for all features in one pass; NULLs are left out.

    Counts are combined before the shuffle, so a value held by a third of all rows costs one
    partial row per task.
    """
    require_columns(df, (*features, spec.treatment))
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features
    ]
    long = df.select(F.col(spec.treatment).alias("t"), F.inline(F.array(*pairs)))
    return (
        long.where("value is not null and t is not null")
        .groupBy("feature", "value")
        .agg(F.count_if(F.col("t") == 0).alias("n_control"), F.count_if(F.col("t") == 1).alias("n_treated"))
    )


def arm_shares(df: DataFrame, spec: ExperimentSpec, features: Sequence[str]) -> DataFrame:
    """Share of each value within each arm."""
    table = contingency(df, spec, features)
    # Summed per task first: a feature with many values is not one task's window.
    sums = table.groupBy("feature").agg(
        F.sum("n_control").alias("all_control"), F.sum("n_treated").alias("all_treated")
    )
    return table.join(sums, "feature").select(
        "feature",
        "value",
        ratio(F.col("n_control"), F.col("all_control")).alias("control_share"),
        ratio(F.col("n_treated"), F.col("all_treated")).alias("treatment_share"),
    )


def chi_square(df: DataFrame, spec: ExperimentSpec, features: Sequence[str]) -> DataFrame:
    """(feature, chi2, dof, p_value), unrounded.

    Everything after the contingency counts works on one row per category. With one degree of
    freedom each deviation shrinks by up to one half (continuity correction); a table with a
    single arm or a single value has no degree of freedom, so chi2 = 0 and p = 1.
    """
    counts = contingency(df, spec, features)
    totals = counts.groupBy("feature").agg(
        F.sum("n_control").alias("all_0"),
        F.sum("n_treated").alias("all_1"),
        F.count(F.lit(1)).alias("n_values"),
    )
    arms = (F.col("all_0") > 0).cast("int") + (F.col("all_1") > 0).cast("int")
    totals = totals.withColumn("dof", ((F.col("n_values") - 1) * (arms - 1)).cast("int"))
    cells = counts.join(totals, "feature").select(
        "feature",
        "dof",
        F.inline(
            F.array(
                F.struct(F.col("n_control").alias("o"), F.col("all_0").alias("arm_total")),
                F.struct(F.col("n_treated").alias("o"), F.col("all_1").alias("arm_total")),
            )
        ),
        (F.col("n_control") + F.col("n_treated")).alias("value_total"),
        (F.col("all_0") + F.col("all_1")).alias("n"),
    )
    expected = F.col("value_total") * F.col("arm_total").cast("double") / F.col("n")
    gap = F.abs(F.col("o") - F.col("e"))
    corrected = F.when(F.col("dof") == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
    statistic = F.coalesce(F.sum(ratio(corrected * corrected, F.col("e"))), F.lit(0.0))
    return (
        cells.withColumn("e", expected)
        .groupBy("feature")
        .agg(statistic.alias("chi2"), F.max("dof").alias("dof"))
        .select(
            "feature",
            F.when(F.col("dof") > 0, F.col("chi2")).otherwise(0.0).alias("chi2"),
            "dof",
        )
        .withColumn("p_value", chi2_upper_tail(F.col("chi2"), F.col("dof")))
    )


def categorical_balance(
    df: DataFrame,
    spec: ExperimentSpec,
    features: Sequence[str] | None = None,
    p_threshold: float = 0.05,
) -> DataFrame:
    names = spec.categorical if features is None else tuple(features)
    if not names:
        return df.sparkSession.createDataFrame([], _CATEGORICAL_COLUMNS)
    flag = F.when(F.col("p_value") < p_threshold, FLAGGED).otherwise(OK)
    return chi_square(df, spec, names).select(
        "feature",
        F.round("chi2", 3).alias("chi2"),
        "dof",
        F.round("p_value", 4).alias("p_value"),
        flag.alias("flag"),
    )


def randomization_check(
    df: DataFrame,
    spec: ExperimentSpec,
    smd_threshold: float = 0.1,
    p_threshold: float = 0.05,
) -> DataFrame:
    """One row: passed, n_checked, n_flagged, flagged features (numeric first, in role order)."""
    numeric = numeric_balance(df, spec, smd_threshold=smd_threshold).select("feature", "flag")
    categorical = categorical_balance(df, spec, p_threshold=p_threshold).select("feature", "flag")
    order = F.array(*[F.lit(name) for name in spec.features])
    flagged = F.when(
        F.col("flag") == FLAGGED,
        F.struct(F.array_position(order, F.col("feature")).alias("at"), "feature"),
    )
    return (
        numeric.unionByName(categorical)
        .agg(
            F.count(F.lit(1)).alias("n_checked"),
            F.count_if(F.col("flag") == FLAGGED).alias("n_flagged"),
            F.sort_array(F.collect_list(flagged)).alias("found"),
        )
        .select(
            (F.col("n_flagged") == 0).alias("passed"),
            "n_checked",
            "n_flagged",
            F.array_join(F.transform("found", lambda f: f["feature"]), ",").alias("flagged"),
        )
    )


def reference_rates(df: DataFrame, spec: ExperimentSpec, outcomes: Sequence[str]) -> DataFrame:
    """(metric, control, treatment): what a split is compared with. Default: the whole table."""
    return _rates(_split_sums(df.withColumn("split", F.lit("all")), spec, outcomes), outcomes).select(
        "metric", "control", "treatment"
    )


def reference_table(df: DataFrame, rates: Mapping[tuple[str, int], float], control_share: float) -> DataFrame:
    """The same table from fixed published rates."""
    rows = [("treatment_share", control_share, 1.0 - control_share)]
    for outcome in dict.fromkeys(name for name, _ in rates):
        rows.append((f"{outcome}_rate", rates[(outcome, 0)], rates[(outcome, 1)]))
    return df.sparkSession.createDataFrame(rows, "metric string, control double, treatment double")


def _split_sums(df: DataFrame, spec: ExperimentSpec, outcomes: Sequence[str]) -> DataFrame:
    """One row per split: arm sizes, and sums and counts of each outcome by arm."""
    t = F.col(spec.treatment)
    return df.groupBy("split").agg(
        F.count_if(t == 0).alias("n_control"),
        F.count_if(t == 1).alias("n_treated"),
        *[F.sum(F.when(t == arm, F.col(y))).alias(f"{y}_{arm}") for y in outcomes for arm in (0, 1)],
        *[
            F.count(F.when(t == arm, F.col(y))).alias(f"{y}_n_{arm}")
            for y in outcomes
            for arm in (0, 1)
        ],
    )


def _rates(sums: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    n = F.col("n_control") + F.col("n_treated")
    rows = [
        {
            "metric": F.lit("treatment_share"),
            "control": ratio(F.col("n_control"), n),
            "treatment": ratio(F.col("n_treated"), n),
        }
    ]
    for y in outcomes:
        rows.append(
            {
                "metric": F.lit(f"{y}_rate"),
                "control": ratio(F.col(f"{y}_0"), F.col(f"{y}_n_0")),
                "treatment": ratio(F.col(f"{y}_1"), F.col(f"{y}_n_1")),
            }
        )
    return rows_from_columns(sums, rows, keep=("split", "n_control", "n_treated"))


def split_balance(
    df: DataFrame,
    spec: ExperimentSpec,
    reference: DataFrame | None = None,
    outcomes: Sequence[str] = ("visit", "conversion"),
    tolerance: float = 0.01,
) -> DataFrame:
    """Per (split, metric): observed and reference rates and a flag beyond ``tolerance``.

    A rate that cannot be computed (empty arm) compares as "ok"; the arm sizes are in the output.
    Without a reference the whole table is one: its sums are those of the splits, so the table is read once.
    The reference has one row per metric, which bounds the broadcast.
    """
    require_columns(df, ("split", spec.treatment, *outcomes))
    sums = materialize(_split_sums(df, spec, outcomes), "split-sums")
    if reference is None:
        whole = sums.agg(*[F.sum(c).alias(c) for c in sums.columns if c != "split"])
        reference = _rates(whole.withColumn("split", F.lit("all")), outcomes)
    known = reference.select(
        "metric", F.col("control").alias("ref_control"), F.col("treatment").alias("ref_treatment")
    )
    off = (F.abs(F.col("control") - F.col("ref_control")) > tolerance) | (
        F.abs(F.col("treatment") - F.col("ref_treatment")) > tolerance
    )
    return (
        _rates(sums, outcomes)
        .join(F.broadcast(known), "metric")
        .select(
            "split",
            "metric",
            "n_control",
            "n_treated",
            "control",
            "treatment",
            "ref_control",
            "ref_treatment",
            F.when(off, DEVIATES).otherwise(OK).alias("flag"),
        )
    )


def any_deviation(balance: DataFrame) -> DataFrame:
    return balance.agg(F.coalesce(F.bool_or(F.col("flag") == DEVIATES), F.lit(False)).alias("any_deviation"))
