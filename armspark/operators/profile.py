"""Profiling: sizes, missing values, arms, outcome rates, effects, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio, revert_label, strat_key
from ..spec import ExperimentSpec, require_columns


def rows_from_columns(wide: DataFrame, rows: Sequence[dict[str, Column]], keep=()) -> DataFrame:
    """Turn each (aggregated) row into ``len(rows)`` rows."""
    structs = [F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]
    return wide.select(*keep, F.inline(F.array(*structs)))


def _null_counts(df: DataFrame) -> list[Column]:
    counts = []
    for f in df.schema.fields:
        absent = F.col(f.name).isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            absent = absent | F.isnan(f.name)
        counts.append(F.count_if(absent).alias(f"null_{f.name}"))
    return counts


def dataset_report(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """(section, item, count, pct): shape, missing values per column, arm sizes; one pass."""
    treated = ~F.col(spec.arm).eqNullSafe(F.lit(spec.control))
    wide = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(treated).alias("n_treated"), *_null_counts(df)
    )
    n = F.col("n")
    no_pct = F.lit(None).cast("double")

    def row(section: str, item: str, count: Column, pct: Column = no_pct) -> dict[str, Column]:
        return {
            "section": F.lit(section),
            "item": F.lit(item),
            "count": count.cast("bigint"),
            "pct": pct,
        }

    def share(count: Column) -> Column:
        return F.round(ratio(count, n) * 100.0, 2)

    rows = [row("shape", "rows", n), row("shape", "columns", F.lit(len(df.columns)))]
    rows += [row("missing", name, F.col(f"null_{name}")) for name in df.columns]
    control = n - F.col("n_treated")
    rows.append(row("arm", "control", control, share(control)))
    rows.append(row("arm", "treatment", F.col("n_treated"), share(F.col("n_treated"))))
    return rows_from_columns(wide, rows)


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct) for columns with at least one missing value."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *_null_counts(df))
    rows = [
        {
            "column_name": F.lit(name),
            "missing_count": F.col(f"null_{name}"),
            "missing_pct": F.round(ratio(F.col(f"null_{name}"), F.col("n")) * 100.0, 3),
        }
        for name in df.columns
    ]
    return rows_from_columns(wide, rows).where("missing_count > 0")


def treatment_split(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """(treatment, count, pct) of all rows; a NULL arm counts in the total but on neither side."""
    require_columns(df, [spec.treatment])
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(spec.treatment) == 0).alias("n_control"),
        F.count_if(F.col(spec.treatment) == 1).alias("n_treated"),
    )
    rows = [
        {
            "treatment": F.lit(value),
            "count": count,
            "pct": F.round(ratio(count, F.col("n")) * 100.0, 2),
        }
        for value, count in ((0, F.col("n_control")), (1, F.col("n_treated")))
    ]
    return rows_from_columns(wide, rows).where("count > 0")


def arm_breakdown(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Rows per raw arm with their rank by size."""
    counts = df.where(F.col(spec.arm).isNotNull()).groupBy(F.col(spec.arm).alias("arm")).count()
    ordered = F.sort_array(
        F.collect_list(F.struct((-F.col("count")).alias("order"), "arm", "count"))
    )
    return counts.agg(ordered.alias("arms")).select(F.posexplode("arms").alias("pos", "r")).select(
        (F.col("pos") + 1).alias("rank"), F.col("r.arm").alias("arm"), F.col("r.count").alias("count")
    )


def arm_sums(y: str, treatment: str, suffix: str = "") -> list[Column]:
    """Counts and outcome sums per arm: the four numbers every effect is made of."""
    t = F.col(treatment)
    return [
        F.count(F.when((t == 1) & F.col(y).isNotNull(), 1)).alias(f"n_t{suffix}"),
        F.count(F.when((t == 0) & F.col(y).isNotNull(), 1)).alias(f"n_c{suffix}"),
        F.sum(F.when(t == 1, F.col(y))).alias(f"y_t{suffix}"),
        F.sum(F.when(t == 0, F.col(y))).alias(f"y_c{suffix}"),
    ]


def outcome_rates(df: DataFrame, spec: ExperimentSpec, outcomes: Sequence[str] | None = None) -> DataFrame:
    """(outcome, control_rate, treatment_rate), NULL for an absent arm; one pass for all outcomes."""
    names = tuple(outcomes or spec.outcomes)
    require_columns(df, (*names, spec.treatment))
    wide = df.agg(*[c for y in names for c in arm_sums(y, spec.treatment, f"_{y}")])
    rows = [
        {
            "outcome": F.lit(y),
            "control_rate": ratio(F.col(f"y_c_{y}"), F.col(f"n_c_{y}")),
            "treatment_rate": ratio(F.col(f"y_t_{y}"), F.col(f"n_t_{y}")),
        }
        for y in names
    ]
    return rows_from_columns(wide, rows)


def naive_effect(df: DataFrame, spec: ExperimentSpec, outcomes: Sequence[str] | None = None) -> DataFrame:
    """Per outcome: rates, their difference and the lift in percent (NULL if the control rate is 0)."""
    diff = F.col("treatment_rate") - F.col("control_rate")
    return outcome_rates(df, spec, outcomes).select(
        "outcome",
        F.round("control_rate", 4).alias("control_rate"),
        F.round("treatment_rate", 4).alias("treatment_rate"),
        F.round(diff, 4).alias("raw_effect"),
        F.round(ratio(diff, F.col("control_rate")) * 100.0, 2).alias("relative_lift_pct"),
    )


def effect_from_sums(suffix: str = "") -> Column:
    """Treated mean minus control mean; NULL when either arm is empty."""
    return ratio(F.col(f"y_t{suffix}"), F.col(f"n_t{suffix}")) - ratio(
        F.col(f"y_c{suffix}"), F.col(f"n_c{suffix}")
    )


def actual_effect(df: DataFrame, treatment: str, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """(effect, n_treated, n_control), for the whole table or per group."""
    require_columns(df, (treatment, outcome, *by))
    t = F.col(treatment)
    sums = df.groupBy(*by).agg(
        *arm_sums(outcome, treatment),
        F.count_if(t == 1).alias("n_treated"),
        F.count_if(t == 0).alias("n_control"),
    )
    return sums.select(*by, effect_from_sums().alias("effect"), "n_treated", "n_control")


def stratum_counts(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    key = strat_key(spec.treatment, spec.strat_outcome).alias("stratum")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def split_summary(df: DataFrame, spec: ExperimentSpec, target: str) -> DataFrame:
    """Per split: rows, positives, target rate, treatment rate."""
    n, pos, treated = F.col("n_rows"), F.col("positives"), F.col("treated")
    return (
        df.groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(target) == 1).alias("positives"),
            F.count_if(F.col(spec.treatment) == 1).alias("treated"),
        )
        .select(
            "split",
            "n_rows",
            "positives",
            ratio(pos, n).alias("target_rate"),
            ratio(treated, n).alias("treatment_rate"),
        )
    )


def arm_summary(df: DataFrame, spec: ExperimentSpec, target: str) -> DataFrame:
    """Per arm: rows and outcome rate."""
    return (
        df.groupBy(spec.treatment)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(target).alias("positives"))
        .select(
            F.col(spec.treatment).alias("treatment"),
            "n_rows",
            ratio(F.col("positives"), F.col("n_rows")).alias("outcome_rate"),
        )
    )


def score_summary(long: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    return long.groupBy(model).agg(
        F.avg(score).alias("mean_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )


def revert_label_rate(df: DataFrame, spec: ExperimentSpec, outcome: str) -> DataFrame:
    labelled = df.select(revert_label(spec.treatment, outcome).alias("z"))
    return labelled.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("z").alias("n_agree")).select(
        "n_rows", "n_agree", ratio(F.col("n_agree"), F.col("n_rows")).alias("agree_rate")
    )


def density_histogram(
    df: DataFrame, spec: ExperimentSpec, features: Sequence[str] | None = None, bins: int = 30
) -> DataFrame:
    """Equal-width density histogram per (feature, arm) over that arm's own range.

    Ranges and counts are two combined-before-shuffle aggregates; the range table has
    features x arms rows, which bounds the broadcast. Empty bins are rows too.
    """
    names = tuple(features or spec.numeric)
    require_columns(df, (*names, spec.treatment))
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in names]
    long = df.select(F.col(spec.treatment).alias("treatment"), F.inline(F.array(*pairs))).where(
        "v is not null"
    )
    ranges = long.groupBy("feature", "treatment").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        "feature",
        "treatment",
        "n",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = F.col("hi") - F.col("lo")
    position = F.floor((F.col("v") - F.col("lo")) * float(bins) / width).cast("int")
    counts = (
        long.join(F.broadcast(ranges), ["feature", "treatment"])
        .groupBy("feature", "treatment", F.least(position, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    grid = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["feature", "treatment", "bin"], "left").select(
        "feature",
        "treatment",
        "bin",
        (F.col("lo") + F.col("bin") * width / float(bins)).alias("bin_start"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        (F.coalesce("count", F.lit(0)) / (F.col("n") * width / float(bins))).alias("density"),
    )
