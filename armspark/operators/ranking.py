"""Rankings, top-k splits, signal checks, combined score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..spec import require_columns
from .curves import arm_values
from .ordering import Scores, global_rank, top_fraction_sums


def combine_scores(
    scores: DataFrame, baseline: DataFrame, key: str, probability: str, output: str = "baseline_score"
) -> DataFrame:
    """Attach the baseline probability to every scored unit.

    Fails if a key repeats on either side or if a unit has no baseline row. Both sides are
    partitioned by the same unique key, so no key is hot.
    """
    require_columns(scores, [key])
    require_columns(baseline, [key, probability])
    # One scan a side and one shuffle of the bare keys find repeated and missing ones together.
    left = scores.select(key, F.lit(1).alias("__own"), F.lit(0).alias("__base"), F.lit(0).alias("__usable"))
    usable = F.col(probability).isNotNull().cast("int")
    right = baseline.select(key, F.lit(0).alias("__own"), F.lit(1).alias("__base"), usable.alias("__usable"))
    sides = ("__own", "__base", "__usable")
    found = (
        left.unionByName(right)
        .groupBy(key)
        .agg(*[F.sum(c).alias(c) for c in sides])
        .agg(
            F.count_if((F.col("__own") > 1) | (F.col("__base") > 1)).alias("repeated"),
            F.count_if((F.col("__own") > 0) & (F.col("__usable") == 0)).alias("missing"),
        )
        .first()
    )
    if found["repeated"]:
        raise ValueError(f"{found['repeated']} duplicate {key} value(s)")
    if found["missing"]:
        raise ValueError(f"{found['missing']} row(s) failed to join with the baseline ranking on {key}")
    return attach_baseline(scores, baseline, key, probability, output)


def attach_baseline(
    scores: DataFrame, baseline: DataFrame, key: str, probability: str, output: str
) -> DataFrame:
    """The join alone, lazily: NULL where a unit has no baseline row."""
    return scores.join(baseline.select(key, F.col(probability).alias(output)), key, "left")


def unmatched_scores(scores: DataFrame, baseline: DataFrame, key: str, probability: str) -> DataFrame:
    """Scored units without a usable baseline probability."""
    usable = baseline.where(F.col(probability).isNotNull()).select(key)
    return scores.join(usable, key, "left_anti")


def build_ranking(scores: Scores, columns: Sequence[str]) -> DataFrame:
    """(model, unit, score, rank, ...) by score descending, unit key ascending. Stored unsorted."""
    return global_rank(scores).select("model", scores.key, "score", "rank", *columns)


def head_and_tail(
    df: DataFrame, score: str, key: str, columns: Sequence[str], head: int = 10, tail: int = 5
) -> DataFrame:
    """The first and last few units of a ranking with their ranks; a report, hence the limits.

    Each side is a per-task top-n merged at the end, never a sort of the table.
    """
    kept = [key, score, *columns]
    # NaN counts as missing and ranks last, as everywhere.
    df = df.select(*kept).withColumn(score, F.nanvl(F.col(score).cast("double"), F.lit(None)))
    down = [F.col(score).desc_nulls_last(), F.col(key)]
    up = [F.col(score).asc_nulls_first(), F.col(key).desc()]
    best, worst = df.orderBy(*down).limit(head), df.orderBy(*up).limit(tail)
    # The windows see ``head`` and ``tail`` rows.
    first = Window.partitionBy(F.lit("head")).orderBy(*down)
    last = Window.partitionBy(F.lit("tail")).orderBy(*up)
    total = df.agg(F.count(F.lit(1)).alias("n"))
    top = best.select(F.lit("head").alias("part"), F.row_number().over(first).cast("bigint").alias("rank"), *kept)
    bottom = worst.select(*kept, F.row_number().over(last).alias("from_end")).join(F.broadcast(total))
    bottom = bottom.select(
        F.lit("tail").alias("part"),
        (F.col("n") - F.col("from_end") + 1).cast("bigint").alias("rank"),
        *kept,
    )
    return top.unionByName(bottom)


def signal_check(
    scores: Scores, outcome: str, top_fraction: float = 0.10, min_gap: float = 0.02
) -> DataFrame:
    """Per model: outcome rate overall, in the top slice and in the rest; gap, lift, verdict."""
    sums = top_fraction_sums(scores, [top_fraction], {"y": F.sum(F.col(outcome).cast("bigint"))})
    overall = ratio(F.col("all_y"), F.col("all_n"))
    top = ratio(F.col("y"), F.col("n"))
    rest = ratio(F.col("all_y") - F.col("y"), F.col("all_n") - F.col("n"))
    return sums.select(
        "model", overall.alias("overall_rate"), top.alias("top_rate"), rest.alias("rest_rate")
    ).select(
        "*",
        (F.col("top_rate") - F.col("rest_rate")).alias("gap"),
        F.when(F.col("overall_rate") > 0, F.col("top_rate") / F.col("overall_rate")).alias("lift_ratio"),
        F.coalesce(F.col("top_rate") - F.col("rest_rate") >= min_gap, F.lit(False)).alias("passed"),
    )


def _effect(yt: Column, nt: Column, y: Column, n: Column) -> Column:
    return ratio(yt, nt) - ratio(y - yt, n - nt)


def signal_check_effect(
    scores: Scores,
    treatment: str,
    outcome: str,
    top_fraction: float = 0.10,
    min_gap: float = 0.01,
) -> DataFrame:
    """Per model: observed effect in the top slice, in the rest and overall; gap and verdict.

    All models go through one job. Effects are NULL, and the check fails, where an arm is empty.
    """
    sums = top_fraction_sums(scores, [top_fraction], _without_n(arm_values(treatment, outcome)))
    c = F.col
    return sums.select(
        "model",
        _effect(c("yt"), c("nt"), c("y"), c("n")).alias("top_effect"),
        _effect(
            c("all_yt") - c("yt"), c("all_nt") - c("nt"), c("all_y") - c("y"), c("all_n") - c("n")
        ).alias("rest_effect"),
        _effect(c("all_yt"), c("all_nt"), c("all_y"), c("all_n")).alias("overall_effect"),
    ).select(
        "*",
        (c("top_effect") - c("rest_effect")).alias("gap"),
        F.coalesce(c("top_effect") - c("rest_effect") >= min_gap, F.lit(False)).alias("passed"),
    )


def _without_n(values: dict[str, Column]) -> dict[str, Column]:
    return {name: column for name, column in values.items() if name != "n"}


def uplift_at_k(
    scores: Scores, treatment: str, outcome: str, fractions: Sequence[float] = (0.1, 0.2, 0.3)
) -> DataFrame:
    """(model, k, n_selected, uplift_at_k) over the first floor(n * k) rows; all k in one job."""
    sums = top_fraction_sums(
        scores, fractions, _without_n(arm_values(treatment, outcome)), rounding="floor"
    )
    c = F.col
    return sums.select(
        "model",
        c("fraction").alias("k"),
        c("n").alias("n_selected"),
        _effect(c("yt"), c("nt"), c("y"), c("n")).alias("uplift_at_k"),
    )


def best_model(table: DataFrame, value: str, models: Sequence[str]) -> DataFrame:
    """Models by ``value`` descending with a rank; equal values keep the declared order.

    One row per model goes in, so the window is tiny.
    """
    declared = F.array(*[F.lit(name) for name in models])
    position = F.array_position(declared, F.col("model"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col(value).desc_nulls_last(), position)
    return table.select(
        F.row_number().over(order).cast("bigint").alias("rank"), "model", F.col(value).alias("value")
    ).withColumn("is_best", F.col("rank") == 1)
