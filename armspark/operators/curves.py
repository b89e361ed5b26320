"""Curve metrics over score order: Qini, ROC, precision/recall. Ties are one point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, stable_sum
from ..session import materialize
from .ordering import Scores, model_name, running_totals


def arm_values(treatment: str, outcome: str) -> dict[str, Column]:
    """Sums behind every effect curve: units, treated units, outcome, treated outcome."""
    t, y = F.col(treatment), F.col(outcome)
    return {
        "n": F.count(F.lit(1)),
        "nt": F.count_if(t == 1),
        "y": F.sum(y.cast("bigint")),
        "yt": F.sum(F.when(t == 1, y).otherwise(0).cast("bigint")),
    }


def qini_height(n: Column, nt: Column, y: Column, yt: Column) -> Column:
    """Incremental outcomes: treated ones minus the control ones scaled to the treated size."""
    nc, yc = n - nt, y - yt
    scaled = F.when(nc != 0, yc * (nt.cast("double") / nc.cast("double"))).otherwise(0.0)
    return yt.cast("double") - scaled


def _cum(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{v}") for v in ("n", "nt", "y", "yt")]


def _previous() -> list[Column]:
    return [F.col(f"cum_{v}") - F.col(v) for v in ("n", "nt", "y", "yt")]


def qini_curve(scores: Scores, treatment: str, outcome: str) -> DataFrame:
    """(model, x, share, y, random_y): one point per distinct score and the origin.

    ``random_y`` is the height of the straight line to the curve's end at the same x.
    """
    return _curve_points(scores, running_totals(scores, arm_values(treatment, outcome)))


def _curve_points(scores: Scores, totals: DataFrame) -> DataFrame:
    end = qini_height(*_cum("all_"))
    share = F.col("cum_n").cast("double") / F.col("all_n")
    points = totals.select(
        "m",
        F.col("cum_n").alias("x"),
        share.alias("share"),
        qini_height(*_cum("cum_")).alias("y"),
        (end * share).alias("random_y"),
        (F.col("cum_n") == F.col("n")).alias("first"),
    )
    # The best score group of a model also brings the origin.
    origin = F.struct(
        F.lit(0).cast("bigint").alias("x"),
        F.lit(0.0).alias("share"),
        F.lit(0.0).alias("y"),
        F.lit(0.0).alias("random_y"),
    )
    point = F.struct("x", "share", "y", "random_y")
    both = F.when(F.col("first"), F.array(origin, point)).otherwise(F.array(point))
    return points.select(model_name(scores).alias("model"), F.inline(both))


def qini_from_area(area: Column, n: Column, nt: Column, y: Column, yt: Column) -> Column:
    """Qini coefficient from the area under the curve and the whole-table sums.

    Both the curve and the perfect ranking are measured above the straight line. The perfect
    ranking puts treated responders first and control responders last, so its area needs no sort.
    NULL unless both arms and both outcome classes are present.
    """
    a, b = yt.cast("double"), (y - yt).cast("double")
    size = n.cast("double")
    end = qini_height(n, nt, y, yt)
    straight = size * end / 2.0
    perfect = a * a / 2.0 + (size - b - a) * a + b * (a + end) / 2.0
    valid = (nt > 0) & (nt < n) & (y > 0) & (y < n)
    return F.when(valid, ratio(area - straight, perfect - straight))


def slice_area() -> Column:
    """Trapezoid between a score group's point and the one before it (cumulative minus own)."""
    before, here = qini_height(*_previous()), qini_height(*_cum("cum_"))
    return F.col("n") * (before + here) / 2.0


def qini_coefficient(scores: Scores, treatment: str, outcome: str) -> DataFrame:
    """(model, n, curve_area, curve_end, qini_coefficient)."""
    return _coefficients(scores, running_totals(scores, arm_values(treatment, outcome)))


def qini_metrics(scores: Scores, treatment: str, outcome: str) -> tuple[DataFrame, DataFrame]:
    """(curve, coefficients) as ``qini_curve`` and ``qini_coefficient`` give them, from one ordered pass.

    The running totals, one row per model and distinct score, are stored and read by both.
    """
    totals = materialize(running_totals(scores, arm_values(treatment, outcome)), "qini-totals")
    return _curve_points(scores, totals), _coefficients(scores, totals)


def _coefficients(scores: Scores, totals: DataFrame) -> DataFrame:
    areas = totals.groupBy("m").agg(
        stable_sum(slice_area()).alias("area"),
        *[F.first(f"all_{v}").alias(f"all_{v}") for v in ("n", "nt", "y", "yt")],
    )
    return areas.select(
        "m",
        model_name(scores).alias("model"),
        F.col("all_n").alias("n"),
        F.col("area").alias("curve_area"),
        qini_height(*_cum("all_")).alias("curve_end"),
        qini_from_area(F.col("area"), *_cum("all_")).alias("qini_coefficient"),
    )


def _label_values(labels: Sequence[str]) -> dict[str, Column]:
    values = {"n": F.count(F.lit(1))}
    for i, label in enumerate(labels):
        values[f"p{i}"] = F.sum(F.col(label).cast("bigint"))
    return values


def roc_auc(scores: Scores, labels: Sequence[str]) -> DataFrame:
    """(model, label, auc): share of (positive, negative) pairs in the right order, ties half.

    Several outcomes share one pass, e.g. the trained one and a second one as a sanity check.
    """
    totals = running_totals(scores, _label_values(labels))
    sums = []
    for i, _ in enumerate(labels):
        own_pos = F.col(f"p{i}")
        own_neg = F.col("n") - own_pos
        pos_before = F.col(f"cum_p{i}") - own_pos
        sums.append(stable_sum(own_neg * (pos_before + own_pos / 2.0), 1).alias(f"pairs{i}"))
        sums.append(F.first(f"all_p{i}").alias(f"pos{i}"))
    wide = totals.groupBy("m").agg(F.first("all_n").alias("n"), *sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                ratio(
                    F.col(f"pairs{i}"),
                    F.col(f"pos{i}").cast("double") * (F.col("n") - F.col(f"pos{i}")),
                ).alias("auc"),
            )
            for i, label in enumerate(labels)
        ]
    )
    return wide.select(model_name(scores).alias("model"), F.inline(rows))


def average_precision(scores: Scores, label: str) -> DataFrame:
    """(model, average_precision): step sum of recall gain times precision, no interpolation."""
    totals = running_totals(scores, _label_values([label]))
    gain = ratio(F.col("p0"), F.col("all_p0"))
    precision = F.col("cum_p0").cast("double") / F.col("cum_n")
    return (
        totals.groupBy("m")
        .agg(stable_sum(gain * precision, 18).alias("average_precision"))
        .select(model_name(scores).alias("model"), "average_precision")
    )


def precision_recall_curve(scores: Scores, label: str) -> DataFrame:
    """(model, threshold, precision, recall, no_skill): one point per distinct score.

    The closing point (precision 1, recall 0) has no threshold.
    """
    totals = running_totals(scores, _label_values([label]))
    no_skill = ratio(F.col("all_p0"), F.col("all_n"))
    points = totals.select(
        "m",
        F.col("score").alias("threshold"),
        (F.col("cum_p0").cast("double") / F.col("cum_n")).alias("precision"),
        ratio(F.col("cum_p0"), F.col("all_p0")).alias("recall"),
        no_skill.alias("no_skill"),
        (F.col("cum_n") == F.col("n")).alias("first"),
    )
    closing = F.struct(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.col("no_skill"),
    )
    point = F.struct("threshold", "precision", "recall", "no_skill")
    both = F.when(F.col("first"), F.array(closing, point)).otherwise(F.array(point))
    return points.select(model_name(scores).alias("model"), F.inline(both))


def _confusion(label: str, threshold: float) -> dict[str, Column]:
    predicted = F.col("score") >= F.lit(float(threshold))
    actual = F.col(label) == 1
    return {
        "tp": F.count_if(predicted & actual),
        "fp": F.count_if(predicted & ~actual),
        "fn": F.count_if(~predicted & actual),
    }


def precision_recall(scores: Scores, label: str, threshold: float = 0.5) -> DataFrame:
    """(model, tp, fp, fn, precision, recall) at a threshold; 0 where undefined. No ordering needed."""
    counts = scores.rows.groupBy("m").agg(
        *[c.alias(name) for name, c in _confusion(label, threshold).items()]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        model_name(scores).alias("model"),
        "tp",
        "fp",
        "fn",
        F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
    )


def classifier_report(scores: Scores, label: str, threshold: float = 0.5) -> DataFrame:
    """(model, auc_roc, precision, recall, average_precision).

    One ordered pass serves all four: a score group lies wholly on one side of the threshold.
    """
    totals = running_totals(scores, _label_values([label]))
    pos, n = F.col("p0"), F.col("n")
    above = F.col("score") >= F.lit(float(threshold))
    wide = totals.groupBy("m").agg(
        stable_sum((n - pos) * (F.col("cum_p0") - pos + pos / 2.0), 1).alias("pairs"),
        stable_sum(
            ratio(pos, F.col("all_p0")) * (F.col("cum_p0").cast("double") / F.col("cum_n")), 18
        ).alias("ap"),
        F.sum(F.when(above, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(above, n).otherwise(0)).alias("chosen"),
        F.first("all_p0").alias("all_pos"),
        F.first("all_n").alias("all_n"),
    )
    all_pos = F.col("all_pos")
    return wide.select(
        model_name(scores).alias("model"),
        ratio(F.col("pairs"), all_pos.cast("double") * (F.col("all_n") - all_pos)).alias("auc_roc"),
        F.coalesce(ratio(F.col("tp"), F.col("chosen")), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(F.col("tp"), all_pos), F.lit(0.0)).alias("recall"),
        F.col("ap").alias("average_precision"),
    )
