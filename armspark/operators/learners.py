"""Response and effect learners: boosted trees, and cell means."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import (
    centred_score,
    positive_probability,
    ratio,
    revert_label,
)
from ..session import materialize
from ..spec import ExperimentSpec, require_columns
from .encoding import EncodedTable, encode_once, feature_stages
from .histogram_trees import boosted_trees

# Rounds of boosting used when the caller names none.
DEFAULT_ROUNDS = 200
# Intervals per feature that a split can fall between.
MAX_BINS = 255


def fit_together(session: SparkSession, fits: Sequence[Callable], at_most: int = 4) -> list:
    """Run independent fits side by side; each is a long chain of short jobs that leaves cores idle."""
    with ThreadPool(min(at_most, len(fits))) as pool:
        return pool.map(inheritable_thread_target(session)(lambda fit: fit()), fits)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(n_negative, n_positive, positive_weight); the weight is NULL without positives."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("n_negative"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
    ).withColumn("positive_weight", ratio(F.col("n_negative"), F.col("n_positive")))


def positive_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive; no positive at all is an error."""
    row = class_counts(df, label).first()
    if not row["n_positive"]:
        raise ValueError(
            f"{label} has no positive rows ({row['n_negative']} negative); is it a 0/1 column?"
        )
    return row["positive_weight"]


def train_response_model(
    train: DataFrame | EncodedTable,
    spec: ExperimentSpec,
    target: str,
    seed: int = 42,
    rounds: int = DEFAULT_ROUNDS,
    depth: int = 5,
    weighted: bool = True,
    max_bins: int = MAX_BINS,
) -> PipelineModel:
    """Boosted trees for P(target), positives weighted up to balance; the arm is not a feature.

    Fitting reads ``train`` a few times and keeps its bins cached. An encoded table brings its encoder along, which becomes part of the
    model; otherwise the model learns one of its own.
    """
    encoded = isinstance(train, EncodedTable)
    rows, inputs = (train.rows, ("features",)) if encoded else (train, spec.features)
    require_columns(rows, (target, *inputs))
    spec.check_leakage()
    data = rows.select(*inputs, F.col(target).cast("double").alias("__label"))
    weight = positive_weight(data, "__label") if weighted else None
    encoder = train.encoder if encoded else Pipeline(stages=feature_stages(spec)).fit(data)
    vectors = (data if encoded else encoder.transform(data)).select("features", "__label")
    learner = boosted_trees(vectors, "__label", "logistic", rounds, depth, max_bins, seed, weight)
    return PipelineModel(stages=[*encoder.stages, learner])


def predict_probability(model: PipelineModel, df: DataFrame, output: str) -> DataFrame:
    """Batch scoring: the input columns plus the positive-class probability."""
    scored = model.transform(df)
    return scored.select(*df.columns, positive_probability("probability").alias(output))


def two_model(
    train: DataFrame | EncodedTable,
    spec: ExperimentSpec,
    target: str,
    seed: int = 42,
    rounds: int = DEFAULT_ROUNDS,
    depth: int = 5,
    max_bins: int = MAX_BINS,
) -> tuple[PipelineModel, PipelineModel]:
    """One weighted model per arm: (treated model, control model). Both share one encoder, fitted on all rows."""
    if not isinstance(train, EncodedTable):
        train = encode_once(train, spec, [spec.treatment, target])
    arm = F.col(spec.treatment)
    return tuple(
        fit_together(
            train.rows.sparkSession,
            [
                lambda value=value: train_response_model(
                    replace(train, rows=train.rows.where(arm == value)), spec, target, seed, rounds, depth, max_bins=max_bins
                )
                for value in (1, 0)
            ],
        )
    )


def score_two_model(models: tuple[PipelineModel, PipelineModel], df: DataFrame, output: str) -> DataFrame:
    """Difference of the two models' probabilities on the same rows."""
    treated, control = models
    both = predict_probability(control, predict_probability(treated, df, "__p1"), "__p0")
    return both.select(*df.columns, (F.col("__p1") - F.col("__p0")).alias(output))


def class_transformation(
    train: DataFrame | EncodedTable,
    spec: ExperimentSpec,
    target: str,
    seed: int = 42,
    rounds: int = DEFAULT_ROUNDS,
    depth: int = 5,
    max_bins: int = MAX_BINS,
) -> PipelineModel:
    """One unweighted model of the revert label, with no correction for unequal arms."""
    label = revert_label(spec.treatment, target)
    if isinstance(train, EncodedTable):
        labelled = replace(train, rows=train.rows.withColumn("__revert", label))
    else:
        labelled = train.withColumn("__revert", label)
    return train_response_model(labelled, spec, "__revert", seed, rounds, depth, weighted=False, max_bins=max_bins)


def score_class_transformation(model: PipelineModel, df: DataFrame, output: str) -> DataFrame:
    scored = predict_probability(model, df, "__p")
    return scored.select(*df.columns, centred_score(F.col("__p")).alias(output))


def _cell_sums(spec: ExperimentSpec, target: str) -> dict[str, Column]:
    t, y = F.col(spec.treatment), F.col(target)
    return {
        "n": F.count(F.lit(1)),
        "nt": F.count_if(t == 1),
        "y": F.sum(y.cast("bigint")),
        "yt": F.sum(F.when(t == 1, y).otherwise(0).cast("bigint")),
        "z": F.sum(revert_label(spec.treatment, target).cast("bigint")),
    }


def cell_formulas() -> dict[str, Column]:
    """Scores of a cell from its sums: outcome rate, difference of arm rates, 2p-1 of agreement."""
    n, nt, y, yt, z = (F.col(c) for c in ("n", "nt", "y", "yt", "z"))
    return {
        "response": ratio(y, n),
        "two_model": ratio(yt, nt) - ratio(y - yt, n - nt),
        "class_transform": centred_score(ratio(z, n)),
    }


def cell_scores(
    train: DataFrame,
    test: DataFrame,
    spec: ExperimentSpec,
    target: str,
    cell: Sequence[str],
    outputs: dict[str, str],
) -> DataFrame:
    """Score test rows by formulas over sums within their cell of the training rows.

    The saturated form of the response, two-model and class-transformation learners: as exact as
    the cells are fine, and checkable in plain SQL. ``outputs`` names a formula per new column; all
    share one aggregate. A cell without a score (unseen, or an arm is empty in it) takes the score
    of the whole training table.

    The cell table is stored, so the join sees its true size: Spark broadcasts it while it is
    small, which spares the test rows a shuffle on a few hot cells, and otherwise shuffles with
    the adaptive skew join.
    """
    require_columns(train, (spec.treatment, target, *cell))
    formulas = cell_formulas()
    sums = _cell_sums(spec, target)
    by_cell = train.groupBy(*cell).agg(*[c.alias(v) for v, c in sums.items()])
    by_cell = materialize(by_cell, "cells")
    scored = by_cell.select(*cell, *[formulas[f].alias(f"__{o}") for o, f in outputs.items()])
    totals = by_cell.agg(*[F.sum(v).alias(v) for v in sums])
    overall = totals.select(*[formulas[f].alias(o) for o, f in outputs.items()]).first()
    filled = [F.coalesce(f"__{o}", F.lit(overall[o]).cast("double")).alias(o) for o in outputs]
    return test.join(scored, list(cell), "left").select(*test.columns, *filled)
