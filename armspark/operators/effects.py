"""Residual-on-residual effects: cross-fitting, population and cell effects, honest effect forest."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import positive_probability, ratio
from ..functions.hashing import STREAM_FOLD, STREAM_HONEST, STREAM_RESAMPLE, unit_hash, wide_hash
from ..session import materialize
from ..spec import ExperimentSpec, require_columns
from .encoding import EncodedTable, encode_once
from .histogram_trees import HistogramTrees, boosted_trees, by_feature, grown_forest, reached
from .learners import MAX_BINS, fit_together

# Assignment probabilities are kept this far off 0 and 1, so that no treatment residual vanishes.
CLIP = 0.01
# Groups of trees with an honest half each; one bit of the unit hash decides per group.
HONEST_GROUPS = 4


def with_fold(df: DataFrame, spec: ExperimentSpec, folds: int, seed: int, out: str = "fold") -> DataFrame:
    """Fold number from the unit key alone: stable, even, and independent of the arm."""
    return df.withColumn(out, (unit_hash(spec.key, seed, STREAM_FOLD) % folds).cast("int"))


def residual_effect(df: DataFrame, y_residual: str, t_residual: str, by: Sequence[str] = ()) -> DataFrame:
    """sum(yr*tr)/sum(tr^2), for the whole table or per group."""
    yr, tr = F.col(y_residual), F.col(t_residual)
    sums = df.groupBy(*by).agg(
        F.sum(yr * tr).alias("cross"), F.sum(tr * tr).alias("square"), F.count(F.lit(1)).alias("n")
    )
    return sums.select(*by, "n", ratio(F.col("cross"), F.col("square")).alias("effect"))


def cell_residual_effect(
    df: DataFrame, spec: ExperimentSpec, target: str, cell: Sequence[str], folds: int = 2, seed: int = 42
) -> DataFrame:
    """Cross-fitted residual effect per cell with cell means as nuisance models.

    Inside a (cell, fold) the out-of-fold means are constants, so the residual products follow
    from whole-number sums: one aggregate combined before the shuffle replaces two passes over the
    rows, and the result does not depend on summation order.
    """
    require_columns(df, (spec.key, spec.treatment, target, *cell))
    t, y = F.col(spec.treatment), F.col(target)
    parts = (
        with_fold(df, spec, folds, seed)
        .groupBy(*cell, "fold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(t.cast("bigint")).alias("st"),
            F.sum(y.cast("bigint")).alias("sy"),
            F.sum((t * y).cast("bigint")).alias("sty"),
        )
    )
    # One row per cell, its folds as a short array in fold order.
    per_cell = parts.groupBy(*cell).agg(
        F.sort_array(F.collect_list(F.struct("fold", "n", "st", "sy", "sty"))).alias("parts"),
        *[F.sum(c).alias(f"all_{c}") for c in ("n", "st", "sy")],
    )

    def out_of_fold(p: Column, c: str) -> Column:
        return ratio(F.col(f"all_{c}") - p[c], F.col("all_n") - p["n"])

    def cross(p: Column) -> Column:
        my, mt = out_of_fold(p, "sy"), out_of_fold(p, "st")
        return p["sty"] - my * p["st"] - mt * p["sy"] + p["n"] * my * mt

    def square(p: Column) -> Column:
        mt = out_of_fold(p, "st")
        return p["st"] - 2.0 * mt * p["st"] + p["n"] * mt * mt

    def total(term) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + term(p))

    return per_cell.select(*cell, F.col("all_n").alias("n"), total(cross).alias("cross"), total(square).alias("square")).select(
        *cell, "n", ratio(F.col("cross"), F.col("square")).alias("effect")
    )


def cell_effect_scores(
    train: DataFrame,
    test: DataFrame,
    spec: ExperimentSpec,
    target: str,
    cell: Sequence[str],
    output: str,
    folds: int = 2,
    seed: int = 42,
) -> DataFrame:
    """Score test rows by their cell's residual effect on the training rows.

    A cell without one (unseen, in a single fold, or with a constant arm) takes the population's.
    The cell table is stored, so the join is planned on its true size.
    """
    by_cell = cell_residual_effect(train, spec, target, cell, folds, seed)
    by_cell = materialize(by_cell.select(*cell, F.col("effect").alias("__cell")), "cell_effects")
    overall = cell_residual_effect(train, spec, target, (), folds, seed).first()["effect"]
    filled = F.coalesce("__cell", F.lit(overall).cast("double"))
    return test.join(by_cell, list(cell), "left").select(*test.columns, filled.alias(output))


def cross_fit_residuals(
    train: DataFrame | EncodedTable,
    spec: ExperimentSpec,
    target: str,
    folds: int = 2,
    rounds: int = 100,
    depth: int = 3,
    seed: int = 42,
    max_bins: int = MAX_BINS,
    clip: float = CLIP,
) -> tuple[DataFrame, PipelineModel]:
    """(unit, features, yr, tr, fold): residuals from models fitted on the other folds.

    Returns the stored residual table and the fitted feature stages. Assignment probabilities are kept
    within ``clip`` and 1 - ``clip``. An encoded table (with key, arm and target) is used as it is.
    """
    spec.check_leakage()
    if not isinstance(train, EncodedTable):
        train = encode_once(train, spec, [spec.key, spec.treatment, target])
    require_columns(train.rows, (spec.key, spec.treatment, target, "features"))
    session = train.rows.sparkSession
    encoded = with_fold(train.rows, spec, folds, seed).select(
        spec.key,
        "fold",
        "features",
        F.col(spec.treatment).cast("double").alias("t"),
        F.col(target).cast("double").alias("y"),
    )
    fits = []
    for k in range(folds):
        others = encoded.where(F.col("fold") != k)
        sizes = (rounds, depth, max_bins, seed)
        fits.append(lambda d=others: boosted_trees(d, "y", "squared", *sizes, output="y_hat"))
        fits.append(lambda d=others: boosted_trees(d, "t", "logistic", *sizes, output="t_prob"))
    models = fit_together(session, fits)
    parts = []
    for k in range(folds):
        own = encoded.where(F.col("fold") == k)
        parts.append(models[2 * k + 1].transform(models[2 * k].transform(own)))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    t_hat = F.least(F.greatest(positive_probability("t_prob"), F.lit(clip)), F.lit(1.0 - clip))
    residuals = together.select(
        spec.key,
        "fold",
        "features",
        (F.col("y") - F.col("y_hat")).alias("yr"),
        (F.col("t") - t_hat).alias("tr"),
    )
    return materialize(residuals, "residuals"), train.encoder


def leaf_offsets(forests: Sequence[HistogramTrees]) -> np.ndarray:
    """Where the leaves of each tree start in one numbering of all leaves, and their total at the end."""
    leaves = [(tree.numNodes + 1) // 2 for forest in forests for tree in forest.trees]
    return np.concatenate([[0], np.cumsum(leaves)]).astype(np.int64)


def _located(forests: Sequence[HistogramTrees]) -> list[tuple]:
    """Per tree feature, threshold, depth, and the leaf number of every bottom place."""
    starts = leaf_offsets(forests)
    trees = [tree for forest in forests for tree in forest.trees]
    return [(t.feature, t.threshold, t.depth, s + t.leaf_numbers()) for t, s in zip(trees, starts)]


@dataclass(frozen=True)
class EffectForest:
    """Fitted forests: feature stages, tree structure by group, honest leaf means, population effect."""

    spec: ExperimentSpec
    encoder: PipelineModel
    forests: tuple[HistogramTrees, ...]
    leaves: DataFrame
    population_effect: float

    def score(self, df: DataFrame, output: str) -> DataFrame:
        """Effect per row: honest means of the row's leaves, added over the trees, then divided.

        The leaf table has a row per leaf of the trees; it goes to every task with them, so no row is multiplied by the number of trees
        and none is joined. A leaf without honest rows adds nothing; without any the population effect stands.
        """
        means = np.zeros((2, int(leaf_offsets(self.forests)[-1])))
        for row in self.leaves.collect():
            means[:, row["slot"]] = row["cross"], row["square"]
        shared = df.sparkSession.sparkContext.broadcast((_located(self.forests), means, self.population_effect))

        @F.arrow_udf("double")
        def effect(features: pa.Array) -> pa.Array:
            trees, means, otherwise = shared.value
            total = np.zeros((2, len(features)))
            if len(features):
                x = by_feature(features)
                for feature, threshold, depth, leaf in trees:
                    total += means[:, leaf[reached(x, feature, threshold, depth)]]
            cross, square = total
            return pa.array(np.where(square > 0, cross / np.where(square > 0, square, 1.0), otherwise))

        return self.encoder.transform(df).select(*df.columns, effect(vector_to_array("features")).alias(output))

    def save(self, path: str) -> None:
        self.encoder.write().overwrite().save(f"{path}/encoder")
        for i, forest in enumerate(self.forests):
            forest.write().overwrite().save(f"{path}/forest-{i}")
        self.leaves.withColumns(
            {"population_effect": F.lit(self.population_effect), "groups": F.lit(len(self.forests))}
        ).repartition(1).write.mode("overwrite").parquet(f"{path}/leaves")

    @staticmethod
    def load(spark: SparkSession, path: str, spec: ExperimentSpec) -> EffectForest:
        stored = spark.read.parquet(f"{path}/leaves")
        facts = stored.first()
        return EffectForest(
            spec,
            PipelineModel.load(f"{path}/encoder"),
            tuple(HistogramTrees.load(f"{path}/forest-{i}") for i in range(facts["groups"])),
            stored.drop("population_effect", "groups"),
            facts["population_effect"],
        )


def _leaf_sums(trees: list[tuple]):
    """Rows, cross and square sums per leaf of ``trees``, added up in each task over its (features, cross, square)."""

    def run(batches):
        low, high = int(trees[0][3][0]), int(trees[-1][3][-1]) + 1
        sums = np.zeros((3, high - low))
        for batch in batches:
            if batch.num_rows:
                x = by_feature(batch.column(0))
                cross, square = (batch.column(i).to_numpy() for i in (1, 2))
                for feature, threshold, depth, leaf in trees:
                    first, last = int(leaf[0]), int(leaf[-1]) + 1
                    at = leaf[reached(x, feature, threshold, depth)] - first
                    for row, weight in zip(sums, (None, cross, square)):
                        row[first - low : last - low] += np.bincount(at, weight, last - first)
        hit = np.flatnonzero(sums[0])
        columns = [pa.array(hit + low), pa.array(sums[0][hit].astype(np.int64)), pa.array(sums[1][hit]), pa.array(sums[2][hit])]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", "cross", "square"])

    return run


def train_effect_forest(
    train: DataFrame | EncodedTable,
    spec: ExperimentSpec,
    target: str,
    trees: int = 200,
    nuisance_rounds: int = 100,
    folds: int = 2,
    depth: int = 5,
    seed: int = 42,
    max_bins: int = MAX_BINS,
    feature_share: str = "onethird",
    honest_groups: int = HONEST_GROUPS,
    clip: float = CLIP,
) -> EffectForest:
    """Honest forest on effect differences.

    In each group of trees one half of the units grows the trees on the residual quotient yr/tr weighted by tr^2, so
    splits chase differences in effect; the other half alone fills the leaves. A bit of the unit's hash
    per group makes the halves, so every unit grows some trees and fills others.
    """
    groups = min(honest_groups, trees)
    if not 1 <= groups <= 32:
        raise ValueError("between 1 and 32 honest groups")
    residuals, encoder = cross_fit_residuals(
        train, spec, target, folds, nuisance_rounds, seed=seed, max_bins=max_bins, clip=clip
    )
    overall = residual_effect(residuals, "yr", "tr").first()["effect"]
    if overall is None:
        raise ValueError("treatment does not vary: no effect to estimate")
    fills = [F.shiftrightunsigned(unit_hash(spec.key, seed, STREAM_HONEST), g) % 2 == 1 for g in range(groups)]

    yr, tr = F.col("yr"), F.col("tr")

    def fit(g: int) -> HistogramTrees:
        return grown_forest(
            residuals.where(~fills[g]),
            wide_hash(spec.key, seed, STREAM_RESAMPLE),
            tr * tr,
            yr / tr,
            trees // groups + (g < trees % groups),
            depth,
            max_bins,
            seed + g,
            feature_share,
        )

    forests = tuple(fit_together(residuals.sparkSession, [lambda g=g: fit(g) for g in range(groups)]))
    located, tree, sums = _located(forests), 0, None
    for g, forest in enumerate(forests):
        mine = located[tree : tree + len(forest.trees)]
        tree += len(mine)
        rows = residuals.where(fills[g]).select(vector_to_array("features").alias("features"), (yr * tr).alias("cross"), (tr * tr).alias("square"))
        part = rows.mapInArrow(_leaf_sums(mine), "slot long, n long, cross double, square double")
        sums = part if sums is None else sums.unionByName(part)
    # Each tree counts the same in a leaf of any size: averages, not totals.
    leaves = sums.groupBy("slot").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in ("cross", "square")])
    return EffectForest(spec, encoder, forests, materialize(leaves, "leaves"), overall)


# The functions of tasks travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
