"""The phases of an experiment analysis, each a function from stored tables to stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import binarize_treatment
from ..operators import balance, curves, effects, learners, profile, ranking, resample, split, targeting
from ..operators.checks import require_unit_keys
from ..operators.encoding import encode_once
from ..operators.ordering import long_scores
from ..session import materialize
from ..sources import sinks, tables
from ..spec import RAW_SCHEMA, ExperimentSpec

# Display names of the models and their score columns.
MODEL_COLUMNS = {
    "Baseline (naive, non-causal)": "baseline_predicted_prob",
    "Two-Model Approach": "uplift_two_model",
    "Class Transformation": "uplift_class_transform",
    "Causal Forest": "uplift_causal_forest",
}
REFERENCE_MODEL = "Causal Forest"


@dataclass(frozen=True)
class Sizes:
    """Learner sizes and resamples; the defaults are the full-size analysis."""

    rounds: int = 200
    nuisance_rounds: int = 100
    trees: int = 200
    depth: int = 5
    replicates: int = 500
    seed: int = 42


def prepare(spark: SparkSession, csv: str, out: str, spec: ExperimentSpec = ExperimentSpec()) -> DataFrame:
    """Scan and validate a raw CSV, give every unit a key, store it; returns the dataset report."""
    names = spark.read.option("header", True).option("escape", '"').csv(csv).columns
    if spec.key in names:
        raw = tables.read_experiment_csv(spark, csv, key=spec.key)
        require_unit_keys(raw, spec.key)
    else:
        raw = tables.assign_unit_ids(tables.read_experiment_csv(spark, csv), spec.key)
    sinks.write_raw(raw, out)
    return profile.dataset_report(spark.read.parquet(out).select(*RAW_SCHEMA.fieldNames()), spec)


def preprocess(
    spark: SparkSession,
    raw: str,
    out: str,
    spec: ExperimentSpec = ExperimentSpec(),
    test_size: float = 0.20,
    seed: int = 42,
    reference: DataFrame | None = None,
) -> DataFrame:
    """Binarise the arm, split exactly, store one table by split; returns the split check."""
    units = binarize_treatment(tables.read_experiment_parquet(spark, raw, key=spec.key), spec)
    sinks.write_split(split.stratified_split(units, spec, test_size, seed), out)
    return balance.split_balance(spark.read.parquet(out), spec, reference)


def train_baseline(
    spark: SparkSession,
    split_path: str,
    model_path: str,
    ranking_path: str,
    spec: ExperimentSpec = ExperimentSpec(),
    target: str = "visit",
    sizes: Sizes = Sizes(),
) -> tuple[DataFrame, DataFrame]:
    """Fit and store the response model and the test ranking; returns (report, signal check)."""
    train, test = (tables.read_split(spark, split_path, side) for side in ("train", "test"))
    model = learners.train_response_model(train, spec, target, sizes.seed, sizes.rounds, sizes.depth)
    sinks.save_model(model, model_path)
    scored = learners.predict_probability(model, test, "predicted_prob")
    sinks.write_scores(
        scored.select(
            spec.key,
            "predicted_prob",
            F.col(spec.treatment).alias("actual_treatment"),
            *[F.col(y).alias(f"actual_{y}") for y in spec.outcomes],
        ),
        ranking_path,
        spec.key,
    )
    stored = tables.read_scores(spark, ranking_path, (spec.key, "predicted_prob"))
    scores = long_scores(stored, {"baseline": "predicted_prob"}, spec.key, [f"actual_{target}"], keyed=True)
    return (
        curves.classifier_report(scores, f"actual_{target}"),
        ranking.signal_check(scores, f"actual_{target}"),
    )


def train_effects(
    spark: SparkSession,
    split_path: str,
    ranking_path: str,
    forest_path: str,
    combined_path: str,
    spec: ExperimentSpec = ExperimentSpec(),
    target: str = "visit",
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """Fit the three effect models, store the combined scores; returns the signal checks."""
    train, test = (tables.read_split(spark, split_path, side) for side in ("train", "test"))
    seed, rounds, depth = sizes.seed, sizes.rounds, sizes.depth
    train = encode_once(train, spec, [spec.key, spec.treatment, target])
    two, revert, forest = learners.fit_together(
        spark,
        [
            lambda: learners.two_model(train, spec, target, seed, rounds, depth),
            lambda: learners.class_transformation(train, spec, target, seed, rounds, depth),
            lambda: effects.train_effect_forest(
                train, spec, target, sizes.trees, sizes.nuisance_rounds, depth=depth, seed=seed
            ),
        ],
    )
    forest.save(forest_path)
    scored = learners.score_two_model(two, test, "uplift_two_model")
    scored = learners.score_class_transformation(revert, scored, "uplift_class_transform")
    scored = forest.score(scored, "uplift_causal_forest")
    slim = scored.select(
        spec.key,
        F.col(spec.treatment).alias("actual_treatment"),
        *[F.col(y).alias(f"actual_{y}") for y in spec.outcomes],
        "uplift_two_model",
        "uplift_class_transform",
        "uplift_causal_forest",
    )
    # The trees are walked once, here; the key check and the join below read the stored scores.
    slim = materialize(slim, "effect_scores")
    baseline = tables.read_scores(spark, ranking_path, (spec.key, "predicted_prob"))
    combined = ranking.combine_scores(
        slim, baseline, spec.key, "predicted_prob", "baseline_predicted_prob"
    )
    sinks.write_scores(combined, combined_path, spec.key)
    stored = tables.read_scores(spark, combined_path)
    effect_models = {m: c for m, c in MODEL_COLUMNS.items() if c.startswith("uplift_")}
    scores = long_scores(
        stored, effect_models, spec.key, ["actual_treatment", f"actual_{target}"], keyed=True
    )
    return ranking.signal_check_effect(scores, "actual_treatment", f"actual_{target}")


def evaluate(
    spark: SparkSession,
    combined_path: str,
    out: str,
    key: str = "unit_id",
    target: str = "visit",
    models: dict[str, str] | None = None,
    sizes: Sizes = Sizes(),
    ks: tuple[float, ...] = (0.1, 0.2, 0.3),
) -> DataFrame:
    """Store curves, coefficients with intervals, pairs and uplift at k; returns the verdict facts."""
    models = models or MODEL_COLUMNS
    stored = tables.read_scores(spark, combined_path, tuple(models.values()))
    t, y = "actual_treatment", f"actual_{target}"
    scores = long_scores(stored, models, key, [t, y])
    curve, coefficients = curves.qini_metrics(scores, t, y)
    curve.write.mode("overwrite").parquet(f"{out}/qini_curves")
    replicates = resample.bootstrap_qini(scores, t, y, sizes.replicates, sizes.seed)
    intervals = resample.with_intervals(
        coefficients, resample.percentile_interval(replicates, scores)
    )
    intervals = materialize(intervals, "intervals")
    uplift = materialize(ranking.uplift_at_k(scores, t, y, ks), "uplift")
    sinks.write_result(resample.results_table(intervals, uplift, ks), f"{out}/results")
    sinks.write_result(
        resample.pairwise_overlap(intervals, tuple(models)), f"{out}/pairwise_overlap"
    )
    sinks.write_result(uplift, f"{out}/uplift_at_k")
    return resample.verdict_facts(intervals, tuple(models), REFERENCE_MODEL)


def simulate_budgets(
    spark: SparkSession,
    combined_path: str,
    out: str,
    key: str = "unit_id",
    target: str = "visit",
    models: dict[str, str] | None = None,
    budgets: tuple[float, ...] = (0.10, 0.20),
    seed: int = 42,
) -> DataFrame:
    """Store the budget table (budget ascending, total descending); returns who beat random."""
    models = models or MODEL_COLUMNS
    stored = tables.read_scores(spark, combined_path, tuple(models.values()))
    t, y = "actual_treatment", f"actual_{target}"
    scores = targeting.strategy_scores(stored, models, key, [t, y], seed)
    table = materialize(targeting.budget_targeting(scores, t, y, budgets), "budgets")
    # A handful of rows: strategies x budgets.
    ordered = table.repartition(1).sortWithinPartitions(
        "budget", F.col("incremental_total").desc_nulls_last()
    )
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{out}/budget_targeting")
    return targeting.beat_random(table)
