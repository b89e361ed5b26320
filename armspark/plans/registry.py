"""Registered queries: every operator over the experiment view of the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import binarize_treatment, threshold_label
from ..operators import balance, curves, effects, encoding, learners, profile, ranking, resample, split
from ..operators import targeting as target
from ..operators.ordering import Scores, flag_top, long_scores, named_rows
from ..session import materialize, scratch_folder
from ..sources import sinks, tables
from ..sources.star import STAR_SPEC as SPEC
from ..sources.star import experiment_table, experiment_units
from ..sources.tables import assemble
from ..spec import RAW_SCHEMA

CELL = ("history_segment", "channel")
SEED = 42
REPLICATES = 500
WEIGHT_REPLICATES = 20
THRESHOLD = 0.18
ROWS_PER_FILE = 500_000
KS = (0.1, 0.2, 0.3)
BUDGETS = (0.10, 0.20)
MODELS = {
    "Baseline": "s_base",
    "Two-Model": "s_two",
    "Class Transformation": "s_class",
    "Residual Effect": "s_res",
    "Continuous": "s_cont",
}
KEEP = ("treatment", "visit", "conversion")
# Learner sizes of the registered queries: those of a full analysis.
ROUNDS, NUISANCE_ROUNDS, DEPTH, TREES = 200, 100, 5, 200
# The smallest boosted model: one split on one of three flags, which SQL can follow.
STUMP_SPEC = replace(SPEC, numeric=("mens", "womens", "newbie"), categorical=())
STUMP = {"rounds": 1, "depth": 1}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_stored: dict[tuple, DataFrame] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def stored(fn):
    """Stage tables are written once per application and state of the input files, then scanned by all queries."""

    @wraps(fn)
    def once(spark: SparkSession, folder: str) -> DataFrame:
        at = (spark.sparkContext.applicationId, folder, fn.__name__, *_file_states(spark, folder))
        if at not in _stored:
            _stored[at] = fn(spark, folder)
        return _stored[at]

    return once


def _file_states(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of the input files, so that changed inputs are not answered from old stage tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def _fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@stored
def experiment(spark, folder):
    return materialize(binarize_treatment(experiment_table(spark, folder), SPEC), "experiment")


@stored
def split_table(spark, folder):
    return materialize(
        split.stratified_split(experiment(spark, folder), SPEC, 0.20, SEED), "split", ("split",)
    )


def _sides(spark, folder):
    table = split_table(spark, folder)
    return table.where("split = 'train'"), table.where("split = 'test'")


@stored
def scored(spark, folder):
    """Test units with the scores of the cell learners and one score that never ties."""
    train, test = _sides(spark, folder)
    formulas = {"s_base": "response", "s_two": "two_model", "s_class": "class_transform"}
    df = learners.cell_scores(train, test, SPEC, "visit", CELL, formulas)
    df = effects.cell_effect_scores(train, df, SPEC, "visit", CELL, "s_res", seed=SEED)
    df = df.withColumn("s_cont", F.col("history") / (1.0 + F.col("recency")))
    return materialize(df.select("unit_id", *KEEP, *MODELS.values()), "scored")


@stored
def _scores(spark, folder) -> Scores:
    """The score rows with their bins, as one analysis builds them once for all its metrics."""
    return long_scores(scored(spark, folder), MODELS, "unit_id", KEEP, keyed=True)


def stage_tables(spark: SparkSession, folder: str) -> None:
    """Write all tables that queries share."""
    _scores(spark, folder)
    _intervals(spark, folder)


# --- scans, arms, profile ---------------------------------------------------------------------


@query
def experiment_view(spark, folder):
    return experiment_table(spark, folder)


@query
def assemble_roles(spark, folder):
    table = experiment(spark, folder)
    return assemble(
        SPEC.project_features(table), SPEC.project_outcomes(table), SPEC.project_treatment(table), SPEC
    )


@query
def arm_labels(spark, folder):
    return experiment(spark, folder).select("unit_id", "segment", "treatment")


@query
def dataset_report(spark, folder):
    return profile.dataset_report(experiment(spark, folder).drop("treatment"), SPEC)


@query
def missing_report(spark, folder):
    return profile.missing_report(experiment_units(spark, folder))


@query
def treatment_split(spark, folder):
    return profile.treatment_split(experiment(spark, folder), SPEC)


@query
def arm_breakdown(spark, folder):
    return profile.arm_breakdown(experiment(spark, folder), SPEC)


@query
def outcome_rates(spark, folder):
    return profile.outcome_rates(experiment(spark, folder), SPEC, ("visit", "conversion"))


@query
def naive_effect(spark, folder):
    return profile.naive_effect(experiment(spark, folder), SPEC)


@query
def actual_effect(spark, folder):
    return profile.actual_effect(experiment(spark, folder), "treatment", "visit", ("zip_code",))


@query
def histogram(spark, folder):
    table = profile.density_histogram(experiment(spark, folder), SPEC)
    return table.withColumns(
        {"bin_start": F.round("bin_start", 6), "density": F.round("density", 6)}
    )


@query
def strat_counts(spark, folder):
    return profile.stratum_counts(experiment(spark, folder), SPEC)


@query
def revert_label(spark, folder):
    return profile.revert_label_rate(experiment(spark, folder), SPEC, "visit")


@query
def class_weight(spark, folder):
    return learners.class_counts(experiment(spark, folder), "visit")


# --- balance ----------------------------------------------------------------------------------


@query
def numeric_balance(spark, folder):
    return balance.numeric_balance(experiment(spark, folder), SPEC)


@query
def contingency(spark, folder):
    return balance.contingency(experiment(spark, folder), SPEC, SPEC.categorical)


@query
def arm_shares(spark, folder):
    return balance.arm_shares(experiment(spark, folder), SPEC, SPEC.categorical)


@query
def categorical_balance(spark, folder):
    return balance.categorical_balance(experiment(spark, folder), SPEC)


@query
def randomization_check(spark, folder):
    return balance.randomization_check(experiment(spark, folder), SPEC)


# --- encoding and split -----------------------------------------------------------------------


@query
def one_hot(spark, folder):
    table = experiment(spark, folder)
    return encoding.fit_one_hot(table, SPEC).transform(table, ("unit_id",))


@query
def stratified_split(spark, folder):
    table = experiment(spark, folder)
    return split.stratified_split(table, SPEC, 0.20, SEED).select("unit_id", "split")


@query
def split_summary(spark, folder):
    return profile.split_summary(split_table(spark, folder), SPEC, "visit")


@query
def split_balance(spark, folder):
    return balance.split_balance(split_table(spark, folder), SPEC)


@query
def split_deviation(spark, folder):
    return balance.any_deviation(balance.split_balance(split_table(spark, folder), SPEC, tolerance=0.001))


@query
def arm_summary(spark, folder):
    train, _ = _sides(spark, folder)
    return profile.arm_summary(train, SPEC, "visit")


# --- cell learners ----------------------------------------------------------------------------


def _cell_query(formula: str):
    def run(spark, folder):
        train, test = _sides(spark, folder)
        df = learners.cell_scores(train, test, SPEC, "visit", CELL, {"score": formula})
        return df.select("unit_id", "score")

    return run


QUERIES["cell_response"] = _cell_query("response")
QUERIES["cell_two_model"] = _cell_query("two_model")
QUERIES["cell_class_transform"] = _cell_query("class_transform")


@query
def residual_effect(spark, folder):
    train, _ = _sides(spark, folder)
    return effects.cell_residual_effect(train, SPEC, "visit", CELL, seed=SEED)


# --- rankings ---------------------------------------------------------------------------------


@query
def score_summary(spark, folder):
    summary = profile.score_summary(named_rows(_scores(spark, folder)))
    return summary.withColumn("mean_score", F.round("mean_score", 6))


@query
def combine_scores(spark, folder):
    table = scored(spark, folder)
    return ranking.combine_scores(
        table.drop("s_base"), table.select("unit_id", "s_base"), "unit_id", "s_base"
    )


@query
def unmatched_scores(spark, folder):
    return ranking.unmatched_scores(
        experiment(spark, folder).select("unit_id"), scored(spark, folder), "unit_id", "s_base"
    )


@query
def rank_units(spark, folder):
    return ranking.build_ranking(_scores(spark, folder), KEEP)


@query
def ranking_head_tail(spark, folder):
    return ranking.head_and_tail(scored(spark, folder), "s_base", "unit_id", KEEP)


@query
def top_k_split(spark, folder):
    return flag_top(_scores(spark, folder), 0.10).select("model", "unit_id", "in_top")


@query
def signal_check(spark, folder):
    return ranking.signal_check(_scores(spark, folder), "visit")


@query
def signal_check_effect(spark, folder):
    return ranking.signal_check_effect(_scores(spark, folder), "treatment", "visit")


@query
def uplift_at_k(spark, folder):
    return ranking.uplift_at_k(_scores(spark, folder), "treatment", "visit", KS)


@query
def best_model(spark, folder):
    checks = ranking.signal_check_effect(_scores(spark, folder), "treatment", "visit")
    return ranking.best_model(checks, "gap", tuple(MODELS))


# --- targeting --------------------------------------------------------------------------------


@query
def random_selection(spark, folder):
    return target.random_selection(scored(spark, folder), "unit_id", 0.10, SEED)


def _budget_table(spark, folder):
    scores = target.strategy_scores(scored(spark, folder), MODELS, "unit_id", KEEP, SEED)
    return target.budget_targeting(scores, "treatment", "visit", BUDGETS)


QUERIES["budget_targeting"] = _budget_table


@query
def beat_random(spark, folder):
    return target.beat_random(_budget_table(spark, folder))


@query
def all_beat_random(spark, folder):
    return target.all_beat_random(_budget_table(spark, folder))


# --- curves -----------------------------------------------------------------------------------


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


@query
def qini_curve(spark, folder):
    curve = curves.qini_curve(_scores(spark, folder), "treatment", "visit")
    return _rounded(curve, "share", "y", "random_y")


@query
def qini_coefficient(spark, folder):
    table = curves.qini_coefficient(_scores(spark, folder), "treatment", "visit").drop("m")
    return _rounded(table, "curve_area", "curve_end", "qini_coefficient", digits=5)


@query
def compute_qini_metrics(spark, folder):
    curve, coefficients = curves.qini_metrics(_scores(spark, folder), "treatment", "visit")
    points = curve.groupBy("model").agg(F.count(F.lit(1)).alias("n_points"), F.max("y").alias("peak"))
    table = coefficients.drop("m").join(points, "model")
    return _rounded(table, "curve_area", "curve_end", "qini_coefficient", "peak", digits=5)


@query
def roc_auc(spark, folder):
    return _rounded(curves.roc_auc(_scores(spark, folder), ("visit", "conversion")), "auc")


@query
def precision_recall(spark, folder):
    return curves.precision_recall(_scores(spark, folder), "visit", THRESHOLD)


@query
def average_precision(spark, folder):
    return _rounded(curves.average_precision(_scores(spark, folder), "visit"), "average_precision")


@query
def pr_curve(spark, folder):
    return curves.precision_recall_curve(_scores(spark, folder), "visit")


@query
def classifier_report(spark, folder):
    report = curves.classifier_report(_scores(spark, folder), "visit", THRESHOLD)
    return _rounded(report, "auc_roc", "average_precision")


# --- resampling -------------------------------------------------------------------------------


@query
def bootstrap_weights(spark, folder):
    return resample.bootstrap_weights(scored(spark, folder), "unit_id", WEIGHT_REPLICATES, SEED)


@query
def bootstrap_replicates(spark, folder):
    scores = _scores(spark, folder)
    table = resample.bootstrap_qini(scores, "treatment", "visit", REPLICATES, SEED)
    named = table.withColumn("model", curves.model_name(scores)).drop("m")
    return _rounded(named, "qini")


@query
def bootstrap_multinomial(spark, folder):
    units, rate = resample.with_exact_draws(scored(spark, folder), "unit_id", REPLICATES, SEED)
    scores = long_scores(units, MODELS, "unit_id", [*KEEP, resample.EXTRA], keyed=True, binary=KEEP)
    table = resample.bootstrap_qini(scores, "treatment", "visit", REPLICATES, SEED, rate)
    named = table.withColumn("model", curves.model_name(scores)).drop("m")
    return _rounded(named, "qini")


@stored
def _intervals(spark, folder) -> DataFrame:
    scores = _scores(spark, folder)
    replicates = resample.bootstrap_qini(scores, "treatment", "visit", REPLICATES, SEED)
    intervals = resample.with_intervals(
        curves.qini_coefficient(scores, "treatment", "visit"),
        resample.percentile_interval(replicates, scores),
    )
    # One row per model; what follows reads it more than once.
    return materialize(intervals, "intervals")


@query
def bootstrap_qini_ci(spark, folder):
    return _rounded(_intervals(spark, folder), "qini_coefficient", "ci_lower_95", "ci_upper_95")


@query
def results_join(spark, folder):
    uplift = ranking.uplift_at_k(_scores(spark, folder), "treatment", "visit", KS)
    return resample.results_table(_intervals(spark, folder), uplift, KS)


@query
def pairwise_overlap(spark, folder):
    return resample.pairwise_overlap(_intervals(spark, folder), tuple(MODELS))


@query
def verdict_facts(spark, folder):
    facts = resample.verdict_facts(_intervals(spark, folder), tuple(MODELS), "Residual Effect")
    return _rounded(facts, "best_qini", "best_lower", "best_upper")


# --- scans and sinks: written as the workflow writes them, read back as it reads them -------------


@query
def csv_round_trip(spark, folder):
    path = _fresh_path(spark, "raw-csv")
    sinks.write_raw(experiment(spark, folder), path, fmt="csv")
    return tables.read_experiment_csv(spark, path, key="unit_id")


def _written_dialect(spark, folder) -> str:
    """Raw files as other programs write them: quotes inside fields, quoted commas and line breaks, some records with a field too many."""
    path = _fresh_path(spark, "raw-dialect")
    names = ["unit_id", *RAW_SCHEMA.fieldNames()]
    df = experiment(spark, folder)
    spoken = F.concat(F.lit('the "'), F.col("zip_code"), F.lit('", or so'))
    zip_code = F.when(F.col("unit_id") % 7 == 0, spoken).when(F.col("unit_id") % 11 == 0, F.concat(F.col("zip_code"), F.lit("\nsecond line")))
    df = df.withColumn("zip_code", zip_code.otherwise(F.col("zip_code")))
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in names]
    surplus = F.when(F.col("unit_id") % 13 == 0, F.lit(',one,"too, many"')).otherwise("")
    # A file with a quoted line break is read whole by one task, so files are many, not large.
    parts = max(4, -(-df.count() // ROWS_PER_FILE))
    part = F.pmod(F.xxhash64("unit_id"), F.lit(parts)).alias("part")
    records = df.select(part, F.lit(1).alias("place"), F.concat(F.concat_ws(",", *quoted), surplus).alias("value"))
    heads = spark.range(parts).select(F.col("id").alias("part"), F.lit(0).alias("place"), F.lit(",".join(names)).alias("value"))
    lines = records.unionByName(heads).repartition(parts, "part").sortWithinPartitions("part", "place")
    lines.select("part", "value").write.partitionBy("part").text(path)
    return path


@query
def csv_dialect(spark, folder):
    return tables.read_experiment_csv(spark, _written_dialect(spark, folder), key="unit_id", skip_bad=True)


@query
def csv_ledger(spark, folder):
    ledger = tables.bad_records(tables.scan_csv(spark, _written_dialect(spark, folder)))
    return ledger.groupBy("fault").agg(F.sum("records").alias("records"))


@query
def parquet_round_trip(spark, folder):
    path = _fresh_path(spark, "raw")
    sinks.write_raw(experiment(spark, folder), path)
    return tables.read_experiment_parquet(spark, path, key="unit_id")


@query
def split_round_trip(spark, folder):
    path = _fresh_path(spark, "split")
    sinks.write_split(split_table(spark, folder), path)
    return tables.read_split(spark, path, "test").select("unit_id", "treatment", "visit", "split")


@query
def scores_round_trip(spark, folder):
    path = _fresh_path(spark, "scores")
    sinks.write_scores(scored(spark, folder), path)
    stored_scores = tables.read_scores(spark, path, tuple(MODELS.values()))
    return _rounded(stored_scores, *MODELS.values())


@query
def result_round_trip(spark, folder):
    path = _fresh_path(spark, "result")
    result = ranking.uplift_at_k(_scores(spark, folder), "treatment", "visit", KS)
    sinks.write_result(result, path)
    return spark.read.option("header", True).option("escape", '"').schema(result.schema).csv(path)


@query
def threshold_labels(spark, folder):
    rows = named_rows(_scores(spark, folder))
    return rows.select("unit_id", "model", threshold_label("score", THRESHOLD).alias("label"))


# --- tree learners: the smallest ones, checked by SQL, then full ones (no SQL counterpart) ---------


@query
def stump_response(spark, folder):
    """Fitted, stored, loaded again, scored."""
    train, test = _sides(spark, folder)
    path = _fresh_path(spark, "model")
    sinks.save_model(learners.train_response_model(train, STUMP_SPEC, "visit", SEED, **STUMP), path)
    scored_test = learners.predict_probability(sinks.load_model(spark, path), test, "score")
    return _rounded(scored_test.select("unit_id", "score"), "score")


@query
def stump_two_model(spark, folder):
    train, test = _sides(spark, folder)
    models = learners.two_model(train, STUMP_SPEC, "visit", SEED, **STUMP)
    return _rounded(learners.score_two_model(models, test, "score").select("unit_id", "score"), "score")


@query
def stump_class_transform(spark, folder):
    train, test = _sides(spark, folder)
    model = learners.class_transformation(train, STUMP_SPEC, "visit", SEED, **STUMP)
    scored_test = learners.score_class_transformation(model, test, "score")
    return _rounded(scored_test.select("unit_id", "score"), "score")


@query
def fold_assignment(spark, folder):
    return effects.with_fold(_sides(spark, folder)[0], SPEC, 2, SEED).select("unit_id", "fold")


@query
def gbt_baseline(spark, folder):
    train, test = _sides(spark, folder)
    model = learners.train_response_model(train, SPEC, "visit", SEED, ROUNDS, DEPTH)
    return learners.predict_probability(model, test, "score").select("unit_id", *KEEP, "score")


@query
def gbt_two_model(spark, folder):
    train, test = _sides(spark, folder)
    models = learners.two_model(train, SPEC, "visit", SEED, ROUNDS, DEPTH)
    return learners.score_two_model(models, test, "score").select("unit_id", *KEEP, "score")


@query
def gbt_class_transform(spark, folder):
    train, test = _sides(spark, folder)
    model = learners.class_transformation(train, SPEC, "visit", SEED, ROUNDS, DEPTH)
    return learners.score_class_transformation(model, test, "score").select("unit_id", *KEEP, "score")


@query
def effect_forest(spark, folder):
    train, test = _sides(spark, folder)
    forest = effects.train_effect_forest(
        train, SPEC, "visit", trees=TREES, nuisance_rounds=NUISANCE_ROUNDS, depth=DEPTH, seed=SEED
    )
    return forest.score(test, "score").select("unit_id", *KEEP, "score")
