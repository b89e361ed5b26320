import numpy as np
import pytest
from conftest import SCORE_COLUMNS, scored_frame
from pyspark.sql import functions as F

from armspark.functions import hashing
from armspark.operators import resample
from armspark.operators.curves import qini_coefficient
from armspark.operators.ordering import long_scores, model_name

KEEP = ["treatment", "visit"]
REPS = 12


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(scored_frame(500))


@pytest.fixture(scope="module", params=[1_000_000, 25], ids=["few-bins", "many-bins"])
def scores(frame, request):
    return long_scores(frame, SCORE_COLUMNS, "unit_id", KEEP, rows_per_bin=request.param)


def by_key(df):
    return {(r.m, r.rep): (r.n, r.qini) for r in df.collect()}


def test_block_bootstrap_equals_explicit_weights(scores, frame, monkeypatch):
    """The per-cell computation against plain joins and windows over the same weights."""
    monkeypatch.setattr(resample, "_BLOCK", 17)
    monkeypatch.setattr(resample, "_AREA_BLOCK", 13)
    blocks = by_key(resample.bootstrap_qini(scores, "treatment", "visit", REPS, seed=9))
    weights = resample.bootstrap_weights(frame, "unit_id", REPS, seed=9)
    rows = by_key(resample.weighted_qini(scores, weights, "treatment", "visit"))
    assert blocks.keys() == rows.keys() and len(rows) == REPS * len(SCORE_COLUMNS)
    for k in rows:
        assert blocks[k][0] == rows[k][0] and blocks[k][1] == pytest.approx(rows[k][1])


def test_weights_as_rows_hash_each_unit_once(frame):
    """A filter pushed under the draw used to repeat the unit's hash hundreds of times per row; texts and NULL keys are units too."""
    plan = resample.bootstrap_weights(frame, "unit_id", REPS, seed=9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2
    named = frame.select(F.concat(F.lit("k"), "unit_id").alias("unit_id")).unionByName(frame.limit(1).select(F.lit(None).cast("string").alias("unit_id")))
    units = named.select("unit_id", hashing.stream_id("unit_id", 9, hashing.STREAM_BOOTSTRAP).alias("u")).collect()
    draws = hashing.poisson_matrix(np.array([r.u for r in units]), hashing.replicate_words(REPS))
    want = {(r.unit_id, rep, int(w)) for r, row in zip(units, draws) for rep, w in enumerate(row) if w}
    got = [tuple(r) for r in resample.bootstrap_weights(named, "unit_id", REPS, seed=9).collect()]
    assert len(got) == len(want) and set(got) == want


def test_resample_work_is_dealt_in_small_cells(spark):
    """Eight cells of a model left most cores idle, and a score that a fortieth of the rows share was walked row by row."""
    few = spark.range(8000).select(
        F.col("id").alias("unit_id"), (F.col("id") % 40 / 40.0).alias("few"), (F.col("id") / 8000.0).alias("smooth"),
        (F.col("id") % 2).alias("treatment"), (F.col("id") % 3 % 2).alias("visit"),
    )
    cells = long_scores(few, {"few": "few", "smooth": "smooth"}, "unit_id", KEEP).rows.groupBy("m", "bin", "sub").count()
    assert cells.agg(F.max("count")).first()[0] <= 8000 / 16


@pytest.mark.parametrize("rate", [1.0, 0.97, 0.2])
def test_poisson_matrix_is_the_inverse_of_the_cumulative_probabilities(rate):
    units, words = np.arange(3000, dtype=np.int64) << 20, hashing.replicate_words(40)
    for by_replicate in (False, True):
        h = hashing.draw_matrix(units, words, by_replicate)
        want = sum((h.astype(np.int64) >= cut).astype(int) for cut in hashing.poisson_cuts(rate))
        assert (hashing.poisson_matrix(units, words, rate, by_replicate) == want).all() and (rate < 1 or want.max() > hashing.COMMON)


def test_weighted_qini_equals_repeated_rows(spark, frame):
    weights = resample.bootstrap_weights(frame, "unit_id", 1, seed=4)
    scores = long_scores(frame, {"A": "tied"}, "unit_id", KEEP)
    got = resample.weighted_qini(scores, weights, "treatment", "visit").first().qini
    repeated = frame.join(weights, "unit_id").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("weight")))
    )
    copies = repeated.withColumn("unit_id", F.col("unit_id") * 100 + F.col("copy"))
    again = long_scores(copies, {"A": "tied"}, "unit_id", KEEP)
    want = qini_coefficient(again, "treatment", "visit").first().qini_coefficient
    assert got == pytest.approx(want)


def test_resample_is_paired_and_seeded(spark, frame):
    twice = long_scores(frame, {"A": "smooth", "B": "smooth"}, "unit_id", KEEP)
    rows = by_key(resample.bootstrap_qini(twice, "treatment", "visit", REPS, seed=1))
    assert all(rows[0, r] == rows[1, r] for r in range(REPS))
    again = by_key(resample.bootstrap_qini(twice, "treatment", "visit", REPS, seed=1))
    assert rows == again
    other = by_key(resample.bootstrap_qini(twice, "treatment", "visit", REPS, seed=2))
    assert rows != other


def test_multinomial_draws(frame):
    weights = resample.multinomial_weights(frame, "unit_id", REPS, seed=3).toPandas()
    assert (weights.groupby("rep").weight.sum() == 500).all() and weights.rep.nunique() == REPS
    assert weights.groupby(["rep", "unit_id"]).size().max() == 1
    assert 0.55 < (weights.groupby("rep").size() / 500).mean() < 0.71


@pytest.mark.parametrize("rows_per_bin", [1_000_000, 25])
def test_streamed_multinomial_equals_explicit_weights(frame, monkeypatch, rows_per_bin):
    monkeypatch.setattr(resample, "_BLOCK", 17)
    monkeypatch.setattr(resample, "_AREA_BLOCK", 13)
    units, rate = resample.with_exact_draws(frame, "unit_id", REPS, seed=3)
    assert 0.5 < rate < 1.0
    scores = long_scores(
        units, SCORE_COLUMNS, "unit_id", [*KEEP, resample.EXTRA], rows_per_bin=rows_per_bin, binary=KEEP
    )
    table = resample.bootstrap_qini(scores, "treatment", "visit", REPS, 3, rate)
    blocks = by_key(table)
    weights = resample.multinomial_weights(frame, "unit_id", REPS, seed=3)
    plain = long_scores(frame, SCORE_COLUMNS, "unit_id", KEEP)
    rows = by_key(resample.weighted_qini(plain, weights, "treatment", "visit"))
    assert blocks.keys() == rows.keys() and len(rows) == REPS * len(SCORE_COLUMNS)
    for k in rows:
        assert blocks[k][0] == rows[k][0] == 500 and blocks[k][1] == pytest.approx(rows[k][1])
    # No task sees units x replicates as rows: the plan explodes nothing but the models.
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == plan.count("Generate inline")


def test_single_draws_are_dealt_not_sent(frame):
    """The few rows that stand for the draws looked small enough to send: all draws went through the driver, made by one task."""
    draws, _ = resample.single_draws(frame, "unit_id", REPS, seed=3)
    rows = draws.collect()
    final = draws._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and len(rows) > REPS
    assert "SortMergeJoin [position" in final and "BroadcastHashJoin [position" not in final
    assert "REPARTITION_BY_NUM" in final


@pytest.mark.parametrize("n, replicates", [(1, 5), (3, 400), (40, 300), (900, 200)])
def test_multinomial_moments(spark, n, replicates):
    """Exactly n draws; mean 1 and variance 1 - 1/n per unit, also for few units (rate 0)."""
    df = spark.range(n).select(F.col("id").alias("unit_id"))
    weights = resample.multinomial_weights(df, "unit_id", replicates, seed=8).toPandas()
    assert (weights.groupby("rep").weight.sum() == n).all() and weights.rep.nunique() == replicates
    table = weights.pivot(index="unit_id", columns="rep", values="weight").reindex(range(n)).fillna(0).to_numpy()
    assert table.mean() == pytest.approx(1.0)
    assert table.var() == pytest.approx(1 - 1 / n, abs=5 * (2 / (n * replicates)) ** 0.5)
    units = np.corrcoef(table) if n > 1 else np.ones((1, 1))
    if n > 1:
        assert abs(units[np.triu_indices(n, 1)].mean() + 1 / (n - 1)) < 6 / (replicates * n) ** 0.5


def test_units_with_equal_halves_of_their_identity_draw_apart(spark):
    """Streams belong to 64 bits: units that agree in 32 of them share no stream, in numpy and in Spark alike."""
    low = np.arange(50, dtype=np.int64)
    units = np.unique(np.concatenate([low, low | (np.int64(1) << 32), low | np.int64(-(2**63)), low << 32]))
    words = hashing.replicate_words(64)
    numbers = hashing.draw_matrix(units, words)
    _, times = np.unique(numbers, return_counts=True)
    assert (times > 1).sum() <= 4  # chance meetings alone: 12,672 numbers below 2^32
    assert (hashing.draw_matrix(units, words, by_replicate=True) == numbers.T).all()
    df = spark.createDataFrame([(int(u), int(w)) for u in units for w in words[:8]], "u long, w long")
    ours = [r[0] for r in df.select(hashing.draw_column(F.col("u"), F.col("w"))).collect()]
    assert ours == numbers[:, :8].ravel().tolist()
    assert abs(np.corrcoef(numbers[:50].ravel(), numbers[50:100].ravel())[0, 1]) < 0.08


def test_interval(spark, frame):
    scores = long_scores(frame, SCORE_COLUMNS, "unit_id", KEEP)
    reps = resample.bootstrap_qini(scores, "treatment", "visit", 40, seed=5)
    pdf = reps.withColumn("model", model_name(scores)).toPandas()
    for r in resample.percentile_interval(reps, scores).collect():
        lo, hi = np.percentile(pdf[pdf.model == r.model].qini, [2.5, 97.5])
        assert (r.ci_lower_95, r.ci_upper_95) == pytest.approx((lo, hi))
        assert r.n_successful_resamples == 40 and r.ci_lower_95 <= r.ci_upper_95


def test_failed_replicates_are_skipped(spark):
    """Three units: many resamples lack an arm or an outcome class."""
    df = spark.createDataFrame(
        [(1, 1, 1, 0.3), (2, 0, 0, 0.2), (3, 1, 0, 0.1)], "unit_id long, treatment int, visit int, s double"
    )
    scores = long_scores(df, {"A": "s"}, "unit_id", KEEP)
    reps = resample.bootstrap_qini(scores, "treatment", "visit", 60)
    row = resample.percentile_interval(reps, scores).first()
    assert 0 < row.n_successful_resamples < 60


REGIONS = ["east", "north", "south", "west"]
CI = [
    ("east", 0.12, 0.05, 0.20),
    ("north", 0.31, 0.18, 0.44),
    ("south", -0.04, -0.11, 0.049),
    ("west", 0.02, -0.06, 0.10),
]


def intervals(spark, rows=CI):
    return spark.createDataFrame(
        rows, "model string, qini_coefficient double, ci_lower_95 double, ci_upper_95 double"
    )


def test_pairwise(spark):
    rows = resample.pairwise_overlap(intervals(spark), REGIONS).collect()
    got = {(r.model_a, r.model_b): r.cis_overlap for r in rows}
    assert got == {
        ("east", "north"): True,
        ("east", "south"): False,
        ("east", "west"): True,
        ("north", "south"): False,
        ("north", "west"): False,
        ("south", "west"): True,
    }
    assert {r.verdict for r in rows if not r.cis_overlap} == {"Distinguishable (CIs do not overlap)"}


def test_verdict(spark):
    row = resample.verdict_facts(intervals(spark), REGIONS, "east").first()
    assert (row.best_model, row.overlapping, row.n_distinguishable, row.n_pairs) == ("north", "east", 3, 6)
    assert (row.reference_rank, row.n_models) == (2, 4)
    tied = [("p", 0.25, 0.125, 0.5), ("q", 0.25, 0.2, 0.4), ("r", 0.0, -0.5, 0.15)]
    row = resample.verdict_facts(intervals(spark, tied), ["p", "q", "r"], "q").first()
    assert (row.best_model, row.overlapping, row.reference_rank) == ("p", "q,r", 1)
    assert resample.verdict_facts(intervals(spark), REGIONS).first().reference_rank is None


def test_results_table(spark):
    uplift = spark.createDataFrame(
        [(m, k, k / 3) for m in REGIONS for k in (0.1, 0.2)], "model string, k double, uplift_at_k double"
    )
    rows = {r.model: r for r in resample.results_table(intervals(spark), uplift, (0.1, 0.2)).collect()}
    assert rows["east"].uplift_at_10pct == 0.0333 and rows["west"].uplift_at_20pct == 0.0667


def test_zero_inclusion(spark):
    ci = spark.createDataFrame([("A", -0.1, 0.1, 9), ("B", 0.1, 0.2, 9)],
        "model string, ci_lower_95 double, ci_upper_95 double, n_successful_resamples long")
    q = spark.createDataFrame([("A", 0.0), ("B", 0.15)], "model string, qini_coefficient double")
    got = {r.model: r.contains_zero for r in resample.with_intervals(q, ci).collect()}
    assert got == {"A": True, "B": False}
