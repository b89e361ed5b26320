import numpy as np
import pandas as pd
import pytest
from conftest import SCORE_COLUMNS, scored_frame
from pyspark.sql import functions as F

from armspark.operators import curves
from armspark.operators.ordering import long_scores

KEEP = ["treatment", "visit", "conversion"]


def reference_curve(t, y, score):
    """Curve points by walking distinct scores downwards."""
    xs, ys = [0], [0.0]
    for cut in sorted(set(score), reverse=True):
        at = score >= cut
        n_t, n_c = (t[at] == 1).sum(), (t[at] == 0).sum()
        y_t, y_c = y[at & (t == 1)].sum(), y[at & (t == 0)].sum()
        xs.append(at.sum())
        ys.append(y_t - (y_c * n_t / n_c if n_c else 0))
    return np.array(xs, float), np.array(ys, float)


def reference_qini(t, y, score):
    x, h = reference_curve(t, y, score)
    px, ph = reference_curve(t, y, y * t - y * (1 - t))
    line = x[-1] * h[-1] / 2
    return (np.trapezoid(h, x) - line) / (np.trapezoid(ph, px) - line)


@pytest.fixture(scope="module")
def frame():
    return scored_frame()


@pytest.fixture(scope="module", params=[1_000_000, 30], ids=["few-bins", "many-bins"])
def scores(spark, frame, request):
    return long_scores(
        spark.createDataFrame(frame), SCORE_COLUMNS, "unit_id", KEEP, rows_per_bin=request.param
    )


def one_model(spark, t, y, s, **bins):
    pdf = pd.DataFrame({"unit_id": range(len(t)), "treatment": t, "visit": y, "s": s})
    return long_scores(spark.createDataFrame(pdf), {"A": "s"}, "unit_id", KEEP[:2], **bins)


def test_hand_computed_curve(spark):
    """Eight rows, both arms, one tie; points and areas worked out on paper.

    0.9: T/1 | 0.8: C/0 | 0.7: T/0, C/1 (tie) | 0.6: T/1 | 0.5: C/0 | 0.4: T/0 | 0.3: C/1
    curve (0,0) (1,1) (2,1) (4,0) (5,0.5) (6,1) (7,2/3) (8,0)
    area 0.5 + 1 + 1 + 0.25 + 0.75 + 5/6 + 1/3 = 14/3; end 0, so the line's area is 0
    perfect: a=2 b=2: 2 + (8-4)*2 + 2*(2+0)/2 = 12
    """
    t = [1, 0, 1, 0, 1, 0, 1, 0]
    y = [1, 0, 0, 1, 1, 0, 0, 1]
    s = [0.9, 0.8, 0.7, 0.7, 0.6, 0.5, 0.4, 0.3]
    scores = one_model(spark, t, y, s)
    points = sorted((r.x, r.y) for r in curves.qini_curve(scores, "treatment", "visit").collect())
    want = [(0, 0), (1, 1), (2, 1), (4, 0), (5, 0.5), (6, 1), (7, 4 / 6), (8, 0)]
    assert [p[0] for p in points] == [p[0] for p in want]
    assert [p[1] for p in points] == pytest.approx([p[1] for p in want])
    row = curves.qini_coefficient(scores, "treatment", "visit").first()
    assert row.curve_area == pytest.approx(14 / 3)
    assert row.qini_coefficient == pytest.approx((14 / 3) / 12)


def test_perfect_constant_and_degenerate(spark):
    rng = np.random.default_rng(2)
    t, y = rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    perfect = one_model(spark, t, y, (y * t - y * (1 - t)).astype(float))
    assert curves.qini_coefficient(perfect, "treatment", "visit").first().qini_coefficient == pytest.approx(1)
    constant = one_model(spark, t, y, np.full(300, 0.25))
    assert curves.qini_coefficient(constant, "treatment", "visit").first().qini_coefficient == pytest.approx(0)
    one_arm = one_model(spark, np.ones(300, int), y, rng.random(300))
    assert curves.qini_coefficient(one_arm, "treatment", "visit").first().qini_coefficient is None
    no_outcome = one_model(spark, t, np.zeros(300, int), rng.random(300))
    assert curves.qini_coefficient(no_outcome, "treatment", "visit").first().qini_coefficient is None


def test_invariances(spark, frame):
    df = spark.createDataFrame(frame).withColumn("moved", F.exp(F.col("smooth")) * 3 + 1)
    base = long_scores(df, {"A": "smooth"}, "unit_id", KEEP)
    moved = long_scores(df.repartition(7), {"A": "moved"}, "unit_id", KEEP, rows_per_bin=40)
    a, b = (curves.qini_coefficient(s, "treatment", "visit").first().qini_coefficient for s in (base, moved))
    assert a == pytest.approx(b)


def test_qini_against_reference(scores, frame):
    t, y = frame.treatment.to_numpy(), frame.visit.to_numpy()
    got = {r.model: r for r in curves.qini_coefficient(scores, "treatment", "visit").collect()}
    points = curves.qini_curve(scores, "treatment", "visit").toPandas()
    for model, column in SCORE_COLUMNS.items():
        s = frame[column].fillna(-np.inf).to_numpy()
        assert got[model].qini_coefficient == pytest.approx(reference_qini(t, y, s))
        x, h = reference_curve(t, y, s)
        mine = points[points.model == model].sort_values("x")
        assert mine.x.tolist() == x.tolist() and np.allclose(mine.y, h)
        assert np.allclose(mine.random_y, mine.share * h[-1])


def test_auc_ap_and_curve(scores, frame):
    auc = {(r.model, r.label): r.auc for r in curves.roc_auc(scores, ["visit", "conversion"]).collect()}
    ap = {r.model: r.average_precision for r in curves.average_precision(scores, "visit").collect()}
    report = {r.model: r for r in curves.classifier_report(scores, "visit", 0.5).collect()}
    plain = {r.model: r for r in curves.precision_recall(scores, "visit", 0.5).collect()}
    points = curves.precision_recall_curve(scores, "visit").toPandas()
    for model, column in SCORE_COLUMNS.items():
        s = frame[column].fillna(-np.inf).to_numpy()
        for label in ("visit", "conversion"):
            pos, neg = s[frame[label] == 1], s[frame[label] == 0]
            pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
            assert auc[model, label] == pytest.approx(pairs / (len(pos) * len(neg)))
        y, last, total, want = frame.visit.to_numpy(), 0.0, frame.visit.sum(), 0.0
        for cut in sorted(set(s), reverse=True):
            recall, precision = y[s >= cut].sum() / total, y[s >= cut].mean()
            want += (recall - last) * precision
            last = recall
        assert ap[model] == pytest.approx(want) == report[model].average_precision
        assert report[model].auc_roc == pytest.approx(auc[model, "visit"])
        chosen = s >= 0.5
        assert plain[model].precision == pytest.approx(y[chosen].mean()) == report[model].precision
        assert plain[model].recall == pytest.approx(y[chosen].sum() / total) == report[model].recall
        mine = points[points.model == model]
        assert len(mine) == len(set(s)) + 1 and (mine.threshold.isna() & (mine.precision == 1)).sum() == 1


def test_undefined_precision_is_zero(spark):
    scores = one_model(spark, [0, 1], [0, 1], [0.1, 0.2])
    row = curves.precision_recall(scores, "visit", 0.9).first()
    assert (row.precision, row.recall) == (0.0, 0.0)
