import math

import numpy as np
import pytest
from conftest import SCORE_COLUMNS, ordered, scored_frame
from pyspark.sql import functions as F

from armspark.operators import ordering, ranking, targeting
from armspark.operators.curves import arm_values

KEEP = ["treatment", "visit", "conversion"]


@pytest.fixture(scope="module")
def frame():
    return scored_frame()


@pytest.fixture(scope="module", params=[1_000_000, 25], ids=["few-bins", "many-bins"])
def scores(spark, frame, request):
    return ordering.long_scores(
        spark.createDataFrame(frame), SCORE_COLUMNS, "unit_id", KEEP, rows_per_bin=request.param
    )


def test_edges_isolate_heavy_values():
    edges, isolated = ordering._edges(ordering._marks([0.1, 0.5, 0.5, 0.5, 0.9]))
    assert edges[0] == -np.inf and edges[-1] == np.inf and edges == sorted(set(edges))
    assert [edges[i] for i in isolated] == [0.5] and edges[isolated[0] + 1] == np.nextafter(0.5, 1)
    edges, isolated = ordering._edges(ordering._marks([-np.inf, -np.inf, 0.0]))
    assert isolated == [0] and edges[1] < -1e308


def test_cells_are_bounded_even_with_a_hot_tie(spark):
    frame = scored_frame(2000, hot=0.5)
    many = ordering.long_scores(
        spark.createDataFrame(frame), SCORE_COLUMNS, "unit_id", KEEP, rows_per_bin=50
    )
    largest = many.rows.groupBy("m", "bin", "sub").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 50


def test_global_rank(scores, frame):
    got = ordering.global_rank(scores).select("model", "unit_id", "rank").toPandas()
    for model, column in SCORE_COLUMNS.items():
        want = ordered(frame, column)["unit_id"].tolist()
        mine = got[got.model == model].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(frame) + 1))
        assert mine["unit_id"].tolist() == want


@pytest.mark.parametrize("rounding", ["ceil", "floor"])
def test_top_sums_and_flags(scores, frame, rounding):
    fractions = [0.0005, 0.07, 0.1, 0.333, 1.0]
    values = {k: v for k, v in arm_values("treatment", "visit").items() if k != "n"}
    got = {
        (r.model, r.fraction): r
        for r in ordering.top_fraction_sums(scores, fractions, values, rounding).collect()
    }
    assert len(got) == len(SCORE_COLUMNS) * len(fractions)
    for model, column in SCORE_COLUMNS.items():
        rows = ordered(frame, column)
        for f in fractions:
            k = getattr(math, rounding)(len(frame) * f)
            top, r = rows.head(k), got[model, f]
            assert (r.n, r.nt, r.y) == (k, top.treatment.sum(), top.visit.sum())
            assert r.yt == (top.treatment * top.visit).sum()
            assert (r.all_n, r.all_y) == (len(frame), frame.visit.sum())
    flags = ordering.flag_top(scores, 0.1, rounding).where("in_top").toPandas()
    k = getattr(math, rounding)(len(frame) * 0.1)
    for model, column in SCORE_COLUMNS.items():
        assert set(flags[flags.model == model].unit_id) == set(ordered(frame, column).head(k).unit_id)


def test_running_totals(scores, frame):
    got = ordering.running_totals(scores, arm_values("treatment", "visit")).toPandas()
    for m, column in enumerate(SCORE_COLUMNS.values()):
        rows = ordered(frame, column)
        rows["ty"] = rows.treatment * rows.visit
        g = rows.groupby("score").agg(
            n=("visit", "size"), nt=("treatment", "sum"), y=("visit", "sum"), yt=("ty", "sum")
        )
        want = g.sort_index(ascending=False).cumsum()
        mine = got[got.m == m].sort_values("score", ascending=False)
        for v in ("n", "nt", "y", "yt"):
            assert mine[f"cum_{v}"].tolist() == want[v].tolist()


def test_bad_rounding_and_columns(scores, spark, frame):
    with pytest.raises(ValueError, match="ceil or floor"):
        ordering.top_fraction_sums(scores, [0.1], {}, "round")
    with pytest.raises(ValueError, match="absent"):
        ordering.long_scores(spark.createDataFrame(frame), {"A": "absent"}, "unit_id", KEEP)


def test_double_arithmetic_of_k():
    assert ordering.selected_sizes(100, [0.07], "ceil") == {0.07: 8}


def test_no_row_scale_single_partition(scores):
    """Only tables of one row per cell or model may meet in a window without the cell as key."""
    frames = [
        ordering.global_rank(scores),
        ordering.running_totals(scores, arm_values("treatment", "visit")),
        ordering.flag_top(scores, 0.1),
    ]
    for df in frames:
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_uplift_at_k_and_checks(scores, frame):
    got = {(r.model, r.k): r for r in ranking.uplift_at_k(scores, "treatment", "visit").collect()}
    check = {r.model: r for r in ranking.signal_check_effect(scores, "treatment", "visit").collect()}
    plain = {r.model: r for r in ranking.signal_check(scores, "visit").collect()}

    def effect(rows):
        means = rows.groupby("treatment")["visit"].mean()
        return means[1] - means[0]

    for model, column in SCORE_COLUMNS.items():
        rows = ordered(frame, column)
        for k in (0.1, 0.2, 0.3):
            assert got[model, k].uplift_at_k == pytest.approx(effect(rows.head(int(600 * k))))
        top, rest = rows.head(60), rows.tail(540)
        gap = effect(top) - effect(rest)
        assert check[model].gap == pytest.approx(gap) and check[model].passed == (gap >= 0.01)
        assert check[model].overall_effect == pytest.approx(effect(rows))
        gap = top.visit.mean() - rest.visit.mean()
        assert plain[model].gap == pytest.approx(gap)
        assert plain[model].lift_ratio == pytest.approx(top.visit.mean() / rows.visit.mean())


def test_top_k_split_sizes(spark):
    df = spark.range(100).select(F.col("id").alias("unit_id"), F.col("id").cast("double").alias("score"))
    s = ordering.long_scores(df, {"A": "score"}, "unit_id", [])
    rows = ordering.flag_top(s, 0.10).collect()
    top, rest = [r.score for r in rows if r.in_top], [r.score for r in rows if not r.in_top]
    assert (len(top), len(rest)) == (10, 90) and min(top) >= max(rest)


def test_empty_arm_gives_null_and_fails(spark):
    df = spark.range(40).select(
        F.col("id").alias("unit_id"), F.col("id").cast("double").alias("s"), F.lit(1).alias("t"), F.lit(1).alias("y")
    )
    s = ordering.long_scores(df, {"A": "s"}, "unit_id", ["t", "y"])
    row = ranking.signal_check_effect(s, "t", "y").first()
    assert row.top_effect is None and row.gap is None and row.passed is False


@pytest.mark.parametrize("column", ["tied", "gaps"])
def test_ranking_head_tail(spark, frame, column):
    df = spark.createDataFrame(frame)
    got = ranking.head_and_tail(df, column, "unit_id", ["visit"]).collect()
    rows = ordered(frame, column)["unit_id"].tolist()
    assert [r.unit_id for r in sorted(got, key=lambda r: r["rank"])] == rows[:10] + rows[-5:]


def test_combine_scores(spark):
    scores = spark.createDataFrame([(i, i / 10) for i in range(20)], "unit_id long, s double")
    base = spark.createDataFrame([(i, 0.5) for i in range(20)], "unit_id long, p double")
    out = ranking.combine_scores(scores, base, "unit_id", "p")
    assert out.count() == 20 and out.columns == ["unit_id", "s", "baseline_score"]
    with pytest.raises(ValueError, match="failed to join"):
        ranking.combine_scores(scores, base.where("unit_id < 19"), "unit_id", "p")
    with pytest.raises(ValueError, match="duplicate"):
        ranking.combine_scores(scores, base.unionByName(base.where("unit_id = 0")), "unit_id", "p")
    gap = base.withColumn("p", F.when(F.col("unit_id") != 3, F.col("p")))
    assert [r.unit_id for r in ranking.unmatched_scores(scores, gap, "unit_id", "p").collect()] == [3]


def test_best_model_ties_keep_declared_order(spark):
    table = spark.createDataFrame([("B", 0.2), ("A", 0.2), ("C", None)], "model string, gap double")
    got = [(r["rank"], r.model) for r in ranking.best_model(table, "gap", ["A", "B", "C"]).collect()]
    assert sorted(got) == [(1, "A"), (2, "B"), (3, "C")]


def test_budgets(spark, frame):
    df = spark.createDataFrame(frame)
    scores = targeting.strategy_scores(df, SCORE_COLUMNS, "unit_id", KEEP, seed=5, rows_per_bin=40)
    table = targeting.budget_targeting(scores, "treatment", "visit", (0.1, 0.29))
    rows = table.collect()
    assert len(rows) == 10 and {r.strategy for r in rows} == {*SCORE_COLUMNS, targeting.RANDOM}
    assert {(r.budget, r.budget_label, r.units_contacted) for r in rows} == {
        (0.1, "10%", 60), (0.29, "29%", 174),
    }
    picked = targeting.random_selection(df, "unit_id", 0.29, seed=5)
    assert picked.count() == 174 and picked.distinct().count() == 174
    assert sorted(picked.collect()) == sorted(
        targeting.random_selection(df.repartition(5), "unit_id", 0.29, seed=5).collect()
    )
    beat = targeting.beat_random(table)
    assert beat.count() == 8
    by_key = {(r.strategy, r.budget): r.incremental_total for r in rows}
    for r in beat.collect():
        assert r.beats_random == (by_key[r.strategy, r.budget] > by_key[targeting.RANDOM, r.budget])
    assert targeting.all_beat_random(table).first()[0] == all(r.beats_random for r in beat.collect())
    with pytest.raises(Exception, match="random selection"):
        targeting.beat_random(table.where("strategy <> 'Random Selection' or budget = 0.1")).collect()


def test_repeated_keys_and_other_values_are_errors(spark):
    df = spark.range(1000).selectExpr("id % 7 as unit_id", "cast(id as double) as s", "1 as t", "0 as y")
    with pytest.raises(ValueError, match="unique"):
        ordering.long_scores(df, {"A": "s"}, "unit_id", [])
    with pytest.raises(ValueError, match="unique"):
        targeting.random_selection(df, "unit_id", 0.1)
    unique = df.withColumn("unit_id", F.col("s").cast("long"))
    for value in (2, None, 5.5):
        wrong = unique.withColumn("y", F.when(F.col("unit_id") == 3, F.lit(value)).otherwise(F.col("y")))
        with pytest.raises(ValueError, match="'y': 1"):
            ordering.long_scores(wrong, {"A": "s"}, "unit_id", ["t", "y"])
    assert ordering.long_scores(unique, {"A": "s"}, "unit_id", ["t", "y"]).n == 1000


@pytest.mark.parametrize("rows_per_bin", [10_000, 25, 3])
def test_text_keys(spark, rows_per_bin):
    df = spark.range(400).selectExpr("concat('kä', id * 37 % 400, '-x') as unit_id", "id % 3 / 2.0 as s")
    scores = ordering.long_scores(df, {"A": "s"}, "unit_id", [], rows_per_bin=rows_per_bin)
    want = sorted(((r.unit_id, r.s) for r in df.collect()), key=lambda r: (-r[1], r[0].encode()))
    got = {r.unit_id: r["rank"] for r in ordering.global_rank(scores).collect()}
    assert got == {unit: i + 1 for i, (unit, _) in enumerate(want)}
    top = {r.unit_id for r in ordering.flag_top(scores, 0.1).where("in_top").collect()}
    assert top == {unit for unit, _ in want[:40]}


def cell_sizes(scores):
    return {(r.m, r.bin, r.sub): r["count"] for r in scores.rows.groupBy("m", "bin", "sub").count().collect()}


# Keys of one tied score: a common beginning of any length, beginnings that differ only late, one hot stretch, and numbers
# that are equal as doubles.
TIED_KEYS = {
    "counter": "concat('customer-', lpad(id, 8, '0'))",
    "long": "concat(repeat('same beginning ', 40), lpad(id * 7919 % 40000, 5, '0'))",
    "hot": "concat(if(id % 10 = 0, 'a', 'zzzzzz-'), sha2(string(id), 256))",
    "numbers": "id + 9007199254740992",
    "falling": "-id * 3",
}


@pytest.mark.parametrize("kind", sorted(TIED_KEYS))
def test_no_cell_of_tied_rows_holds_more_than_twice_its_share(spark, kind):
    df = spark.range(40_000).selectExpr(f"{TIED_KEYS[kind]} as unit_id", "if(id % 20 = 0, id / 40000.0, 0.25) as s", "1.0D as flat")
    df = df.select("*")
    scores = ordering.long_scores(df, {"A": "s", "B": "flat"}, "unit_id", [], rows_per_bin=2000, keyed=True)
    sizes = cell_sizes(scores)
    assert max(sizes.values()) <= 4000 and sum(sizes.values()) == 80_000
    assert len([c for c in sizes if c[0] == 1]) >= 10 and len(sizes) <= scores.max_cells
    # Inside a score the keys of one cell lie between those of its neighbours.
    spans = scores.rows.where("m = 1").groupBy("sub").agg(F.min("unit_id").alias("lo"), F.max("unit_id").alias("hi")).orderBy("sub").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))
    want = sorted(((r.unit_id, r.s) for r in df.collect()), key=lambda r: (-r[1], r[0]))
    got = {r.unit_id: r["rank"] for r in ordering.global_rank(scores).where("model = 'A'").collect()}
    assert got == {unit: i + 1 for i, (unit, _) in enumerate(want)}
    top = {r.unit_id for r in ordering.flag_top(scores, 0.3).where("in_top AND model = 'A'").collect()}
    assert top == {unit for unit, _ in want[:12_000]}


def test_score_intervals_that_the_sketch_leaves_too_large_are_split(spark):
    # A value just below two shares beside a dense stretch of other scores.
    df = spark.range(20_000).selectExpr("id as unit_id", "case when id < 3900 then 0.5 when id < 12000 then 0.5 + id * 1e-9 else id end as s")
    scores = ordering.long_scores(df, {"A": "s"}, "unit_id", [], rows_per_bin=2000, min_bins=2)
    marks = [dict.fromkeys([100.0], False)]
    cells = ordering._Cells(scores.rows.select("unit_id", F.col("score").alias("__s0")), "unit_id", (), marks, [[]])
    ordering._even_scores(cells, 2000)
    ordering._even_keys(cells, 2000)
    sizes = {tuple(r)[:2]: r["count"] for r in cells.rows().groupBy("bin", "sub").count().collect()}
    assert max(sizes.values()) <= 4000 and sum(sizes.values()) == 20_000
    assert max(cell_sizes(scores).values()) <= 4000


def test_repeated_keys_end_the_splitting(spark):
    df = spark.range(9000).selectExpr("'same' as unit_id", "1.0D as s")
    scores = ordering.long_scores(df, {"A": "s"}, "unit_id", [], rows_per_bin=1000, keyed=True)
    assert set(cell_sizes(scores).values()) == {9000}
