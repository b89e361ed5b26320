import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from armspark.functions.columns import positive_probability
from armspark.operators import effects, encoding, histogram_trees, learners
from armspark.operators.histogram_trees import boosted_trees
from armspark.session import materialize
from armspark.sources import sinks
from armspark.spec import ExperimentSpec

SPEC = ExperimentSpec(numeric=("x1", "x2"), categorical=("g",), outcomes=("visit", "conversion"))


@pytest.fixture(scope="module")
def planted(spark):
    """Effect 0.4 where x1 > 0, none elsewhere; base rate 0.15; two thirds treated."""
    rng = np.random.default_rng(8)
    n = 4000
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    t = (rng.random(n) < 2 / 3).astype(int)
    visit = (rng.random(n) < 0.15 + 0.4 * t * (x1 > 0)).astype(int)
    pdf = pd.DataFrame(
        {
            "unit_id": np.arange(n),
            "x1": x1,
            "x2": x2,
            "g": np.where(x1 > 0, "up", "down"),
            "treatment": t,
            "visit": visit,
            "conversion": 0,
        }
    )
    stored = materialize(spark.createDataFrame(pdf).repartition(4), "planted")
    return stored.where("unit_id % 4 <> 0"), stored.where("unit_id % 4 = 0")


def separation(scored):
    pdf = scored.toPandas()
    assert np.isfinite(pdf.score).all() and len(pdf) == 1000
    return pdf[pdf.x1 > 0].score.mean() - pdf[pdf.x1 <= 0].score.mean()


def test_positive_weight(spark):
    df = spark.createDataFrame([(int(i < 20),) for i in range(100)], "y int")
    assert learners.positive_weight(df, "y") == 4.0
    with pytest.raises(ValueError, match="no positive"):
        learners.positive_weight(df.where("y = 0"), "y")
    with pytest.raises(ValueError, match="no positive"):
        learners.positive_weight(df.select(F.lit(None).cast("int").alias("y")), "y")


def test_response_model_round_trip(spark, planted, tmp_path):
    train, test = planted
    model = learners.train_response_model(train, SPEC, "visit", rounds=3, depth=2)
    scored = learners.predict_probability(model, test, "score")
    pdf = scored.toPandas()
    assert pdf.score.between(0, 1).all() and separation(scored) > 0.1
    again = learners.predict_probability(
        learners.train_response_model(train, SPEC, "visit", rounds=3, depth=2), test, "score"
    )
    key = lambda df: {r.unit_id: r.score for r in df.select("unit_id", "score").collect()}
    assert key(scored) == key(again)
    sinks.save_model(model, str(tmp_path / "model"))
    loaded = sinks.load_model(spark, str(tmp_path / "model"))
    assert key(scored) == key(learners.predict_probability(loaded, test, "score"))
    with pytest.raises(FileNotFoundError):
        sinks.load_model(spark, str(tmp_path / "absent"))
    (tmp_path / "broken").mkdir()
    with pytest.raises(RuntimeError, match="cannot load"):
        sinks.load_model(spark, str(tmp_path / "broken"))


def test_effect_learners_find_the_planted_group(planted):
    train, test = planted
    two = learners.two_model(train, SPEC, "visit", rounds=3, depth=2)
    assert separation(learners.score_two_model(two, test, "score")) > 0.15
    revert = learners.class_transformation(train, SPEC, "visit", rounds=3, depth=2)
    scored = learners.score_class_transformation(revert, test, "score")
    assert scored.toPandas().score.between(-1, 1).all() and separation(scored) > 0.1


def test_learners_share_one_encoder(planted, monkeypatch):
    """An encoded table serves all learners, with the scores of an encoder of their own."""
    train, test = planted
    fitted = []
    fit = encoding.fit_features
    monkeypatch.setattr(encoding, "fit_features", lambda *a, **k: fitted.append(1) or fit(*a, **k))
    table = encoding.encode_once(train, SPEC, [SPEC.key, SPEC.treatment, "visit"])
    score = lambda model, how: {r.unit_id: r.score for r in how(model, test, "score").select("unit_id", "score").collect()}
    shared = learners.class_transformation(table, SPEC, "visit", rounds=2, depth=2)
    two = learners.two_model(table, SPEC, "visit", rounds=2, depth=2)
    forest = effects.train_effect_forest(table, SPEC, "visit", trees=4, nuisance_rounds=2, depth=2)
    assert len(fitted) == 1 and forest.encoder is table.encoder
    own = learners.class_transformation(train, SPEC, "visit", rounds=2, depth=2)
    assert score(shared, learners.score_class_transformation) == score(own, learners.score_class_transformation)
    pairs = learners.two_model(train, SPEC, "visit", rounds=2, depth=2)
    assert len(fitted) == 2
    assert score(two, learners.score_two_model) == score(pairs, learners.score_two_model)


def test_missing_feature_and_leak(planted):
    train, _ = planted
    with pytest.raises(ValueError, match="x1"):
        learners.train_response_model(train.drop("x1"), SPEC, "visit", rounds=1)
    leaky = ExperimentSpec(numeric=("treatment",), categorical=())
    with pytest.raises(ValueError, match="leaked"):
        learners.train_response_model(train, leaky, "visit", rounds=1)


def test_cell_scores(planted):
    train, test = planted
    outputs = {"a": "response", "score": "two_model", "c": "class_transform"}
    scored = learners.cell_scores(train, test, SPEC, "visit", ["g"], outputs)
    assert separation(scored) > 0.3
    pdf, got = train.toPandas(), scored.toPandas().groupby("g")[["a", "score", "c"]].first()
    for g, part in pdf.groupby("g"):
        means = part.groupby("treatment").visit.mean()
        assert got.loc[g, "a"] == pytest.approx(part.visit.mean())
        assert got.loc[g, "score"] == pytest.approx(means[1] - means[0])
        assert got.loc[g, "c"] == pytest.approx(2 * (part.treatment == part.visit).mean() - 1)


def test_unseen_cell_and_empty_arm_fall_back(spark):
    spec = ExperimentSpec(numeric=(), categorical=("g",), outcomes=("visit",))
    train = spark.createDataFrame(
        [(1, "a", 1, 1), (2, "a", 0, 0), (3, "b", 1, 0)], "unit_id int, g string, treatment int, visit int"
    )
    test = spark.createDataFrame([(9, "a"), (8, "b"), (7, "z")], "unit_id int, g string")
    got = {
        r.g: r.s for r in learners.cell_scores(train, test, spec, "visit", ["g"], {"s": "two_model"}).collect()
    }
    assert got == {"a": 1.0, "b": 0.5, "z": 0.5}


def test_cell_residual_effect_equals_row_wise_residuals(planted):
    train, _ = planted
    got = {r.g: r for r in effects.cell_residual_effect(train, SPEC, "visit", ["g"]).collect()}
    pdf = effects.with_fold(train, SPEC, 2, 42).toPandas()
    for g, part in pdf.groupby("g"):
        cross = square = 0.0
        for fold in (0, 1):
            own, other = part[part.fold == fold], part[part.fold != fold]
            yr, tr = own.visit - other.visit.mean(), own.treatment - other.treatment.mean()
            cross, square = cross + (yr * tr).sum(), square + (tr * tr).sum()
        assert got[g].effect == pytest.approx(cross / square) and got[g].n == len(part)


def test_residual_effect(spark):
    df = spark.createDataFrame([(1.0, 0.5), (-0.5, -0.5)], "yr double, tr double")
    assert effects.residual_effect(df, "yr", "tr").first().effect == pytest.approx(0.75 / 0.5)
    assert effects.residual_effect(df.where("false"), "yr", "tr").first().effect is None


def test_forest(spark, planted, tmp_path):
    train, test = planted
    sizes = {"trees": 6, "nuisance_rounds": 2, "depth": 3}
    forest = effects.train_effect_forest(train, SPEC, "visit", **sizes)
    scored = forest.score(test, "score")
    assert separation(scored) > 0.15
    assert 0.1 < forest.population_effect < 0.3
    key = lambda f: {r.unit_id: r.score for r in f.score(test, "score").collect()}
    first = key(forest)
    again = effects.train_effect_forest(train, SPEC, "visit", **sizes)
    assert key(again) == pytest.approx(first)
    forest.save(str(tmp_path / "forest"))
    assert key(effects.EffectForest.load(spark, str(tmp_path / "forest"), SPEC)) == first
    # brute force over the honest leaf means of a few rows
    starts = effects.leaf_offsets(forest.forests)
    leaves = {r.slot: r for r in forest.leaves.collect()}
    encoded = forest.encoder.transform(test).select("unit_id", "features").limit(20).collect()
    trees = [tree for part in forest.forests for tree in part.trees]
    assert len(trees) == 6 and len(forest.forests) == 4
    for r in encoded:
        slots = [int(starts[i]) + int(tree.predictLeaf(r.features)) for i, tree in enumerate(trees)]
        hit = [leaves[s] for s in slots if s in leaves]
        want = sum(h.cross for h in hit) / sum(h.square for h in hit)
        assert first[r.unit_id] == pytest.approx(want)
    with pytest.raises(ValueError, match="honest groups"):
        effects.train_effect_forest(train, SPEC, "visit", honest_groups=0, **sizes)


@pytest.mark.parametrize("positive", [None, 3.0])
def test_boosted_trees_score_as_spark_ml_does(spark, positive):
    """Same split points, gains and steps on a table small enough that neither samples; later rounds, flags and ties included."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 9, 3000), rng.integers(0, 2, (3000, 10)), np.ones(3000)])
    y = (rng.random(3000) < 0.2 + 0.3 * (x[:, 0] > 0.3) + 0.2 * x[:, 4]).astype(float)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])]).assign(y=y, w=np.where(y > 0, positive or 1.0, 1.0))
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(x.shape[1])], outputCol="features").transform(spark.createDataFrame(pdf))
    vectors = materialize(vectors.select("features", "y", "w").repartition(3), "vectors")
    own = boosted_trees(vectors, "y", "logistic", 6, 4, 40, 7, positive).transform(vectors)
    other = GBTClassifier(labelCol="y", weightCol="w", maxIter=6, maxDepth=4, maxBins=40, seed=7).fit(vectors)
    both = other.setProbabilityCol("p").setPredictionCol("c").setRawPredictionCol("r").transform(own)
    got = both.select(positive_probability("probability").alias("a"), positive_probability("p").alias("b")).toPandas()
    assert np.allclose(got.a, got.b, atol=1e-9) and got.a.nunique() > 50
    squares = boosted_trees(vectors, "y", "squared", 4, 3, 40, 7, output="own").transform(vectors)
    fitted = GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, maxBins=40, seed=7).fit(vectors)
    got = fitted.transform(squares).select("own", "prediction").toPandas()
    assert np.allclose(got.own, got.prediction, atol=1e-9)


def test_levels_move_sums_not_rows(spark, monkeypatch):
    """What a level sends to the driver does not grow with the rows, and scores do not depend on how rows are dealt."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.normal(size=2000), "b": rng.normal(size=2000), "u": np.arange(2000)})
    pdf["y"] = (rng.random(2000) < 0.3 + 0.4 * (pdf.a > 0)).astype(float)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(pdf))
    df = materialize(df.select("features", "y", "u"), "dealt")
    sizes = []
    add = histogram_trees.Growth._sums
    monkeypatch.setattr(histogram_trees.Growth, "_sums", lambda *a: sizes.append((len(a[3]), add(*a))) or sizes[-1][1])
    fits = []
    for parts, checkpoint in ((1, 20), (7, 2)):
        monkeypatch.setattr(histogram_trees, "CHECKPOINT", checkpoint)
        fits.append(boosted_trees(df.repartition(parts, "u"), "y", "logistic", 5, 3, 32, 1))
    assert fits[0].getOrDefault("trees_") == fits[1].getOrDefault("trees_")
    assert all(sums.shape == (2, nodes, 2, 256) and nodes <= 4 for nodes, sums in sizes)
    with pytest.raises(ValueError, match="labels in y"):
        boosted_trees(df.withColumn("y", F.col("y") * 2), "y", "logistic", 1, 1, 32, 1)
    with pytest.raises(ValueError, match="no training rows"):
        boosted_trees(df.where("false"), "y", "logistic", 1, 1, 32, 1)


def test_forest_does_not_depend_on_how_rows_are_dealt(spark):
    """Resamples belong to units and sums are exact, so the trees agree however the rows are dealt."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"u": np.arange(1500), "a": rng.normal(size=1500), "b": rng.normal(size=1500), "w": rng.random(1500) + 0.1})
    pdf["y"] = (pdf.a > 0) + rng.normal(size=1500)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(pdf))
    df = materialize(df.select("u", "features", "w", "y"), "forest-rows")
    sizes = (F.xxhash64("u"), F.col("w"), F.col("y"), 5, 3, 32, 4, "onethird")
    one, other = (histogram_trees.grown_forest(df.repartition(n, "u"), *sizes) for n in (1, 6))
    assert one.getOrDefault("trees_") == other.getOrDefault("trees_")
    assert len({tuple(tree.value) for tree in one.trees}) == 5
    first = one.trees[0]
    assert first.numNodes == 2 * len(set(first.leaf_numbers())) - 1
