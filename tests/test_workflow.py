import pytest

from armspark.plans import workflow
from armspark.session import scratch_folder
from armspark.sources import sinks


@pytest.fixture(scope="module")
def chain(spark, units, tmp_path_factory):
    """All phases on a small table, starting from a CSV that has no key column."""
    root = tmp_path_factory.mktemp("chain")
    at = lambda name: str(root / name)
    sinks.write_raw(units.drop("unit_id"), at("csv"), fmt="csv")
    sizes = workflow.Sizes(rounds=2, nuisance_rounds=2, trees=3, depth=2, replicates=15)
    results = {
        "report": workflow.prepare(spark, at("csv"), at("raw")),
        "split": workflow.preprocess(spark, at("raw"), at("split")),
    }
    results["metrics"], results["signal"] = workflow.train_baseline(
        spark, at("split"), at("baseline"), at("ranking"), sizes=sizes
    )
    results["effects"] = workflow.train_effects(
        spark, at("split"), at("ranking"), at("forest"), at("combined"), sizes=sizes
    )
    results["verdict"] = workflow.evaluate(spark, at("combined"), at("eval"), sizes=sizes)
    results["budgets"] = workflow.simulate_budgets(spark, at("combined"), at("budget"))
    return root, results


def test_tables_of_every_phase(spark, chain):
    root, results = chain
    rows = {(r.section, r.item): r["count"] for r in results["report"].collect()}
    assert rows["shape", "rows"] == 1200 and rows["shape", "columns"] == 12
    split = spark.read.parquet(str(root / "split"))
    assert split.where("split = 'test'").count() == 240 and "unit_id" in split.columns
    ranking = spark.read.parquet(str(root / "ranking"))
    assert ranking.count() == 240 and "actual_conversion" in ranking.columns
    combined = spark.read.parquet(str(root / "combined"))
    assert set(workflow.MODEL_COLUMNS.values()) <= set(combined.columns)
    assert combined.select("unit_id").distinct().count() == 240


def test_results_of_every_phase(spark, chain):
    root, results = chain
    metrics = results["metrics"].first()
    assert 0 <= metrics.auc_roc <= 1 and results["signal"].count() == 1
    assert {r.model for r in results["effects"].collect()} == {
        "Two-Model Approach", "Class Transformation", "Causal Forest",
    }
    verdict = results["verdict"].first()
    assert verdict.best_model in workflow.MODEL_COLUMNS and verdict.n_pairs == 6
    assert 1 <= verdict.reference_rank <= 4
    table = spark.read.option("header", True).csv(str(root / "eval" / "results"))
    assert table.columns == [
        "model", "qini_coefficient", "ci_lower_95", "ci_upper_95",
        "uplift_at_10pct", "uplift_at_20pct", "uplift_at_30pct",
    ]
    assert table.count() == 4
    budget = spark.read.option("header", True).csv(str(root / "budget" / "budget_targeting"))
    assert budget.count() == 10 and {r.units_contacted for r in budget.collect()} == {"24", "48"}
    assert results["budgets"].count() == 8


def test_phases_fail_loudly_without_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        workflow.preprocess(spark, str(tmp_path / "absent"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        workflow.evaluate(spark, str(tmp_path / "absent"), str(tmp_path / "out"))


class StubSession:
    """Only what the folder choice looks at; the real setting is fixed when a session starts."""

    def __init__(self, folder, master, app="stub-app"):
        self.conf = type("C", (), {"get": staticmethod(lambda key, default=None: folder or default)})
        self.sparkContext = type("S", (), {"master": master, "applicationId": app})


def test_scratch_folder_follows_the_session():
    assert scratch_folder(StubSession("/shared/dir/", "yarn")) == "/shared/dir"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_folder(StubSession(None, "spark://host:7077"))
    local = scratch_folder(StubSession(None, "local[2]"))
    assert local == scratch_folder(StubSession(None, "local[2]"))
