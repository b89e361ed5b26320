import pandas as pd
import pytest
from pyspark.sql import functions as F

from armspark.functions.columns import binarize_treatment
from armspark.sources import sinks, tables
from armspark.spec import RAW_SCHEMA, ExperimentSpec


def contract_csv(path, rows=50, **changes):
    pdf = pd.DataFrame(
        {
            "recency": 5,
            "history_segment": "1) $0 - $100",
            "history": 50.0,
            "mens": [i % 2 for i in range(rows)],
            "womens": [1 - i % 2 for i in range(rows)],
            "zip_code": "Urban",
            "newbie": 0,
            "channel": "Web",
            "segment": ["Mens E-Mail" if i % 2 else "No E-Mail" for i in range(rows)],
            "visit": [i % 2 for i in range(rows)],
            "conversion": 0,
            "spend": 0.0,
        }
    )
    pdf.assign(**changes).to_csv(path, index=False)
    return str(path)


def test_csv_contract(spark, tmp_path):
    path = contract_csv(tmp_path / "raw.csv", extra="dropped")
    df = tables.read_experiment_csv(spark, path)
    assert df.columns == RAW_SCHEMA.fieldNames() and len(df.columns) == 12
    assert [f.dataType for f in df.schema] == [f.dataType for f in RAW_SCHEMA]
    assert df.count() == 50


def test_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_experiment_csv(spark, str(tmp_path / "absent.csv"))
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError, match="missing"):
        tables.read_experiment_csv(spark, str(empty))
    short = tmp_path / "short.csv"
    short.write_text("recency,history\n1,2.0\n")
    with pytest.raises(ValueError, match="conversion"):
        tables.read_experiment_csv(spark, str(short))
    other = tmp_path / "semicolon.csv"
    other.write_text(";".join(RAW_SCHEMA.fieldNames()) + "\n" + ";".join(["1"] * 12) + "\n")
    with pytest.raises(ValueError, match="missing"):
        tables.read_experiment_csv(spark, str(other))
    bad = contract_csv(tmp_path / "bad.csv", recency="soon")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_experiment_csv(spark, bad).collect()


def dialect_csv(folder, name, records, width=12):
    head = ",".join(RAW_SCHEMA.fieldNames())
    (folder / name).write_text("\n".join([head, *records]) + "\n", encoding="utf-8")


def record(zip_code, more="", recency="5"):
    return f'{recency},1) $0 - $100,50.0,1,0,{zip_code},0,Web,Mens E-Mail,1,0,0.0{more}'


def test_csv_dialect(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    dialect_csv(folder, "lines.csv", [record('"say ""x"", or y"'), record('"two\nlines"'), record('""""'), record("plain")])
    dialect_csv(folder, "plain é.csv", [record('"a, b"'), record("Urban", recency=""), "", record('"Urban"')])
    (folder / "bare.csv").write_text(",".join(RAW_SCHEMA.fieldNames()) + "\n")
    rows = tables.read_experiment_csv(spark, str(folder)).collect()
    assert sorted(r.zip_code for r in rows) == sorted(['say "x", or y', "two\nlines", '"', "plain", "a, b", "Urban", "Urban"])
    assert [r.recency for r in rows].count(None) == 1
    plain, broken = tables._line_files(spark, str(folder))
    assert [f.rsplit("/", 1)[1] for f in broken] == ["lines.csv"] and len(plain) == 2


def test_bad_records_are_named_counted_and_listed(spark, tmp_path):
    surplus = [record("Urban", ",x"), record('"a, b"', ',"y, z"'), record("Urban", ",")]
    dialect_csv(tmp_path, "one.csv", [record("Urban"), *surplus])
    dialect_csv(tmp_path, "two.csv", [record('"b\nc"'), record("Rural", ",q"), '7,"never closed'])
    dialect_csv(tmp_path, "short.csv", ["9,1) $0 - $100,50.0", record("Urban")])
    with pytest.raises(ValueError, match=r"one\.csv: 3 with surplus fields, such as .*two\.csv: 1 with open quote.*two\.csv: 1 with surplus"):
        tables.read_experiment_csv(spark, str(tmp_path))
    kept = tables.read_experiment_csv(spark, str(tmp_path), skip_bad=True).collect()
    assert sorted(str(r.zip_code) for r in kept) == ["None", "Urban", "Urban", "b\nc"]
    ledger = tables.bad_records(tables.scan_csv(spark, str(tmp_path))).collect()
    told = {(r.file.rsplit("/", 1)[1], r.fault): r.records for r in ledger}
    assert told == {("one.csv", "surplus fields"): 3, ("two.csv", "surplus fields"): 1, ("two.csv", "open quote"): 1}


def test_another_header_is_an_error(spark, tmp_path):
    dialect_csv(tmp_path, "a.csv", [record("Urban")])
    names = RAW_SCHEMA.fieldNames()
    (tmp_path / "b.csv").write_text(",".join([names[1], names[0], *names[2:]]) + "\n" + record("Urban") + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_experiment_csv(spark, str(tmp_path)).collect()


def test_csv_sink_keeps_quotes_and_line_breaks(spark, units, tmp_path):
    odd = units.limit(20).withColumn("zip_code", F.concat(F.lit('a "b", c\\'), F.lit("\n"), F.col("unit_id").cast("string")))
    sinks.write_raw(odd, str(tmp_path / "raw"), fmt="csv")
    back = tables.read_experiment_csv(spark, str(tmp_path / "raw"), key="unit_id")
    assert sorted(r.zip_code for r in back.collect()) == sorted(r.zip_code for r in odd.collect())


def test_missing_tokens_become_null(spark, tmp_path):
    path = contract_csv(tmp_path / "gaps.csv", history="NaN", zip_code="NA")
    row = tables.read_experiment_csv(spark, path).first()
    assert row["history"] is None and row["zip_code"] is None


def test_assign_unit_ids_is_dense_and_stable(spark):
    df = spark.range(0, 1000, 1, 5).select((F.col("id") * 2).alias("v"))
    keyed = tables.assign_unit_ids(df)
    first = sorted((r.unit_id, r.v) for r in keyed.collect())
    assert [u for u, _ in first] == list(range(1000))
    assert first == sorted((r.unit_id, r.v) for r in keyed.repartition(3).collect())


def test_assemble_checks_keys(spark, units, spec):
    parts = (spec.project_features(units), spec.project_outcomes(units), spec.project_treatment(units))
    assert tables.assemble(*parts, spec).count() == units.count()
    with pytest.raises(ValueError, match="one to one"):
        tables.assemble(parts[0], parts[1].limit(10), parts[2], spec)
    with pytest.raises(ValueError, match="one to one"):
        tables.assemble(parts[0], parts[1].unionByName(parts[1]), parts[2], spec)


def test_split_round_trip_prunes_the_other_side(spark, units, tmp_path):
    table = units.withColumn("split", F.when(F.col("unit_id") % 5 == 0, "test").otherwise("train"))
    path = str(tmp_path / "split")
    sinks.write_split(table, path)
    test = tables.read_split(spark, path, "test")
    assert test.count() == table.where("split = 'test'").count()
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(ValueError):
        tables.read_split(spark, path, "both")


def test_scores_and_results_round_trip(spark, units, tmp_path):
    scores = units.select("unit_id", F.col("history").alias("score"))
    sinks.write_scores(scores, str(tmp_path / "scores"))
    back = tables.read_scores(spark, str(tmp_path / "scores"), ("score",))
    assert sorted(back.collect()) == sorted(scores.collect())
    with pytest.raises(ValueError, match="other"):
        tables.read_scores(spark, str(tmp_path / "scores"), ("other",))
    sinks.write_result(spark.createDataFrame([("a", 1.0)], "model string, q double"), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1


def test_raw_sink_validates(spark, units, tmp_path):
    sinks.write_raw(units, str(tmp_path / "raw"))
    assert tables.read_experiment_parquet(spark, str(tmp_path / "raw"), key="unit_id").count() == 1200
    with pytest.raises(ValueError, match="segment"):
        sinks.write_raw(units.drop("segment"), str(tmp_path / "bad"))


def test_leakage_guard():
    with pytest.raises(ValueError, match="visit"):
        ExperimentSpec(numeric=("history", "visit")).check_leakage()


def test_binarized_csv_matches_arms(spark, tmp_path, spec):
    df = binarize_treatment(tables.read_experiment_csv(spark, contract_csv(tmp_path / "r.csv")), spec)
    assert df.where("treatment = 1").count() == 25


def test_csv_refuses_fractions_in_whole_number_columns(spark, tmp_path):
    from pyspark.sql import types as T

    from armspark.sources.tables import _typed

    raw = spark.createDataFrame([("3",), ("4.0",), (None,), ("NaN",)], "recency string")
    assert [r[0] for r in raw.select(_typed("recency", T.IntegerType())).collect()] == [3, 4, None, None]
    with pytest.raises(Exception, match="not a whole number"):
        spark.createDataFrame([("1.9",)], "recency string").select(_typed("recency", T.IntegerType())).collect()
