"""Feature encoding: fitted category lists, 0/1 columns, and the vector form for learners."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column_name
from ..session import materialize
from ..spec import ExperimentSpec, require_columns


@dataclass(frozen=True)
class OneHotEncoding:
    """Fitted one-hot encoding: every category gets a column, none is dropped."""

    spec: ExperimentSpec
    categories: tuple[tuple[str, tuple[str, ...]], ...]
    names: tuple[str, ...]

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Numerics unchanged plus 0/1 columns. NULL and unseen values are zero everywhere."""
        require_columns(df, (*keep, *self.spec.features))
        flags = [
            F.when(F.col(name) == value, 1).otherwise(0)
            for name, values in self.categories
            for value in values
        ]
        encoded = flags_named(flags, self.names[len(self.spec.numeric) :])
        numerics = [F.col(n).alias(a) for n, a in zip(self.spec.numeric, self.names)]
        return df.select(*keep, *numerics, *encoded)


def flags_named(columns, names):
    return [column.alias(name) for column, name in zip(columns, names)]


def fit_one_hot(df: DataFrame, spec: ExperimentSpec, sanitize: bool = True) -> OneHotEncoding:
    """Learn the sorted category list of each categorical column in one pass.

    The driver receives the distinct pairs because each becomes a column of the result. A feature with
    more values than a table should have columns belongs in ``feature_stages``: one sparse vector.
    """
    spec.check_leakage()
    require_columns(df, spec.features)
    values: dict[str, list[str]] = {name: [] for name in spec.categorical}
    if spec.categorical:
        pairs = [
            F.struct(F.lit(n).alias("feature"), F.col(n).cast("string").alias("value"))
            for n in spec.categorical
        ]
        distinct = df.select(F.inline(F.array(*pairs))).where("value is not null").distinct()
        for row in distinct.collect():
            values[row["feature"]].append(row["value"])
    categories = tuple((name, tuple(sorted(values[name]))) for name in spec.categorical)
    sources = [*((name, None) for name in spec.numeric), *((name, v) for name, vs in categories for v in vs)]
    plain = [name if v is None else f"{name}_{v}" for name, v in sources]
    names = [column_name(*source) for source in sources] if sanitize else plain
    if len(set(names)) != len(names):
        clashes = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"feature names collide: {clashes}")
    return OneHotEncoding(spec, categories, tuple(names))


def feature_stages(spec: ExperimentSpec, output: str = "features") -> list:
    """Spark ML stages: index, one-hot (no category dropped), assemble; any number of categories."""
    spec.check_leakage()
    stages: list = []
    inputs = list(spec.numeric)
    if spec.categorical:
        indexed = [f"__{c}_index" for c in spec.categorical]
        coded = [f"__{c}_code" for c in spec.categorical]
        stages.append(
            StringIndexer(
                inputCols=list(spec.categorical),
                outputCols=indexed,
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True))
        inputs += coded
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error"))
    return stages


def fit_features(df: DataFrame, spec: ExperimentSpec, output: str = "features") -> PipelineModel:
    require_columns(df, spec.features)
    return Pipeline(stages=feature_stages(spec, output)).fit(df)


@dataclass(frozen=True)
class EncodedTable:
    """Feature vectors of a table, stored with some of its columns, and the encoder that made them."""

    rows: DataFrame
    encoder: PipelineModel


def encode_once(df: DataFrame, spec: ExperimentSpec, keep: Sequence[str]) -> EncodedTable:
    """Fit one encoder on all rows and store the vectors (column ``features``), for any number of learners."""
    require_columns(df, (*keep, *spec.features))
    encoder = fit_features(df, spec)
    return EncodedTable(materialize(encoder.transform(df).select(*keep, "features"), "encoded"), encoder)
