"""Scalar expressions on units: arms, labels, scores, guarded arithmetic."""

from __future__ import annotations

import re

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import ExperimentSpec, require_columns


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in double that is NULL, not an error, on a zero denominator."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def stable_sum(value: Column, digits: int = 10) -> Column:
    """A sum of doubles that does not depend on the order of the rows.

    Each term is fixed to ``digits`` decimals first, and decimal addition is exact, so reruns and
    other partitionings give the same bits.
    """
    return F.sum(value.cast(f"decimal(38,{digits})")).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Aggregates skip NULL but not NaN, so NaN never gets past a scan."""
    exprs = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*exprs)


def binarize_treatment(df: DataFrame, spec: ExperimentSpec, strict: bool = False) -> DataFrame:
    """Add the 0/1 treatment flag: 1 unless the arm equals the control label.

    A NULL arm counts as treated; ``strict`` makes such a row fail the job instead.
    """
    require_columns(df, [spec.arm])
    arm = F.col(spec.arm)
    flag = (~arm.eqNullSafe(F.lit(spec.control))).cast("int")
    if strict:
        flag = F.when(arm.isNotNull(), flag).otherwise(
            F.raise_error(F.lit(f"NULL in arm column {spec.arm}")).cast("int")
        )
    return df.withColumn(spec.treatment, flag)


# Fixed value: what a column name may not hold; each run of such characters is one underscore.
_OUTSIDE = re.compile(r"[^A-Za-z0-9_]+")


def column_name(feature: str, value: str | None = None) -> str:
    """The name of a feature's column, or of the column of one of its categories."""
    return "_".join(_OUTSIDE.split(feature if value is None else f"{feature}_{value}"))


def strat_key(treatment: str, outcome: str) -> Column:
    return F.concat(
        F.coalesce(F.col(treatment).cast("string"), F.lit("null")),
        F.lit("_"),
        F.coalesce(F.col(outcome).cast("string"), F.lit("null")),
    )


def revert_label(treatment: str, outcome: str) -> Column:
    """1 where the 0/1 columns of arm and outcome agree; 0 otherwise, also where one is NULL."""
    return F.coalesce((F.col(treatment) == F.col(outcome)).cast("int"), F.lit(0))


def class_weight(label: str, positive_weight: float) -> Column:
    return F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))


def positive_probability(probability: str) -> Column:
    return vector_to_array(F.col(probability))[1]


def threshold_label(score: str, threshold: float) -> Column:
    return (F.col(score) >= F.lit(float(threshold))).cast("int")


def centred_score(p: Column) -> Column:
    """Effect score of a revert-label probability: 2p - 1."""
    return F.lit(2.0) * p - F.lit(1.0)
