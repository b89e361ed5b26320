"""Checks of what the operators rely on: one row per unit, arms and outcomes of 0 and 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_binary(column: str) -> Column:
    """Is the value anything but 0 or 1? NULL and NaN are."""
    return ~F.coalesce(F.col(column).isin(0, 1), F.lit(False))


def require_unit_keys(df: DataFrame, key: str) -> None:
    """Every unit has a key of its own; one aggregate over the keys alone, combined before its shuffle."""
    wrong = df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
    if wrong:
        raise ValueError(f"{key} must be unique and not NULL: {wrong[0][0]!r} has {wrong[0][1]} rows")


def require_binary(faults: dict[str, int]) -> None:
    """Raise for columns with values other than 0 and 1; ``faults`` counts them per column."""
    wrong = {column: n for column, n in faults.items() if n}
    if wrong:
        raise ValueError(f"columns must hold 0 and 1 only; rows that do not: {wrong}")


def counted_faults(columns: Sequence[str]) -> list[Column]:
    """One count per column of what ``require_binary`` refuses, for an aggregate that runs anyway."""
    return [F.count_if(not_binary(c)).alias(f"fault_{i}") for i, c in enumerate(columns)]
