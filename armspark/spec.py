"""Roles of the columns of an experiment table, and the raw-table contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names, order and types of the raw experiment table.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("recency", T.IntegerType()),
        T.StructField("history_segment", T.StringType()),
        T.StructField("history", T.DoubleType()),
        T.StructField("mens", T.IntegerType()),
        T.StructField("womens", T.IntegerType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("newbie", T.IntegerType()),
        T.StructField("channel", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("visit", T.IntegerType()),
        T.StructField("conversion", T.IntegerType()),
        T.StructField("spend", T.DoubleType()),
    ]
)
# Fixed value: label of the untreated arm in the raw table.
RAW_CONTROL_LABEL = "No E-Mail"


@dataclass(frozen=True)
class ExperimentSpec:
    """Which column plays which role. The defaults describe the raw contract table."""

    key: str = "unit_id"
    arm: str = "segment"
    control: str = RAW_CONTROL_LABEL
    treatment: str = "treatment"
    numeric: tuple[str, ...] = ("recency", "history", "mens", "womens", "newbie")
    categorical: tuple[str, ...] = ("history_segment", "zip_code", "channel")
    outcomes: tuple[str, ...] = ("visit", "conversion", "spend")
    # Outcome half of the stratification key: the rarest one.
    strat_outcome: str = "conversion"

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def check_leakage(self) -> None:
        """Arm, treatment flag, key and outcomes must never be features."""
        forbidden = {self.key, self.arm, self.treatment, *self.outcomes}
        leaked = sorted(forbidden & set(self.features))
        if leaked:
            raise ValueError(f"columns leaked into the features: {leaked}")

    def project_features(self, df: DataFrame) -> DataFrame:
        require_columns(df, (self.key, *self.features))
        return df.select(self.key, *self.features)

    def project_treatment(self, df: DataFrame) -> DataFrame:
        require_columns(df, (self.key, self.treatment))
        return df.select(self.key, self.treatment)

    def project_outcomes(self, df: DataFrame) -> DataFrame:
        require_columns(df, (self.key, *self.outcomes))
        return df.select(self.key, *self.outcomes)


def require_columns(df: DataFrame, names) -> None:
    """Metadata-only check; the error names every missing column."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing expected columns: {missing}")
