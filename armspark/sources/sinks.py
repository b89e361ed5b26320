"""Sinks: validated raw tables, splits, scores, small result tables, fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..spec import RAW_SCHEMA, require_columns


def write_raw(df: DataFrame, path: str, schema: T.StructType = RAW_SCHEMA, fmt="parquet") -> None:
    require_columns(df, schema.fieldNames())
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """One keyed table; readers of one side touch only that side's folder."""
    require_columns(df, ["split"])
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_scores(df: DataFrame, path: str, key: str = "unit_id") -> None:
    require_columns(df, [key])
    df.write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """A result table has a handful of rows (models x levels), hence the single file.

    The shuffle keeps the work before it parallel; ``coalesce`` would pull it into one task.
    """
    df.repartition(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """A missing folder and an unreadable one raise different errors."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop_path):
        raise FileNotFoundError(f"no fitted model at {path}")
    try:
        return PipelineModel.load(path)
    except Exception as error:
        raise RuntimeError(f"cannot load the fitted model at {path}: {error}") from error
