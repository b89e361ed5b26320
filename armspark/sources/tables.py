"""Scans: raw experiment files, split tables, score tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from ..session import materialize
from ..spec import RAW_SCHEMA, ExperimentSpec, require_columns

# Columns that a CSV scan adds.
BAD_RECORD, SOURCE_FILE = "__bad_record", "__source_file"

# Texts a raw CSV file uses for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _typed(name: str, kind: T.DataType):
    """Cast a raw text; a text that is not a number of the declared type fails the job."""
    text = F.when(~F.trim(F.col(name)).isin(*MISSING_TOKENS), F.trim(F.col(name)))
    if isinstance(kind, T.StringType):
        return F.when(~F.col(name).isin(*MISSING_TOKENS), F.col(name)).alias(name)
    if isinstance(kind, T.IntegerType):
        number = text.cast("double")
        refused = F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), text)).cast("int")
        whole = F.when(number == F.floor(number), number.cast("int")).otherwise(refused)
        return F.when(number.isNotNull(), whole).alias(name)
    return text.cast(kind).alias(name)


def conform(df: DataFrame, schema: T.StructType = RAW_SCHEMA, key: str | None = None) -> DataFrame:
    """Check the contract on column names, then project to contract order (plus the key)."""
    names = ([key] if key else []) + schema.fieldNames()
    require_columns(df, names)
    kept = [F.col(key).cast("bigint").alias(key)] if key else []
    return nan_to_null(df.select(*kept, *[F.col(f.name).cast(f.dataType) for f in schema.fields]))


def _line_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files whose records are single lines, and files in which a quoted field holds a line break.

    A line with an odd number of quotes opens or closes such a field. Only files that have one must each be read by one task; all others
    are split. One row per file reaches the driver.
    """
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), odd.alias("odd"))
    found = lines.groupBy("file").agg(F.bool_or("odd").alias("odd")).collect()
    plain, broken = [], []
    for row in sorted(found):
        (broken if row.odd else plain).append(unquote(row.file))
    return plain, broken


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """All records of headed comma-separated files as texts, with the columns ``BAD_RECORD`` and ``SOURCE_FILE``.

    Fields may be quoted, a doubled quote stands for a quote, and a quoted field may hold commas and line breaks. ``BAD_RECORD`` holds the whole
    record where it has another number of fields than the header. The header of every file must be that of the first one.
    """
    try:
        reader = spark.read.option("header", True).option("escape", '"').option("recursiveFileLookup", True)
        header = reader.csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*header, BAD_RECORD)])
    # Nothing of the first field is added; but Spark refuses queries that read the record column alone.
    nothing = F.substring(F.coalesce(F.col(header[0]), F.lit("")), 1, 0) if header else F.lit("")
    whole = F.concat(F.col(BAD_RECORD), nothing)
    scans = []
    for files, multi_line in zip(_line_files(spark, path), (False, True)):
        if files:
            reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            reader = reader.option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE")
            # Fields are counted only where all of them are parsed.
            reader = reader.option("columnPruning", False).option("columnNameOfCorruptRecord", BAD_RECORD)
            scans.append(reader.csv(files).select(*header, whole.alias(BAD_RECORD), F.col("_metadata.file_path").alias(SOURCE_FILE)))
    if not scans:
        return spark.createDataFrame([], schema.add(SOURCE_FILE, "string"))
    return reduce(DataFrame.unionByName, scans)


def _fault(scan: DataFrame) -> Column:
    """Why a record cannot be used; NULL if it can. Fields that a short record lacks are NULL, which is no fault."""
    record = F.col(BAD_RECORD)
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    width = len(scan.columns) - 2
    surplus = F.size(F.split(bare, ",")) > width
    return F.when(record.isNull(), None).when(F.contains(bare, F.lit('"')), "open quote").when(surplus, "surplus fields")


def bad_records(scan: DataFrame) -> DataFrame:
    """The ledger of a scan: (file, fault, records, example), one row per file and fault."""
    faulty = scan.select(F.col(SOURCE_FILE).alias("file"), _fault(scan).alias("fault"), F.col(BAD_RECORD).alias("record"))
    return (
        faulty.where(F.col("fault").isNotNull())
        .groupBy("file", "fault")
        .agg(F.count(F.lit(1)).alias("records"), F.min("record").alias("example"))
    )


def read_experiment_csv(
    spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, key: str | None = None, skip_bad: bool = False
) -> DataFrame:
    """Scan headed comma-separated experiment files with a declared schema.

    Everything is read as text, the header is checked by name, then the contract columns are cast.
    Extra columns are dropped. Missing columns (also the effect of an empty file or of another
    delimiter) raise ``ValueError`` before any row is read. Records with more fields than the header, or with a quote that never closes,
    raise ``ValueError`` with their file and number; with ``skip_bad`` they are left out, and ``bad_records`` lists them.
    """
    scan = scan_csv(spark, path)
    names = ([key] if key else []) + schema.fieldNames()
    require_columns(scan, names)
    if skip_bad:
        scan = scan.where(_fault(scan).isNull())
    else:
        ledger = bad_records(scan).orderBy("file", "fault").limit(20).collect()
        if ledger:
            told = "; ".join(f"{r.file}: {r.records} with {r.fault}, such as {r.example[:200]!r}" for r in ledger)
            raise ValueError(f"records that do not fit the header: {told}")
    kept = [F.col(key).cast("bigint").alias(key)] if key else []
    return nan_to_null(scan.select(*kept, *[_typed(f.name, f.dataType) for f in schema.fields]))


def read_experiment_parquet(
    spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, key: str | None = None
) -> DataFrame:
    try:
        raw = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    return conform(raw, schema, key)


def assign_unit_ids(df: DataFrame, key: str = "unit_id") -> DataFrame:
    """Dense 0-based keys for a table that arrives without one.

    The rows are written once with a provisional number (task and position in the task); the dense
    number is computed from the written table, so no later re-execution can renumber the units.
    """
    if key in df.columns:
        raise ValueError(f"table already has a column {key}")
    written = materialize(df.withColumn("__raw_id", F.monotonically_increasing_id()), "keyed")
    task = F.shiftrightunsigned("__raw_id", 33).alias("__task")
    position = F.col("__raw_id").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per scan task; stored, so the join with the rows is planned on its true size.
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy(task).count().select(
        "__task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")
    )
    offsets = materialize(starts, "offsets")
    return (
        written.withColumn("__task", F.shiftrightunsigned("__raw_id", 33))
        .join(offsets, "__task")
        .select((F.col("__start") + position).alias(key), *df.columns)
    )


def assemble(
    features: DataFrame, outcomes: DataFrame, arms: DataFrame, spec: ExperimentSpec
) -> DataFrame:
    """Join features, outcomes and arm on the unit key; keys must match one to one."""
    require_matching_keys((features, outcomes, arms), spec.key)
    return features.join(outcomes, spec.key).join(arms, spec.key)


def key_presence(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """(key, n_0, n_1, ...): rows per part for every key, combined before its one shuffle."""
    tagged = [part.select(key, F.lit(i).alias("__part")) for i, part in enumerate(parts)]
    together = reduce(DataFrame.unionByName, tagged)
    return together.groupBy(key).agg(
        *[F.count_if(F.col("__part") == i).alias(f"n_{i}") for i in range(len(parts))]
    )


def require_matching_keys(parts: Sequence[DataFrame], key: str) -> None:
    """Every key occurs exactly once in every part; one pass over the keys alone."""
    bad = reduce(lambda a, b: a | b, [F.col(f"n_{i}") != 1 for i in range(len(parts))])
    example = key_presence(parts, key).where(bad).limit(1).collect()
    if example:
        raise ValueError(f"unit keys do not match one to one: {example[0].asDict()}")


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One side of a persisted split; the filter prunes the other side's folder."""
    if split not in ("train", "test"):
        raise ValueError(f"unknown split {split!r}")
    return spark.read.parquet(path).where(F.col("split") == split)


def read_scores(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    scores = spark.read.parquet(path)
    require_columns(scores, columns)
    return scores
