"""Exact, reproducible stratified train/test split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import strat_key
from ..functions.hashing import STREAM_SPLIT, unit_hash
from ..session import materialize
from ..spec import ExperimentSpec, require_columns
from .checks import counted_faults, require_binary, require_unit_keys

_HASH_BITS = 32
_ROWS_PER_BIN = 1_000_000


def allocate(sizes: DataFrame, test_size: float) -> DataFrame:
    """(stratum, take): test rows per stratum, proportional, whole remainder to the largest fractions.

    ``sizes`` has one row (stratum, size) per stratum. Whole-number arithmetic, so the result never depends on
    rounding. Equal fractions are served in stratum order.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie between 0 and 1")
    facts = sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("n"),
        F.count(F.lit(1)).alias("strata"),
        F.count_if(F.col("size") < 2).alias("lonely"),
        F.min_by("stratum", "size").alias("least"),
    ).first()
    n, n_test = facts["n"], math.ceil(facts["n"] * test_size)
    if facts["lonely"]:
        raise ValueError(f"strata with a single row cannot be split: {facts['lonely']}, such as {facts['least']}")
    if min(n_test, n - n_test) < facts["strata"]:
        raise ValueError(f"{n_test} test and {n - n_test} train rows for {facts['strata']} strata")
    # Sizes multiply: decimals hold what a bigint would not.
    product = f"cast(size as decimal(19,0)) * cast({n_test} as decimal(19,0))"
    shares = sizes.select(
        "stratum", F.expr(f"({product}) div {max(n, 1)}").alias("whole"), F.expr(f"({product}) % {max(n, 1)}").alias("rest")
    )
    served = F.row_number().over(Window.orderBy(F.desc("rest"), "stratum"))
    left = F.lit(n_test) - F.sum("whole").over(Window.partitionBy())
    return shares.select("stratum", (F.col("whole") + (served <= left).cast("int")).alias("take"))


def stratified_split(
    df: DataFrame, spec: ExperimentSpec, test_size: float = 0.20, seed: int = 42, keyed: bool = False
) -> DataFrame:
    """Add ``split``: 'test' for exactly ceil(n * test_size) rows, spread over treatment x outcome.

    Within a stratum the rows with the smallest keyed hash are the test rows. Because the hash is
    uniform, its leading bits are balanced bins: one small aggregate finds the bin holding the
    last test row, only that bin is ranked, and every row is then compared with the cut-off. Pass
    a stored table, it is read three times; no pass moves more than the boundary bins. Repeated
    keys (unless ``keyed`` says they were checked) and arms or outcomes other than 0 and 1 are errors.
    """
    require_columns(df, (spec.key, spec.treatment, spec.strat_outcome))
    if not keyed:
        require_unit_keys(df, spec.key)
    hashed = df.withColumns(
        {
            "__h": unit_hash(spec.key, seed, STREAM_SPLIT),
            "__stratum": strat_key(spec.treatment, spec.strat_outcome),
        }
    )
    n = df.count()
    if not n:
        raise ValueError("cannot split an empty table")
    bits = min(_HASH_BITS, max(3, math.ceil(math.log2(max(1, n / _ROWS_PER_BIN)))))
    hash_bin = F.shiftrightunsigned("__h", _HASH_BITS - bits)
    flags = (spec.treatment, spec.strat_outcome)
    slim = hashed.select(F.col(spec.key).alias("__key"), "__stratum", "__h", hash_bin.alias("__bin"))
    # strata x 2^bits rows at most; stored, because sizes and cut-offs both come from it.
    counts = hashed.groupBy("__stratum", hash_bin.alias("__bin")).agg(F.count(F.lit(1)).alias("n"), *counted_faults(flags))
    counts = materialize(counts, "strata")
    faults = counts.agg(*[F.sum(f"fault_{i}") for i in range(len(flags))]).first()
    require_binary(dict(zip(flags, faults)))
    sizes = counts.groupBy(F.col("__stratum").alias("stratum")).agg(F.sum("n").alias("size"))
    wanted = allocate(sizes, test_size).select(F.col("stratum").alias("__stratum"), F.col("take").alias("__k"))
    ahead = (
        Window.partitionBy("__stratum")
        .orderBy("__bin")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    boundary = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .join(wanted, "__stratum")
        .where((F.col("before") < F.col("__k")) & (F.col("__k") <= F.col("before") + F.col("n")))
        .select("__stratum", "__bin", (F.col("__k") - F.col("before")).alias("need"))
    )
    # One row per stratum, stored so that the joins with the rows are planned on its true size.
    boundary = materialize(boundary, "boundaries")
    at = Window.partitionBy("__stratum").orderBy("__h", "__key")
    cut = (
        slim.join(boundary, ["__stratum", "__bin"])
        .withColumn("rn", F.row_number().over(at))
        .where("rn = need")
        .select("__stratum", F.col("__h").alias("__cut_h"), F.col("__key").alias("__cut_key"))
    )
    cut = materialize(cut, "cuts")
    in_test = (F.col("__h") < F.col("__cut_h")) | (
        (F.col("__h") == F.col("__cut_h")) & (F.col(spec.key) <= F.col("__cut_key"))
    )
    return (
        hashed.join(cut, "__stratum", "left")
        .withColumn("split", F.when(in_test, "test").otherwise("train"))
        .select(*df.columns, "split")
    )
