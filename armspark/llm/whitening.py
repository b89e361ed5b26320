"""Embedding whitening with distributed block matrices.

Vectors become whole numbers, so that sums and deviations are exact. The distinct vectors are indexed and cut into
row blocks of a Spark MLlib ``BlockMatrix``; its transpose times itself is the scatter, a matrix of dimensions x dimensions
whose local eigendecomposition gives the whitening matrix; a second block multiplication projects every row.

What reaches the driver: one number per dimension, the scatter, and the list of block numbers that MLlib's own multiplication
plans with (one per ``_BLOCK_CELLS`` numbers). The middle dimension of the scatter product is split over the tasks, so
no task multiplies more than its share of the blocks. Rows are never grouped by vector to be joined: a vector that a third of all rows
share is deduplicated before its shuffle and projected where its rows lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Numbers in one block (8 bytes each), and the share of the trace below which a direction has no variance.
_BLOCK_CELLS, _FLAT = 1 << 18, 1e-12
# Whole numbers beyond this size are not exact as doubles; larger entries are held at it.
_LARGEST = 1 << 52


@dataclass
class Fit:
    """Count, sums, trace of the covariance, eigenvalues and the whitening matrix (dimensions x components)."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    matrix: np.ndarray


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite entries only."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(column).isNotNull() & fine)


def whole_numbers(column: str, width: int) -> Column:
    """floor(64 c) + 1000000 of every entry; a vector shorter than ``width`` goes on with zeros."""

    def whole(c):
        inside = F.greatest(F.lit(-float(_LARGEST)), F.least(F.lit(float(_LARGEST)), F.floor(c.cast("double") * SCALE).cast("double")))
        return inside.cast("long") + F.lit(SHIFT)

    held = F.transform(column, lambda c: F.when(F.abs(c.cast("double")) < float(_LARGEST), c.cast("double")).otherwise(F.signum(c) * float(_LARGEST)))
    rest = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size(column))
    return F.concat(F.transform(held, whole), rest)


def dense_index(rows: DataFrame, name: str) -> DataFrame:
    """A stored table with a column ``index`` from 0 on, without gaps.

    The rows are stored with the number of their task and place; the offsets of the tasks, one row each, are added from there.
    """
    stored = materialize(rows.withColumn("place", F.monotonically_increasing_id()), name)
    task = F.shiftrightunsigned("place", 33)
    counts = {r.task: r["count"] for r in stored.groupBy(task.alias("task")).count().collect()}
    starts, total = [], 0
    for t in sorted(counts):
        starts.append((t, total))
        total += counts[t]
    offsets = rows.sparkSession.createDataFrame(starts or [(0, 0)], "task long, start long")
    numbered = stored.withColumn("task", task).join(F.broadcast(offsets), "task")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select((F.col("start") + inside).alias("index"), *rows.columns)


def blocks_of(rows: DataFrame, column: str, width: int) -> BlockMatrix:
    """Rows (index, array of doubles) as a block matrix; the vectors never leave the JVM."""
    vectors = rows.select("index", array_to_vector(column).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"))
    return indexed.toBlockMatrix(max(1, _BLOCK_CELLS // width), width)


def gram(matrix: BlockMatrix, tasks: int) -> np.ndarray:
    """The transpose times the matrix, its middle dimension split over ``tasks``.

    The split is a public argument of the JVM method that the Python method does not pass on.
    """
    blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    java = matrix._java_matrix_wrapper
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", java._java_model, max(1, min(tasks, blocks)))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(matrix: BlockMatrix, by: np.ndarray) -> DataFrame:
    """(index, array) of every row times ``by``."""
    context = SparkSession.active().sparkContext
    block = DenseMatrix(*by.shape, np.asfortranarray(by).ravel(order="F"))
    right = BlockMatrix(context.parallelize([((0, 0), block)], 1), matrix.colsPerBlock, by.shape[1])
    result = matrix.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", result._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def _numbers(values: list, kind: str) -> Column:
    """A literal array. One SQL text, because a Column for each number is many calls into the JVM."""
    return F.expr(f"array({', '.join(repr(v) + ('D' if kind == 'double' else '') for v in values)})").cast(f"array<{kind}>")


def centred(column: str, fit_n: int, sums: list[int]) -> Column:
    """x - S / n of every entry, as doubles: the whole part of the mean is taken off before rounding."""
    whole = _numbers([s // fit_n for s in sums], "bigint")
    rest = _numbers([(s % fit_n) / fit_n for s in sums], "double")
    near = F.zip_with(column, whole, lambda x, m: (x - m).cast("double"))
    return F.zip_with(near, rest, lambda x, r: x - r)


def components(scatter: np.ndarray, n: int, sums: list[int], most: int) -> Fit:
    """Unit eigenvectors by falling eigenvalue, divided by the root of the eigenvalue; directions without variance are left out."""
    covariance = scatter / n
    covariance = (covariance + covariance.T) / 2.0
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    trace = float(np.trace(covariance))
    order = order[values[order] > _FLAT * trace] if trace > 0 else order[:0]
    return Fit(n, sums, trace, values[order], vectors[:, order] / np.sqrt(values[order]))


def _exact_deviation(fit: Fit) -> Column:
    """Sum over the dimensions of (n x - S)^2 in whole numbers; NULL beyond a long."""
    sums = _numbers(fit.sums, "decimal(38,0)")
    bound = max((abs(fit.n) * 2 * _LARGEST), *(abs(s) for s in fit.sums), 1)
    if bound < 1 << 62:
        # The differences fit a long; their squares are summed as decimals unless they surely fit as well.
        gap = F.zip_with("x", _numbers(fit.sums, "bigint"), lambda x, s: x * F.lit(fit.n) - s)
    else:
        gap = F.zip_with("x", sums, lambda x, s: x.cast("decimal(19,0)") * F.lit(fit.n).cast("decimal(18,0)") - s)
    square = F.transform(gap, lambda g: F.try_multiply(g.cast("decimal(19,0)"), g.cast("decimal(19,0)")))
    total = F.aggregate(square, F.lit(0).cast("decimal(38,0)"), lambda a, s: F.try_add(a, s).cast("decimal(38,0)"))
    return F.when(total <= F.lit(str((1 << 63) - 1)).cast("decimal(38,0)"), total.cast("long"))


def whitened(vectors: DataFrame, most: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per usable row and component.

    Rows whose vector is NULL or holds NULL or non-finite entries are dropped. Repeated rows give rows each, and count once in the
    fit; a NULL vec_id is kept. Shorter vectors are continued with zeros. Entries beyond 2^52 in size are held there. A table whose vectors
    have no variance (none, one, or equal ones only) has no components and gives an empty result, as do dimensions without variance.
    A deviation beyond a long is NULL. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("e")), "e")
    width = rows.agg(F.max(F.size("e"))).first()[0] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], schema)
    every = dense_index(rows.select("vec_id", whole_numbers("e", width).alias("x")), "whiten-rows")
    fit_list = dense_index(every.select("x").distinct(), "whiten-fit")
    facts = fit_list.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    facts = sorted(facts.collect())
    n, sums = facts[0].n, [int(f.s) for f in facts]
    tasks = 4 * spark.sparkContext.defaultParallelism
    ready = fit_list.select("index", centred("x", n, sums).alias("c"))
    fit_blocks = blocks_of(ready, "c", width)
    fit = components(gram(fit_blocks, tasks), n, sums, most)
    if not len(fit.eigenvalues):
        return spark.createDataFrame([], schema)
    error = identity_error(project(fit_blocks, fit.matrix), len(fit.eigenvalues), n, tasks)
    seen = project(blocks_of(every.select("index", centred("x", n, sums).alias("c")), "c", width), fit.matrix)
    deviation = every.select("index", "vec_id", _exact_deviation(fit).alias("deviation"))
    shares = _numbers([float(e / fit.trace) for e in fit.eigenvalues], "double")
    return (
        deviation.join(seen, "index")
        .select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(shares, F.col("at") + 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )


def identity_error(seen: DataFrame, width: int, n: int, tasks: int) -> float:
    """Largest entry of the fit list's whitened covariance, centred before multiplying, minus the identity."""
    seen = materialize(seen, "whiten-seen")
    means = seen.agg(*[F.avg(F.col("values")[i]).alias(f"m{i}") for i in range(width)]).first()
    middle = _numbers([float(m) for m in means], "double")
    again = seen.select("index", F.zip_with("values", middle, lambda v, m: v - m).alias("c"))
    covariance = gram(blocks_of(again, "c", width), tasks) / n
    return float(np.abs(covariance - np.eye(width)).max())
