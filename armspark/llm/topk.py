"""Exact top-k inner products through a pivot-distance index.

Vectors are quantised to whole numbers and lifted by one coordinate to a sphere, so that the largest inner product is the
smallest distance. Every vector is keyed by its nearest pivot and its distance from it, and the keys are range-sorted:
a run of rows is an annulus around a pivot. For a query at distance d from the pivot, a vector at distance r is at least
|d - r| away, which bounds its inner product. Annuli are taken in the order of that gap, and a group of queries stops where the bound
falls below what it already holds.

Range partitions are cut by (pivot, distance, id), so many copies of one vector spread over tasks. Queries go in blocks of a bounded
number, each a bounded broadcast and one map over the index; a task returns at most k rows per query. Scores are exact
integers; floating point serves the bounds alone, with a margin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import hash_sample

K, SCALE = 5, 256
PIVOTS, SAMPLE = 32, 2048
QUERY_BLOCK = 4096
ANNULUS = 256
_MARGIN = 1e-6


def quantise(values: list | None) -> np.ndarray | None:
    """floor(256 x) per component; None for a missing vector or one with a missing or non-finite component."""
    if values is None or any(v is None for v in values):
        return None
    x = np.floor(SCALE * np.array(values, np.float64))
    return x.astype(np.int64) if np.isfinite(x).all() and (np.abs(x) < 2.0**62).all() else None


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows: in doubles where all sums stay below 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    x, pivots = x.astype(np.float64), pivots.astype(np.float64)
    flat = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(flat + (lift[:, None] - pivot_lift[None]) ** 2, 0.0))


def far_apart(x: np.ndarray, lift: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``x`` picked so that each is farthest from those before it."""
    picked = [0]
    nearest = distances(x, lift, x[:1], lift[:1])[:, 0]
    while len(picked) < min(count, len(x)) and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(x, lift, x[picked[-1:]], lift[picked[-1:]])[:, 0])
    return np.array(picked)


def best_rows(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int):
    """The k rows of each query with the highest scores, ties to the smaller id; all three arrays cut to them."""
    order = np.lexsort((ident, -score, query))
    query, score, ident = query[order], score[order], ident[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else query
    return query[rank < k], score[rank < k], ident[rank < k]


class QueryBlock:
    """A block of queries, their distances from the pivots, and the scores they must reach."""

    def __init__(self, ids, x, pivots, pivot_lift, top, floor):
        self.ids, self.x, self.floor = ids, x, floor
        self.reach = distances(x, np.zeros(len(x)), pivots, pivot_lift)
        self.power = (x.astype(np.float64) ** 2).sum(1) + top
        self.home = self.reach.argmin(1)

    def search(self, pivot, dist, ident, x, state, k):
        """Go through sorted rows of the index; ``state`` holds (query, score, id) found so far and the current floor."""
        cut = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
        starts = np.concatenate([np.arange(s, e, ANNULUS) for s, e in zip(cut, np.r_[cut[1:], len(pivot)])])
        ends = np.r_[starts[1:], len(pivot)]
        low, high, at = dist[starts], dist[ends - 1], pivot[starts]
        for group in np.unique(self.home):
            mine = np.flatnonzero(self.home == group)
            reach = self.reach[mine][:, at]
            gap = np.maximum(np.maximum(reach - high, low - reach) - _MARGIN * (1.0 + reach), 0.0)
            bound = (self.power[mine][:, None] - gap * gap) / 2.0
            bound += _MARGIN * np.abs(self.power[mine])[:, None] + 1.0
            most = bound.max(0)
            for ring in np.argsort(-most, kind="stable"):
                floor = state["floor"][mine]
                if most[ring] < floor.min():
                    break  # every later annulus is bounded lower still
                active = mine[bound[:, ring] >= floor]
                if not len(active):
                    continue
                rows = slice(starts[ring], ends[ring])
                score = products(self.x[active], x[rows])
                ok = score >= state["floor"][active][:, None]
                q, r = np.nonzero(ok)
                own = (ident[rows][r] == self.ids[active[q]]) & (x[rows][r] == self.x[active[q]]).all(1)
                q, r = q[~own], r[~own]
                if not len(q):
                    continue
                found = best_rows(active[q], score[q, r], ident[rows][r], k)
                merged = [np.concatenate(pair) for pair in zip(state["found"], found)]
                state["found"] = best_rows(*merged, k)
                held, count = np.unique(state["found"][0], return_counts=True)
                full = held[count == k]
                worst = np.full(len(self.ids), np.iinfo(np.int64).max)
                np.minimum.at(worst, state["found"][0], state["found"][1])
                state["floor"][full] = np.maximum(state["floor"][full], worst[full])


def _stack(rows) -> np.ndarray:
    return np.stack([np.frombuffer(bytes(r), np.int64) for r in rows])


def whole_vectors(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """(vec_id, dim, x, power): valid quantised vectors; rows equal in id and vector are one."""

    def run(batches):
        for batch in batches:
            out = [
                (i, len(x), x.tobytes(), float((x.astype(np.float64) ** 2).sum()))
                for i, x in zip(batch.column(0).to_pylist(), map(quantise, batch.column(1).to_pylist()))
                if x is not None and i is not None and len(x)
            ]
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["vec_id", "dim", "x", "power"])

    rows = vectors.select(F.col(ident).cast("long"), F.col(column).cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, dim int, x binary, power double").dropDuplicates(["vec_id", "x"])


def pivot_index(rows: DataFrame, pivots: np.ndarray, pivot_lift: np.ndarray, top: float) -> DataFrame:
    """(pivot, dist, vec_id, x), range-sorted by key."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots, pivot_lift))

    def run(batches):
        centres, centre_lift = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _stack(batch.column(1).to_pylist())
                lift = np.sqrt(np.maximum(top - (x.astype(np.float64) ** 2).sum(1), 0.0))
                far = distances(x, lift, centres, centre_lift)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(x)), near]), batch.column(0), batch.column(1)],
                    names=["pivot", "dist", "vec_id", "x"],
                )

    keyed = rows.select("vec_id", "x").mapInArrow(run, "pivot int, dist double, vec_id long, x binary")
    return keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")


def nearest_rows(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    ident: str = "vec_id",
    column: str = "embedding",
    query_block: int = QUERY_BLOCK,
    sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query among all other rows.

    is_query: condition on ``vec_id``. The sample only sets pivots and a first floor; every row is indexed and the result is exact.

    NULL ids and vectors, empty vectors and vectors with NULL or non-finite components take no part. Vectors of different length do
    not compare. Rows equal in id and vector count once; a row with a query's id but another vector is a candidate like any
    other. Fewer than k candidates: all of them. Other columns are ignored.
    """
    spark = vectors.sparkSession
    valid = materialize(whole_vectors(vectors, ident, column), "topk-vectors")
    parts = []
    for dim in sorted(r.dim for r in valid.select("dim").distinct().collect()):
        rows = valid.where(F.col("dim") == dim)
        top = rows.agg(F.max("power")).first()[0]
        some = hash_sample(rows, F.struct("vec_id", "x"), sample).select("vec_id", "x").collect()
        some = sorted(some or rows.select("vec_id", "x").limit(sample).collect(), key=lambda r: (r.vec_id, bytes(r.x)))
        some_ids, some_x = np.array([r.vec_id for r in some]), _stack([r.x for r in some])
        some_lift = np.sqrt(np.maximum(top - (some_x.astype(np.float64) ** 2).sum(1), 0.0))
        picked = far_apart(some_x, some_lift, PIVOTS)
        pivots, pivot_lift = some_x[picked], some_lift[picked]
        index = materialize(pivot_index(rows, pivots, pivot_lift, top), "topk-index")
        asked = rows.where(is_query)
        blocks = -(-asked.count() // query_block)
        for n in range(blocks):
            mine = asked.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)) == n).select("vec_id", "x").orderBy("vec_id", "x").collect()
            if not mine:
                continue
            ids, x = np.array([r.vec_id for r in mine]), _stack([r.x for r in mine])
            score = products(x, some_x)
            own = ids[:, None] == some_ids[None]
            score = np.where(own, np.iinfo(np.int64).min, score)
            floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(x), np.iinfo(np.int64).min)
            block = QueryBlock(ids, x, pivots, pivot_lift, top, floor)
            shared = spark.sparkContext.broadcast(block)

            def run(batches, shared=shared):
                block = shared.value
                none = np.zeros(0, np.int64)
                state = {"found": (none, none, none), "floor": block.floor.copy()}
                for batch in batches:
                    if batch.num_rows:
                        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                        block.search(*columns, _stack(batch.column(3).to_pylist()), state, k)
                query, score, ident = state["found"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query), pa.array(block.ids[query]), pa.array(ident), pa.array(score)],
                    names=["place", "query_id", "vec_id", "score"],
                )

            found = index.mapInArrow(run, "place long, query_id long, vec_id long, score long")
            order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            parts.append(ranked.select("query_id", "rank", "vec_id", "score"))
    if not parts:
        return valid.limit(0).select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
