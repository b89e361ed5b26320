"""Boosted trees and forests for tables of any size: one Spark job per level, sums per node and bin instead of rows.

Every feature is cut into bins at sampled split points. Rows are binned once and cached as blocks of one-byte codes, up to eight
two-valued features in one byte, dealt evenly over the tasks. A level of a tree is one pass: a task walks its blocks down the tree so far and
adds up weight and weighted target per node, code column and code; the sums are added over the tasks, and the driver, which sees
nothing else, chooses the splits. The definitions are those of Spark ML's trees: split points, squared-error gain, first tree at full weight and later
ones at a tenth, no Newton step. Summands are rounded to a common binary step so small that it does not show and so large that
every sum is exact; reruns therefore agree, in whatever order partial sums arrive.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from math import ceil, frexp, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

STEP = 0.1  # weight of every tree after the first
ROWS_PER_TASK = 4_000_000
CHECKPOINT = 20  # rounds after which the cached state is written, so that its lineage stays short
AT_ONCE = 256  # nodes whose sums are gathered in one job
TREES_AT_ONCE = 16
MAX_DEPTH = 20
_POISSON_BITS = 16
_CACHED = StorageLevel.MEMORY_AND_DISK


# --- bins --------------------------------------------------------------------------------------------


def split_points(values: np.ndarray, weights: np.ndarray, max_bins: int) -> np.ndarray:
    """Split points of one feature from its ascending distinct values and their weights: all midpoints, or those at even weights."""
    middles = (values[1:] + values[:-1]) / 2.0
    if len(middles) < max_bins:
        return middles
    stride = weights.sum() / max_bins
    upto = np.cumsum(weights)
    points, goal = [], stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - goal) < abs(upto[i] - goal):
            points.append(middles[i - 1])
            goal += stride
    return np.array(points)


def find_bins(features: DataFrame, rows: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Split points of every feature of ``features`` (arrays) with ``weight``, from a sample as large as Spark ML takes."""
    wanted = max(max_bins * max_bins, 10_000)
    if wanted < rows:
        features = features.sample(False, wanted / rows, seed)
    each = features.select("weight", F.posexplode("features").alias("feature", "value"))
    each = each.groupBy("feature", "value").agg(F.sum("weight").alias("weight"))
    bins = min(max_bins, rows)

    def find(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        points = split_points(part["value"].to_numpy(), part["weight"].to_numpy(), bins)
        return pd.DataFrame({"feature": [part["feature"].iloc[0]], "points": [points]})

    found = {r.feature: np.array(r.points) for r in each.groupBy("feature").applyInPandas(find, "feature int, points array<double>").collect()}
    return [found[i] for i in sorted(found)]


@dataclass(frozen=True)
class Packing:
    """Where the bin of each feature stands: code column, shift and mask. Features without a split point have no place."""

    points: tuple[np.ndarray, ...]
    column: np.ndarray
    shift: np.ndarray
    mask: np.ndarray
    columns: int
    width: int

    @staticmethod
    def of(points: list[np.ndarray]) -> Packing:
        column, shift = np.full(len(points), -1), np.zeros(len(points), np.int64)
        width = max([256, *(len(p) + 1 for p in points)])
        mask = np.full(len(points), (1 << (width - 1).bit_length()) - 1)
        wide = [i for i, p in enumerate(points) if len(p) > 1]
        flags = [i for i, p in enumerate(points) if len(p) == 1]
        column[wide] = np.arange(len(wide))
        for j, i in enumerate(flags):
            column[i], shift[i], mask[i] = len(wide) + j // 8, j % 8, 1
        return Packing(tuple(points), column, shift, mask, len(wide) + -(-len(flags) // 8), width)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes by column of the rows ``x``."""
        out = np.zeros((max(self.columns, 1), len(x)), np.uint8 if self.width <= 256 else np.int32)
        for i, c in enumerate(self.column):
            if c >= 0:
                out[c] |= (np.searchsorted(self.points[i], x[:, i]) << self.shift[i]).astype(out.dtype)
        return out

    def right(self, feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node of a tree the code column it reads, and per node and code whether a row goes right."""
        codes = np.arange(self.width)
        bins = (codes >> self.shift[feature][:, None]) & self.mask[feature][:, None]
        return np.maximum(self.column[feature], 0), (bins > cut[:, None]).ravel()

    def best(self, sums: np.ndarray, allowed: np.ndarray | None = None) -> list[tuple | None]:
        """Per node the best split (feature, cut, sums on the left, sums on the right), or None. ``sums``: (weight, target) by node, column, code.

        Ties go to the lower feature and cut. ``allowed`` tells which features each node may use.
        """
        nodes = sums.shape[1]
        best = np.zeros(nodes)
        chosen: list[tuple | None] = [None] * nodes
        set_bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        whole = sums[:, :, 0, :].sum(axis=2) if sums.shape[2] else np.zeros((2, nodes))
        flags = {}
        for i, points in enumerate(self.points):
            c = self.column[i]
            if c < 0:
                continue
            if self.mask[i] == 1:
                if c not in flags:
                    flags[c] = whole[:, :, None] - sums[:, :, c, :256] @ set_bits
                left = flags[c][:, :, self.shift[i]][:, :, None]
            else:
                left = np.cumsum(sums[:, :, c, : len(points)], axis=2)
            rest = whole[:, :, None] - left
            ok = (left[0] > 0) & (rest[0] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                parts = left[1] ** 2 / left[0] + rest[1] ** 2 / rest[0]
                gain = parts - (whole[1] ** 2 / whole[0])[:, None]
            # Less than rounding can make is no gain.
            gain = np.where(ok & (gain > 1e-12 * parts), gain, 0.0)
            cut = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(nodes), cut] > best):
                if allowed is None or allowed[k, i]:
                    best[k] = gain[k, cut[k]]
                    chosen[k] = (i, int(cut[k]), left[:, k, cut[k]], rest[:, k, cut[k]])
        return chosen


# --- cached blocks -----------------------------------------------------------------------------------


def exact_step(bound: float, rows: int) -> float:
    """A power of two of which ``rows`` multiples, each at most ``bound``, add up without rounding."""
    return 2.0 ** (frexp(max(bound, 1e-300) * max(rows, 1))[1] - 53)


def rounded(x: np.ndarray, step: float) -> np.ndarray:
    return np.rint(x / step) * step


def cached_blocks(df: DataFrame, features: str, extras: dict[str, Column], packing: Packing, rows: int) -> RDD:
    """(codes, *extras) of the rows, a block each, dealt evenly over the tasks. Extras are doubles or longs."""
    names = list(extras)
    kinds = dict(df.select(*[c.alias(n) for n, c in extras.items()]).dtypes)
    types = [np.int64 if kinds[n] == "bigint" else np.float64 for n in names]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                packed = [packing.codes(x), *(batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(names)))]
                columns = [pa.array([batch.num_rows], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in packed)]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "codes", *names])

    def block(row):
        codes = np.frombuffer(row[1], np.uint8 if packing.width <= 256 else np.int32).reshape(-1, row[0])
        return (codes, *(np.frombuffer(x, t) for x, t in zip(row[2:], types)))

    schema = "n long, codes binary" + "".join(f", `{n}` binary" for n in names)
    blocks = df.select(vector_to_array(features).alias("features"), *[c.alias(n) for n, c in extras.items()]).mapInArrow(run, schema)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / ROWS_PER_TASK))
    return blocks.repartition(tasks).rdd.map(block)


def _forget(rdd: RDD, written: bool = False) -> None:
    """Free the cached blocks of ``rdd``, and if ``written`` its checkpoint."""
    rdd.unpersist()
    file = rdd.getCheckpointFile() if written else None
    if file:
        path = rdd.ctx._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(rdd.ctx._jsc.hadoopConfiguration()).delete(path, True)


# --- growing -----------------------------------------------------------------------------------------


def walk(codes: np.ndarray, at: np.ndarray, right: np.ndarray, width: int, levels: int) -> np.ndarray:
    """The node each row reaches after ``levels`` steps; children of node i are 2i+1 and 2i+2."""
    n = codes.shape[1]
    if not levels:
        return np.zeros(n, np.int64)
    node = 1 + right[codes[at[0]]].astype(np.int64)
    flat, rows, starts = codes.ravel(), np.arange(n), at * n
    for _ in range(levels - 1):
        code = flat[starts[node] + rows]
        node = 2 * node + 1 + right[node * width + code]
    return node


def add_sums(sums: np.ndarray, codes: np.ndarray, slot: np.ndarray, weight: np.ndarray | None, target: np.ndarray) -> None:
    """Add the rows of a block to ``sums`` (weight and weighted target, by slot, column, code); slot -1 takes no part."""
    _, slots, columns, width = sums.shape
    active = np.flatnonzero(slot >= 0)
    if len(active) < len(slot):
        codes, slot, target = codes[:, active], slot[active], target[active]
        weight = None if weight is None else weight[active]
    base = slot * width
    for c in range(columns):
        key = base + codes[c]
        sums[0, :, c] += np.bincount(key, weight, slots * width).reshape(slots, width)
        sums[1, :, c] += np.bincount(key, target, slots * width).reshape(slots, width)


class Growth:
    """Trees while they grow: per tree and node the feature, the cut between bins and the mean target. Leaves hand their value down."""

    def __init__(self, trees: int, depth: int, packing: Packing):
        nodes = 2 ** (depth + 1) - 1
        self.packing, self.depth = packing, depth
        self.feature = np.full((trees, nodes), -1)
        self.cut = np.zeros((trees, nodes), np.int64)
        self.value = np.zeros((trees, nodes))

    def paths(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """``Packing.right`` of the inner nodes; at a leaf every row goes left."""
        inner = 2**self.depth - 1
        feature = self.feature[tree, :inner]
        return self.packing.right(np.maximum(feature, 0), np.where(feature < 0, self.packing.width, self.cut[tree, :inner]))

    def hand_down(self, tree: int, node: int) -> None:
        first, last = 2 * node + 1, 2 * node + 2
        while first < self.value.shape[1]:
            self.value[tree, first : last + 1] = self.value[tree, node]
            first, last = 2 * first + 1, 2 * last + 2

    def grow(self, blocks: RDD, summands, allowed=None) -> Growth:
        """Grow all trees level by level. ``summands(block, tree)`` gives weights (or None) and weighted targets of a block."""
        packing = self.packing
        frontier = [(t, 0) for t in range(len(self.feature))]
        for level in range(self.depth):
            following = []
            for at in range(0, len(frontier), AT_ONCE):
                part = frontier[at : at + AT_ONCE]
                sums = self._sums(blocks, summands, part, level)
                may = None if allowed is None else np.stack([allowed(t, node) for t, node in part])
                for k, ((t, node), split) in enumerate(zip(part, packing.best(sums, may))):
                    if not level:
                        weight, target = sums[:, k, 0].sum(axis=1)
                        self.value[t, 0] = target / weight if weight else 0.0
                    if split is None:
                        self.hand_down(t, node)
                        continue
                    self.feature[t, node], self.cut[t, node], *sides = split
                    for child, side in zip((2 * node + 1, 2 * node + 2), sides):
                        self.value[t, child] = side[1] / side[0]
                        following.append((t, child))
            frontier = following
        return self

    def _sums(self, blocks: RDD, summands, part: list[tuple[int, int]], level: int) -> np.ndarray:
        slots = {}
        first = 2**level - 1
        for k, (t, node) in enumerate(part):
            slots.setdefault(t, np.full(2**level, -1))[node - first] = k
        paths = {t: self.paths(t) for t in slots}
        shape, width = (2, len(part), max(self.packing.columns, 1), self.packing.width), self.packing.width

        def run(held):
            sums = np.zeros(shape)
            for block in held:
                for t, slot in slots.items():
                    weight, target = summands(block, t)
                    node = walk(block[0], *paths[t], width, level)
                    add_sums(sums, block[0], slot[node - first], weight, target)
            yield sums

        tasks = blocks.getNumPartitions()
        return blocks.mapPartitions(run).treeReduce(np.add, 1 if tasks <= 32 else 2)

    def thresholds(self) -> tuple[list, list, list]:
        """(feature, threshold, value) per tree and node, as plain numbers."""
        points = self.packing.points
        threshold = [[float(points[f][c]) if f >= 0 else 0.0 for f, c in zip(*tree)] for tree in zip(self.feature, self.cut)]
        return self.feature.tolist(), threshold, self.value.tolist()


# --- models ------------------------------------------------------------------------------------------


def reached(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, depth: int) -> np.ndarray:
    """The bottom place, leaf or below one, that each row of ``x`` (by feature) reaches in a tree."""
    n = x.shape[1]
    flat, rows, starts = x.ravel(), np.arange(n), np.maximum(feature, 0) * n
    node = np.zeros(n, np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (flat[starts[node] + rows] > threshold[node])
    return node - (2**depth - 1)


def by_feature(features: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1).T)


class HistogramTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees over the column ``features``. ``loss`` is ``logistic`` (adds ``probability``), ``squared`` (``prediction``) or ``none``."""

    trees_ = Param(Params._dummy(), "trees_", "feature, threshold and value per tree and node", TypeConverters.identity)
    loss = Param(Params._dummy(), "loss", "logistic, squared or none", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "column to add", TypeConverters.toString)

    @staticmethod
    def of(growths: list[Growth], loss: str, output: str) -> HistogramTrees:
        model = HistogramTrees()
        parts = [g.thresholds() for g in growths]
        model._set(trees_=[[tree for part in parts for tree in part[i]] for i in range(3)], loss=loss, output=output)
        return model

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        feature, threshold, value = self.getOrDefault("trees_")
        depth = (len(feature[0]) + 1).bit_length() - 2
        return np.array(feature), np.array(threshold), np.array(value), depth

    @property
    def trees(self) -> list[FittedTree]:
        feature, threshold, value, depth = self.arrays()
        return [FittedTree(*tree, depth) for tree in zip(feature, threshold, value)]

    def _transform(self, df: DataFrame) -> DataFrame:
        feature, threshold, value, depth = self.arrays()
        bottom = value[:, -(2**depth) :]

        @F.arrow_udf("double")
        def margin(features: pa.Array) -> pa.Array:
            total = np.zeros(len(features))
            if len(features):
                x = by_feature(features)
                for i in range(len(feature)):
                    total += (STEP if i else 1.0) * bottom[i][reached(x, feature[i], threshold[i], depth)]
            return pa.array(total)

        output, score = self.getOrDefault("output"), margin(vector_to_array("features"))
        if self.getOrDefault("loss") == "squared":
            return df.withColumn(output, score)
        p = 1.0 / (1.0 + F.exp(-2.0 * score))
        return df.withColumn(output, p).withColumn(output, array_to_vector(F.array(1.0 - F.col(output), F.col(output))))


@dataclass(frozen=True)
class FittedTree:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    @property
    def numNodes(self) -> int:
        return 2 * int(self.leaf_numbers().max()) + 1

    def leaf_numbers(self) -> np.ndarray:
        """Number of the leaf above each bottom place; leaves count from the left."""
        places = np.zeros(1, np.int64)
        above = np.zeros(1, np.int64) - 1  # the leaf above, if any
        for _ in range(self.depth):
            above = np.where((above < 0) & (self.feature[places] < 0), places, above)
            places = np.stack([2 * places + 1, 2 * places + 2], axis=1).ravel()
            above = np.repeat(above, 2)
        leaf = np.where(above < 0, places, above)
        return np.cumsum(np.r_[0, leaf[1:] != leaf[:-1]])

    def predictLeaf(self, features) -> int:
        x = np.asarray(features.toArray(), float).reshape(-1, 1)
        return int(self.leaf_numbers()[reached(x, self.feature, self.threshold, self.depth)[0]])


# --- learners ----------------------------------------------------------------------------------------


def _binned(df: DataFrame, features: str, weight: Column, max_bins: int, seed: int, rows: int) -> Packing:
    weighted = df.select(vector_to_array(features).alias("features"), weight.alias("weight"))
    return Packing.of(find_bins(weighted, rows, max_bins, seed))


def _checked(depth: int) -> None:
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")


def boosted_trees(
    df: DataFrame,
    label: str,
    loss: str,
    rounds: int,
    depth: int,
    max_bins: int,
    seed: int,
    positive: float | None = None,
    output: str = "probability",
    features: str = "features",
) -> HistogramTrees:
    """Boosted trees on ``features`` (vectors): ``loss`` is ``logistic`` for 0/1 labels or ``squared``. Positives weigh ``positive``."""
    _checked(depth)
    ensure_checkpoint_dir(df.sparkSession)
    y = F.col(label).cast("double")
    bad = y.isNull() | F.isnan(y) | (~y.isin(0.0, 1.0) if loss == "logistic" else F.lit(False))
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.max(F.abs(y)).alias("most")).first()
    if not facts.n:
        raise ValueError("no training rows")
    if facts.bad:
        raise ValueError(f"{facts.bad} labels in {label} are missing" + (" or not 0 and 1" if loss == "logistic" else ""))
    heaviest = max(positive or 1.0, 1.0)
    step_w = exact_step(heaviest, facts.n)
    step_t = exact_step(4.0 * heaviest * (1.0 if loss == "logistic" else facts.most), facts.n)

    def weights(y):
        return None if positive is None else rounded(np.where(y > 0, positive, 1.0), step_w)

    def target(y, margin, first):
        if loss == "squared":
            pull = y if first else 2.0 * (y - margin)
        else:
            sign = 2.0 * y - 1.0
            pull = sign if first else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
        weight = weights(y)
        return rounded(pull if weight is None else weight * pull, step_t)

    weight = F.lit(1.0) if positive is None else F.when(y > 0, float(positive)).otherwise(1.0)
    packing = _binned(df, features, weight, max_bins, seed, facts.n)
    raw = cached_blocks(df, features, {"y": y}, packing, facts.n)
    # A block: codes, label, margin, weighted target.
    state = raw.map(lambda b: (b[0], b[1], np.zeros(len(b[1])), target(b[1], None, True))).persist(_CACHED)
    grown, older, written = [], None, None
    for m in range(rounds):
        tree = Growth(1, depth, packing).grow(state, lambda b, _: (weights(b[1]), b[3]))
        if older is not None:
            _forget(older)
        if m and m % CHECKPOINT == 0:
            if written is not None:
                _forget(written, True)
            written = state
        grown.append(tree)
        older = state
        if m + 1 < rounds:
            paths, width = tree.paths(0), packing.width
            gains = (STEP if m else 1.0) * tree.value[0, -(2**depth) :]

            def advance(b, paths=paths, gains=gains):
                margin = b[2] + gains[walk(b[0], *paths, width, depth) - (2**depth - 1)]
                return b[0], b[1], margin, target(b[1], margin, False)

            state = state.map(advance).persist(_CACHED)
            if (m + 1) % CHECKPOINT == 0:
                state.checkpoint()
    _forget(state)
    if written is not None:
        _forget(written, True)
    return HistogramTrees.of(grown, loss, output)


def share_of(strategy: str, features: int) -> int:
    """How many features a node of a forest may use, by the names that Spark ML uses."""
    named = {"auto": features / 3, "onethird": features / 3, "all": features, "sqrt": sqrt(features), "log2": log2(features) if features > 1 else 1}
    if strategy in named:
        wanted = named[strategy]
    else:
        wanted = int(strategy) if strategy.isdigit() else float(strategy) * features
    if wanted <= 0:
        raise ValueError(f"no features by {strategy}")
    return min(features, max(1, ceil(wanted)))


def poisson_counts(units: np.ndarray, stream: int, table: np.ndarray) -> np.ndarray:
    """Bootstrap counts: a fixed function of unit number and stream."""
    x = units.view(np.uint64) + np.uint64((stream * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return table[(x >> np.uint64(64 - _POISSON_BITS)).astype(np.int64)]


def _poisson_table() -> np.ndarray:
    p = np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)])
    return np.searchsorted(np.cumsum(p)[:-1], (np.arange(2**_POISSON_BITS) + 0.5) / 2**_POISSON_BITS).astype(np.float64)


def grown_forest(
    df: DataFrame,
    unit: Column,
    weight: Column,
    target: Column,
    trees: int,
    depth: int,
    max_bins: int,
    seed: int,
    strategy: str,
    features: str = "features",
) -> HistogramTrees:
    """Regression trees of ``target`` weighted by ``weight``: each on a Poisson resample by ``unit``, each node on a share of the features."""
    _checked(depth)
    w, wt = weight.cast("double"), (weight * target).cast("double")
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.max(w).alias("w"), F.max(F.abs(wt)).alias("wt")).first()
    if not facts.n:
        raise ValueError("no training rows")
    step_w, step_t = exact_step(4.0 * facts.w, facts.n), exact_step(4.0 * facts.wt, facts.n)
    packing = _binned(df, features, w, max_bins, seed, facts.n)
    raw = cached_blocks(df, features, {"unit": unit.cast("long"), "w": w, "wt": wt}, packing, facts.n)
    blocks = raw.map(lambda b: (b[0], b[1], rounded(b[2], step_w), rounded(b[3], step_t))).persist(_CACHED)
    table, count = _poisson_table(), len(packing.points)
    share = share_of(strategy, count)
    grown = []
    for first in range(0, trees, TREES_AT_ONCE):

        def resampled(b, t, first=first):
            times = poisson_counts(b[1], seed * 1_000_003 + first + t + 1, table)
            return b[2] * times, b[3] * times

        def allowed(t, node, first=first):
            may = np.zeros(count, bool)
            may[np.random.default_rng([abs(seed), first + t, node]).choice(count, share, replace=False)] = True
            return may

        together = Growth(min(TREES_AT_ONCE, trees - first), depth, packing)
        grown.append(together.grow(blocks, resampled, None if share == count else allowed))
    blocks.unpersist()
    return HistogramTrees.of(grown, "none", "")


# The functions of tasks travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
