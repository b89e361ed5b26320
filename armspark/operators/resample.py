"""Paired bootstrap of the Qini coefficient, interval comparison, verdict facts.

A replicate gives each unit a Poisson(1) weight that depends on (seed, unit, replicate) only, so
all models of a replicate see the same resample. Exploding units x replicates through the shuffle
would multiply its volume by the number of replicates. Instead the compact score rows are shuffled
once per model, into the bounded cells of ``ordering``, and a cell computes its weights in blocks:

1. every cell returns its weighted sums per replicate (cells x replicates rows);
2. Spark adds up what precedes each bin;
3. every light cell returns its area under the curve, starting from those offsets. A bin that holds
   a single tied score is one point of the curve, so its area follows from its sums alone.

Both passes stream a cell in Arrow batches, the second one in the order Spark has sorted it, so a
task holds a block of rows times the replicates, whatever the cell size.

The multinomial resample (exactly n draws per replicate) goes the same way. Independent Poisson weights with a rate a little below 1 are, given their total,
a multinomial of that total; the draws that are missing to n are made one by one and added. A replicate lacks
about ``SPARE_DEVIATIONS`` times the root of n draws, so they are few, and each unit carries its own as a short list.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing
from ..functions.columns import stable_sum
from ..functions.hashing import (
    STREAM_BOOTSTRAP,
    STREAM_DRAW,
    poisson_matrix,
    replicate_words,
    stream_id,
    wide_hash,
)
from ..session import materialize
from .curves import qini_from_area, qini_height, slice_area
from .ordering import LIGHT, Scores, global_rank, long_scores, model_name, running_totals

# The cell functions travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(hashing)

# The Poisson total of a replicate lies this many standard deviations below n; it passes n with a chance below 1e-15.
SPARE_DEVIATIONS = 8.0
EXTRA = "__extra_draws"
# Single draws that one task makes, about.
DRAWS_PER_TASK = 1_000_000
# Rows of a block: its draws stay in the cache, and the sums of a block of areas fit into the lanes of one number.
_BLOCK = 128
_AREA_BLOCK = 128
_LANE = 15
_SUMS = ("n", "nt", "y", "yt")
_SUM_SCHEMA = "m int, bin int, sub int, rep int, n bigint, nt bigint, y bigint, yt bigint"


def bootstrap_weights(df: DataFrame, key: str, n_replicates: int, seed: int = 42, rate: float = 1.0) -> DataFrame:
    """(unit, rep, weight) for weights above zero: the resamples themselves, as rows.

    Drawn in blocks of units, like the passes below: as column expressions the filter on the weight would be pushed under the draw, and the hash
    of the unit with it, written out hundreds of times per row.
    """
    words = replicate_words(n_replicates)
    units = df.select(key, stream_id(key, seed, STREAM_BOOTSTRAP).alias("__u"))

    def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                block = batch.slice(start, _BLOCK)
                weights = poisson_matrix(block.column(1).to_numpy(), words, rate)
                at, rep = np.nonzero(weights)
                columns = [block.column(0).take(pa.array(at)), pa.array(rep.astype(np.int32)), pa.array(weights[at, rep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "rep", "weight"])

    schema = T.StructType([df.select(key).schema[0], T.StructField("rep", T.IntegerType(), False), T.StructField("weight", T.IntegerType(), False)])
    return units.mapInArrow(draws, schema)


def _arm_masks(pdf: pd.DataFrame) -> np.ndarray:
    """Rows x 4 indicators matching ``_SUMS``."""
    t = pdf["t"].to_numpy(np.int64)
    y = pdf["y"].to_numpy(np.int64)
    return np.stack([np.ones_like(t), t, y, t * y])


def _add_extra(weights: np.ndarray, extra: pd.Series | None, by_replicate: bool) -> np.ndarray:
    """Add the single draws that the units of a block carry; ``extra`` holds a list of replicates, or nothing, per unit."""
    if extra is None:
        return weights
    lists = [(i, reps) for i, reps in enumerate(extra) if reps is not None and len(reps)]
    if lists:
        units = np.repeat([i for i, _ in lists], [len(r) for _, r in lists])
        reps = np.concatenate([np.asarray(r, np.int64) for _, r in lists])
        np.add.at(weights, (reps, units) if by_replicate else (units, reps), 1)
    return weights


def _cell_sums(n_replicates: int, rate: float = 1.0):
    words = replicate_words(n_replicates)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, n_replicates), dtype=np.int64)
        cell = {}
        for batch in batches:
            cell = {c: int(batch[c].iloc[0]) for c in ("m", "bin", "sub")}
            unit, extra = batch["u"].to_numpy(np.int64), batch.get("extra")
            masks = _arm_masks(batch)
            for start in range(0, len(batch), _BLOCK):
                block = slice(start, start + _BLOCK)
                # Small whole numbers: float32 products are exact and use fast matrix kernels.
                weights = poisson_matrix(unit[block], words, rate)
                weights = _add_extra(weights, None if extra is None else extra.iloc[block], False).astype(np.float32)
                total += (masks[:, block].astype(np.float32) @ weights).astype(np.int64)
        yield pd.DataFrame({**cell, "rep": np.arange(n_replicates), **dict(zip(_SUMS, total))})

    return sums


def _height(n, nt, yt, yc):
    nc = n - nt
    with np.errstate(divide="ignore", invalid="ignore"):
        share = nt / nc
    if not nc.all():  # only ahead of the first control unit
        share[nc == 0] = 0.0
    share *= yc
    return np.subtract(yt, share, out=share)


def _unpacked(pairs: np.ndarray, ahead: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The four sums that share two numbers, each added to what lies ahead."""
    low, high = np.int32((1 << _LANE) - 1), np.int32(_LANE)
    found = [part for pair in pairs for part in (pair & low, pair >> high)]
    return [part + before for part, before in zip(found, ahead)]


def _cell_areas(n_replicates: int, rate: float = 1.0):
    words = replicate_words(n_replicates)

    def areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walk a cell in score order. A tie may go on in the next block, so the point of a score
        is drawn when the first row of the next score, or the end, is seen.

        Replicates are the rows of every array here, so the running sums read memory in order.
        """
        m, score = 0, None
        area = np.zeros(n_replicates)
        for batch in batches:
            if batch["carry"].iloc[0] is not None:  # the first row of a cell brings the offsets
                m = int(batch["m"].iloc[0])
                n, nt, y, yt = np.asarray(batch["carry"].iloc[0], np.float64).reshape(4, n_replicates)
                cum = [n, nt, yt, y - yt]
                x, height = n, _height(*cum)
                batch = batch.iloc[1:]
            scores = batch["score"].to_numpy(np.float64)
            unit, extra = batch["u"].to_numpy(np.int64), batch.get("extra")
            t, y = batch["t"].to_numpy(np.int32), batch["y"].to_numpy(np.int32)
            # What a unit adds to (n, nt) and to (yt, yc), two sums side by side in one number.
            lanes = np.stack([1 + (t << _LANE), t * y + (((1 - t) * y) << _LANE)])[:, None, :].astype(np.int32)
            for start in range(0, len(batch), _AREA_BLOCK):
                block = slice(start, start + _AREA_BLOCK)
                s = scores[block]
                previous = np.append(s[0] if score is None else score, s[:-1])
                if (s > previous).any():
                    raise RuntimeError("rows of a cell must arrive by descending score")
                weights = poisson_matrix(unit[block], words, rate, by_replicate=True)
                if extra is not None:
                    weights = _add_extra(weights.astype(np.int32), extra.iloc[block], True)
                drawn = np.flatnonzero(s != previous)
                score = s[-1]
                # Runs of one score; a run that goes on from the block before adds to what is ahead of the first point here.
                runs = drawn if len(drawn) and drawn[0] == 0 else np.append(0, drawn)
                sums = weights.astype(np.int32) * lanes[:, :, block]
                if len(runs) < len(s):
                    sums = np.add.reduceat(sums, runs, axis=2)
                if sums.shape[2] > 1:
                    np.cumsum(sums, axis=2, out=sums)
                last = _unpacked(sums[:, :, -1], cum)
                if len(drawn) == 0:
                    cum = last
                    continue
                # Column i: sums of everything ahead of the i-th point.
                xs, hs = np.empty((n_replicates, len(drawn) + 1)), np.empty((n_replicates, len(drawn) + 1))
                xs[:, 0], hs[:, 0] = x, height
                inner = _unpacked(sums[:, :, :-1], [c[:, None] for c in cum])
                if len(runs) == len(drawn):  # a point ahead of the first row
                    xs[:, 1], hs[:, 1] = cum[0], _height(*cum)
                xs[:, xs.shape[1] - inner[0].shape[1] :] = inner[0]
                hs[:, xs.shape[1] - inner[0].shape[1] :] = _height(*inner)
                width, both = xs[:, 1:] - xs[:, :-1], hs[:, 1:] + hs[:, :-1]
                area += np.einsum("ij,ij->i", width, both) / 2.0
                x, height, cum = xs[:, -1].copy(), hs[:, -1].copy(), last
        area += (cum[0] - x) * (height + _height(*cum)) / 2.0
        yield pd.DataFrame({"m": m, "rep": np.arange(n_replicates), "area": area})

    return areas


def _tasks(scores: Scores) -> int:
    """Several tasks per core even out the cells; more only while there are cells to fill them."""
    parallelism = scores.rows.sparkSession.sparkContext.defaultParallelism
    by_size = scores.n * len(scores.models) // 100_000
    return int(max(parallelism, min(scores.max_cells, max(3 * parallelism, by_size))))


def bootstrap_qini(
    scores: Scores, treatment: str, outcome: str, n_replicates: int = 500, seed: int = 42, rate: float = 1.0
) -> DataFrame:
    """(m, rep, n, qini): the coefficient of every model in every replicate; exact.

    NULL where the resample lacks an arm or an outcome class. ``treatment`` and ``outcome`` are 0/1. Where ``with_exact_draws`` has prepared the
    units, pass its rate, and keep the column ``EXTRA`` in ``scores``: the resamples are multinomial then.
    """
    slim = scores.rows.select(
        "m",
        "bin",
        "sub",
        "score",
        stream_id(scores.key, seed, STREAM_BOOTSTRAP).alias("u"),
        F.col(treatment).cast("int").alias("t"),
        F.col(outcome).cast("int").alias("y"),
        *([F.col(EXTRA).alias("extra")] if EXTRA in scores.rows.columns else []),
    )
    # A cell is small in bytes and heavy in work, so the number of tasks is set here; left to
    # itself the adaptive planner would merge many cells into one task.
    sums = (
        slim.repartition(_tasks(scores), "m", "bin", "sub")
        .groupBy("m", "bin", "sub")
        .applyInPandas(_cell_sums(n_replicates, rate), _SUM_SCHEMA)
    )
    bins = sums.groupBy("m", "bin", "rep").agg(
        F.min("sub").alias("first_sub"), *[F.sum(s).alias(s) for s in _SUMS]
    )
    # models x bins x replicates rows, used three times below: stored, so the draws are made once.
    bins = materialize(bins, "resampled_bins")
    model = Window.partitionBy("m", "rep")
    ahead = model.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select(
        "*",
        *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(f"before_{s}") for s in _SUMS],
        *[F.sum(s).over(model).alias(f"all_{s}") for s in _SUMS],
    )

    # One row per light cell with all its offsets; it sorts ahead of the rows of the cell.
    light = offsets.where(F.col("first_sub") == LIGHT)
    parts = F.sort_array(F.collect_list(F.struct("rep", *[f"before_{s}" for s in _SUMS])))
    carry = light.groupBy("m", "bin").agg(parts.alias("o")).select(
        "m",
        "bin",
        F.concat(*[F.col(f"o.before_{s}") for s in _SUMS]).alias("carry"),
    )
    # The row with the offsets is no unit; its stream is named 0, so that the column stays whole numbers in every batch.
    carry = carry.withColumn("u", F.lit(0).cast("bigint"))
    rows = slim.where(F.col("sub") == LIGHT).unionByName(carry, allowMissingColumns=True)
    light_area = (
        rows.repartition(_tasks(scores), "m", "bin")
        .sortWithinPartitions("m", "bin", F.col("carry").isNull(), F.col("score").desc())
        .groupBy("m", "bin")
        .applyInPandas(_cell_areas(n_replicates, rate), "m int, rep int, area double")
    )
    before = [F.col(f"before_{s}") for s in _SUMS]
    after = [F.col(f"before_{s}") + F.col(s) for s in _SUMS]
    tied_area = F.col("n") * (qini_height(*before) + qini_height(*after)) / 2.0
    tied = offsets.where(F.col("first_sub") != LIGHT).select("m", "rep", tied_area.alias("area"))
    area = light_area.unionByName(tied).groupBy("m", "rep").agg(stable_sum(F.col("area")).alias("area"))

    whole = offsets.groupBy("m", "rep").agg(*[F.first(f"all_{s}").alias(s) for s in _SUMS])
    return whole.join(area, ["m", "rep"]).select(
        "m", "rep", "n", qini_from_area(F.col("area"), *[F.col(s) for s in _SUMS]).alias("qini")
    )


def exact_rate(n: int) -> float:
    """The Poisson rate of a multinomial resample of ``n`` units; 0 for few units, whose draws are all single ones."""
    return max(0.0, 1.0 - SPARE_DEVIATIONS / math.sqrt(n)) if n else 0.0


def _poisson_totals(df: DataFrame, key: str, n_replicates: int, seed: int, rate: float) -> list[int]:
    """Sum of the Poisson weights of each replicate: one streamed pass over the keys, one row per task and replicate."""
    words = replicate_words(n_replicates)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_replicates, np.int64)
        for batch in batches:
            unit = batch["u"].to_numpy(np.int64)
            for start in range(0, len(unit), _BLOCK):
                total += poisson_matrix(unit[start : start + _BLOCK], words, rate).sum(axis=0, dtype=np.int64)
        yield pd.DataFrame({"rep": np.arange(n_replicates), "n": total})

    streams = df.select(stream_id(key, seed, STREAM_BOOTSTRAP).alias("u"))
    found = streams.mapInPandas(sums, "rep int, n bigint").groupBy("rep").agg(F.sum("n").alias("n")).collect()
    return [n for _, n in sorted((r.rep, r.n) for r in found)] or [0] * n_replicates


def single_draws(df: DataFrame, key: str, n_replicates: int, seed: int = 42) -> tuple[DataFrame, float]:
    """((unit, rep) rows, rate): the draws that Poisson weights of that rate lack to exactly n per replicate.

    About ``SPARE_DEVIATIONS`` times the root of n per replicate, made in the tasks that route them. The units are numbered
    by their keys without a global sort.
    """
    n = df.count()
    rate = exact_rate(n)
    missing = [n - total for total in _poisson_totals(df, key, n_replicates, seed, rate)]
    if min(missing, default=0) < 0:
        raise RuntimeError("more Poisson draws than units: choose another seed")
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(enumerate(missing)), "rep int, missing bigint").where("missing > 0")
    # As many rows per replicate as there are blocks of draws, so that one replicate is made by many tasks.
    block = 1 << 16
    starts = wanted.select("rep", "missing", F.explode(F.sequence(F.lit(0), F.col("missing") - 1, F.lit(block))).alias("at"))
    ends = F.least(F.col("at") + block, F.col("missing")) - 1
    # The adaptive planner sees these few rows, not the draws they stand for: with a number of tasks it does not merge them into one.
    tasks = max(spark.sparkContext.defaultParallelism, sum(missing) // DRAWS_PER_TASK)
    draws = starts.repartition(tasks, "rep", "at").select("rep", F.explode(F.sequence("at", ends)).alias("draw"))
    place = wide_hash(F.concat_ws(":", "rep", "draw"), seed, STREAM_DRAW) % F.lit(max(n, 1))
    # A constant score ranks the units by key alone: a dense position without a global sort.
    flat = long_scores(df.select(key).withColumn("flat", F.lit(0.0)), {"": "flat"}, key, [])
    places = global_rank(flat).select(key, (F.col("rank") - 1).alias("position"))
    # For the same reason it would send all draws through the driver to every task; both sides are large, so they are dealt by position.
    routed = draws.select("rep", place.alias("position")).hint("merge")
    return routed.join(places, "position").select(key, "rep"), rate


def with_exact_draws(df: DataFrame, key: str, n_replicates: int, seed: int = 42) -> tuple[DataFrame, float]:
    """``df`` with the column ``EXTRA``, the replicates that draw the unit once more, and the rate for ``bootstrap_qini``.

    A unit's list is short: all lists together hold the single draws. The table is stored, as its readers pass over it more than once.
    """
    draws, rate = single_draws(df, key, n_replicates, seed)
    lists = draws.groupBy(key).agg(F.collect_list("rep").alias(EXTRA))
    return materialize(df.join(lists, key, "left"), "exact_draws"), rate


def multinomial_weights(df: DataFrame, key: str, n_replicates: int, seed: int = 42) -> DataFrame:
    """(unit, rep, weight): exactly n draws with replacement per replicate, as rows.

    Units x replicates rows: the literal table, for small sizes and for checks. ``with_exact_draws`` serves the same draws without it.
    """
    draws, rate = single_draws(df, key, n_replicates, seed)
    single = draws.select(key, "rep", F.lit(1).alias("weight"))
    both = bootstrap_weights(df, key, n_replicates, seed, rate).unionByName(single)
    return both.groupBy(key, "rep").agg(F.sum("weight").cast("int").alias("weight"))


def weighted_qini(scores: Scores, weights: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """(m, rep, n, qini) for explicit (unit, rep, weight) rows, with joins and windows alone."""
    rows = scores.rows.join(weights, scores.key)
    w, t, y = F.col("weight").cast("bigint"), F.col(treatment), F.col(outcome)
    values = {"n": F.sum(w), "nt": F.sum(w * t), "y": F.sum(w * y), "yt": F.sum(w * t * y)}
    totals = running_totals(replace(scores, rows=rows), values, extra=["rep"])
    sums = totals.groupBy("m", "rep").agg(
        stable_sum(slice_area()).alias("area"), *[F.first(f"all_{s}").alias(s) for s in _SUMS]
    )
    return sums.select(
        "m", "rep", "n", qini_from_area(F.col("area"), *[F.col(s) for s in _SUMS]).alias("qini")
    )


def percentile_interval(replicates: DataFrame, scores: Scores) -> DataFrame:
    """(model, ci_lower_95, ci_upper_95, n_successful_resamples) over non-NULL replicates.

    Linear interpolation between order statistics; one group holds ``n_replicates`` values.
    """
    bounds = F.percentile("qini", F.array(F.lit(0.025), F.lit(0.975)))
    return (
        replicates.groupBy("m")
        .agg(bounds.alias("b"), F.count("qini").alias("n_successful_resamples"))
        .select(
            model_name(scores).alias("model"),
            F.col("b")[0].alias("ci_lower_95"),
            F.col("b")[1].alias("ci_upper_95"),
            "n_successful_resamples",
        )
    )


def with_intervals(coefficients: DataFrame, intervals: DataFrame) -> DataFrame:
    """Coefficient, interval and whether the interval contains zero; one row per model."""
    return coefficients.join(F.broadcast(intervals), "model").select(
        "model",
        "qini_coefficient",
        "ci_lower_95",
        "ci_upper_95",
        "n_successful_resamples",
        ((F.col("ci_lower_95") <= 0) & (F.col("ci_upper_95") >= 0)).alias("contains_zero"),
    )


def results_table(intervals: DataFrame, uplift: DataFrame, ks: Sequence[float]) -> DataFrame:
    """One row per model: coefficient, interval and uplift at each k as columns, rounded to 4."""

    def at(k: float) -> Column:
        return F.max(F.when(F.col("k") == F.lit(float(k)), F.col("uplift_at_k")))

    wide = uplift.groupBy("model").agg(*[at(k).alias(f"uplift_at_{round(k * 100)}pct") for k in ks])
    names = ["qini_coefficient", "ci_lower_95", "ci_upper_95"]
    names += [f"uplift_at_{round(k * 100)}pct" for k in ks]
    # One row per model on both sides.
    return intervals.join(F.broadcast(wide), "model").select(
        "model", *[F.round(name, 4).alias(name) for name in names]
    )


def _declared(models: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in models]), F.col("model"))


def pairwise_overlap(intervals: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every unordered pair of models: do their intervals overlap?

    The pairs are built inside one row, from the array of models (a handful), so the table needs
    no self-join.
    """
    ordered = intervals.select(
        F.struct(
            _declared(models).alias("at"),
            "model",
            F.col("qini_coefficient").alias("qini"),
            F.col("ci_lower_95").alias("lo"),
            F.col("ci_upper_95").alias("hi"),
        ).alias("r")
    ).agg(F.sort_array(F.collect_list("r")).alias("all"))
    firsts = ordered.select("all", F.explode("all").alias("a"))
    pairs = firsts.select("a", F.explode("all").alias("b")).where(F.col("a.at") < F.col("b.at"))
    overlap = (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))
    # The two verdict texts.
    return pairs.select(
        F.col("a.model").alias("model_a"),
        F.col("b.model").alias("model_b"),
        F.round("a.qini", 4).alias("qini_a"),
        F.round("b.qini", 4).alias("qini_b"),
        overlap.alias("cis_overlap"),
    ).withColumn(
        "verdict",
        F.when(F.col("cis_overlap"), "NOT distinguishable (CIs overlap)").otherwise(
            "Distinguishable (CIs do not overlap)"
        ),
    )


def verdict_facts(
    intervals: DataFrame, models: Sequence[str], reference_model: str | None = None
) -> DataFrame:
    """One row: best model and its interval, who overlaps with it, pair counts, reference rank.

    Equal coefficients: the model declared first is best, and tied models share the better rank.
    Works on one row per model throughout.
    """
    best_key = F.struct(F.col("qini_coefficient"), (-_declared(models)).alias("early"))
    ref = F.col("model") == F.lit(reference_model)
    summary = intervals.agg(
        F.max_by(
            F.struct("model", "qini_coefficient", "ci_lower_95", "ci_upper_95"), best_key
        ).alias("best"),
        F.max(F.when(ref, F.col("qini_coefficient"))).alias("ref_qini"),
        F.collect_list("qini_coefficient").alias("all_qini"),
        F.count(F.lit(1)).alias("n_models"),
    )
    # One row.
    pairs = pairwise_overlap(intervals, models).join(F.broadcast(summary.select("best")))
    with_best = (F.col("model_a") == F.col("best.model")) | (F.col("model_b") == F.col("best.model"))
    other = F.when(F.col("model_a") == F.col("best.model"), F.col("model_b")).otherwise(
        F.col("model_a")
    )
    facts = pairs.agg(
        F.array_join(
            F.sort_array(F.collect_set(F.when(with_best & F.col("cis_overlap"), other))), ","
        ).alias("overlapping"),
        F.count_if(~F.col("cis_overlap")).alias("n_distinguishable"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
    rank = F.size(F.filter("all_qini", lambda q: q > F.col("ref_qini"))) + 1
    return summary.join(F.broadcast(facts)).select(
        F.col("best.model").alias("best_model"),
        F.col("best.qini_coefficient").alias("best_qini"),
        F.col("best.ci_lower_95").alias("best_lower"),
        F.col("best.ci_upper_95").alias("best_upper"),
        "overlapping",
        "n_distinguishable",
        "n_pairs",
        F.when(F.col("ref_qini").isNotNull(), rank).cast("bigint").alias("reference_rank"),
        "n_models",
    )
