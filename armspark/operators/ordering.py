"""Global order without a global sort: bins, running totals, exact cut-offs, exact ranks.

A window without partition keys, or partitioned by model only, puts the whole table into one task
per model. Instead every row gets a *cell* that is a pure function of its own values:

* ``bin``: which quantile interval of the score it is in. A score shared by more rows than one
  interval should hold is isolated in an interval of its own.
* ``sub``: inside such an isolated interval, which interval of the unit key; -1 elsewhere.

Reading cells in (bin descending, sub ascending) order is reading rows in (score descending, key
ascending) order, cut into pieces of bounded size even if a third of all rows tie. The number of
intervals follows from the number of rows. Score edges come from an approximate quantile sketch, key edges from
whole keys sampled inside each isolated score and compared as what they are, numbers or texts. Then the rows of each cell are
counted, and a cell with more than twice its share is split again, until none is left. Where an edge lies moves work
between tasks, never a result.

Cell totals are combined before the shuffle and are a small table (models x cells). Whoever needs
positions adds the total of the preceding cells to a window *inside* the cell.
"""

from __future__ import annotations

import itertools
import json
import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import require_columns
from .checks import counted_faults, require_binary, require_unit_keys

ROWS_PER_BIN = 2_000_000
# Enough cells of a model to keep the tasks even, and fine enough to set a score alone that a sixty-fourth of the rows share.
MIN_BINS = 64
# Cell tables up to this many rows are sent to every task.
SENT_CELLS = 100_000

# A cell may hold this many times ``rows_per_bin``; sampled keys per ``rows_per_bin`` rows of a cell that is split.
LARGEST_CELL = 2
SAMPLED_KEYS = 64

LIGHT = -1


@dataclass(frozen=True)
class Scores:
    """Long score rows (m, score, bin, sub, key, ...); ``m`` is the position in ``models``.

    ``n`` is the number of units, the same for every model. ``max_cells`` bounds the cell tables; ``tied``
    says whether any score fills an interval alone.
    """

    rows: DataFrame
    models: tuple[str, ...]
    key: str
    n: int
    max_cells: int
    tied: bool


def _marks(quantiles: Sequence[float]) -> dict[float, bool]:
    """Score values that become edges, and whether they are so frequent that they fill an interval alone."""
    return {float(v): times > 1 for v, times in Counter(quantiles).items() if v != np.inf}


def _edges(marks: Mapping[float, bool]) -> tuple[list[float], list[int]]:
    """Strictly increasing edges, and which intervals hold exactly one (heavy) value."""
    edges, isolated = [-np.inf], []
    for value, heavy in sorted(marks.items()):
        if value > edges[-1]:
            edges.append(value)
        if heavy:
            isolated.append(len(edges) - 1)
            edges.append(float(np.nextafter(value, np.inf)))
    return [*edges, np.inf], isolated


def long_scores(
    df: DataFrame,
    score_columns: Mapping[str, str],
    key: str,
    keep: Sequence[str],
    rows_per_bin: int = ROWS_PER_BIN,
    min_bins: int = MIN_BINS,
    keyed: bool = False,
    binary: Sequence[str] | None = None,
) -> Scores:
    """One row per (unit, model) with its cell. ``df`` should be a stored table: it is read here
    once for the edges and again by every operator on the result.

    NULL and NaN scores rank last, as minus infinity. The driver sees (models + 1) edges per
    ``rows_per_bin`` rows. Keys may be numbers or texts. A repeated or NULL key is an error; ``keyed`` says
    that this has been checked before. The columns ``binary`` (all of ``keep``, if not given) must be 0 or 1.
    """
    models = tuple(score_columns)
    require_columns(df, (key, *keep, *score_columns.values()))
    flags = tuple(keep if binary is None else binary)
    if not keyed:
        require_unit_keys(df, key)
    facts = df.agg(F.count(F.lit(1)).alias("n"), *counted_faults(flags)).first()
    require_binary({c: facts[f"fault_{i}"] for i, c in enumerate(flags)})
    n = facts["n"]
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    clean = df.select(
        (F.col(key).cast("bigint") if whole else F.col(key)).alias(key),
        *keep,
        *[
            F.coalesce(
                F.nanvl(F.col(c).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))
            ).alias(f"__s{i}")
            for i, c in enumerate(score_columns.values())
        ],
    )
    scores = [f"__s{i}" for i in range(len(models))]
    n_bins = max(min_bins, -(-n // rows_per_bin))
    levels = [j / n_bins for j in range(1, n_bins)]
    quantiles = clean.approxQuantile(scores, levels, 1.0 / (4 * n_bins)) if n else [[] for _ in models]
    cells = _Cells(clean, key, tuple(keep), [_marks(q) for q in quantiles], [[] for _ in models])
    if n > LARGEST_CELL * rows_per_bin:
        _even_scores(cells, rows_per_bin)
        _even_keys(cells, rows_per_bin)
    layout = [_edges(m) for m in cells.marks]
    max_cells = sum(len(e) for e, _ in layout) + sum(len(k) for k in cells.keys)
    return Scores(cells.rows(), models, key, n, max_cells, any(heavy for _, heavy in layout))


@dataclass
class _Cells:
    """Where cells begin: per model its score marks, and sorted (bin, key, key as text) inside isolated scores."""

    clean: DataFrame
    key: str
    keep: tuple[str, ...]
    marks: list[dict[float, bool]]
    keys: list[list[tuple[int, object, str]]]

    def rows(self) -> DataFrame:
        """Long rows with their cell."""
        layout = [_edges(m) for m in self.marks]
        kind = self.clean.schema[self.key].dataType.simpleString()
        binned = _bucketize(self.clean, {f"__b{i}": (f"__s{i}", edges) for i, (edges, _) in enumerate(layout)})
        structs = []
        for i, (_, isolated) in enumerate(layout):
            bin_ = F.col(f"__b{i}")
            heavy = bin_.isin(isolated) if isolated else F.lit(False)
            probe = F.struct(bin_.alias("b"), F.col(self.key).alias("k"))
            structs.append(
                F.struct(
                    F.lit(i).alias("m"),
                    F.col(f"__s{i}").alias("score"),
                    bin_.alias("bin"),
                    F.when(heavy, _edges_up_to(self.keys[i], kind, probe)).otherwise(LIGHT).alias("sub"),
                )
            )
        return binned.select(self.key, *self.keep, F.inline(F.array(*structs)))


def _edges_up_to(edges: Sequence[tuple[int, object, str]], kind: str, probe: Column) -> Column:
    """How many of the sorted (bin, key) edges are not above ``probe``: a binary search in one constant array."""
    if not edges:
        return F.lit(0)
    text = json.dumps([{"b": b, "k": k} for b, _, k in edges])
    table = F.from_json(F.lit(text), "array<struct<b:int,k:string>>").cast(f"array<struct<b:int,k:{kind}>>")

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        below = F.struct((middle + 1).alias("lo"), span["hi"].alias("hi"))
        above = F.struct(span["lo"].alias("lo"), middle.alias("hi"))
        return F.when(span["lo"] >= span["hi"], span).when(F.get(table, middle) <= probe, below).otherwise(above)

    steps = F.sequence(F.lit(1), F.lit(len(edges).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi"))
    return F.aggregate(steps, start, halve, lambda span: span["lo"])


def _even_scores(cells: _Cells, rows_per_bin: int) -> None:
    """Split score intervals that hold more than twice their share, until only single scores do.

    One row per interval reaches the driver, as many as there are edges.
    """
    while True:
        found = (
            cells.rows()
            .where(F.col("sub") == LIGHT)
            .groupBy("m", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", [j / 16 for j in range(17)], 1000).alias("p"))
            .where(F.col("n") > LARGEST_CELL * rows_per_bin)
            .collect()
        )
        before = [dict(m) for m in cells.marks]
        for row in found:
            marks = cells.marks[row.m]
            for value, times in Counter(row.p).items():
                if value != np.inf and (times > 1 or value > row.p[0]):
                    marks[value] = marks.get(value, False) or times > 1
        if cells.marks == before:
            return


def _even_keys(cells: _Cells, rows_per_bin: int) -> None:
    """Split cells of one score along the unit key, until none holds more than twice its share.

    Each round counts the cells, takes a sample of keys in those that are too large (``SAMPLED_KEYS`` per share, by a hash of the key) and puts
    edges at equal steps of the sorted sample. One key per share reaches the driver.
    """
    share, key = SAMPLED_KEYS / rows_per_bin, cells.key
    for turn in itertools.count():
        rows = cells.rows().where(F.col("sub") != LIGHT)
        sizes = rows.groupBy("m", "bin", "sub").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > LARGEST_CELL * rows_per_bin).collect()
        if not large:
            return
        # One row per cell that is too large, never more than there are shares of rows.
        wanted = F.broadcast(rows.sparkSession.createDataFrame(large, sizes.schema))
        chance = F.pmod(F.xxhash64(F.lit(turn), F.col("m"), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
        sample = rows.join(wanted, ["m", "bin", "sub"]).where(chance < min(1.0, share))
        cell = Window.partitionBy("m", "bin", "sub")
        at, pieces = F.row_number().over(cell.orderBy(key)), F.ceil(F.col("n") / rows_per_bin)
        step = lambda place: F.floor(place * pieces / F.count(F.lit(1)).over(cell))
        chosen = sample.select("m", "bin", key, step(at).alias("now"), step(at - 1).alias("before"), at.alias("at"))
        edges = chosen.where((F.col("now") > F.col("before")) & (F.col("at") > 1))
        found = edges.select("m", "bin", F.col(key).alias("k"), F.col(key).cast("string").alias("text")).collect()
        before = sum(len(k) for k in cells.keys)
        for row in found:
            cells.keys[row.m].append((row.bin, row.k, row.text))
        # Code points and UTF-8 bytes sort alike, so the driver's order is Spark's.
        cells.keys = [sorted(set(k)) for k in cells.keys]
        if sum(len(k) for k in cells.keys) == before:
            if share >= 1.0:
                return  # only repeated keys: nothing is left to split
            share *= 8


def _bucketize(df: DataFrame, wanted: Mapping[str, tuple[str, list[float]]]) -> DataFrame:
    """Interval number of each column (binary search in the JVM); 0 where there is one interval."""
    searched = {out: spec for out, spec in wanted.items() if len(spec[1]) > 2}
    if searched:
        raw = [f"{out}_d" for out in searched]
        df = Bucketizer(
            splitsArray=[edges for _, edges in searched.values()],
            inputCols=[column for column, _ in searched.values()],
            outputCols=raw,
            handleInvalid="keep",
        ).transform(df)
    for out in wanted:
        number = F.col(f"{out}_d").cast("int") if out in searched else F.lit(0)
        df = df.withColumn(out, number)
    return df


def cell_totals(
    scores: Scores, values: Mapping[str, Column], by_sub: bool, extra: Sequence[str] = ()
) -> DataFrame:
    """Totals per cell with ``before_*`` (all better cells of the model) and ``all_*`` (the model).

    ``extra`` columns, such as a replicate number, make separate orders. The windows run over at
    most one row per cell.
    """
    own = ["m", *extra]
    keys = [*own, "bin", "sub"] if by_sub else [*own, "bin"]
    totals = scores.rows.groupBy(*keys).agg(*[c.alias(name) for name, c in values.items()])
    order = [F.col("bin").desc(), *([F.col("sub")] if by_sub else [])]
    model = Window.partitionBy(*own)
    ahead = model.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        *values,
        *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"before_{v}") for v in values],
        *[F.sum(v).over(model).alias(f"all_{v}") for v in values],
    )


def running_totals(
    scores: Scores, values: Mapping[str, Column], extra: Sequence[str] = ()
) -> DataFrame:
    """One row per (model, distinct score): own sums and ``cum_*`` totals down to that score.

    Rows of ordinary bins are dealt once by (model, bin), which serves the sums per score and the
    window alike. A bin that one score fills alone needs no window: its sums are combined before
    their shuffle, so it never meets in one task. The offset table has one row per (model, bin), at most
    ``max_cells``; it is sent to the tasks while that is few.
    """
    keys = ["m", *extra, "bin"]
    sums = [c.alias(v) for v, c in values.items()]
    light = F.col("sub") == LIGHT
    groups = scores.rows.where(light).repartition(*keys).groupBy(*keys, "score").agg(*sums)
    inside = (
        Window.partitionBy(*keys)
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = groups.select("*", *[F.sum(v).over(inside).alias(f"in_{v}") for v in values])
    if scores.tied:
        alone = scores.rows.where(~light).groupBy(*keys, "score").agg(*sums)
        local = local.unionByName(alone.select("*", *[F.col(v).alias(f"in_{v}") for v in values]))
    offsets = cell_totals(scores, values, by_sub=False, extra=extra).select(
        *keys, *[f"before_{v}" for v in values], *[f"all_{v}" for v in values]
    )
    if not extra and scores.max_cells <= SENT_CELLS:
        offsets = F.broadcast(offsets)
    return local.join(offsets, keys).select(
        *keys,
        "score",
        *values,
        *[(F.col(f"before_{v}") + F.col(f"in_{v}")).alias(f"cum_{v}") for v in values],
        *[f"all_{v}" for v in values],
    )


def selected_sizes(n: int, fractions: Sequence[float], rounding: str) -> dict[float, int]:
    """k = ceil or floor of n * fraction, in double arithmetic."""
    if rounding not in ("ceil", "floor"):
        raise ValueError(f"rounding must be ceil or floor, not {rounding!r}")
    whole = math.ceil if rounding == "ceil" else math.floor
    return {float(f): int(whole(float(n) * float(f))) for f in fractions}


def _boundary_rows(scores: Scores, cells: DataFrame, sizes: Mapping[float, int]) -> DataFrame:
    """Rows of the cells in which a k-th row lies, numbered from the best, with the cell's totals.

    At most models x fractions cells qualify, which bounds the broadcast; each becomes one window
    group of bounded size. ``need`` is how many of its rows are selected.
    """
    wanted = [(f, k) for f, k in sizes.items() if k > 0]
    targets = F.array(
        *[F.struct(F.lit(f).alias("fraction"), F.lit(k).cast("bigint").alias("k")) for f, k in wanted]
    )
    boundary = (
        cells.select("*", F.inline(targets))
        .where((F.col("before_n") < F.col("k")) & (F.col("k") <= F.col("before_n") + F.col("n")))
        .withColumn("need", F.col("k") - F.col("before_n"))
        .drop("n")
    )
    at = Window.partitionBy("m", "fraction").orderBy(F.col("score").desc(), F.col(scores.key))
    return scores.rows.join(F.broadcast(boundary), ["m", "bin", "sub"]).withColumn(
        "rn", F.row_number().over(at)
    )


def top_fraction_sums(
    scores: Scores,
    fractions: Sequence[float],
    values: Mapping[str, Column],
    rounding: str = "ceil",
) -> DataFrame:
    """Sums over the best k = round(n * fraction) rows of each model, for all fractions at once.

    Returns (m, model, fraction, <value>, all_<value>); the row count ``n`` is added to the sums.
    Rows better than the boundary cell are only counted, never ranked or moved: two scans and
    small shuffles, however large k is.
    """
    sums = {"n": F.count(F.lit(1)), **values}
    sizes = selected_sizes(scores.n, fractions, rounding)
    cells = cell_totals(scores, {f"cell_{v}": c for v, c in sums.items()}, by_sub=True)
    cells = cells.withColumnsRenamed({"cell_n": "n", "before_cell_n": "before_n"})
    carried = [f"before_cell_{v}" for v in values] + [f"all_cell_{v}" for v in sums]
    parts = []
    if any(sizes.values()):
        inside = (
            _boundary_rows(scores, cells.drop(*[f"cell_{v}" for v in values]), sizes)
            .where(F.col("rn") <= F.col("need"))
            .groupBy("m", "fraction")
            .agg(
                *[c.alias(f"in_{v}") for v, c in sums.items()],
                *[F.first(c).alias(c) for c in ("before_n", *carried)],
            )
        )
        chosen = {"n": F.col("before_n") + F.col("in_n")}
        chosen |= {v: F.col(f"before_cell_{v}") + F.col(f"in_{v}") for v in values}
        parts.append(
            inside.select(
                "m",
                "fraction",
                *[c.alias(v) for v, c in chosen.items()],
                *[F.col(f"all_cell_{v}").alias(f"all_{v}") for v in sums],
            )
        )
    empty = [f for f, k in sizes.items() if k == 0]
    if empty:
        # floor(n * fraction) = 0 selects nothing, but the row still reports the whole table.
        whole = scores.rows.groupBy("m").agg(*[c.alias(f"all_{v}") for v, c in sums.items()])
        parts.append(
            whole.select(
                "m",
                F.explode(F.array(*[F.lit(f) for f in empty])).alias("fraction"),
                *[F.lit(0).cast("bigint").alias(v) for v in sums],
                *[f"all_{v}" for v in sums],
            )
        )
    together = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return together.select("*", model_name(scores).alias("model"))


def cutoffs(scores: Scores, fractions: Sequence[float], rounding: str = "ceil") -> DataFrame:
    """(m, fraction, k, cut_score, cut_key): the last selected row of each (model, fraction)."""
    sizes = selected_sizes(scores.n, fractions, rounding)
    cells = cell_totals(scores, {"n": F.count(F.lit(1))}, by_sub=True)
    return (
        _boundary_rows(scores, cells, sizes)
        .where(F.col("rn") == F.col("need"))
        .select(
            "m",
            "fraction",
            "k",
            F.col("score").alias("cut_score"),
            F.col(scores.key).alias("cut_key"),
        )
    )


def flag_top(scores: Scores, fraction: float, rounding: str = "ceil") -> DataFrame:
    """All rows with ``in_top``. The cut-off table has one row per model, which bounds the broadcast."""
    if not selected_sizes(scores.n, [fraction], rounding)[float(fraction)]:
        return named_rows(scores).withColumn("in_top", F.lit(False))
    cut = cutoffs(scores, [fraction], rounding).select("m", "cut_score", "cut_key")
    above = F.col("score") > F.col("cut_score")
    tied = (F.col("score") == F.col("cut_score")) & (F.col(scores.key) <= F.col("cut_key"))
    return (
        scores.rows.join(F.broadcast(cut), "m", "left")
        .withColumn("in_top", F.coalesce(above | tied, F.lit(False)))
        .withColumn("model", model_name(scores))
        .drop("m", "bin", "sub", "cut_score", "cut_key")
    )


def global_rank(scores: Scores) -> DataFrame:
    """All rows with their exact 1-based rank by (score descending, key ascending)."""
    before = cell_totals(scores, {"n": F.count(F.lit(1))}, by_sub=True).select(
        "m", "bin", "sub", "before_n"
    )
    inside = Window.partitionBy("m", "bin", "sub").orderBy(
        F.col("score").desc(), F.col(scores.key)
    )
    return (
        scores.rows.withColumn("rn", F.row_number().over(inside))
        .join(before, ["m", "bin", "sub"])
        .withColumn("rank", (F.col("before_n") + F.col("rn")).cast("bigint"))
        .withColumn("model", model_name(scores))
        .drop("m", "bin", "sub", "rn", "before_n")
    )


def model_name(scores: Scores, index: str = "m") -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in scores.models]), F.col(index) + 1)


def named_rows(scores: Scores) -> DataFrame:
    """The long rows with the model's name instead of its position and cell."""
    return scores.rows.withColumn("model", model_name(scores)).drop("m", "bin", "sub")
