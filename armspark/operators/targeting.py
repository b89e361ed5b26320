"""Budget-constrained targeting: every strategy and a random pick at every budget."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.hashing import STREAM_RANDOM_PICK, unit_hash
from .curves import arm_values
from .ordering import Scores, flag_top, long_scores, top_fraction_sums

# Fixed value: name of the strategy that picks at random.
RANDOM = "Random Selection"


def with_random_score(df: DataFrame, key: str, seed: int, out: str = "random_score") -> DataFrame:
    """A score whose descending order is a seeded random order (32 bits, exact as double)."""
    return df.withColumn(out, -unit_hash(key, seed, STREAM_RANDOM_PICK).cast("double"))


def random_selection(
    df: DataFrame, key: str, fraction: float, seed: int = 42, keyed: bool = False
) -> DataFrame:
    """Exactly ceil(n * fraction) rows without replacement; the same rows for the same seed."""
    scored = with_random_score(df.select(key), key, seed)
    scores = long_scores(scored, {RANDOM: "random_score"}, key, [], keyed=keyed)
    return flag_top(scores, fraction).where("in_top").select(key)


def strategy_scores(
    df: DataFrame,
    strategies: Mapping[str, str],
    key: str,
    keep: Sequence[str],
    seed: int = 42,
    **bins,
) -> Scores:
    """Long scores of all strategies with the random one added as the last."""
    scored = with_random_score(df, key, seed)
    return long_scores(scored, {**strategies, RANDOM: "random_score"}, key, keep, **bins)


def budget_targeting(
    scores: Scores,
    treatment: str,
    outcome: str,
    budgets: Sequence[float] = (0.10, 0.20),
) -> DataFrame:
    """(strategy, budget, budget_label, units_contacted, incremental_rate, incremental_total).

    Strategies, the random pick and all budgets share one job. The numeric budget is the key; the
    label rounds. Rate and total are NULL where the selection lacks an arm.
    """
    values = {k: v for k, v in arm_values(treatment, outcome).items() if k != "n"}
    sums = top_fraction_sums(scores, budgets, values)
    c = F.col
    rate = ratio(c("yt"), c("nt")) - ratio(c("y") - c("yt"), c("n") - c("nt"))
    label = F.concat(F.round(c("fraction") * 100.0).cast("int").cast("string"), F.lit("%"))
    return sums.select(
        c("model").alias("strategy"),
        c("fraction").alias("budget"),
        label.alias("budget_label"),
        c("n").alias("units_contacted"),
        rate.alias("incremental_rate"),
        (rate * c("n")).alias("incremental_total"),
    )


def beat_random(table: DataFrame) -> DataFrame:
    """(budget, strategy, incremental_total, random_total, beats_random): strict comparison.

    A budget without a random row fails the job. ``table`` has strategies x budgets rows; its
    random half, one row per budget, is broadcast.
    """
    at_random = table.where(F.col("strategy") == RANDOM).select(
        "budget", F.col("incremental_total").alias("random_total"), F.lit(True).alias("found")
    )
    joined = table.where(F.col("strategy") != RANDOM).join(F.broadcast(at_random), "budget", "left")
    complete = F.when(F.col("found"), F.col("random_total")).otherwise(
        F.raise_error(F.lit("a budget has no random selection to compare with")).cast("double")
    )
    return joined.select(
        "budget", "strategy", "incremental_total", complete.alias("random_total")
    ).withColumn(
        "beats_random",
        F.coalesce(F.col("incremental_total") > F.col("random_total"), F.lit(False)),
    )


def all_beat_random(table: DataFrame) -> DataFrame:
    return beat_random(table).agg(F.bool_and("beats_random").alias("all_beat_random"))
