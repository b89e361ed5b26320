"""Upper tail of the chi-square distribution as a Spark expression, for any whole dof."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_upper_tail(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic).

    With h = statistic/2 the term ratio of the series is h/(n + offset). Even dof is a finite
    sum of Poisson probabilities; odd dof is one minus the matching half-integer series, cut where
    its terms have decayed below double precision. Terms are carried as logarithms, so a huge
    statistic underflows to p = 0 instead of failing.
    """
    h = statistic.cast("double") / 2.0
    log_h = F.ln(F.greatest(h, F.lit(1e-300)))
    half = F.floor(dof / 2).cast("int")

    def fold(count: Column, first: Column, offset: float) -> Column:
        start = F.struct(F.lit(0.0).alias("total"), first.alias("log_term"), F.lit(0.0).alias("n"))
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            start,
            lambda acc, _i: F.struct(
                (acc["total"] + F.exp(acc["log_term"])).alias("total"),
                (acc["log_term"] + log_h - F.ln(acc["n"] + 1.0 + offset)).alias("log_term"),
                (acc["n"] + 1.0).alias("n"),
            ),
            lambda acc: acc["total"],
        )

    even = fold(half, -h, 0.0)
    # Beyond ``limit`` the odd tail is zero in double precision, whatever the series length.
    limit = 700.0 + 40.0 * dof
    reach = F.least(h, limit)
    # erf(sqrt(h)) minus the first ``half`` terms leaves the lower tail, summed from n = 0.
    whole = fold(
        F.ceil(reach + 12.0 * F.sqrt(reach) + 60.0).cast("int"),
        -h + 0.5 * log_h - math.lgamma(1.5),
        0.5,
    )
    skipped = fold(half, -h + 0.5 * log_h - math.lgamma(1.5), 0.5)
    lower = whole - F.when(half > 0, skipped).otherwise(0.0)
    odd = F.when(h > limit, 0.0).otherwise(1.0 - lower)
    tail = F.when(dof % 2 == 0, even).otherwise(odd)
    return (
        F.when(dof <= 0, F.lit(1.0))
        .when(statistic <= 0, F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))
    )
