"""DuckDB SQL that computes each registered query independently, over the same parquet tables.

Written with plain global windows and sorts: slow at scale, but a check on the distributed plans.
"""

from __future__ import annotations

import math

from ..functions.hashing import (
    MASK,
    MULTIPLIER,
    STREAM_BOOTSTRAP,
    STREAM_DRAW,
    STREAM_FOLD,
    STREAM_RANDOM_PICK,
    STREAM_SPLIT,
    poisson_cuts,
    unit_prefix,
)
from ..operators.resample import SPARE_DEVIATIONS
from .registry import (
    BUDGETS,
    CELL,
    KS,
    MODELS,
    REPLICATES,
    SEED,
    THRESHOLD,
    WEIGHT_REPLICATES,
)
from ..sources.star import STAR_SPEC as SPEC
from ..spec import RAW_SCHEMA


def _mix(h: str) -> str:
    for _ in range(2):
        h = f"((xor({h}, {h} >> 16) * {MULTIPLIER}) & {MASK})"
    return f"xor({h}, {h} >> 16)"


def _unit_hash(name: str, source: str, stream: int, columns: str) -> str:
    """A CTE: ``columns`` of ``source`` plus the unit hash ``h``."""
    text = f"md5('{unit_prefix(SEED, stream)}:' || unit_id)"
    return f"""
{name} AS (SELECT {columns}, CAST('0x' || substr({text}, 1, 8) AS BIGINT) AS h FROM {source})"""


def _streams(name: str, source: str, columns: str) -> str:
    """A CTE: ``columns`` of ``source`` plus both halves of the unit's stream."""
    text = f"md5('{unit_prefix(SEED, STREAM_BOOTSTRAP)}:' || unit_id)"
    halves = ", ".join(f"CAST('0x' || substr({text}, {at}, 8) AS BIGINT) AS {h}" for at, h in ((1, "hi"), (9, "lo")))
    return f"""
{name} AS (SELECT {columns}, {halves} FROM {source})"""


def _drawn(name: str, source: str, columns: str, count: int) -> str:
    """CTEs ending in ``name``: ``columns``, ``rep`` and a number ``r`` below 2^32 for every unit and replicate."""
    return f"""
{name}_reps AS (SELECT rep, {_mix("rep")} AS word FROM (SELECT unnest(range({count})) AS rep)),
{name}_mixed AS (SELECT {columns}, rep, hi, xor(lo, word) AS r0 FROM {source}, {name}_reps),
{name}_half AS (SELECT * EXCLUDE (r0, hi), xor({_mix("r0")}, hi) AS r1 FROM {name}_mixed),
{name} AS (SELECT * EXCLUDE (r1), {_mix("r1")} AS r FROM {name}_half)"""


_UNITS = """
lines AS (
  SELECT l_orderkey,
         max(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS mens,
         max(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END) AS womens,
         max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.085::DOUBLE THEN 1 ELSE 0 END) AS visit,
         max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.095::DOUBLE AND l_linestatus = 'F'
                   AND l_quantity >= 40 THEN 1 ELSE 0 END) AS conversion,
         max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.095::DOUBLE AND l_linestatus = 'F'
                   AND l_quantity >= 40 THEN l_extendedprice END) AS spend
  FROM lineitem GROUP BY l_orderkey),
units AS (
  SELECT o_orderkey AS unit_id, o_orderstatus AS segment,
         CAST(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS INTEGER) AS recency,
         o_totalprice AS history, c_acctbal AS acctbal,
         CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS newbie,
         CASE WHEN o_totalprice < 10000 THEN '1) <10k' WHEN o_totalprice < 25000 THEN '2) 10-25k'
              WHEN o_totalprice < 50000 THEN '3) 25-50k' WHEN o_totalprice < 100000 THEN '4) 50-100k'
              WHEN o_totalprice < 150000 THEN '5) 100-150k' WHEN o_totalprice < 200000 THEN '6) 150-200k'
              ELSE '7) 200k +' END AS history_segment,
         r_name AS zip_code, c_mktsegment AS channel, mens, womens, visit, conversion, spend
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN lines ON l_orderkey = o_orderkey),
raw_exp AS (
  SELECT unit_id, segment, recency, history, acctbal, coalesce(mens, 0) AS mens,
         coalesce(womens, 0) AS womens, newbie, history_segment, zip_code, channel,
         coalesce(visit, 0) AS visit, coalesce(conversion, 0) AS conversion,
         coalesce(spend, 0.0::DOUBLE) AS spend
  FROM units),
exp AS (
  SELECT *, CAST(CASE WHEN segment IS NOT DISTINCT FROM 'P' THEN 0 ELSE 1 END AS INTEGER) AS treatment
  FROM raw_exp)"""

_SPLIT = f"""
{_unit_hash("hashed", "exp", STREAM_SPLIT, "*, treatment || '_' || conversion AS stratum").lstrip()},
sizes AS (SELECT stratum, count(*) AS size FROM hashed GROUP BY stratum),
quota AS (
  SELECT stratum, size, CAST(ceil(sum(size) OVER () * 0.2::DOUBLE) AS BIGINT) AS n_test,
         CAST(sum(size) OVER () AS BIGINT) AS n FROM sizes),
shares AS (
  SELECT *, n_test * size // n AS whole,
         row_number() OVER (ORDER BY (n_test * size) % n DESC, stratum) AS place FROM quota),
allocation AS (
  SELECT stratum, whole + CASE WHEN place <= n_test - sum(whole) OVER () THEN 1 ELSE 0 END AS take
  FROM shares),
split AS (
  SELECT hashed.* EXCLUDE (h, stratum),
         CASE WHEN row_number() OVER (PARTITION BY hashed.stratum ORDER BY h, unit_id) <= take
              THEN 'test' ELSE 'train' END AS split
  FROM hashed JOIN allocation ON hashed.stratum = allocation.stratum),
train AS (SELECT * FROM split WHERE split = 'train'),
test AS (SELECT * FROM split WHERE split = 'test')"""

_cell = ", ".join(CELL)
_sums = """count(*) AS n, sum(treatment) AS nt, sum(visit) AS y, sum(visit * treatment) AS yt,
         sum(CASE WHEN treatment = visit THEN 1 ELSE 0 END) AS z"""
_formulas = """y / CAST(n AS DOUBLE) AS base,
         yt / CAST(nullif(nt, 0) AS DOUBLE) - (y - yt) / CAST(nullif(n - nt, 0) AS DOUBLE) AS two,
         2 * (z / CAST(n AS DOUBLE)) - 1 AS cls"""


def _out_of_fold(c: str) -> str:
    return f"(CAST(all_{c} - {c} AS DOUBLE) / CAST(nullif(all_n - n, 0) AS DOUBLE))"


def _residual(name: str, cells: str) -> str:
    """CTEs ending in ``name``: cross-fitted residual effect per group of ``cells`` (may be empty)."""
    listed = f"{cells}, " if cells else ""
    window = f"PARTITION BY {cells}" if cells else ""
    both = [
        f"(max(CASE WHEN fold = 0 THEN {c} END) + max(CASE WHEN fold = 1 THEN {c} END))"
        for c in ("crossed", "square")
    ]
    return f"""
{name}_folds AS (
  SELECT {listed}h % 2 AS fold, count(*) AS n, sum(treatment) AS st, sum(visit) AS sy,
         sum(treatment * visit) AS sty FROM folded GROUP BY {listed}h % 2),
{name}_all AS (
  SELECT *, sum(n) OVER c AS all_n, sum(st) OVER c AS all_st, sum(sy) OVER c AS all_sy
  FROM {name}_folds WINDOW c AS ({window})),
{name}_means AS (SELECT *, {_out_of_fold("sy")} AS my, {_out_of_fold("st")} AS mt FROM {name}_all),
{name}_terms AS (
  SELECT *, sty - my * st - mt * sy + n * my * mt AS crossed,
         st - 2 * mt * st + n * mt * mt AS square FROM {name}_means),
{name} AS (
  SELECT {listed}CAST(sum(n) AS BIGINT) AS n, {both[0]} / nullif({both[1]}, 0) AS effect
  FROM {name}_terms {f"GROUP BY {cells}" if cells else ""})"""


_SCORED = f"""
cell_means AS (SELECT {_cell}, {_formulas} FROM (SELECT {_cell}, {_sums} FROM train GROUP BY {_cell})),
all_means AS (SELECT {_formulas} FROM (SELECT {_sums} FROM train)),
{_unit_hash("folded", "train", STREAM_FOLD, "*").lstrip()},
{_residual("residual", _cell).lstrip()},
{_residual("population_residual", "").lstrip()},
scored AS (
  SELECT unit_id, treatment, visit, conversion, coalesce(c.base, a.base) AS s_base,
         coalesce(c.two, a.two) AS s_two, coalesce(c.cls, a.cls) AS s_class,
         coalesce(residual.effect, p.effect) AS s_res,
         history / CAST(1 + recency AS DOUBLE) AS s_cont
  FROM test LEFT JOIN cell_means c USING ({_cell}) LEFT JOIN residual USING ({_cell}),
       all_means a, population_residual p)"""


def _long(name: str, source: str, models: dict[str, str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS m, '{model}' AS model, {column} AS score, unit_id, treatment, visit, conversion"
        f" FROM {source}"
        for i, (model, column) in enumerate(models.items())
    )
    return f"""
{name} AS ({parts})"""


def _ranked(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, unit_id) AS rn,
         count(*) OVER (PARTITION BY m) AS n_all FROM {source})"""


_LONG = _long("long", "scored", MODELS) + "," + _ranked("ranked", "long")

_RANDOM = (
    _unit_hash("picked", "scored", STREAM_RANDOM_PICK, "*")
    + ",\npick AS (SELECT *, -CAST(h AS DOUBLE) AS random_score FROM picked),"
    + _long("strategies", "pick", {**MODELS, "Random Selection": "random_score"})
    + ","
    + _ranked("contenders", "strategies")
)


def _values(numbers) -> str:
    return ", ".join(f"(CAST({v} AS DOUBLE))" for v in numbers)


_EFFECT = """sum(CASE WHEN treatment = 1 THEN visit END) / CAST(nullif(count(*) FILTER (treatment = 1), 0) AS DOUBLE)
         - sum(CASE WHEN treatment = 0 THEN visit END) / CAST(nullif(count(*) FILTER (treatment = 0), 0) AS DOUBLE)"""

_BUDGET = f"""
budgets(budget) AS (VALUES {_values(BUDGETS)}),
budget_rates AS (
  SELECT model AS strategy, budget, count(*) AS units_contacted, {_EFFECT} AS incremental_rate
  FROM contenders, budgets WHERE rn <= ceil(n_all * budget) GROUP BY model, budget),
budget_table AS (
  SELECT strategy, budget, CAST(CAST(round(budget * 100) AS INTEGER) AS VARCHAR) || '%' AS budget_label,
         units_contacted, incremental_rate, incremental_rate * units_contacted AS incremental_total
  FROM budget_rates)"""

_CHECK_EFFECT = f"""
flagged AS (SELECT *, rn <= ceil(n_all * 0.1::DOUBLE) AS in_top FROM ranked),
slices AS (
  SELECT m, model, in_top, {_EFFECT} AS effect, count(*) AS n, sum(visit) AS y
  FROM flagged GROUP BY m, model, in_top),
overall AS (SELECT model, {_EFFECT} AS effect FROM ranked GROUP BY model),
effect_check AS (
  SELECT model, t.effect AS top_effect, r.effect AS rest_effect, o.effect AS overall_effect,
         t.effect - r.effect AS gap, coalesce(t.effect - r.effect >= 0.01::DOUBLE, false) AS passed
  FROM slices t JOIN slices r USING (model) JOIN overall o USING (model)
  WHERE t.in_top AND NOT r.in_top)"""


def _height(n: str, nt: str, y: str, yt: str) -> str:
    return (
        f"(CAST({yt} AS DOUBLE) - CASE WHEN {n} <> {nt} THEN ({y} - {yt})"
        f" * (CAST({nt} AS DOUBLE) / CAST({n} - {nt} AS DOUBLE)) ELSE 0 END)"
    )


def _qini(area: str, n: str, nt: str, y: str, yt: str) -> str:
    end = _height(n, nt, y, yt)
    a, b, size = f"CAST({yt} AS DOUBLE)", f"CAST({y} - {yt} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    straight = f"({size} * {end} / 2)"
    perfect = f"({a} * {a} / 2 + ({size} - {b} - {a}) * {a} + {b} * ({a} + {end}) / 2)"
    return (
        f"CASE WHEN {nt} > 0 AND {nt} < {n} AND {y} > 0 AND {y} < {n}"
        f" THEN ({area} - {straight}) / nullif({perfect} - {straight}, 0) END"
    )


_CURVE = f"""
groups AS (
  SELECT m, model, score, count(*) AS n, sum(treatment) AS nt, sum(visit) AS y,
         sum(visit * treatment) AS yt, sum(conversion) AS c FROM long GROUP BY m, model, score),
cums AS (
  SELECT *, sum(n) OVER w AS cn, sum(nt) OVER w AS cnt, sum(y) OVER w AS cy, sum(yt) OVER w AS cyt,
         sum(c) OVER w AS cc, sum(n) OVER a AS an, sum(nt) OVER a AS ant, sum(y) OVER a AS ay,
         sum(yt) OVER a AS ayt, sum(c) OVER a AS ac
  FROM groups
  WINDOW w AS (PARTITION BY m ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY m)),
heights AS (
  SELECT *, {_height("cn", "cnt", "cy", "cyt")} AS y1,
         {_height("(cn - n)", "(cnt - nt)", "(cy - y)", "(cyt - yt)")} AS y0,
         {_height("an", "ant", "ay", "ayt")} AS y_end FROM cums),
areas AS (
  SELECT m, model, any_value(an) AS an, any_value(ant) AS ant, any_value(ay) AS ay,
         any_value(ayt) AS ayt, any_value(y_end) AS y_end, sum(n * (y0 + y1) / 2) AS area
  FROM heights GROUP BY m, model),
coefficients AS (
  SELECT m, model, CAST(an AS BIGINT) AS n, area AS curve_area, y_end AS curve_end,
         {_qini("area", "an", "ant", "ay", "ayt")} AS qini_coefficient FROM areas)"""


def _poisson_draws(count: int) -> str:
    cases = " ".join(f"WHEN r < {cut} THEN {i}" for i, cut in enumerate(poisson_cuts()))
    return (
        _streams("booted", "scored", "unit_id").lstrip()
        + ","
        + _drawn("numbers", "booted", "unit_id", count)
        + f""",
draws AS (SELECT unit_id, rep, CASE {cases} ELSE {len(poisson_cuts())} END AS w FROM numbers)"""
    )


def _multinomial_draws(count: int) -> str:
    """Poisson weights of a rate below 1, and the single draws that are missing to exactly as many as there are units."""
    below = [" + ".join(f"pow(rate, {k}) / {math.factorial(k)}" for k in range(i + 1)) for i in range(12)]
    cases = " ".join(f"WHEN r < floor(exp(-rate) * ({sums}) * {2**32}) THEN {i}" for i, sums in enumerate(below))
    text = f"md5('{unit_prefix(SEED, STREAM_DRAW)}:' || rep || ':' || draw)"
    return (
        f"""
population AS (SELECT count(*) AS size, greatest(0.0, 1.0 - {SPARE_DEVIATIONS} / sqrt(count(*))) AS rate FROM scored),"""
        + _streams("booted", "scored", "unit_id")
        + ","
        + _drawn("numbers", "booted", "unit_id", count)
        + f""",
below AS (SELECT unit_id, rep, CASE {cases} ELSE 12 END AS w FROM numbers, population),
missing AS (SELECT rep, any_value(size) - sum(w) AS lacks FROM below, population GROUP BY rep),
singles AS (SELECT rep, unnest(range(CAST(lacks AS BIGINT))) AS draw FROM missing),
positions AS (SELECT rep, CAST('0x' || substr({text}, 1, 15) AS BIGINT) % size AS position FROM singles, population),
places AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS position FROM scored),
draws AS (
  SELECT unit_id, rep, sum(w) AS w FROM (
    SELECT unit_id, rep, w FROM below UNION ALL SELECT unit_id, rep, 1 FROM positions JOIN places USING (position))
  GROUP BY unit_id, rep)"""
    )


def _bootstrap(draws: str) -> str:
    return f"""
{draws.lstrip()},
boot_groups AS (
  SELECT m, model, rep, score, sum(w) AS n, sum(w * treatment) AS nt, sum(w * visit) AS y,
         sum(w * visit * treatment) AS yt
  FROM long JOIN draws USING (unit_id) WHERE w > 0 GROUP BY m, model, rep, score),
boot_cums AS (
  SELECT *, sum(n) OVER w AS cn, sum(nt) OVER w AS cnt, sum(y) OVER w AS cy, sum(yt) OVER w AS cyt
  FROM boot_groups WINDOW w AS (PARTITION BY m, rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
boot_heights AS (
  SELECT *, {_height("cn", "cnt", "cy", "cyt")} AS y1,
         {_height("(cn - n)", "(cnt - nt)", "(cy - y)", "(cyt - yt)")} AS y0 FROM boot_cums),
boot_areas AS (
  SELECT m, model, rep, sum(n) AS an, sum(nt) AS ant, sum(y) AS ay, sum(yt) AS ayt,
         sum(n * (y0 + y1) / 2) AS area
  FROM boot_heights GROUP BY m, model, rep),
replicates AS (
  SELECT m, model, rep, CAST(an AS BIGINT) AS n,
         {_qini("area", "an", "ant", "ay", "ayt")} AS qini FROM boot_areas)"""


_INTERVALS = f"""
{_bootstrap(_poisson_draws(REPLICATES)).lstrip()},
bounds AS (
  SELECT model, quantile_cont(qini, 0.025) AS lo, quantile_cont(qini, 0.975) AS hi,
         count(qini) AS n_ok FROM replicates GROUP BY model),
intervals AS (
  SELECT m, model, qini_coefficient, lo AS ci_lower_95, hi AS ci_upper_95,
         n_ok AS n_successful_resamples FROM coefficients JOIN bounds USING (model))"""

_UPLIFT = f"""
ks(k) AS (VALUES {_values(KS)}),
uplift AS (
  SELECT model, k, count(*) AS n_selected, {_EFFECT} AS uplift_at_k
  FROM ranked, ks WHERE rn <= floor(n_all * k) GROUP BY model, k)"""

_PAIRS = """
pairs AS (
  SELECT a.model AS model_a, b.model AS model_b, round(a.qini_coefficient, 4) AS qini_a,
         round(b.qini_coefficient, 4) AS qini_b,
         a.ci_lower_95 <= b.ci_upper_95 AND b.ci_lower_95 <= a.ci_upper_95 AS cis_overlap
  FROM intervals a JOIN intervals b ON a.m < b.m)"""

_numeric_long = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{f}' AS feature, treatment, CAST({f} AS DOUBLE) AS v FROM exp"
    for i, f in enumerate(SPEC.numeric)
)
_categorical_long = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS value, treatment FROM exp" for f in SPEC.categorical
)

_BALANCE = f"""
numeric_long AS ({_numeric_long}),
moments AS (
  SELECT pos, feature, avg(v) FILTER (treatment = 0) AS m0, avg(v) FILTER (treatment = 1) AS m1,
         stddev_samp(v) FILTER (treatment = 0) AS s0, stddev_samp(v) FILTER (treatment = 1) AS s1
  FROM numeric_long GROUP BY pos, feature),
smds AS (
  SELECT *, CASE WHEN sqrt((s1 * s1 + s0 * s0) / 2) > 0
                 THEN (m1 - m0) / sqrt((s1 * s1 + s0 * s0) / 2) ELSE 0 END AS smd FROM moments),
categorical_long AS ({_categorical_long}),
contingency AS (
  SELECT feature, value, count(*) FILTER (treatment = 0) AS n_control,
         count(*) FILTER (treatment = 1) AS n_treated
  FROM categorical_long WHERE value IS NOT NULL GROUP BY feature, value),
observed AS (
  SELECT feature, value, n_control AS o, sum(n_control) OVER f AS arm_total,
         n_control + n_treated AS value_total, sum(n_control + n_treated) OVER f AS n,
         count(*) OVER f AS n_values FROM contingency WINDOW f AS (PARTITION BY feature)
  UNION ALL
  SELECT feature, value, n_treated, sum(n_treated) OVER f, n_control + n_treated,
         sum(n_control + n_treated) OVER f, count(*) OVER f
  FROM contingency WINDOW f AS (PARTITION BY feature)),
chi AS (
  SELECT feature, CAST(max(n_values) - 1 AS INTEGER) AS dof,
         sum(pow(o - value_total * CAST(arm_total AS DOUBLE) / n, 2)
             / (value_total * CAST(arm_total AS DOUBLE) / n)) AS chi2
  FROM observed GROUP BY feature),
chi_p AS (
  SELECT *, CASE dof WHEN 4 THEN exp(-chi2 / 2) * (1 + chi2 / 2)
                     WHEN 6 THEN exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2) END AS p
  FROM chi),
flags AS (
  SELECT pos AS place, feature, abs(smd) > 0.1 AS bad FROM smds
  UNION ALL
  SELECT list_position({list(SPEC.categorical)}, feature) + 100, feature, p < 0.05 FROM chi_p)"""

_RATES = """
metrics AS (
  SELECT split, count(*) FILTER (treatment = 0) AS n_control, count(*) FILTER (treatment = 1) AS n_treated,
         sum(visit) FILTER (treatment = 0) AS v0, sum(visit) FILTER (treatment = 1) AS v1,
         sum(conversion) FILTER (treatment = 0) AS c0, sum(conversion) FILTER (treatment = 1) AS c1
  FROM (SELECT split, treatment, visit, conversion FROM split
        UNION ALL SELECT 'all', treatment, visit, conversion FROM exp) GROUP BY split),
metric_rows AS (
  SELECT split, 'treatment_share' AS metric, n_control, n_treated,
         n_control / CAST(n_control + n_treated AS DOUBLE) AS control,
         n_treated / CAST(n_control + n_treated AS DOUBLE) AS treatment FROM metrics
  UNION ALL
  SELECT split, 'visit_rate', n_control, n_treated, v0 / CAST(n_control AS DOUBLE),
         v1 / CAST(n_treated AS DOUBLE) FROM metrics
  UNION ALL
  SELECT split, 'conversion_rate', n_control, n_treated, c0 / CAST(n_control AS DOUBLE),
         c1 / CAST(n_treated AS DOUBLE) FROM metrics),
compared AS (
  SELECT s.split, metric, s.n_control, s.n_treated, s.control, s.treatment,
         r.control AS ref_control, r.treatment AS ref_treatment
  FROM metric_rows s JOIN metric_rows r USING (metric) WHERE s.split <> 'all' AND r.split = 'all')"""

_BASE = _UNITS
_WITH_SPLIT = _BASE + "," + _SPLIT
_WITH_SCORES = _WITH_SPLIT + "," + _SCORED
_WITH_LONG = _WITH_SCORES + "," + _LONG
_WITH_CURVE = _WITH_LONG + "," + _CURVE
_WITH_INTERVALS = _WITH_CURVE + "," + _INTERVALS
_WITH_BUDGET = _WITH_SCORES + "," + _RANDOM + "," + _BUDGET


def _stump(name: str, label: str, where: str = "true", weighted: bool = True) -> str:
    """CTEs ending in ``name`` (f, v, p): the flag that splits best, its sides, their probabilities.

    The first boosted tree fits 2y - 1 with weights; the split with the most variance between its sides wins.
    """
    weight = "count(*) FILTER (y = 0) / CAST(count(*) FILTER (y = 1) AS DOUBLE)" if weighted else "1.0::DOUBLE"
    return f"""
{name}_rows AS (SELECT mens, womens, newbie, {label} AS y FROM train WHERE {where}),
{name}_weight AS (SELECT {weight} AS pw FROM {name}_rows {"" if weighted else "LIMIT 1"}),
{name}_long AS (
  SELECT unnest([1, 2, 3]) AS f, unnest([mens, womens, newbie]) AS v, y,
         CASE WHEN y = 1 THEN pw ELSE 1.0::DOUBLE END AS w FROM {name}_rows, {name}_weight),
{name}_sides AS (SELECT f, v, sum(w) AS w, sum(w * (2 * y - 1)) AS s FROM {name}_long GROUP BY f, v),
{name}_best AS (
  SELECT f FROM {name}_sides GROUP BY f HAVING count(*) = 2 ORDER BY sum(s * s / w) DESC, f LIMIT 1),
{name} AS (SELECT f, v, 1 / (1 + exp(-2 * s / w)) AS p FROM {name}_sides JOIN {name}_best USING (f))"""


def _sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def _dataset_report() -> str:
    names = (
        "unit_id segment recency history acctbal mens womens newbie history_segment zip_code"
        " channel visit conversion spend"
    ).split()
    rows = ["SELECT 'shape' AS section, 'rows' AS item, count(*) AS count, NULL::DOUBLE AS pct FROM raw_exp"]
    rows.append(f"SELECT 'shape', 'columns', {len(names)}::BIGINT, NULL")
    rows += [f"SELECT 'missing', '{n}', count(*) FILTER ({n} IS NULL), NULL FROM raw_exp" for n in names]
    for item, arm in (("control", 0), ("treatment", 1)):
        rows.append(
            f"SELECT 'arm', '{item}', count(*) FILTER (treatment = {arm}),"
            f" round(count(*) FILTER (treatment = {arm}) / CAST(count(*) AS DOUBLE) * 100, 2) FROM exp"
        )
    return _sql(_BASE, " UNION ALL ".join(rows))


def _missing_report() -> str:
    names = (
        "unit_id segment recency history acctbal newbie history_segment zip_code channel"
        " mens womens visit conversion spend"
    ).split()
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(*) FILTER ({n} IS NULL) AS missing_count,"
        f" round(count(*) FILTER ({n} IS NULL) / CAST(count(*) AS DOUBLE) * 100, 3) AS missing_pct FROM units"
        for n in names
    )
    return _sql(_BASE, f"SELECT * FROM ({rows}) WHERE missing_count > 0")


def _rate(y: str, arm: int) -> str:
    return (
        f"sum({y}) FILTER (treatment = {arm})"
        f" / CAST(nullif(count(*) FILTER (treatment = {arm}), 0) AS DOUBLE)"
    )


def _outcome_rates() -> str:
    return " UNION ALL ".join(
        f"SELECT '{y}' AS outcome, {_rate(y, 0)} AS control_rate, {_rate(y, 1)} AS treatment_rate FROM exp"
        for y in ("visit", "conversion")
    )


def _naive_effect() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{y}' AS outcome, {_rate(y, 0)} AS c, {_rate(y, 1)} AS t FROM exp"
        for y in ("visit", "conversion", "spend")
    )
    return f"""
SELECT outcome, round(c, 4) AS control_rate, round(t, 4) AS treatment_rate, round(t - c, 4) AS raw_effect,
       round((t - c) / nullif(c, 0) * 100, 2) AS relative_lift_pct FROM ({rows})"""


def _one_hot() -> str:
    def flag(column: str, value: str, name: str) -> str:
        return f"CAST(CASE WHEN {column} = '{value}' THEN 1 ELSE 0 END AS INTEGER) AS {name}"

    bands = {
        "1) <10k": "1_10k", "2) 10-25k": "2_10_25k", "3) 25-50k": "3_25_50k",
        "4) 50-100k": "4_50_100k", "5) 100-150k": "5_100_150k", "6) 150-200k": "6_150_200k",
        "7) 200k +": "7_200k_",
    }
    flags = [flag("history_segment", v, f"history_segment_{n}") for v, n in bands.items()]
    for region in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"):
        flags.append(flag("zip_code", region, "zip_code_" + region.replace(" ", "_")))
    for channel in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        flags.append(flag("channel", channel, f"channel_{channel}"))
    return f"SELECT unit_id, {', '.join(SPEC.numeric)}, {', '.join(flags)} FROM exp"


def oracle_queries() -> dict[str, str]:
    k = ", ".join(
        f"round(max(CASE WHEN k = CAST({v} AS DOUBLE) THEN uplift_at_k END), 4) AS uplift_at_{round(v * 100)}pct"
        for v in KS
    )
    tp = f"count(*) FILTER (score >= {THRESHOLD}::DOUBLE AND visit = 1)"
    fp = f"count(*) FILTER (score >= {THRESHOLD}::DOUBLE AND visit = 0)"
    fn = f"count(*) FILTER (score < {THRESHOLD}::DOUBLE AND visit = 1)"
    declared = list(MODELS)
    return {
        "experiment_view": _sql(_BASE, "SELECT * FROM raw_exp"),
        "assemble_roles": _sql(
            _BASE,
            f"SELECT unit_id, {', '.join(SPEC.features)}, {', '.join(SPEC.outcomes)}, treatment FROM exp",
        ),
        "arm_labels": _sql(_BASE, "SELECT unit_id, segment, treatment FROM exp"),
        "dataset_report": _dataset_report(),
        "missing_report": _missing_report(),
        "treatment_split": _sql(
            _BASE,
            """SELECT treatment, count(*) AS count,
       round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS pct FROM exp GROUP BY treatment""",
        ),
        "arm_breakdown": _sql(
            _BASE,
            """SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, segment) AS INTEGER) AS rank,
       segment AS arm, count(*) AS count FROM exp WHERE segment IS NOT NULL GROUP BY segment""",
        ),
        "outcome_rates": _sql(_BASE, _outcome_rates()),
        "naive_effect": _sql(_BASE, _naive_effect()),
        "actual_effect": _sql(
            _BASE,
            f"""SELECT zip_code, {_EFFECT} AS effect, count(*) FILTER (treatment = 1) AS n_treated,
       count(*) FILTER (treatment = 0) AS n_control FROM exp GROUP BY zip_code""",
        ),
        "histogram": _sql(
            _BASE + "," + _BALANCE,
            """, ranges AS (
  SELECT feature, treatment, count(*) AS n, min(v) - CASE WHEN min(v) = max(v) THEN 0.5::DOUBLE ELSE 0 END AS lo,
         max(v) + CASE WHEN min(v) = max(v) THEN 0.5::DOUBLE ELSE 0 END AS hi
  FROM numeric_long GROUP BY feature, treatment),
filled AS (
  SELECT feature, treatment, CAST(least(floor((v - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS count
  FROM numeric_long JOIN ranges USING (feature, treatment) GROUP BY ALL),
grid AS (SELECT ranges.*, CAST(bin AS INTEGER) AS bin FROM ranges, (SELECT unnest(range(30)) AS bin))
SELECT feature, treatment, bin, round(lo + bin * (hi - lo) / 30, 6) AS bin_start,
       coalesce(count, 0) AS count, round(coalesce(count, 0) / (n * (hi - lo) / 30), 6) AS density
FROM grid LEFT JOIN filled USING (feature, treatment, bin)""",
        ),
        "strat_counts": _sql(
            _BASE,
            "SELECT treatment || '_' || conversion AS stratum, count(*) AS count FROM exp GROUP BY 1",
        ),
        "revert_label": _sql(
            _BASE,
            """SELECT count(*) AS n_rows, count(*) FILTER (treatment = visit) AS n_agree,
       count(*) FILTER (treatment = visit) / CAST(count(*) AS DOUBLE) AS agree_rate FROM exp""",
        ),
        "class_weight": _sql(
            _BASE,
            """SELECT count(*) FILTER (visit = 0) AS n_negative, count(*) FILTER (visit = 1) AS n_positive,
       count(*) FILTER (visit = 0) / CAST(count(*) FILTER (visit = 1) AS DOUBLE) AS positive_weight FROM exp""",
        ),
        "numeric_balance": _sql(
            _BASE + "," + _BALANCE,
            """SELECT feature, round(m0, 4) AS control_mean, round(m1, 4) AS treatment_mean, round(smd, 4) AS smd,
       CASE WHEN abs(smd) > 0.1 THEN 'IMBALANCED' ELSE 'ok' END AS flag FROM smds""",
        ),
        "contingency": _sql(_BASE + "," + _BALANCE, "SELECT * FROM contingency"),
        "arm_shares": _sql(
            _BASE + "," + _BALANCE,
            """SELECT feature, value, n_control / CAST(sum(n_control) OVER f AS DOUBLE) AS control_share,
       n_treated / CAST(sum(n_treated) OVER f AS DOUBLE) AS treatment_share
FROM contingency WINDOW f AS (PARTITION BY feature)""",
        ),
        "categorical_balance": _sql(
            _BASE + "," + _BALANCE,
            """SELECT feature, round(chi2, 3) AS chi2, dof, round(p, 4) AS p_value,
       CASE WHEN p < 0.05 THEN 'IMBALANCED' ELSE 'ok' END AS flag FROM chi_p""",
        ),
        "randomization_check": _sql(
            _BASE + "," + _BALANCE,
            """SELECT count(*) FILTER (bad) = 0 AS passed, count(*) AS n_checked, count(*) FILTER (bad) AS n_flagged,
       coalesce(string_agg(feature, ',' ORDER BY place) FILTER (bad), '') AS flagged FROM flags""",
        ),
        "one_hot": _sql(_BASE, _one_hot()),
        "stratified_split": _sql(_WITH_SPLIT, "SELECT unit_id, split FROM split"),
        "split_summary": _sql(
            _WITH_SPLIT,
            """SELECT split, count(*) AS n_rows, count(*) FILTER (visit = 1) AS positives,
       count(*) FILTER (visit = 1) / CAST(count(*) AS DOUBLE) AS target_rate,
       count(*) FILTER (treatment = 1) / CAST(count(*) AS DOUBLE) AS treatment_rate FROM split GROUP BY split""",
        ),
        "split_balance": _sql(
            _WITH_SPLIT + "," + _RATES,
            """SELECT *, CASE WHEN abs(control - ref_control) > 0.01 OR abs(treatment - ref_treatment) > 0.01
                 THEN 'DEVIATES' ELSE 'ok' END AS flag FROM compared""",
        ),
        "split_deviation": _sql(
            _WITH_SPLIT + "," + _RATES,
            """SELECT bool_or(abs(control - ref_control) > 0.001 OR abs(treatment - ref_treatment) > 0.001)
       AS any_deviation FROM compared""",
        ),
        "arm_summary": _sql(
            _WITH_SPLIT,
            """SELECT treatment, count(*) AS n_rows, sum(visit) / CAST(count(*) AS DOUBLE) AS outcome_rate
FROM train GROUP BY treatment""",
        ),
        "cell_response": _sql(_WITH_SCORES, "SELECT unit_id, s_base AS score FROM scored"),
        "cell_two_model": _sql(_WITH_SCORES, "SELECT unit_id, s_two AS score FROM scored"),
        "cell_class_transform": _sql(_WITH_SCORES, "SELECT unit_id, s_class AS score FROM scored"),
        "residual_effect": _sql(_WITH_SCORES, f"SELECT {_cell}, n, effect FROM residual"),
        "score_summary": _sql(
            _WITH_LONG,
            """SELECT model, round(avg(score), 6) AS mean_score, min(score) AS min_score, max(score) AS max_score
FROM long GROUP BY model""",
        ),
        "combine_scores": _sql(
            _WITH_SCORES,
            """SELECT unit_id, treatment, visit, conversion, s_two, s_class, s_res, s_cont, s_base AS baseline_score
FROM scored""",
        ),
        "unmatched_scores": _sql(
            _WITH_SCORES, "SELECT unit_id FROM exp ANTI JOIN scored USING (unit_id)"
        ),
        "rank_units": _sql(
            _WITH_LONG,
            "SELECT model, unit_id, score, rn AS rank, treatment, visit, conversion FROM ranked",
        ),
        "ranking_head_tail": _sql(
            _WITH_LONG,
            """SELECT CASE WHEN rn <= 10 THEN 'head' ELSE 'tail' END AS part, rn AS rank, unit_id, score AS s_base,
       treatment, visit, conversion FROM ranked WHERE m = 0 AND (rn <= 10 OR rn > n_all - 5)""",
        ),
        "top_k_split": _sql(
            _WITH_LONG,
            "SELECT model, unit_id, rn <= ceil(n_all * 0.1::DOUBLE) AS in_top FROM ranked",
        ),
        "signal_check": _sql(
            _WITH_LONG + "," + _CHECK_EFFECT,
            """, rates AS (
  SELECT t.model, (t.y + r.y) / CAST(t.n + r.n AS DOUBLE) AS overall_rate, t.y / CAST(t.n AS DOUBLE) AS top_rate,
         r.y / CAST(r.n AS DOUBLE) AS rest_rate
  FROM slices t JOIN slices r USING (m) WHERE t.in_top AND NOT r.in_top)
SELECT *, top_rate - rest_rate AS gap, CASE WHEN overall_rate > 0 THEN top_rate / overall_rate END AS lift_ratio,
       top_rate - rest_rate >= 0.02::DOUBLE AS passed FROM rates""",
        ),
        "signal_check_effect": _sql(_WITH_LONG + "," + _CHECK_EFFECT, "SELECT * FROM effect_check"),
        "uplift_at_k": _sql(_WITH_LONG + "," + _UPLIFT, "SELECT * FROM uplift"),
        "result_round_trip": _sql(_WITH_LONG + "," + _UPLIFT, "SELECT * FROM uplift"),
        "best_model": _sql(
            _WITH_LONG + "," + _CHECK_EFFECT,
            f"""SELECT row_number() OVER w AS rank, model, gap AS value, row_number() OVER w = 1 AS is_best
FROM effect_check WINDOW w AS (ORDER BY gap DESC, list_position({declared}, model))""",
        ),
        "random_selection": _sql(
            _WITH_SCORES + "," + _RANDOM,
            """SELECT unit_id FROM contenders
WHERE model = 'Random Selection' AND rn <= ceil(n_all * 0.1::DOUBLE)""",
        ),
        "budget_targeting": _sql(_WITH_BUDGET, "SELECT * FROM budget_table"),
        "beat_random": _sql(
            _WITH_BUDGET,
            """SELECT s.budget, s.strategy, s.incremental_total, r.incremental_total AS random_total,
       s.incremental_total > r.incremental_total AS beats_random
FROM budget_table s JOIN budget_table r ON s.budget = r.budget AND r.strategy = 'Random Selection'
WHERE s.strategy <> 'Random Selection'""",
        ),
        "all_beat_random": _sql(
            _WITH_BUDGET,
            """SELECT bool_and(s.incremental_total > r.incremental_total) AS all_beat_random
FROM budget_table s JOIN budget_table r ON s.budget = r.budget AND r.strategy = 'Random Selection'
WHERE s.strategy <> 'Random Selection'""",
        ),
        "qini_curve": _sql(
            _WITH_CURVE,
            """SELECT model, CAST(cn AS BIGINT) AS x, round(CAST(cn AS DOUBLE) / an, 6) AS share, round(y1, 6) AS y,
       round(y_end * (CAST(cn AS DOUBLE) / an), 6) AS random_y FROM heights
UNION ALL SELECT DISTINCT model, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM heights""",
        ),
        "qini_coefficient": _sql(
            _WITH_CURVE,
            """SELECT model, n, round(curve_area, 5) AS curve_area, round(curve_end, 5) AS curve_end,
       round(qini_coefficient, 5) AS qini_coefficient FROM coefficients""",
        ),
        "compute_qini_metrics": _sql(
            _WITH_CURVE,
            """SELECT model, n, round(curve_area, 5) AS curve_area, round(curve_end, 5) AS curve_end,
       round(qini_coefficient, 5) AS qini_coefficient, n_points, round(peak, 5) AS peak
FROM coefficients JOIN (SELECT model, count(*) + 1 AS n_points, greatest(max(y1), 0) AS peak
                        FROM heights GROUP BY model) USING (model)""",
        ),
        "csv_round_trip": _sql(_BASE, f"SELECT unit_id, {', '.join(RAW_SCHEMA.fieldNames())} FROM raw_exp"),
        "csv_dialect": _sql(
            _BASE,
            f"""SELECT unit_id, {', '.join(RAW_SCHEMA.fieldNames())} FROM (
  SELECT * REPLACE (CASE WHEN unit_id % 7 = 0 THEN 'the "' || zip_code || '", or so'
                         WHEN unit_id % 11 = 0 THEN zip_code || chr(10) || 'second line' ELSE zip_code END AS zip_code)
  FROM raw_exp WHERE unit_id % 13 <> 0)""",
        ),
        "csv_ledger": _sql(
            _BASE,
            "SELECT 'surplus fields' AS fault, CAST(count(*) AS BIGINT) AS records FROM raw_exp WHERE unit_id % 13 = 0",
        ),
        "parquet_round_trip": _sql(_BASE, f"SELECT unit_id, {', '.join(RAW_SCHEMA.fieldNames())} FROM raw_exp"),
        "split_round_trip": _sql(_WITH_SPLIT, "SELECT unit_id, treatment, visit, split FROM test"),
        "scores_round_trip": _sql(
            _WITH_SCORES,
            "SELECT unit_id, treatment, visit, conversion, "
            + ", ".join(f"round({c}, 6) AS {c}" for c in MODELS.values())
            + " FROM scored",
        ),
        "threshold_labels": _sql(
            _WITH_LONG, f"SELECT unit_id, model, CAST(score >= {THRESHOLD}::DOUBLE AS INTEGER) AS label FROM long"
        ),
        "stump_response": _sql(
            _WITH_SPLIT + "," + _stump("stump", "visit"),
            "SELECT unit_id, round(p, 6) AS score FROM test JOIN stump ON v = [mens, womens, newbie][f]",
        ),
        "stump_two_model": _sql(
            _WITH_SPLIT + "," + _stump("one", "visit", "treatment = 1") + "," + _stump("nil", "visit", "treatment = 0"),
            """SELECT unit_id, round(one.p - nil.p, 6) AS score FROM test
JOIN one ON one.v = [mens, womens, newbie][one.f] JOIN nil ON nil.v = [mens, womens, newbie][nil.f]""",
        ),
        "stump_class_transform": _sql(
            _WITH_SPLIT + "," + _stump("stump", "CAST(treatment = visit AS INTEGER)", weighted=False),
            "SELECT unit_id, round(2 * p - 1, 6) AS score FROM test JOIN stump ON v = [mens, womens, newbie][f]",
        ),
        "fold_assignment": _sql(
            _WITH_SPLIT + "," + _unit_hash("folded", "train", STREAM_FOLD, "*").lstrip(),
            "SELECT unit_id, CAST(h % 2 AS INTEGER) AS fold FROM folded",
        ),
        "roc_auc": _sql(
            _WITH_CURVE,
            """SELECT model, 'visit' AS label,
       round(sum((n - y) * (cy - y + y / 2)) / (CAST(any_value(ay) AS DOUBLE) * any_value(an - ay)), 6) AS auc
FROM cums GROUP BY model
UNION ALL
SELECT model, 'conversion',
       round(sum((n - c) * (cc - c + c / 2)) / (CAST(any_value(ac) AS DOUBLE) * any_value(an - ac)), 6)
FROM cums GROUP BY model""",
        ),
        "precision_recall": _sql(
            _WITH_LONG,
            f"""SELECT model, {tp} AS tp, {fp} AS fp, {fn} AS fn,
       coalesce({tp} / CAST(nullif({tp} + {fp}, 0) AS DOUBLE), 0) AS precision,
       coalesce({tp} / CAST(nullif({tp} + {fn}, 0) AS DOUBLE), 0) AS recall FROM long GROUP BY model""",
        ),
        "average_precision": _sql(
            _WITH_CURVE,
            """SELECT model, round(sum(CAST(y AS DOUBLE) / ay * (CAST(cy AS DOUBLE) / cn)), 6) AS average_precision
FROM cums GROUP BY model""",
        ),
        "pr_curve": _sql(
            _WITH_CURVE,
            """SELECT model, score AS threshold, CAST(cy AS DOUBLE) / cn AS precision,
       CAST(cy AS DOUBLE) / ay AS recall, CAST(ay AS DOUBLE) / an AS no_skill FROM cums
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1::DOUBLE, 0::DOUBLE, CAST(ay AS DOUBLE) / an FROM cums""",
        ),
        "classifier_report": _sql(
            _WITH_CURVE,
            f""", thresholded AS (
  SELECT model, coalesce({tp} / CAST(nullif({tp} + {fp}, 0) AS DOUBLE), 0) AS precision,
         coalesce({tp} / CAST(nullif({tp} + {fn}, 0) AS DOUBLE), 0) AS recall FROM long GROUP BY model),
ordered AS (
  SELECT model,
         round(sum((n - y) * (cy - y + y / 2)) / (CAST(any_value(ay) AS DOUBLE) * any_value(an - ay)), 6) AS auc_roc,
         round(sum(CAST(y AS DOUBLE) / ay * (CAST(cy AS DOUBLE) / cn)), 6) AS average_precision
  FROM cums GROUP BY model)
SELECT * FROM thresholded JOIN ordered USING (model)""",
        ),
        "bootstrap_weights": _sql(
            _WITH_SCORES
            + ","
            + _poisson_draws(WEIGHT_REPLICATES),
            "SELECT unit_id, CAST(rep AS INTEGER) AS rep, CAST(w AS INTEGER) AS weight FROM draws WHERE w > 0",
        ),
        "bootstrap_replicates": _sql(
            _WITH_LONG + "," + _bootstrap(_poisson_draws(REPLICATES)),
            "SELECT model, CAST(rep AS INTEGER) AS rep, n, round(qini, 6) AS qini FROM replicates",
        ),
        "bootstrap_multinomial": _sql(
            _WITH_LONG + "," + _bootstrap(_multinomial_draws(REPLICATES)),
            "SELECT model, CAST(rep AS INTEGER) AS rep, n, round(qini, 6) AS qini FROM replicates",
        ),
        "bootstrap_qini_ci": _sql(
            _WITH_INTERVALS,
            """SELECT model, round(qini_coefficient, 6) AS qini_coefficient, round(ci_lower_95, 6) AS ci_lower_95,
       round(ci_upper_95, 6) AS ci_upper_95, n_successful_resamples,
       ci_lower_95 <= 0 AND ci_upper_95 >= 0 AS contains_zero FROM intervals""",
        ),
        "results_join": _sql(
            _WITH_INTERVALS + "," + _UPLIFT,
            f"""SELECT model, any_value(round(qini_coefficient, 4)) AS qini_coefficient,
       any_value(round(ci_lower_95, 4)) AS ci_lower_95, any_value(round(ci_upper_95, 4)) AS ci_upper_95, {k}
FROM intervals JOIN uplift USING (model) GROUP BY model""",
        ),
        "pairwise_overlap": _sql(
            _WITH_INTERVALS + "," + _PAIRS,
            """SELECT *, CASE WHEN cis_overlap THEN 'NOT distinguishable (CIs overlap)'
                 ELSE 'Distinguishable (CIs do not overlap)' END AS verdict FROM pairs""",
        ),
        "verdict_facts": _sql(
            _WITH_INTERVALS + "," + _PAIRS,
            """, best AS (SELECT * FROM intervals ORDER BY qini_coefficient DESC, m LIMIT 1)
SELECT best.model AS best_model, round(best.qini_coefficient, 6) AS best_qini,
       round(best.ci_lower_95, 6) AS best_lower, round(best.ci_upper_95, 6) AS best_upper,
       (SELECT coalesce(string_agg(other, ',' ORDER BY other), '') FROM (
          SELECT CASE WHEN model_a = best.model THEN model_b ELSE model_a END AS other
          FROM pairs, best WHERE cis_overlap AND best.model IN (model_a, model_b))) AS overlapping,
       (SELECT count(*) FILTER (NOT cis_overlap) FROM pairs) AS n_distinguishable,
       (SELECT count(*) FROM pairs) AS n_pairs,
       (SELECT 1 + count(*) FROM intervals WHERE qini_coefficient >
          (SELECT qini_coefficient FROM intervals WHERE model = 'Residual Effect')) AS reference_rank,
       (SELECT count(*) FROM intervals) AS n_models
FROM best""",
        ),
    }
