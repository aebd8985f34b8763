"""DuckDB texts that say what each query must give, on the driver's tables."""

from __future__ import annotations

from ..config import ORDERS as C
from ..operators.chainladder import widths
from .adapter import FLOOR_YEAR

_CHANNELS = ", ".join(f"'{c}'" for c in C.channels)
_ERA = "CASE " + " ".join(f"WHEN cohort_year BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in C.eras) + " END"

REC = f"""
raw AS (
  SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) AS incident, CAST(l_shipdate AS DATE) AS receipt,
         CASE WHEN l_quantity >= 50 THEN 3 WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS severity,
         o_orderpriority AS channel, p_brand AS make, p_type AS family
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""


def flagged(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, coalesce(delay_days < 0, false) AS neg_delay, coalesce(cohort_p < {FLOOR_YEAR * 12}, false) AS pre_floor, coalesce(delay_m > {C.max_delay}, false) AS beyond_cap,
         coalesce(delay_days >= 0, false) AS valid_delay, coalesce(delay_days >= 0 AND cohort_p <= {C.mature_until}, false) AS mature,
         coalesce(delay_days >= 0 AND delay_m <= {C.max_delay} AND report_p <= {C.cutoff} AND cohort_p >= {C.t0}, false) AS in_triangle
  FROM (SELECT *, report_p - cohort_p AS delay_m FROM (
    SELECT *, year(receipt) * 12 + month(receipt) - 1 AS report_p, year(incident) * 12 + month(incident) - 1 AS cohort_p, date_diff('day', incident, receipt) AS delay_days,
           receipt IS NOT NULL AND incident IS NOT NULL AS has_both_dates, coalesce(channel IN ({_CHANNELS}), false) AS consumer FROM {source}))
)"""


FLG = REC + "," + flagged("raw", "flg")


def mature(consumer: bool = True, day: bool = False, name: str = "mat") -> str:
    cap = f"delay_days <= {C.day_cap}" if day else f"delay_m <= {C.max_delay}"
    return f""",
{name} AS (SELECT *, {_ERA} AS era FROM (SELECT *, cohort_p // 12 AS cohort_year FROM flg
  WHERE valid_delay AND cohort_p BETWEEN {C.t0} AND {C.mature_until} AND {cap} {'AND consumer' if consumer else ''}))"""


STR = """,
str AS (SELECT *, unnest(CASE WHEN severity >= 1 THEN ['all', 'Y' || severity, 'severe'] ELSE ['all', 'Y' || severity] END) AS stream FROM flg WHERE consumer)"""


def cells(source: str = "str", by: str = "stream", d_max: int = C.max_delay, p: str = "") -> str:
    """tri, cum: counts and running counts on the full grid."""
    return f""",
{p}tri AS (SELECT {by}, cohort_p AS t, delay_m AS d, count(*) AS n FROM {source}
  WHERE valid_delay AND cohort_p BETWEEN {C.t0} AND {C.cutoff} AND delay_m BETWEEN 0 AND {d_max} AND report_p <= {C.cutoff} GROUP BY ALL),
{p}grid AS (SELECT {by}, t, d, coalesce(n, 0) AS n FROM (SELECT DISTINCT {by} FROM {p}tri) CROSS JOIN range({C.t0}, {C.cutoff + 1}) a(t) CROSS JOIN range(0, {d_max + 1}) b(d) LEFT JOIN {p}tri USING ({by}, t, d)),
{p}cum AS (SELECT {by}, t, d, n, sum(n) OVER (PARTITION BY {by}, t ORDER BY d) AS c FROM {p}grid)"""


def curve(window: int = C.window, by: str = "stream", d_max: int = C.max_delay, p: str = "", cum: str = "cum") -> str:
    """fac, cur: factors and maturity at every cutoff."""
    lam = "coalesce(" + ", ".join(f"sum(c1) OVER w{i} / nullif(sum(c0) OVER w{i}, 0)" for i, _ in enumerate(widths(window, C.cutoff - C.t0))) + ", 1)"
    used = "CASE " + " ".join(f"WHEN sum(c0) OVER w{i} > 0 THEN {w}" for i, w in enumerate(widths(window, C.cutoff - C.t0))) + " END"
    over = ", ".join(f"w{i} AS (PARTITION BY {by}, d ORDER BY t RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)" for i, w in enumerate(widths(window, C.cutoff - C.t0)))
    return f""",
{p}pairs AS (SELECT {by}, t, d, a.c AS c0, b.c AS c1 FROM {cum} a JOIN (SELECT {by}, t, d - 1 AS d, c FROM {cum}) b USING ({by}, t, d) WHERE t + d + 1 <= {C.cutoff}),
{p}fac AS (SELECT {by}, t + d + 1 AS cutoff, d, greatest({lam}, 1) AS lam, {used} AS used FROM {p}pairs WINDOW {over}),
{p}cur AS (SELECT {by}, cutoff, d, CASE WHEN d < {d_max} THEN coalesce(lam, 1) END AS lam, exp(-sum(ln(coalesce(lam, 1))) OVER (PARTITION BY {by}, cutoff ORDER BY d DESC)) AS F
  FROM (SELECT DISTINCT {by}, cutoff FROM {p}fac) CROSS JOIN range(0, {d_max + 1}) g(d) LEFT JOIN {p}fac USING ({by}, cutoff, d))"""


ONE = f""",
fin AS (SELECT stream, t, d, c, max(c) OVER (PARTITION BY stream, t) AS z FROM cum WHERE t + {C.max_delay} <= {C.cutoff}),
rat AS (SELECT stream, t + {C.max_delay} AS cutoff, d, coalesce(sum(c) OVER w / nullif(sum(z) OVER w, 0), 1) AS r FROM fin
  WINDOW w AS (PARTITION BY stream, d ORDER BY t RANGE BETWEEN {C.window} PRECEDING AND CURRENT ROW)),
one AS (SELECT stream, cutoff, d, CASE WHEN d = {C.max_delay} THEN 1 ELSE least(max(r) OVER (PARTITION BY stream, cutoff ORDER BY d), 1) END AS F1 FROM rat)"""

BASE = FLG + STR + cells()
FIT = BASE + curve()
REPLAY = FIT + curve(C.short_window, p="s") + ONE + f""",
pts AS (
  SELECT stream, l.cutoff, u.t, u.d AS h, u.c AS c_obs, u.c / l.F AS n_hat, u.c / greatest(coalesce(o.F1, 1), 1e-12) AS n_one_step, l.F AS f_hat, coalesce(o.F1, 1) AS f_one_step,
         ln(greatest(l.F, 1e-12)) - ln(greatest(s.F, 1e-12)) AS stale, r.c AS realized, l.cutoff <= {C.last_training_origin} AS train, u.c = 0 AS degenerate
  FROM cur l JOIN scur s USING (stream, cutoff, d) LEFT JOIN one o USING (stream, cutoff, d) JOIN cum u USING (stream, d) JOIN cum r USING (stream, t)
  WHERE l.cutoff BETWEEN {C.first_origin} AND {C.last_origin} AND u.d = least(l.cutoff - u.t, {C.max_delay}) AND u.t BETWEEN l.cutoff - {C.max_lag} AND l.cutoff AND r.d = {C.max_delay}
),
met AS (
  SELECT stream, h, method, CASE WHEN train THEN 'training' ELSE 'evaluation' END AS origin_set, count(*) AS n, avg(rel) AS rel_bias, median(rel) AS median_rel_bias, avg(abs(rel)) AS mape,
         sqrt(avg((pred - realized) ** 2)) AS rmse, avg(realized) AS mean_realized
  FROM (SELECT *, (pred - realized) / realized AS rel FROM (
    SELECT stream, h, train, realized, 'naive' AS method, c_obs::DOUBLE AS pred FROM pts UNION ALL SELECT stream, h, train, realized, 'one_step', n_one_step FROM pts
    UNION ALL SELECT stream, h, train, realized, 'nowcast', n_hat FROM pts) WHERE realized > 0) GROUP BY ALL
)"""

_PAIR = "make, family"
_AGES = [min(12 * k, C.max_delay) for k in range(1, C.base_years + 1)]


def _arm(name: str, base: list[str], current: str, extra: str) -> str:
    values = "[" + ", ".join(base) + "]"
    sd = f"greatest(coalesce(list_stddev_samp({values}), 0), sqrt(greatest(list_avg({values}), 1)))"
    sd = f"sqrt({sd} ** 2 + list_avg({values}) * ({extra}))" if extra else sd
    return f"list_avg({values}) AS mu_{name}, {sd} AS sd_{name}, ({current} - list_avg({values})) / ({sd}) AS z_{name}"


_DEV = [f"b{k}.c::DOUBLE" for k in range(1, C.base_years + 1)]
_OWN = [f"o{k}.c::DOUBLE" for k in range(1, C.base_years + 1)]
_NOW = [f"b{k}.c / greatest(f{k}.F, 1e-9)" for k in range(1, C.base_years + 1)]
_Z = FIT + """,
sev AS (SELECT * FROM flg WHERE consumer AND severity >= 1)""" + cells("sev", _PAIR, p="m") + f""",
eli AS (
  SELECT make, family, sum(c) AS "rows", max(roll) FILTER (WHERE i >= {C.peak_months}) AS peak
  FROM (SELECT *, sum(c) OVER (PARTITION BY make, family ORDER BY t ROWS BETWEEN {C.peak_months - 1} PRECEDING AND CURRENT ROW) AS roll, row_number() OVER (PARTITION BY make, family ORDER BY t) AS i
        FROM mcum WHERE d = {C.max_delay}) GROUP BY ALL HAVING sum(c) >= {C.min_stream_rows} AND max(roll) FILTER (WHERE i >= {C.peak_months}) >= {C.min_stream_peak}
),
pool AS (SELECT cutoff, d, F FROM cur WHERE stream = 'severe'),
zs AS (
  SELECT x.make, x.family, x.t AS cutoff, x.c AS obs, x.c / greatest(f0.F, 1e-9) AS nowcast,
    {_arm("naive", _DEV, "x.c", "")}, {_arm("naive_matched", _OWN, "x.c", "")}, {_arm("nowcast", _NOW, "x.c / greatest(f0.F, 1e-9)", "1 / greatest(f0.F, 1e-9) - 1")}
  FROM (SELECT * FROM mcum SEMI JOIN eli USING (make, family) WHERE d = 0) x JOIN pool f0 ON f0.cutoff = x.t AND f0.d = 0
  {" ".join(f"JOIN mcum b{k} ON b{k}.make = x.make AND b{k}.family = x.family AND b{k}.t = x.t - {12 * k} AND b{k}.d = {a} JOIN mcum o{k} ON o{k}.make = x.make AND o{k}.family = x.family AND o{k}.t = x.t - {12 * k} AND o{k}.d = 0 JOIN pool f{k} ON f{k}.cutoff = x.t AND f{k}.d = {a}" for k, a in enumerate(_AGES, 1))}
)"""
_LEVELS = _Z + """,
lev AS (SELECT make, family, cutoff, """ + ", ".join(f"CASE WHEN lag(z_{a}) OVER w IS NOT NULL THEN least(z_{a}, lag(z_{a}) OVER w) END AS level_{a}" for a in ("naive", "naive_matched", "nowcast")) + """
  FROM zs WINDOW w AS (PARTITION BY make, family ORDER BY cutoff))"""
ALARMS = _LEVELS + f""",
alm AS (SELECT make, family, {", ".join(f"min(cutoff) FILTER (WHERE level_{a} > {C.z_threshold}) AS tau_{a}" for a in ("naive", "naive_matched", "nowcast"))} FROM lev GROUP BY ALL),
gns AS (SELECT *, tau_naive - tau_nowcast AS delta_vs_naive, tau_naive_matched - tau_nowcast AS delta_vs_naive_matched FROM alm)"""

BURST = f""",
bcell AS (SELECT make, family, report_p, count(*) AS n FROM cons GROUP BY ALL),
burst AS (SELECT * FROM (SELECT *, median(n) OVER (PARTITION BY make, family) AS median_n FROM bcell) WHERE n >= {C.burst_count} AND n > {C.burst_ratio} * greatest(median_n, 1))"""

HAZ = FLG + mature() + f""",
topf AS (SELECT family FROM mat GROUP BY family ORDER BY count(*) DESC, family LIMIT {C.top_families}),
hcell AS (SELECT severity, era, channel, CASE WHEN family IN (FROM topf) THEN family ELSE 'OTHER' END AS family, delay_m AS d, count(*) AS events FROM mat WHERE era IS NOT NULL GROUP BY ALL),
per AS (SELECT * FROM (
  SELECT severity, era, channel, family, d, coalesce(events, 0) AS events, sum(coalesce(events, 0)) OVER (PARTITION BY severity, era, channel, family ORDER BY d DESC) AS at_risk
  FROM (SELECT DISTINCT severity, era, channel, family FROM hcell) CROSS JOIN range(0, {C.max_delay + 1}) g(d) LEFT JOIN hcell USING (severity, era, channel, family, d)) WHERE at_risk > 0)"""
HBINS = ((7, 9), (10, 12))
HBIN = "CASE " + " ".join(f"WHEN d BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in HBINS) + " ELSE d::VARCHAR END"
HC = HAZ + f""",
hz AS (SELECT {HBIN} AS dbin, severity, era, channel, family, sum(events) AS events, sum(at_risk) AS at_risk FROM per GROUP BY ALL)"""
