"""DuckDB texts of everything that draws random numbers: the same keys, the same inverted distributions."""

from __future__ import annotations

from ..config import ORDERS, DelayConfig
from ..functions import random as r
from . import oracles as o


def u(*key: object, at: int = 1) -> str:
    """A uniform of a key of SQL expressions."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(map(str, key))})), {at}, 13))::BIGINT + 0.5) / {float(1 << 52)!r})"


def let(value: str, name: str, text: str) -> str:
    return f"list_transform([{value}], lambda {name}: {text})[1]"


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def normal(value: str) -> str:
    tail = lambda x: f"{polynomial(x, r.TAIL)} / {polynomial(x, r.TAIL_BELOW)}"
    low, high, square = "sqrt(-2 * ln(p))", "sqrt(-2 * ln(1 - p))", "((p - 0.5) * (p - 0.5))"
    centre = f"{polynomial(square, r.CENTRE)} * (p - 0.5) / {polynomial(square, r.CENTRE_BELOW)}"
    return let(value, "p", f"CASE WHEN p < {r.EDGE} THEN {tail(low)} WHEN p > {1 - r.EDGE} THEN -({tail(high)}) ELSE {centre} END")


def steps(value: str, first: str, a: str, b: str) -> str:
    ratio = f"({a} + {b} / x[1])"
    return f"list_reduce(list_transform(range(1, 45), lambda j: [j::DOUBLE]), lambda s, x: [x[1], s[2] * {ratio}, s[3] + s[2] * {ratio}, s[4] + (s[3] < {value})::INT], [0::DOUBLE, {first}, {first}, 0::DOUBLE])[4]"


def moments(value: str, mean: str, sd: str, skew: str, excess: str) -> str:
    w = f"z + {skew} * (z * z - 1) / 6 + {excess} * (z * z * z - 3 * z) / 24 - {skew} * {skew} * (2 * z * z * z - 5 * z) / 36"
    return let(normal(value), "z", f"greatest(0, floor({mean} + {sd} * ({w}) + 0.5))")


def poisson(value: str, mean: str) -> str:
    return f"CASE WHEN {mean} <= 0 THEN 0 WHEN {mean} <= {r.EXACT} THEN {steps(value, f'exp(-{mean})', '0', mean)} ELSE {moments(value, mean, f'sqrt({mean})', f'(1 / sqrt({mean}))', f'(1 / {mean})')} END"


def binomial(value: str, n: str, p: str) -> str:
    def side(value: str, p: str) -> str:
        sd, odds = f"sqrt({n} * {p} * (1 - {p}))", f"({p} / (1 - {p}))"
        small = steps(value, f"exp({n} * ln(1 - {p}))", f"(-{odds})", f"(({n} + 1) * {odds})")
        return f"CASE WHEN {n} * {p} <= {r.EXACT} THEN least({n}, {small}) ELSE least({n}, {moments(value, f'{n} * {p}', sd, f'((1 - 2 * {p}) / {sd})', f'((1 - 6 * {p} * (1 - {p})) / ({sd} * {sd}))')}) END"

    return f"CASE WHEN {n} <= 0 OR {p} <= 0 THEN 0 WHEN {p} >= 1 THEN {n} WHEN {p} <= 0.5 THEN {side(value, p)} ELSE {n} - {side(f'(1 - {value})', f'(1 - {p})')} END"


def gamma(shape: str, *key: object) -> str:
    def candidate(i: int) -> str:
        cubed = "pow(1 + x / sqrt(9 * d), 3)"
        good = f"v > 0 AND ln({u(*key, chr(39) + 'g' + chr(39), i, at=14)}) < 0.5 * x * x + d - d * v + d * ln(greatest(v, 1e-300))"
        return let(normal(u(*key, "'g'", i)), "x", let(cubed, "v", f"CASE WHEN {good} THEN d * v END"))

    raised = f"CASE WHEN {shape} < 1 THEN {shape} + 1 ELSE {shape} END - {1 / 3!r}"
    boost = f"CASE WHEN {shape} < 1 THEN pow({u(*key, chr(39) + 'b' + chr(39))}, 1 / {shape}) ELSE 1 END"
    return let(raised, "d", f"coalesce({', '.join(candidate(i) for i in range(r.CANDIDATES))}, d)") + f" * {boost}"


def negative_binomial(mean: str, phi: str, *key: object) -> str:
    mixed = let(f"{mean} * {gamma(phi, *key)} / {phi}", "m", poisson(u(*key, "'p'"), "m"))
    return f"CASE WHEN {mean} <= 1e-12 THEN 0 ELSE {mixed} END"


def cohort_sums(p: str, cur: str, cum: str, c: DelayConfig, seed: int, where: str) -> str:
    """{p}sum: (stream, cutoff, b, d, num, den) of cohorts drawn with replacement."""
    k = f"least({c.window + c.max_delay + 2}, cutoff - {c.t0} + 1)"
    return f""",
{p}grp AS (SELECT DISTINCT stream, cutoff, {k} AS k FROM {cur} WHERE {where}),
{p}wgt AS (SELECT stream, cutoff, b, floor({u(f"'{seed}'", 'stream', 'cutoff', 'b', 'j')} * k)::INT AS age, count(*) AS w FROM {p}grp CROSS JOIN range(1, {c.draws + 1}) x(b) CROSS JOIN range(1, {c.window + c.max_delay + 3}) y(j) WHERE k > 1 AND j <= k GROUP BY ALL),
{p}sum AS (
  SELECT w.stream, w.cutoff, w.b, g.d, coalesce(sum(w.w * y.c) FILTER (WHERE w.age BETWEEN g.d + 1 AND g.d + 1 + {c.window}), 0)::DOUBLE AS num, coalesce(sum(w.w * x.c) FILTER (WHERE w.age BETWEEN g.d + 1 AND g.d + 1 + {c.window}), 0)::DOUBLE AS den
  FROM {p}wgt w CROSS JOIN range(0, {c.max_delay}) g(d) JOIN {cum} x ON x.stream = w.stream AND x.t = w.cutoff - w.age AND x.d = g.d JOIN {cum} y ON y.stream = w.stream AND y.t = w.cutoff - w.age AND y.d = g.d + 1 GROUP BY ALL)"""


def multinomial_sums(p: str, cur: str, cum: str, c: DelayConfig, seed: int, where: str) -> str:
    """{p}sum of cohorts whose records are dealt anew: sums thinned down the delays, and up them for cohorts that leave the window."""
    top, w = c.max_delay, c.window
    k = f"least({w + top + 2}, l.cutoff - {c.t0} + 1)"
    chance = lambda kind, d: u(f"'{seed}'", "stream", "cutoff", "b", f"'{kind}'", d)
    has = lambda age: f"coalesce((SELECT n FROM {p}has h WHERE h.stream = q.stream AND h.cutoff = q.cutoff AND h.age = {age}), 0)"
    thin = lambda source: f"SELECT stream, cutoff, b, d, above, {binomial(chance('a', 'd'), 'above', 'p')} AS n FROM ({source})"
    laws = f"JOIN {p}law l ON l.stream = q.stream AND l.cutoff = q.cutoff"
    late = lambda source: f"SELECT stream, cutoff, b, d, now, whole, now + {binomial(chance('i', 'd'), '(whole - now)', 'p')} AS later FROM (SELECT *, before + {binomial(chance('e', 'd'), 'fresh', 'law')} AS now FROM ({source}))"
    rise = f"({{0}} - l.F) / greatest(1 - l.F, 1e-300)".format(f"CASE WHEN l.d < {top} THEN l.up ELSE 1 END")
    return f""",
{p}law AS MATERIALIZED (SELECT stream, cutoff, d, F, lead(F) OVER (PARTITION BY stream, cutoff ORDER BY d) AS up FROM {cur} WHERE {where}),
{p}has AS MATERIALIZED (SELECT l.stream, l.cutoff, l.cutoff - c.t AS age, c.c::DOUBLE AS n FROM (SELECT DISTINCT stream, cutoff FROM {p}law) l JOIN {cum} c ON c.stream = l.stream AND c.d = least(l.cutoff - c.t, {top}) AND c.t BETWEEN l.cutoff - ({k} - 1) AND l.cutoff),
{p}beg AS (SELECT stream, cutoff, b, coalesce(sum(n) FILTER (WHERE age BETWEEN {top} AND {w + 1}), 0) AS above FROM {p}has CROSS JOIN range(1, {c.draws + 1}) x(b) GROUP BY ALL),
{p}dn AS (
  {thin(f"SELECT q.stream, q.cutoff, b, {top - 1} AS d, above, l.F / l.up AS p FROM {p}beg q {laws} AND l.d = {top - 1}")}
  UNION ALL {thin(f"SELECT q.stream, q.cutoff, q.b, q.d - 1 AS d, q.n + {has('q.d')} AS above, l.F / l.up AS p FROM {p}dn q {laws} AND l.d = q.d - 1 WHERE q.d > 0")}),
{p}up AS (
  {late(f"SELECT q.stream, q.cutoff, b, 0 AS d, 0::DOUBLE AS before, 0::DOUBLE AS fresh, 0::DOUBLE AS whole, l.F AS law, {rise} AS p FROM {p}beg q {laws} AND l.d = 0")}
  UNION ALL {late(f"SELECT q.stream, q.cutoff, q.b, q.d + 1 AS d, q.later AS before, {has(f'q.d + {2 + w}')} AS fresh, q.whole + {has(f'q.d + {2 + w}')} AS whole, l.F AS law, {rise} AS p FROM {p}up q {laws} AND l.d = q.d + 1 WHERE q.d < {top - 1}")}),
{p}sum AS (SELECT stream, cutoff, b, d, x.above + y.later AS num, x.n + y.now AS den FROM {p}dn x JOIN {p}up y USING (stream, cutoff, b, d))"""


SUMS = {"cohort": cohort_sums, "multinomial": multinomial_sums}


def drawn(method: str, p: str, c: DelayConfig = ORDERS, cur: str = "cur", cum: str = "cum", seed: int | None = None, where: str | None = None) -> str:
    """{p}crv: (stream, cutoff, b, d, F) resampled curves; the fitted one where nothing is drawn."""
    where = where or f"cutoff BETWEEN {c.first_origin} AND {c.last_origin}"
    return SUMS[method](p, cur, cum, c, c.seed if seed is None else seed, where) + f""",
{p}lam AS (SELECT *, CASE WHEN den > 0 THEN ln(greatest(num / den, 1)) ELSE 0 END AS x FROM {p}sum),
{p}crv AS MATERIALIZED (
  SELECT stream, cutoff, b, d, exp(-sum(x) OVER (PARTITION BY stream, cutoff, b ORDER BY d DESC)) AS F FROM {p}lam UNION ALL SELECT DISTINCT stream, cutoff, b, {c.max_delay}, 1 FROM {p}sum
  UNION ALL SELECT stream, cutoff, b, d, F FROM {cur} CROSS JOIN range(1, {c.draws + 1}) x(b) WHERE {where} AND (stream, cutoff) NOT IN (SELECT (stream, cutoff) FROM {p}sum))"""


def scales(method: str, p: str = "", c: DelayConfig = ORDERS, pts: str = "pts", cur: str = "cur", cum: str = "cum") -> str:
    """{p}drw, {p}row, {p}phu, {p}phc, {p}kap, {p}phi: draws of replayed predictions, their moments, dispersions and drift scales."""
    phi = "CASE WHEN a > 0 AND b > 0 THEN greatest(a / b, 1e-3) ELSE 1e6 END AS phi"
    return drawn(method, p, c, cur, cum) + f""",
{p}drw AS MATERIALIZED (SELECT x.*, b, c_obs / greatest(v.F, 1e-12) AS n FROM {pts} x JOIN {p}crv v ON v.stream = x.stream AND v.cutoff = x.cutoff AND v.d = x.h),
{p}row AS MATERIALIZED (SELECT x.*, s2, realized - n_hat AS e, n_hat - c_obs AS u FROM {pts} x JOIN (SELECT stream, cutoff, t, var_pop(n) AS s2 FROM {p}drw GROUP BY ALL) USING (stream, cutoff, t)),
{p}phu AS (SELECT stream, {phi} FROM (SELECT stream, sum(u * u) AS a, sum(e * e - u - s2) AS b FROM {p}row WHERE train AND u > 1e-9 GROUP BY stream)),
{p}cen AS (SELECT *, e - avg(e / n_hat) OVER (PARTITION BY stream, h) * n_hat AS ec FROM (SELECT * REPLACE (greatest(u, 0) AS u) FROM {p}row WHERE train AND n_hat > 1e-9)),
{p}phc AS (SELECT stream, {phi} FROM (SELECT stream, sum(u * u) AS a, sum(ec * ec - u - s2) AS b FROM {p}cen WHERE u > 1e-9 GROUP BY stream)),
{p}kap AS (SELECT stream, h, CASE WHEN n < 8 OR m2 <= 1e-12 THEN 0 ELSE sqrt(greatest(total - noise - fit, 0) / m2) END AS kappa FROM (
  SELECT stream, h, count(*) AS n, avg(e * e / (n_hat * n_hat)) AS total, avg((greatest(u, 0) + greatest(u, 0) ** 2 / phi) / (n_hat * n_hat)) AS noise, avg(s2 / (n_hat * n_hat)) AS fit, avg(stale * stale) AS m2
  FROM {p}row JOIN {p}phc USING (stream) WHERE train AND n_hat > 1e-9 GROUP BY stream, h)),
{p}rdy AS (SELECT x.*, coalesce(kappa, 0) * abs(stale) AS sigma FROM {p}row x LEFT JOIN {p}kap USING (stream, h)),
{p}phi AS (SELECT stream, {phi} FROM (SELECT stream, sum(u * u) AS a, sum(e * e - u - s2 - n_hat * n_hat * (exp(sigma * sigma) - 1)) AS b FROM {p}rdy WHERE train AND u > 1e-9 GROUP BY stream))"""


def simulated(p: str, rows: str, draws: str, c: DelayConfig = ORDERS) -> str:
    """{p}itv: rows (stream, cutoff, t, sigma, ...) with the points of what will have come in. draws: stream, cutoff, t, b, n, c_obs."""
    key = (f"'{c.seed + 1}'", "stream", "cutoff", "t", "b")
    drift = f"CASE WHEN sigma > 0 THEN exp(sigma * {normal(u(*key, chr(39) + 'z' + chr(39)))} - sigma * sigma / 2) ELSE 1 END"
    points = ", ".join(f"quantile_cont(came, {q}) AS {name}" for name, q in (("lo90", 0.05), ("lo50", 0.25), ("sim_median", 0.5), ("hi50", 0.75), ("hi90", 0.95)))
    return f""",
{p}inp AS (SELECT d.stream, d.cutoff, d.t, d.b, d.c_obs, d.n, phi, sigma FROM {draws} d JOIN (SELECT stream, cutoff, t, sigma FROM {rows}) r USING (stream, cutoff, t) JOIN {p}phi USING (stream)),
{p}sim AS (SELECT stream, cutoff, t, b, c_obs + {negative_binomial('m', 'phi', *key)} AS came FROM (SELECT *, greatest(n * {drift} - c_obs, 0) AS m FROM {p}inp)),
{p}itv AS (SELECT * FROM {rows} JOIN (SELECT stream, cutoff, t, {points} FROM {p}sim GROUP BY stream, cutoff, t) USING (stream, cutoff, t))"""


def intervals(method: str, p: str = "", c: DelayConfig = ORDERS, pts: str = "pts", cur: str = "cur", cum: str = "cum") -> str:
    return scales(method, p, c, pts, cur, cum) + simulated(p, f"{p}rdy", f"{p}drw", c) + f""",
{p}cov AS (SELECT *, realized BETWEEN lo90 AND hi90 AS cov90, realized BETWEEN lo50 AND hi50 AS cov50 FROM {p}itv)"""


REPLAYED = "WITH RECURSIVE " + o.REPLAY
SCALES = "SELECT stream, h, kappa, u.phi AS phi, c.phi AS phi_centred, n.phi AS phi_net FROM {p}kap JOIN {p}phi n USING (stream) JOIN {p}phu u USING (stream) JOIN {p}phc c USING (stream)"
COVERAGE = "SELECT stream, count(*) AS n, avg(cov90::INT) AS cov90, avg(cov50::INT) AS cov50 FROM {p}cov WHERE NOT train GROUP BY GROUPING SETS ((stream), ())"


def by_method(text, select: str) -> str:
    """Both methods' rows of a select that has {p} for the method's prefix."""
    parts = {"cohort": "co", "multinomial": "mu"}
    rows = " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({select.format(p=p)})" for m, p in parts.items())
    return REPLAYED + "".join(text(m, p) for m, p in parts.items()) + f", both_methods AS ({rows})\nSELECT * FROM both_methods"


def live() -> str:
    here, seed = f"cutoff = {ORDERS.cutoff}", ORDERS.seed + 2
    rows = f"""SELECT l.stream, l.cutoff, u.t, u.d AS h, u.c AS c_obs, l.F, u.c / l.F AS n_hat, u.c = 0 AS degenerate, ln(l.F) - ln(s.F) AS stale
  FROM cur l JOIN scur s USING (stream, cutoff, d) JOIN cum u USING (stream, d) WHERE l.cutoff = {ORDERS.cutoff} AND u.d = least(l.cutoff - u.t, {ORDERS.max_delay}) AND u.t BETWEEN l.cutoff - 35 AND l.cutoff"""
    drawn_rows = "SELECT x.stream, x.cutoff, x.t, x.c_obs, b, c_obs / greatest(v.F, 1e-12) AS n FROM lvrow x JOIN lvcrv v ON v.stream = x.stream AND v.cutoff = x.cutoff AND v.d = x.h"
    return REPLAYED + scales("multinomial") + drawn("multinomial", "lv", seed=seed, where=here) + f""",
lvrow AS (SELECT x.*, coalesce(kappa, 0) * abs(stale) AS sigma FROM ({rows}) x LEFT JOIN kap USING (stream, h)), lvdrw AS ({drawn_rows}), lvphi AS (SELECT * FROM phi)""" + simulated("lv", "lvrow", "lvdrw") + "\nSELECT * FROM lvitv"


BANDS = REPLAYED + "".join(drawn(m, p, where=f"(cutoff BETWEEN {ORDERS.first_origin} AND {ORDERS.last_origin} OR cutoff = {ORDERS.cutoff})") for m, p in (("cohort", "co"), ("multinomial", "mu"))) + f""",
now AS (SELECT u.stream, l.cutoff, u.t, u.d AS h, u.c AS c_obs FROM (SELECT DISTINCT stream, cutoff FROM mucrv) l JOIN cum u ON u.stream = l.stream AND u.d = least(l.cutoff - u.t, {ORDERS.max_delay}) AND u.t BETWEEN l.cutoff - {ORDERS.max_lag} AND l.cutoff),
bnd AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS method, x.stream, x.cutoff, x.t, x.h, x.c_obs, quantile_cont(c_obs / greatest(v.F, 1e-12), 0.05) AS lo, quantile_cont(c_obs / greatest(v.F, 1e-12), 0.95) AS hi FROM now x JOIN {p}crv v ON v.stream = x.stream AND v.cutoff = x.cutoff AND v.d = x.h GROUP BY ALL" for m, p in (("cohort", "co"), ("multinomial", "mu"))) + ")\nSELECT * FROM bnd"

COVERAGE_MATRIX = REPLAYED + intervals("multinomial") + "\nSELECT stream, h, avg(cov90::INT) - 0.9 AS gap90, avg(cov50::INT) - 0.5 AS gap50 FROM cov WHERE NOT train GROUP BY stream, h"
METRICS = REPLAYED + intervals("multinomial") + """, shr AS (
  SELECT stream, h, CASE WHEN train THEN 'training' ELSE 'evaluation' END AS origin_set, 'nowcast' AS method, avg(cov50::INT) AS cov50, avg(cov90::INT) AS cov90 FROM cov WHERE realized > 0 GROUP BY ALL)
SELECT * FROM met LEFT JOIN shr USING (stream, h, origin_set, method)"""


def replay(p: str, cum: str, c: DelayConfig) -> str:
    """{p}pts: predictions at past cutoffs under other settings, with what the intervals need of them."""
    return o.curve(c.window, d_max=c.max_delay, p=p, cum=cum) + o.curve(c.short_window, d_max=c.max_delay, p=f"{p}s", cum=cum) + f""",
{p}pts AS (
  SELECT stream, l.cutoff, u.t, u.d AS h, u.c AS c_obs, u.c / l.F AS n_hat, ln(greatest(l.F, 1e-12)) - ln(greatest(s.F, 1e-12)) AS stale, r.c AS realized, l.cutoff <= {c.last_training_origin} AS train
  FROM {p}cur l JOIN {p}scur s USING (stream, cutoff, d) JOIN {cum} u USING (stream, d) JOIN {cum} r USING (stream, t)
  WHERE l.cutoff BETWEEN {c.first_origin} AND {c.last_origin} AND u.d = least(l.cutoff - u.t, {c.max_delay}) AND u.t BETWEEN l.cutoff - {c.max_lag} AND l.cutoff AND r.d = {c.max_delay})"""


def variant_coverage(variants: str, specs: list[tuple[str, str, str, DelayConfig]]) -> str:
    """specs: a prefix, the cumulative table with streams named variant/stream, how it is made, and the settings."""
    text = variants.replace("WITH ", "WITH RECURSIVE ", 1)
    for p, cum, made, c in specs:
        text += f", {cum} AS MATERIALIZED ({made})" + replay(p, cum, c) + intervals("multinomial", p, c, f"{p}pts", f"{p}cur", cum)
    rows = " UNION ALL ".join(f"SELECT stream, cov90 FROM {p}cov WHERE NOT train AND realized > 0 AND h IN {c.horizons}" for p, _, _, c in specs)
    return text + f", every_cov AS ({rows})\nSELECT split_part(stream, '/', 1) AS variant, split_part(stream, '/', 2) AS stream, count(*) AS n, avg(cov90::INT) AS cov90 FROM every_cov GROUP BY ALL"


COUNTERS = f"""WITH k AS (SELECT o_orderkey AS id, o_totalprice / 20000 AS mean, floor(o_totalprice / 1000) AS n FROM orders)
SELECT id, {u("'41'", 'id')} AS u, {normal(u("'41'", 'id'))} AS z, {poisson(u("'41'", 'id'), 'mean')} AS poisson, {binomial(u("'41'", 'id'), 'n', '0.3::DOUBLE')} AS binomial, {negative_binomial('mean', '2.5::DOUBLE', "'41'", 'id')} AS negative_binomial FROM k"""
