"""Factors, maturity, nowcasts and what is built on them, against literal loops."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoclock.config import DelayConfig
from duoclock.functions import draws, random
from duoclock.operators import backtest, bootstrap, chainladder, descriptive, hazard, intervals, surveillance, variants
from duoclock.operators.triangle import as_known_at, cumulative, dense, triangle, with_streams


def long_form(spark, counts: np.ndarray, stream: str = "all", known: int | None = None):
    last = len(counts) - 1 if known is None else known
    rows = [(stream, t, d, int(n)) for t, row in enumerate(counts) for d, n in enumerate(row) if n and t + d <= last]
    return spark.createDataFrame(rows, "stream string, t int, d int, n bigint")


def literal_factor(c: np.ndarray, cutoff: int, d: int, window: int) -> float:
    top = cutoff - d - 1
    if top < 0:
        return 1.0
    w = window
    while True:
        low = max(0, top - w)
        den = c[low : top + 1, d].sum()
        if den > 0:
            return max(1.0, c[low : top + 1, d + 1].sum() / den)
        if low == 0:
            return 1.0
        w = w * 2 if w else 12


@pytest.mark.parametrize(("window", "busy"), [(9, 0.95), (500, 0.9), (0, 0.15), (4, 0.08)])
def test_factors_and_maturity(spark, window, busy):
    """Cohorts of geometric size whose records thin out with delay; many are empty where `busy` is low."""
    rng = np.random.default_rng(913)
    shares = 0.7 ** np.arange(7)
    counts = rng.binomial(rng.geometric(1 - busy, 47)[:, None] - 1, shares)
    cfg = DelayConfig(t0=0, cutoff=46, max_delay=6, window=window)
    c = np.cumsum(counts, axis=1)
    cum = cumulative(long_form(spark, counts), cfg).cache()
    got = {(r["cutoff"], r["d"]): r["lam"] for r in chainladder.dev_factors(cum, cfg).collect()}
    assert len(got) == sum(46 - d for d in range(6))
    for (cutoff, d), lam in got.items():
        assert lam == pytest.approx(literal_factor(c, cutoff, d, window), rel=1e-12), (cutoff, d)
    curves = chainladder.fit(cum, cfg).collect()
    for r in curves:
        assert r["F"] == pytest.approx(np.prod([1 / literal_factor(c, r["cutoff"], u, window) for u in range(r["d"], 6)]), rel=1e-9)
    by = {(r["cutoff"], r["d"]): r["F"] for r in curves}
    assert all(by[k, 6] == 1 and by[k, d] <= by[k, d + 1] + 1e-12 and by[k, d] > 0 for k, d in by if d < 6)


def test_one_step(spark):
    counts = np.random.default_rng(3).poisson(1.0, (40, 7))
    cfg, c = DelayConfig(t0=0, cutoff=39, max_delay=6, window=5), np.cumsum(counts, axis=1)
    for r in chainladder.one_step(cumulative(long_form(spark, counts), cfg), cfg).collect():
        low, top = max(0, r["cutoff"] - 6 - 5), r["cutoff"] - 6
        total = c[low : top + 1, 6].sum()
        want = np.minimum(np.maximum.accumulate(c[low : top + 1].sum(axis=0) / total), 1) if total else np.ones(7)
        assert r["F1"] == pytest.approx(1.0 if r["d"] == 6 else want[r["d"]])


def test_recovery_of_a_known_law(spark):
    """Cohorts drawn from a power law of delays: its distribution and their sizes come back."""
    rng = np.random.default_rng(40_961)
    law = np.arange(1, 10) ** -1.6
    law /= law.sum()
    sizes = rng.poisson(2500, 180)
    counts = np.array([rng.multinomial(n, law) for n in sizes])
    cfg = DelayConfig(t0=0, cutoff=179, max_delay=8, window=400)
    cum = cumulative(long_form(spark, counts), cfg).cache()
    curves = chainladder.fit(cum, cfg, cutoffs=chainladder.span(179)).cache()
    # a share of n records is off by sqrt(p (1 - p) / n), at most 1 / (2 sqrt(n))
    spread = 0.5 / np.sqrt(sizes.sum())
    for r in curves.collect():
        assert abs(r["F"] - law[: r["d"] + 1].sum()) < 6 * spread
    points = {r["t"]: r for r in chainladder.nowcast(cum, curves, cfg, 12).collect()}
    assert sorted(points) == list(range(167, 180))
    for t, r in points.items():
        seen = law[: 180 - t].sum()
        assert abs(r["n_hat"] - sizes[t]) <= 6 * np.sqrt(sizes[t] * (1 - seen) / seen) + 1e-6


def test_future_records_change_nothing(spark):
    counts = np.random.default_rng(4).poisson(3.0, (61, 7))
    cfg = DelayConfig(t0=0, cutoff=60, max_delay=6, window=12, first_origin=20, last_origin=54, last_training_origin=40, max_lag=6, short_window=6)
    tri = long_form(spark, counts).cache()
    known = {(r["t"], r["d"]): r["n"] for r in as_known_at(tri, 40).collect()}
    assert known == {(t, d): counts[t, d] for t in range(61) for d in range(7) if t + d <= 40 and counts[t, d]}
    then = replace(cfg, cutoff=40)
    early = chainladder.fit(cumulative(as_known_at(tri, 40), then), then).where("cutoff <= 40")
    late = chainladder.fit(cumulative(tri, cfg), cfg).where("cutoff <= 40")
    key = lambda df: {(r["cutoff"], r["d"]): round(r["F"], 12) for r in df.collect()}
    assert key(early) == key(late)


def test_streams(spark):
    df = spark.createDataFrame([(k % 4, 5, 5 + k % 3, k % 3) for k in range(40)], "severity int, cohort_p int, report_p int, delay_m int").withColumn("valid_delay", F.lit(True))
    cfg = DelayConfig(t0=0, cutoff=10, max_delay=4)
    cells = {(r["stream"], r["d"]): r["n"] for r in triangle(with_streams(df), cfg).collect()}
    for d in range(3):
        parts = [cells.get((f"Y{s}", d), 0) for s in range(4)]
        assert cells["all", d] == sum(parts) and cells["severe", d] == sum(parts[1:])
    assert dense(triangle(with_streams(df), cfg), cfg).count() == 6 * 11 * 5


def test_degenerate_cohort(spark):
    counts = np.full((30, 4), 5)
    counts[29] = 0
    cfg = DelayConfig(t0=0, cutoff=29, max_delay=3, window=5)
    cum = cumulative(long_form(spark, counts), cfg)
    rows = {r["t"]: r for r in chainladder.nowcast(cum, chainladder.fit(cum, cfg, cutoffs=chainladder.span(29)), cfg, 2).collect()}
    assert rows[29]["degenerate"] and rows[29]["n_hat"] == 0 and not rows[28]["degenerate"]


def replayed(spark, n_draws=200):
    rng = np.random.default_rng(11)
    law = np.array([0.4, 0.25, 0.15, 0.1, 0.06, 0.04])
    frames = None
    for stream, level in (("all", 300), ("severe", 30)):
        counts = np.array([rng.multinomial(rng.poisson(level), law) for _ in range(121)])
        part = long_form(spark, counts, stream)
        frames = part if frames is None else frames.union(part)
    cfg = DelayConfig(t0=0, cutoff=120, max_delay=5, window=24, short_window=12, max_lag=5, first_origin=50, last_origin=115, last_training_origin=80, draws=n_draws)
    return cumulative(frames, cfg).cache(), cfg


@pytest.mark.parametrize("method", ["cohort", "multinomial"])
def test_intervals_cover(spark, method):
    cum, cfg = replayed(spark)
    points = backtest.replay(cum, cfg)
    resampled = bootstrap.prediction_draws(cum, chainladder.fit(cum, cfg, cutoffs=chainladder.span(cfg.first_origin, cfg.last_origin)), cfg, method)
    rows = intervals.with_spread(points, resampled).cache()
    assert rows.count() == points.count() == 2 * 66 * 6
    kappa = intervals.drift_scale(rows, intervals.phi_centred(rows))
    ready = intervals.with_sigma(rows, kappa)
    bands = intervals.with_coverage(intervals.simulate(ready, intervals.phi_net(ready), cfg)).cache()
    assert bands.where("lo90 > lo50 OR lo50 > sim_median OR sim_median > hi50 OR hi50 > hi90").isEmpty()
    pooled = {r["stream"]: r for r in backtest.coverage(bands).collect()}
    assert 0.85 <= pooled[None]["cov90"] <= 1 and 0.4 <= pooled[None]["cov50"] <= 0.9
    again = intervals.simulate(ready.repartition(5), intervals.phi_net(ready), cfg)
    assert bands.select("stream", "cutoff", "t", "lo90").exceptAll(again.select("stream", "cutoff", "t", "lo90")).isEmpty()
    scores = backtest.metrics(points)
    assert {r["method"] for r in scores.collect()} == set(backtest.METHODS)
    assert backtest.bias_gate(scores, ("all",), 4).first()["passed"]
    assert backtest.coverage_gate(backtest.coverage(bands), 0.5, 1.0).first()["passed"]


def test_draws_follow_their_laws(spark):
    keys = [f"k|{i}" for i in range(60_000)]
    u = draws.uniforms(keys)[0]
    assert abs(u.mean() - 0.5) < 0.006 and abs(np.corrcoef(*draws.uniforms(keys))[0, 1]) < 0.02
    z = draws.normal_quantile(u)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and draws.normal_quantile(np.array([0.975]))[0] == pytest.approx(1.959964, abs=1e-6)
    for mean, phi in ((3, 0.4), (40, 2.0), (900, 60.0), (5, 1e6)):
        x = draws.negative_binomial_draw(np.full(len(keys), float(mean)), phi, keys)
        sd = (mean + mean**2 / phi) ** 0.5
        assert abs(x.mean() - mean) < 5 * sd / len(keys) ** 0.5 and abs(x.std() / sd - 1) < 0.05
    for n, p in ((12, 0.3), (12, 0.9), (4000, 0.35), (100_000, 0.00003)):
        x = draws.binomial_quantile(u, np.full(len(u), float(n)), p)
        sd = (n * p * (1 - p)) ** 0.5
        assert abs(x.mean() - n * p) < 5 * sd / len(u) ** 0.5 and abs(x.std() / sd - 1) < 0.02 and x.min() >= 0 and x.max() <= n
    small = np.arange(1, 2000) / 2000
    assert draws.poisson_quantile(small, np.full(1999, 2.0)).tolist() == [next(k for k in range(60) if sum(np.exp(-2.0) * 2.0**j / math.factorial(j) for j in range(k + 1)) >= q) for q in small]
    assert draws.negative_binomial_draw(np.zeros(3), 2.0, keys[:3]).tolist() == [0, 0, 0]
    # columns give the same as arrays
    frame = spark.range(300).select(F.col("id"), (F.col("id") / 10).alias("m"))
    got = frame.select("id", "m", random.negative_binomial_draw(F.col("m"), F.lit(0.7), 9, F.col("id")).alias("x"), random.binomial_quantile(random.uniform("b", F.col("id")), F.col("id").cast("double"), F.lit(0.6)).alias("b")).collect()
    for r in got:
        assert r["x"] == draws.negative_binomial_draw(np.array([r["m"]]), 0.7, [f"9|{r['id']}"])[0]
        assert r["b"] == draws.binomial_quantile(draws.uniforms([f"b|{r['id']}"])[0], np.array([float(r["id"])]), 0.6)[0]


def test_dealing_sums_is_dealing_records(spark):
    """Factors from sums drawn as sums have the law of those from cohorts dealt one by one."""
    rng = np.random.default_rng(8)
    law = np.array([0.3, 0.25, 0.2, 0.15, 0.1])
    counts = np.array([rng.multinomial(rng.poisson(25), law) for _ in range(30)])
    cfg = DelayConfig(t0=0, cutoff=29, max_delay=4, window=6, draws=3000)
    cum = cumulative(long_form(spark, counts), cfg)
    curves = chainladder.fit(cum, cfg, cutoffs=chainladder.span(29))
    f = np.array([r["F"] for r in curves.orderBy("d").collect()])
    got = bootstrap.resampled_curves(cum, curves, cfg, "multinomial").first()["drawn"]
    c, out = np.cumsum(counts, axis=1), []
    for _ in range(3000):
        dealt = {}
        for age in range(cfg.window + cfg.max_delay + 2):
            h = min(age, 4)
            p = np.diff(f, prepend=0)[: h + 1]
            dealt[age] = np.cumsum(rng.multinomial(c[29 - age, h], p / p.sum()))
        lam = [max(1.0, sum(dealt[a][d + 1] for a in range(d + 1, d + 2 + cfg.window)) / sum(dealt[a][d] for a in range(d + 1, d + 2 + cfg.window))) for d in range(4)]
        out.append([1 / np.prod(lam[h:]) for h in range(5)])
    got, want = np.array(got), np.array(out)
    assert np.allclose(got.mean(axis=0), want.mean(axis=0), atol=4 * want.std() / 3000**0.5) and np.allclose(got.std(axis=0), want.std(axis=0), rtol=0.08, atol=1e-12)
    assert np.allclose(np.corrcoef(got[:, :4].T), np.corrcoef(want[:, :4].T), atol=0.08)


def test_phi_sentinel(spark):
    rows = spark.createDataFrame([("a", True, 5.0, 0.0, 100.0)], "stream string, train boolean, u double, e double, s2 double")
    assert intervals.phi_uncentred(rows).first()["phi"] == intervals.POISSON


def alarms_of(spark, z, thresholds=None, bar=3.0):
    rows = [("m", "f", 100 + i, *[None if x is None else float(x)] * 3) for i, x in enumerate(z)]
    df = spark.createDataFrame(rows, "make string, family string, cutoff int, z_naive double, z_naive_matched double, z_nowcast double")
    return surveillance.first_alarms(df, DelayConfig(z_threshold=bar), ("make", "family"), thresholds).first()["tau_nowcast"]


def test_alarm(spark):
    assert alarms_of(spark, [0, 3.5, 1, 3.1, 3.2, 5, 0]) == 104
    assert alarms_of(spark, [4, 4]) == 101
    assert alarms_of(spark, [4, 0, 4, 0]) is None
    assert alarms_of(spark, [3.0, 3.0, 3.0]) is None
    assert alarms_of(spark, [4, None, None, 4]) is None


def test_matched_thresholds(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(1.5, 1.2, (40, 12, 3))
    z[..., 2] += 0.8
    rows = [("m", f"f{i}", t, *map(float, z[i, t])) for i in range(40) for t in range(12)]
    df = spark.createDataFrame(rows, "make string, family string, cutoff int, z_naive double, z_naive_matched double, z_nowcast double")
    cfg = DelayConfig()
    levels = surveillance.alarm_levels(df, ("make", "family"))
    got = {r["arm"]: r for r in surveillance.matched_thresholds(levels, cfg, ("make", "family")).collect()}
    alarming = lambda arm, bar: sum(any(min(z[i, t, arm], z[i, t - 1, arm]) > bar for t in range(1, 12)) for i in range(40))
    target = alarming(2, 3.0)
    for arm, name in enumerate(("naive", "naive_matched")):
        lo, hi = 0.0, 3.0
        if alarming(arm, hi) >= target:
            lo = hi
        while hi - lo > 1e-3:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if alarming(arm, mid) >= target else (lo, mid)
        assert got[name]["target"] == target and got[name]["threshold"] == pytest.approx(lo, abs=1e-12)


def test_bursts_and_elapsed_days(spark):
    rows = [("a", "x", p) for p in range(10) for _ in range(2)] + [("a", "x", 20)] * 40 + [("b", "x", 3)] * 19
    df = spark.createDataFrame(rows, "make string, family string, report_p int")
    cfg = DelayConfig()
    assert [(r["make"], r["report_p"], r["n"]) for r in variants.burst_cells(df, cfg).collect()] == [("a", 20, 40)]
    assert variants.without_bursts(df, cfg).count() == len(rows) - 40
    days = variants.by_elapsed_days(spark.createDataFrame([(30, 5, 9), (31, 5, 9), (61, 5, 9)], "delay_days int, cohort_p int, report_p int"), cfg)
    assert [(r["delay_m"], r["report_p"]) for r in days.orderBy("delay_days").collect()] == [(0, 5), (1, 6), (2, 7)]


def test_ks_and_median_difference(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 60, 400), rng.integers(10, 80, 300)
    df = spark.createDataFrame([(int(x), 0) for x in a] + [(int(x), 1) for x in b], "v int, g int")
    r = descriptive.ks_two_sample(df, "v", F.col("g") == 0, F.col("g") == 1).first()
    grid = np.arange(90)
    want = np.abs((a[:, None] <= grid).mean(axis=0) - (b[:, None] <= grid).mean(axis=0)).max()
    assert r["D"] == pytest.approx(want) and r["p"] < 1e-6
    same = descriptive.ks_two_sample(df.where("g = 0"), "v", F.col("v") % 2 == 0, F.col("v") % 2 == 1).first()
    assert same["p"] > 0.3
    m = bootstrap.median_difference(df, "v", F.col("g") == 0, F.col("g") == 1).first()
    assert m["diff"] == np.median(a) - np.median(b) and m["lo95"] <= m["diff"] <= m["hi95"]


def test_hazard_recovers_its_law(spark):
    rows = []
    for s in range(3):
        for d, alpha in enumerate((-1.5, -1.0, -0.5)):
            h = 1 - np.exp(-np.exp(alpha + 0.4 * (s == 1) - 0.3 * (s == 2)))
            rows.append((str(d), s, "e", "c", "f", int(round(1e7 * h)), int(1e7)))
    cells = spark.createDataFrame(rows, "dbin string, severity int, era string, channel string, family string, events bigint, at_risk bigint")
    fitted = {r["term"]: r for r in hazard.fit_hazard(cells, {"dbin": "0", "severity": "0", "era": "e", "channel": "c", "family": "f"}).collect()}
    assert fitted["severity_1"]["beta"] == pytest.approx(0.4, abs=1e-3) and fitted["severity_2"]["hr"] == pytest.approx(np.exp(-0.3), abs=1e-3)
    assert fitted["intercept"]["beta"] == pytest.approx(-1.5, abs=1e-3) and fitted["severity_1"]["hr_lo95"] < np.exp(0.4) < fitted["severity_1"]["hr_hi95"]


def test_person_periods(spark):
    cfg = DelayConfig(max_delay=3, top_families=1)
    rows = [(0, "e", "c", "top", d) for d in (0, 0, 1, 3)] + [(0, "e", "c", "rare", 2)]
    got = hazard.person_periods(spark.createDataFrame(rows, "severity int, era string, channel string, family string, delay_m int"), cfg).collect()
    assert sorted((r["family"], r["d"], r["events"], r["at_risk"]) for r in got) == [("OTHER", 0, 0, 1), ("OTHER", 1, 0, 1), ("OTHER", 2, 1, 1), ("top", 0, 2, 4), ("top", 1, 1, 2), ("top", 2, 0, 1), ("top", 3, 1, 1)]


def test_selected_quantiles(spark):
    """Against numpy: one value alone, ties that fill most of a group, null keys and values, no rows."""
    import numpy as np

    from duoclock.operators.descriptive import PERCENTILES, selected_quantiles

    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(0, 9, 3000)] + [("b", 5.0)] * 700 + [("b", float(x)) for x in rng.normal(5, 1, 300)] + [("c", -1.5), (None, 2.0), (None, 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in selected_quantiles(df, "x", ("g",)).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        values = [x for k, x in rows if k == g and x is not None]
        assert r["n"] == len(values)
        for name, q in PERCENTILES.items():
            assert abs(r[name] - np.quantile(values, q)) < 1e-9
    whole = selected_quantiles(df, "x").first()
    assert whole["n"] == 4003 and abs(whole["p90"] - np.quantile([x for _, x in rows if x is not None], 0.9)) < 1e-9
    assert selected_quantiles(df.limit(0), "x").count() == 0
