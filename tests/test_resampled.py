"""Queries on resampled numbers: what is fixed in them by plain Python, and what must hold of the rest."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest

from duoclock.functions import tables
from duoclock.operators import intervals
from duoclock.plans import queries as q
from duoclock.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few_draws():
    """The test tables' settings with few draws, for the time of this module."""
    before = q.C
    q.C = replace(before, draws=40)
    yield q.C
    q.C = before


@pytest.fixture(scope="module")
def scaled(spark, few_draws):
    rows, kappa, phi = intervals.replayed_scales(q._cum(spark, SF), few_draws)
    return rows, kappa.collect(), phi.collect()


def moment(num: float, den: float) -> float:
    return max(num / den, 1e-3) if num > 0 and den > 0 else 1e6


def test_scales_from_draws(scaled):
    rows, kappa, phi = scaled
    train = [r for r in rows.collect() if r["train"]]
    s2 = {id(r): float(np.var(r["draws"])) for r in train}
    streams = defaultdict(list)
    for r in train:
        streams[r["stream"]].append(r)
    plain = {r["stream"]: r["phi"] for r in intervals.phi_uncentred(rows).collect()}
    centred = {r["stream"]: r["phi"] for r in intervals.phi_centred(rows).collect()}
    net, drift = {r["stream"]: r["phi"] for r in phi}, {(r["stream"], r["h"]): r["kappa"] for r in kappa}
    assert set(streams) == set(net) == set(centred)
    for s, of in streams.items():
        e, u = (lambda r: r["realized"] - r["n_hat"]), (lambda r: r["n_hat"] - r["c_obs"])
        used = [r for r in of if u(r) > 1e-9]
        assert plain[s] == pytest.approx(moment(sum(u(r) ** 2 for r in used), sum(e(r) ** 2 - u(r) - s2[id(r)] for r in used)), rel=1e-6)
        ages = defaultdict(list)
        for r in of:
            if r["n_hat"] > 1e-9:
                ages[r["h"]].append(r)
        bias = {h: np.mean([e(r) / r["n_hat"] for r in x]) for h, x in ages.items()}
        c = moment(sum(max(u(r), 0) ** 2 for r in used), sum((e(r) - bias[r["h"]] * r["n_hat"]) ** 2 - u(r) - s2[id(r)] for r in used))
        assert centred[s] == pytest.approx(c, rel=1e-6)
        for h, x in ages.items():
            n2, m2 = (lambda r: r["n_hat"] ** 2), np.mean([r["stale"] ** 2 for r in x])
            up = lambda r: max(u(r), 0.0)
            left = np.mean([e(r) ** 2 / n2(r) for r in x]) - np.mean([(up(r) + up(r) ** 2 / c) / n2(r) for r in x]) - np.mean([s2[id(r)] / n2(r) for r in x])
            assert drift[s, h] == pytest.approx(0.0 if len(x) < 8 or m2 <= 1e-12 else math.sqrt(max(left, 0.0) / m2), rel=1e-6, abs=1e-9)
        spread = sum(e(r) ** 2 - u(r) - s2[id(r)] - r["n_hat"] ** 2 * (math.exp(r["sigma"] ** 2) - 1) for r in used)
        assert net[s] == pytest.approx(moment(sum(u(r) ** 2 for r in used), spread), rel=1e-6)


def test_intervals_and_what_is_counted_from_them(spark, few_draws):
    rows = q.QUERIES["replayed_intervals"].spark(spark, SF).collect()
    assert len(rows) == q.QUERIES["backtest_points"].spark(spark, SF).count()
    for r in rows:
        assert r["lo90"] <= r["lo50"] <= r["sim_median"] <= r["hi50"] <= r["hi90"] and r["lo90"] >= r["c_obs"] - 1e-6
        assert r["cov90"] == (r["lo90"] <= r["realized"] <= r["hi90"]) and r["cov50"] == (r["lo50"] <= r["realized"] <= r["hi50"])
    judged = [r for r in rows if not r["train"]]
    got = {r["stream"]: r for r in q.QUERIES["coverage"].spark(spark, SF).collect()}
    for s in {None, *(r["stream"] for r in judged)}:
        mine = [r["cov90"] for r in judged if s is None or r["stream"] == s]
        assert got[s]["n"] == len(mine) and got[s]["cov90"] == pytest.approx(np.mean(mine), abs=1e-6)
    least, most = min(r["cov90"] for r in got.values()), max(r["cov90"] for r in got.values())
    gate = q.QUERIES["coverage_gate"].spark(spark, SF).first()
    assert (gate["least"], gate["most"]) == (least, most) and gate["passed"] == (least >= 0.80 and most <= 0.97)
    for r in q.QUERIES["coverage_matrix"].spark(spark, SF).collect():
        assert r["gap90"] == pytest.approx(np.mean([x["cov90"] for x in judged if (x["stream"], x["h"]) == (r["stream"], r["h"])]) - 0.9, abs=1e-6)
    table = {(r["stream"], r["h"], r["method"], r["origin_set"]): r for r in q.QUERIES["backtest_metrics"].spark(spark, SF).collect()}
    assert any(r["cov90"] is not None for r in table.values()) and all((r["cov90"] is None) or r["method"] == "nowcast" for r in table.values())


def test_live_intervals_and_bands(spark, few_draws):
    live = q.QUERIES["live_intervals"].spark(spark, SF).collect()
    assert live and all(r["lo90"] <= r["lo50"] <= r["sim_median"] <= r["hi50"] <= r["hi90"] for r in live)
    assert all(r["n_hat"] == r["c_obs"] for r in live if r["h"] == few_draws.max_delay)
    bands = q.QUERIES["bootstrap_bands"].spark(spark, SF).collect()
    assert {r["method"] for r in bands} == {"cohort", "multinomial"}
    assert all(r["c_obs"] - 1e-6 <= r["lo"] <= r["hi"] for r in bands)
    assert len({r["cutoff"] for r in bands}) == few_draws.last_origin - few_draws.first_origin + 2


def test_hazard_fit_solves_its_equations(spark):
    """At the fitted coefficients the likelihood's gradient is zero."""
    cells = [r.asDict() for r in q.QUERIES["hazard_cells"].spark(spark, SF).collect()]
    beta = {r["term"]: r["beta"] for r in q.QUERIES["hazard_fit"].spark(spark, SF).collect()}
    terms = [t for t in beta if t.lower() not in ("const", "intercept")]
    const = next(t for t in beta if t not in terms)
    gradient, scale = defaultdict(float), 0.0
    for r in cells:
        on = [t for t in terms if any(t == f"{k}_{r[k]}" for k in ("dbin", "severity", "era", "channel", "family"))] + [const]
        rate = math.exp(sum(beta[t] for t in on))
        p = -math.expm1(-rate)
        for t in on:
            gradient[t] += (r["events"] - r["at_risk"] * p) / p * rate if p > 0 else 0.0
        scale += r["events"]
    assert scale > 0 and all(abs(g) < 1e-3 * scale for g in gradient.values())


def test_variant_coverage_query(spark, few_draws):
    rows = q.QUERIES["variant_coverage"].spark(spark, SF).collect()
    assert {r["variant"] for r in rows} == {"base", "all_channels", "above_floor", "no_bursts", "elapsed_days", "short_window", "all_history", "short_delay"}
    assert all(r["n"] > 0 and 0 <= r["cov90"] <= 1 for r in rows)


def test_variants_scan_records_once(spark):
    from duoclock.operators import variants
    from duoclock.operators.triangle import triangle, with_streams
    from duoclock.plans.adapter import FLOOR_YEAR, records

    plan = triangle(with_streams(variants.variant_rows(records(spark, SF), q.C, FLOOR_YEAR)), q.C, variants.BY, "n")
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("lineitem.parquet") - 2 * final.count("ReusedExchange") <= 2


def test_functions_in_sql(spark):
    tables.register(spark, q.C)
    rows = spark.sql("SELECT nb_quantile(0.5, 0D, 2D) AS none, nb_quantile(0.9, 3D, 1e9) AS poisson, nb_quantile(0.5, 10D, 1D) AS wide").first()
    assert (rows["none"], rows["poisson"], rows["wide"]) == (0.0, 5.0, 7.0)


def test_gate_log_grows(spark, tmp_path):
    one = spark.createDataFrame([(True, 3)], "ok boolean, n int")
    sinks.append_gates(sinks.gate(one, "s1", "g1", "ok", "n"), str(tmp_path / "log"))
    sinks.append_gates(sinks.gate(one, "s2", "g2", "NOT ok", "n"), str(tmp_path / "log"))
    log = sinks.read_gates(spark, str(tmp_path / "log"))
    assert [(r["step"], r["passed"]) for r in log.collect()] == [("s1", True), ("s2", False)]
    assert "| s2 | g2 | FAIL | 3 |" in sinks.gates_markdown(log)
    (tmp_path / "d.json").write_text(sinks.to_document(one))
    assert sinks.read_document(spark, str(tmp_path / "d.json"), "ok boolean, n int").collect() == one.collect()
    text = sinks.latex_table(spark.createDataFrame([("a_b", 0.5, None)], "name string, x double, y double"), "50 % & more")
    assert r"a\_b & 0.500 & -- \\" in text and r"50 \% \& more" in text


def test_source_rules():
    """No machine-local caches, no RDD code and no prints in the library."""
    from pathlib import Path

    for path in (Path(q.__file__).resolve().parents[1]).rglob("*.py"):
        text = path.read_text()
        assert not [word for word in ("localCheckpoint", ".rdd", "print(", "mapPartitions(") if word in text], path


@pytest.mark.parametrize("batches", [1, 3])
def test_alarm_runs_in_any_order(spark, tmp_path, batches):
    """Runs end at a missing month and don't depend on batches or on the order of rows in them."""
    from pyspark.sql import functions as F

    from duoclock.streaming import replay

    z = {"s": {100: 0.0, 101: 3.5, 102: 1.0, 103: 3.1, 104: 3.2, 105: 5.0, 106: 0.0}, "gap": {101: 9.0, 102: 9.0, 104: 9.0, 105: 9.0, 106: 9.0}, "none": {101: None, 102: 9.0}}
    rows = spark.createDataFrame([(s, 24000 + m, v) for s, of in z.items() for m, v in sorted(of.items(), reverse=True)], "stream string, cutoff int, z double")
    edges = [100, 107] if batches == 1 else [100, 102, 105, 107]
    replay.arrive(rows, f"{tmp_path}/z", [F.col("cutoff").between(24000 + a, 24000 + b - 1) for a, b in zip(edges, edges[1:], strict=False)])
    runs = replay.alarm_runs(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/z"), 3.0)
    with replay.rocksdb(spark):
        replay.run_available(runs, str(tmp_path)).awaitTermination()
    got = spark.read.schema(runs.schema).parquet(f"{tmp_path}/rows").collect()
    assert sorted((r["stream"], r["cutoff"] - 24000, r["run"]) for r in got) == [("gap", 102, 2), ("gap", 105, 2), ("gap", 106, 3), ("s", 104, 2), ("s", 105, 3)]


def test_late_records_change_nothing_given_out(spark, tmp_path):
    from pyspark.sql import functions as F

    from duoclock.config import DelayConfig
    from duoclock.streaming import replay

    cfg = DelayConfig(max_delay=2)
    on_time = [(24000 + i, i, True) for i in range(12) for _ in range(3)]
    late = [(24001, 9, True), (24000, 11, True)]
    given = []
    for name, rows in (("plain", on_time), ("late", on_time + late)):
        frame = spark.createDataFrame(rows, "cohort_p int, report_p int, valid_delay boolean")
        replay.arrive(frame, f"{tmp_path}/{name}/in", [F.col("report_p").between(b, b + 2) for b in (0, 3, 6, 9)])
        out = replay.finished_cohorts(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in"), cfg)
        query = replay.run_available(out, f"{tmp_path}/{name}")
        query.awaitTermination()
        given.append((sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}/rows").collect())), replay.dropped_late(query)))
    (plain, none), (again, some) = given
    assert plain == again and plain and all(n == 3 for _, n in plain) and (none, some) == ((4, 0), (4, 2))
