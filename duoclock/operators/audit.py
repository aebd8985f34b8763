"""The library's own results held against plainer ways to the same numbers, as a table of checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DelayConfig
from . import chainladder
from .triangle import STREAM, as_known_at, cumulative

#: Largest difference that still passes.
TOLERANCE = 1e-9


def _check(rows: DataFrame, name: str, gap: Column) -> DataFrame:
    worst = F.coalesce(F.max(gap), F.lit(0.0))
    return rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("cases"), worst.alias("worst"), (worst <= TOLERANCE).alias("passed"))


def plain_factors(cum: DataFrame, cfg: DelayConfig, cutoff: int, by: tuple[str, ...] = STREAM) -> DataFrame:
    """(keys, d, plain) at one cutoff, straight from the definition: two sums over the window's cohorts; only where the window has records."""
    last = F.lit(cutoff) - F.col("d") - 1
    below = cum.where((F.col("d") < cfg.max_delay) & F.col("t").between(last - cfg.window, last)).groupBy(*by, "d").agg(F.sum("c").alias("c0"))
    after = F.lit(cutoff) - F.col("d")  # the same cohorts, a month of delay later
    above = cum.where((F.col("d") > 0) & F.col("t").between(after - cfg.window, after)).groupBy(*by, (F.col("d") - 1).alias("d")).agg(F.sum("c").alias("c1"))
    return below.where("c0 > 0").join(above, [*by, "d"]).select(*by, "d", F.greatest(F.lit(1.0), F.col("c1") / F.col("c0")).alias("plain"))


def self_audit(records: DataFrame, tri: DataFrame, cfg: DelayConfig, cutoff: int) -> DataFrame:
    """(check, cases, worst, passed): how many cases each check looked at, and the largest difference.

    delays: a record's delay against the months between the first days of its two months. cells: the pooled stream's cells
    against admitted records, one case. factors: against the definition. maturity: falls nowhere, and is 1 at the
    largest delay. leakage: factors at the cutoff from all records against those from what was known then. nowcasts: times maturity
    against what is known. No records: no cases, which passes.
    """
    cum, at = cumulative(tri, cfg), chainladder.span(cutoff)
    delays = _check(records.where("has_both_dates"), "delays", F.abs(F.months_between(F.trunc("receipt", "month"), F.trunc("incident", "month")) - F.col("delay_m")))
    sums = tri.where("stream = 'all'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(records.where("consumer AND in_triangle").agg(F.count(F.lit(1)).alias("m")))  # one row each
    factors = chainladder.dev_factors(cum, cfg, cutoffs=at)
    curve = chainladder.maturity(factors, cfg)
    curves = curve.join(curve.select("stream", (F.col("d") - 1).alias("d"), F.col("F").alias("later")), ["stream", "d"], "left")
    known = chainladder.dev_factors(cumulative(as_known_at(tri, cutoff), cfg), cfg, cutoffs=at).select("stream", "d", F.col("lam").alias("known"))
    checks = [
        delays, _check(sums, "cells", F.abs(F.col("n") - F.col("m")).cast("double")),
        _check(factors.join(plain_factors(cum, cfg, cutoff), ["stream", "d"]), "factors", F.abs(F.col("lam") - F.col("plain"))),
        _check(curves, "maturity", F.greatest(F.lit(0.0), F.col("F") - F.coalesce("later", F.lit(1.0)), F.when(F.col("d") == cfg.max_delay, F.abs(F.col("F") - 1)))),
        _check(factors.join(known, ["stream", "d"]), "leakage", F.abs(F.col("lam") - F.col("known"))),
        _check(chainladder.nowcast(cum, curve, cfg, cfg.max_lag), "nowcasts", F.abs(F.col("n_hat") * F.col("F") - F.col("c_obs"))),
    ]
    return reduce(DataFrame.union, checks)
