"""Resampled maturity curves: every draw comes from its own key (seed, stream, cutoff, number), so any engine and any retry gives the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DelayConfig
from ..functions.draws import binomial_quantile, uniforms
from ..functions.random import uniform

Sums = Callable[[DataFrame, DataFrame, DelayConfig], DataFrame]


def cohort_arrays(cum: DataFrame) -> DataFrame:
    """(stream, t, c): each cohort's running counts by delay, as an array."""
    return cum.groupBy("stream", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda x: x["c"]).alias("c"))


def _pool(cutoff: Column, cfg: DelayConfig) -> Column:
    """How many cohorts, the youngest first, can count at a cutoff."""
    return F.least(F.lit(cfg.window + cfg.max_delay + 2), cutoff - cfg.t0 + 1)


def _shown(age: Column, d: int, window: int) -> Column:
    """Whether a cohort of this age shows delay d + 1 and is among the window's last."""
    return age.between(d + 1, d + 1 + window)


def cohort_sums(arrays: DataFrame, fitted: DataFrame, cfg: DelayConfig) -> DataFrame:
    """(stream, cutoff, b, num, den): cohorts drawn with replacement, one set of weights a draw for all delays.

    A draw's weights are counts of hashed places in the pool; one aggregation sums the cohorts with them.
    """
    key = (cfg.seed, F.col("stream"), F.col("cutoff"), F.col("b"))
    pool = _pool(F.col("cutoff"), cfg)
    each = fitted.where(pool > 1).select("stream", "cutoff", pool.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(cfg.draws))).alias("b"))
    drawn = each.select("stream", "cutoff", "b", "k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("j"))
    ages = drawn.select("stream", "cutoff", "b", F.floor(uniform(*key, F.col("j")) * F.col("k")).cast("int").alias("age"))
    weights = ages.groupBy("stream", "cutoff", "b", "age").agg(F.count(F.lit(1)).alias("w"))
    rows = weights.withColumn("t", F.col("cutoff") - F.col("age")).join(arrays, ["stream", "t"])
    total = lambda d, shift: F.sum(F.when(_shown(F.col("age"), d, cfg.window), F.col("w") * F.col("c")[d + shift]).otherwise(0))
    delays = range(cfg.max_delay)
    sums = rows.groupBy("stream", "cutoff", "b").agg(*[total(d, 1).alias(f"n{d}") for d in delays], *[total(d, 0).alias(f"m{d}") for d in delays])
    return sums.select("stream", "cutoff", "b", F.array(*[F.col(f"n{d}") for d in delays]).cast("array<double>").alias("num"), F.array(*[F.col(f"m{d}") for d in delays]).cast("array<double>").alias("den"))


def multinomial_sums(arrays: DataFrame, fitted: DataFrame, cfg: DelayConfig) -> DataFrame:
    """(stream, cutoff, b, num, den): each cohort's observed records dealt anew over its observed delays, by the fitted delay law.

    Only sums over cohorts are needed, and those are drawn themselves, with the same joint law. What cohorts up to
    window + 1 months old have at delay d + 1 is thinned to d with chance F(d) / F(d + 1), younger cohorts joining at the
    delay they have reached; older ones, which the window drops from the lowest delays, join from their own lowest delay
    upwards, and what they have not yet is thinned likewise. That takes three binomial draws for each delay, however many
    cohorts there are, and is done for all draws of a row together.
    The window must hold max_delay - 1 months or more.
    """
    top, window = cfg.max_delay, cfg.window
    if window < top - 1:
        raise ValueError("the multinomial bootstrap needs a window of max_delay - 1 months or more")
    span = F.sequence(F.col("cutoff") - (_pool(F.col("cutoff"), cfg) - 1), F.col("cutoff"))
    cohorts = fitted.select("stream", "cutoff", F.explode(span).alias("t")).join(arrays, ["stream", "t"]).withColumn("age", F.col("cutoff") - F.col("t"))
    reached = F.get("c", F.least(F.col("age"), F.lit(top)))
    # place a: what the cohort of age a has reached, and all of those between max_delay and window + 1
    groups = cohorts.groupBy("stream", "cutoff").agg(
        F.map_from_entries(F.collect_list(F.struct("age", reached.cast("double").alias("n")))).alias("has"),
        F.sum(F.when(F.col("age").between(top, window + 1), reached).otherwise(0)).cast("double").alias("full"),
    )
    seed, draws = cfg.seed, cfg.draws

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                stream, cutoff, reached_by_age, full, law = (batch.column(c)[i].as_py() for c in range(5))
                has, law = dict(reached_by_age), [*law, 1.0]
                chance = lambda kind, d: uniforms([f"{seed}|{stream}|{cutoff}|{b}|{kind}|{d}" for b in range(1, draws + 1)])[0]  # noqa: B023, E731
                num, den = np.zeros((draws, top)), np.zeros((draws, top))
                have = np.full(draws, full)
                for d in range(top - 1, -1, -1):
                    above = have + (has.get(d + 1, 0.0) if d + 1 < top else 0.0)
                    have = binomial_quantile(chance("a", d), above, law[d] / law[d + 1])
                    num[:, d] += above
                    den[:, d] += have
                have, whole = np.zeros(draws), 0.0
                for d in range(top):
                    new = has.get(d + 1 + window, 0.0) if d else 0.0
                    whole += new
                    now = have + binomial_quantile(chance("e", d), np.full(draws, new), law[d])
                    above = law[d + 1] if d + 1 < top else 1.0
                    have = now + binomial_quantile(chance("i", d), whole - now, (above - law[d]) / max(1 - law[d], 1e-300))
                    num[:, d] += have
                    den[:, d] += now
                rows = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), top).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([stream] * draws), pa.array([cutoff] * draws, pa.int32()), pa.array(range(1, draws + 1), pa.int32()), rows(num), rows(den)], names=["stream", "cutoff", "b", "num", "den"])

    return groups.join(fitted, ["stream", "cutoff"]).mapInArrow(run, "stream string, cutoff int, b int, num array<double>, den array<double>")


METHODS: dict[str, Sums] = {"cohort": cohort_sums, "multinomial": multinomial_sums}


def resampled_curves(cum: DataFrame, curves: DataFrame, cfg: DelayConfig, method: str | Sums = "multinomial") -> DataFrame:
    """(stream, cutoff, F, drawn): the fitted curve at each cutoff of curves, and as many resampled ones, each an array by delay.

    A factor without records, or under 1, is 1. Where the method draws nothing, the fitted curve is drawn every time.
    """
    sums = METHODS[method] if isinstance(method, str) else method
    fitted = curves.groupBy("stream", "cutoff").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "F"))), lambda x: x["F"]).alias("F"))
    found = sums(cohort_arrays(cum), fitted, cfg)
    logs = F.zip_with("num", "den", lambda n, m: F.when(m > 0, F.ln(F.greatest(n / m, F.lit(1.0)))).otherwise(0.0))
    # sums of the logs from each delay on, by going down the delays
    rest = F.aggregate(F.reverse(logs), F.array(F.lit(0.0)), lambda s, x: F.concat(F.array(s[0] + x), s))
    drawn = found.select("stream", "cutoff", "b", F.transform(rest, lambda x: F.exp(-x)).alias("f"))
    per = drawn.groupBy("stream", "cutoff").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "f"))), lambda x: x["f"]).alias("drawn"))
    return fitted.join(per, ["stream", "cutoff"], "left").select("stream", "cutoff", "F", F.coalesce("drawn", F.array_repeat("F", cfg.draws)).alias("drawn"))


def prediction_draws(cum: DataFrame, curves: DataFrame, cfg: DelayConfig, method: str | Sums = "multinomial", lag: int | None = None) -> DataFrame:
    """(stream, cutoff, h, t, c_obs, draws): resampled nowcasts C / F_b(h) of the last lag + 1 cohorts at each cutoff of curves."""
    lag = cfg.max_lag if lag is None else lag
    rows = resampled_curves(cum, curves, cfg, method).select("stream", "cutoff", "drawn", F.explode(F.sequence(F.lit(0), F.lit(lag))).alias("age"))
    rows = rows.select("stream", "cutoff", "drawn", F.least("age", F.lit(cfg.max_delay)).alias("h"), (F.col("cutoff") - F.col("age")).alias("t"))
    at = rows.select("stream", "cutoff", "t", "h", F.transform("drawn", lambda f: f[F.col("h")]).alias("f"))
    joined = at.join(cum.select("stream", "t", F.col("d").alias("h"), F.col("c").alias("c_obs")), ["stream", "t", "h"])
    return joined.select("stream", "cutoff", "h", "t", "c_obs", F.transform("f", lambda x: F.col("c_obs") / F.greatest(x, F.lit(1e-12))).alias("draws"))


def band(draws: str, q: float) -> Column:
    """The q point of an array of numbers, between neighbours in proportion; null of none."""
    n = F.size(draws)
    place = (n - 1) * q
    low = F.floor(place).cast("int")
    at = lambda i: F.get(F.array_sort(draws), i)
    return at(low) + (place - low) * (at(F.least(low + 1, n - 1)) - at(low))


def median_difference(df: DataFrame, value: str, first, second, draws: int = 1000, seed: int = 1, most_values: int = 100_000) -> DataFrame:
    """(diff, lo95, hi95): difference of two groups' medians with a bootstrap interval.

    The groups' counts of distinct values, not their rows, go to one task: a resample of n rows is a multinomial over
    the values. This is for values on a small domain such as days: over `most_values` distinct ones are an error.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(first).alias("a"), F.count_if(second).alias("b"))

    def median(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        after = np.cumsum(counts, axis=-1)
        n = after[..., -1:]
        low, high = (n - 1) // 2, n // 2
        return (values[(after <= low).sum(axis=-1)] + values[(after <= high).sum(axis=-1)]) / 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_values:
            raise ValueError(f"over {most_values} distinct values: round them first")
        pdf = pdf.sort_values("v")
        values, rng, sides = pdf["v"].to_numpy(), np.random.default_rng(seed), []
        for name in ("a", "b"):
            n = pdf[name].to_numpy()
            if not n.sum():
                return pd.DataFrame({"diff": [None], "lo95": [None], "hi95": [None]}, dtype=float)
            sides.append((median(values, n), median(values, rng.multinomial(n.sum(), n / n.sum(), size=draws))))
        (ma, da), (mb, db) = sides
        lo, hi = np.percentile(da - db, [2.5, 97.5])
        return pd.DataFrame({"diff": [float(ma - mb)], "lo95": [lo], "hi95": [hi]})

    return counts.limit(most_values + 1).groupBy(F.lit(1).alias("one")).applyInPandas(run, "diff double, lo95 double, hi95 double")
