"""Prediction intervals: resampled nowcasts, drift of the curve, and over-dispersed arrival noise.

Scales have a row for each stream, or each age of one; they are joined without hints, so Spark broadcasts them while they are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DelayConfig
from ..functions.draws import negative_binomial_draw, normal_quantile, uniforms
from ..shared import stored
from .backtest import replay
from .bootstrap import prediction_draws
from .chainladder import fit, span

POISSON = 1e6
QUANTILES = ("lo90", "lo50", "sim_median", "hi50", "hi90")


def _moment(num: Column, den: Column) -> Column:
    return F.when((num > 0) & (den > 0), F.greatest(num / den, F.lit(1e-3))).otherwise(POISSON)


def with_spread(points: DataFrame, draws: DataFrame) -> DataFrame:
    """Training moments of each prediction: error e, what is still to come u, and the draws' variance s2."""
    mean = F.aggregate("draws", F.lit(0.0), lambda a, x: a + x) / F.size("draws")
    s2 = F.aggregate("draws", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("draws")
    spread = draws.withColumn("m", mean).select("stream", "cutoff", "t", "draws", s2.alias("s2"))
    return points.join(spread, ["stream", "cutoff", "t"]).withColumn("e", F.col("realized") - F.col("n_hat")).withColumn("u", F.col("n_hat") - F.col("c_obs"))


def phi_uncentred(rows: DataFrame) -> DataFrame:
    """(stream, phi) by moments: sum of u^2 over sum of e^2 - u - s2; POISSON where a sum isn't positive."""
    used = rows.where("train AND u > 1e-9").groupBy("stream").agg(F.sum(F.col("u") ** 2).alias("a"), F.sum(F.col("e") ** 2 - F.col("u") - F.col("s2")).alias("b"))
    return used.select("stream", _moment(F.col("a"), F.col("b")).alias("phi"))


def phi_centred(rows: DataFrame) -> DataFrame:
    """(stream, phi) as above after taking out each age's mean relative error."""
    train = rows.where("train AND n_hat > 1e-9").withColumn("u", F.greatest("u", F.lit(0.0)))
    bias = train.groupBy("stream", "h").agg(F.avg(F.col("e") / F.col("n_hat")).alias("b"))
    centred = train.join(bias, ["stream", "h"]).withColumn("ec", F.col("e") - F.col("b") * F.col("n_hat")).where("u > 1e-9")
    used = centred.groupBy("stream").agg(F.sum(F.col("u") ** 2).alias("a"), F.sum(F.col("ec") ** 2 - F.col("u") - F.col("s2")).alias("b"))
    return used.select("stream", _moment(F.col("a"), F.col("b")).alias("phi"))


def drift_scale(rows: DataFrame, phi: DataFrame, least_rows: int = 8) -> DataFrame:
    """(stream, h, kappa): relative error beyond noise for each unit of staleness; 0 for too few rows or no staleness."""
    u = F.greatest("u", F.lit(0.0))
    n2 = F.col("n_hat") ** 2
    train = rows.where("train AND n_hat > 1e-9").join(phi, "stream")
    per = train.groupBy("stream", "h").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("e") ** 2 / n2).alias("total"), F.avg((u + u * u / F.col("phi")) / n2).alias("noise"), F.avg(F.col("s2") / n2).alias("fit"), F.avg(F.col("stale") ** 2).alias("m2"))
    kappa = F.when((F.col("n") < least_rows) | (F.col("m2") <= 1e-12), 0.0).otherwise(F.sqrt(F.greatest(F.col("total") - F.col("noise") - F.col("fit"), F.lit(0.0)) / F.col("m2")))
    return per.select("stream", "h", kappa.alias("kappa"))


def with_sigma(rows: DataFrame, kappa: DataFrame | None) -> DataFrame:
    """sigma: the drift's standard deviation; 0 without drift scales."""
    if kappa is None:
        return rows.withColumn("sigma", F.lit(0.0))
    return rows.join(kappa, ["stream", "h"], "left").withColumn("sigma", F.coalesce("kappa", F.lit(0.0)) * F.abs("stale")).drop("kappa")


def phi_net(rows: DataFrame) -> DataFrame:
    """(stream, phi) with the drift's variance taken out as well."""
    used = rows.where("train AND u > 1e-9").groupBy("stream").agg(
        F.sum(F.col("u") ** 2).alias("a"), F.sum(F.col("e") ** 2 - F.col("u") - F.col("s2") - F.col("n_hat") ** 2 * (F.exp(F.col("sigma") ** 2) - 1)).alias("b")
    )
    return used.select("stream", _moment(F.col("a"), F.col("b")).alias("phi"))


def negative_binomial_quantile(q: np.ndarray, mean: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """The least count whose distribution function is q or more, for counts with this mean and variance mean + mean^2 / phi; by summing probabilities up."""
    p = phi / (phi + np.maximum(mean, 1e-12))
    term = np.exp(phi * np.log(p))
    total, count, out = term.copy(), np.zeros(len(mean)), np.zeros(len(mean))
    todo = np.flatnonzero((mean > 1e-12) & (total < q))
    while len(todo):
        count[todo] += 1
        term[todo] *= (count[todo] - 1 + phi[todo]) / count[todo] * (1 - p[todo])
        total[todo] += term[todo]
        out[todo] = count[todo]
        todo = todo[(total[todo] < q[todo]) & (term[todo] > 1e-300)]
    return out


def simulate(rows: DataFrame, phi: DataFrame, cfg: DelayConfig) -> DataFrame:
    """Rows (with draws, sigma, c_obs) and the 5, 25, 50, 75 and 95 % points of what will have come in, from one draw for each of theirs."""
    seed, kept = cfg.seed + 1, [c for c in rows.columns if c != "draws"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                stream, cutoff, t, c_obs, sigma, phi = (batch.column(c)[i].as_py() for c in range(1, 7))
                n = batch.column(7)[i].values.to_numpy()
                keys = [f"{seed}|{stream}|{cutoff}|{t}|{b}" for b in range(1, len(n) + 1)]
                if sigma > 0:
                    n = n * np.exp(sigma * normal_quantile(uniforms([f"{k}|z" for k in keys])[0]) - sigma * sigma / 2)
                found.append(np.percentile(c_obs + negative_binomial_draw(np.maximum(n - c_obs, 0), phi, keys), (5, 25, 50, 75, 95)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in np.reshape(found, (-1, 5)).T)], names=["row", *QUANTILES])

    ready = rows.join(phi, "stream").select(F.struct(*kept).alias("row"), "stream", "cutoff", "t", "c_obs", "sigma", "phi", "draws")
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return ready.mapInArrow(run, f"row struct<{fields}>, " + ", ".join(f"{q} double" for q in QUANTILES)).select("row.*", *QUANTILES)


def with_coverage(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("cov90", F.col("realized").between(F.col("lo90"), F.col("hi90"))).withColumn("cov50", F.col("realized").between(F.col("lo50"), F.col("hi50")))


def replayed_scales(cum: DataFrame, cfg: DelayConfig, method: str = "multinomial") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replayed predictions with draws and sigma (draws stored, so that they are made once), drift scales and the net dispersion."""
    curves = fit(cum, cfg, cutoffs=span(cfg.first_origin, cfg.last_origin))
    rows = stored(with_spread(replay(cum, cfg), prediction_draws(cum, curves, cfg, method)), "draws")
    kappa = drift_scale(rows, phi_centred(rows))
    ready = with_sigma(rows, kappa)
    return ready, kappa, phi_net(ready)


def replayed_intervals(cum: DataFrame, cfg: DelayConfig, method: str = "multinomial") -> DataFrame:
    rows, _, phi = replayed_scales(cum, cfg, method)
    return with_coverage(simulate(rows, phi, cfg))


def training_moments(points: DataFrame) -> DataFrame:
    """(stream, h, n, bias, total, pending, m2): what the scales take from training predictions themselves, without draws."""
    e, u = F.col("realized") - F.col("n_hat"), F.greatest(F.col("n_hat") - F.col("c_obs"), F.lit(0.0))
    train = points.where("train AND n_hat > 1e-9")
    return train.groupBy("stream", "h").agg(
        F.count(F.lit(1)).alias("n"), F.avg(e / F.col("n_hat")).alias("bias"), F.avg(e * e / F.col("n_hat") ** 2).alias("total"),
        F.avg(u / F.col("n_hat") ** 2).alias("pending"), F.avg(F.col("stale") ** 2).alias("m2"),
    )
