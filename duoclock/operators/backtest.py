"""Nowcasts replayed at past cutoffs, as they would have been known then, and how they scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DelayConfig
from .chainladder import fit_windows, nowcast, one_step, span
from .triangle import STREAM

METHODS = ("naive", "one_step", "nowcast")


def replay(cum: DataFrame, cfg: DelayConfig, by: tuple[str, ...] = STREAM) -> DataFrame:
    """A row for each origin, key and cohort of the last max_lag months: three predictions, staleness and what came in the end.

    stale: how far the short window's curve is from the long one's, in logs.
    """
    cutoffs = span(cfg.first_origin, cfg.last_origin)
    fits = fit_windows(cum, cfg, {"long": cfg.window, "short": cfg.short_window}, by, cutoffs)
    of = lambda window: F.max(F.when(F.col("window") == window, F.col("F")))
    curves = fits.groupBy(*by, "cutoff", "d").agg(of("long").alias("F"), of("short").alias("F_short"))
    curves = curves.join(one_step(cum, cfg, None, by, cutoffs), [*by, "cutoff", "d"], "left").withColumn("F1", F.coalesce("F1", F.lit(1.0)))
    rows = nowcast(cum, curves, cfg, cfg.max_lag, by, ("F", "F_short", "F1"))
    realized = cum.where(F.col("d") == cfg.max_delay).select(*by, "t", F.col("c").alias("realized"))
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    return rows.join(realized, [*by, "t"]).select(
        *by, "cutoff", "t", "h", "c_obs", F.col("n_hat"), (F.col("c_obs") / floor("F1")).alias("n_one_step"), F.col("F").alias("f_hat"), F.col("F1").alias("f_one_step"),
        (F.ln(floor("F")) - F.ln(floor("F_short"))).alias("stale"), "realized", (F.col("cutoff") <= cfg.last_training_origin).alias("train"), "degenerate",
    )


def unpivoted(points: DataFrame, by: tuple[str, ...] = STREAM) -> DataFrame:
    """One row for each method's prediction."""
    return points.select(*by, "cutoff", "t", "h", "train", "realized", F.expr("stack(3, 'naive', cast(c_obs AS double), 'one_step', n_one_step, 'nowcast', n_hat) AS (method, pred)"))


def metrics(points: DataFrame, by: tuple[str, ...] = STREAM) -> DataFrame:
    """Errors by keys, age, method and set of origins, where anything came in the end."""
    rel = (F.col("pred") - F.col("realized")) / F.col("realized")
    scored = unpivoted(points, by).where("realized > 0").withColumn("rel", rel)
    return scored.groupBy(*by, "h", "method", F.when(F.col("train"), "training").otherwise("evaluation").alias("origin_set")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("rel").alias("rel_bias"), F.percentile("rel", F.lit(0.5)).alias("median_rel_bias"), F.avg(F.abs("rel")).alias("mape"),
        F.sqrt(F.avg(F.pow(F.col("pred") - F.col("realized"), F.lit(2.0)))).alias("rmse"), F.avg("realized").alias("mean_realized"),
    )


def with_interval_coverage(scores: DataFrame, intervals: DataFrame, by: tuple[str, ...] = STREAM) -> DataFrame:
    """The errors' table with the nowcast's cov50 and cov90 by keys, age and set of origins; null for the other methods."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    found = intervals.where("realized > 0").groupBy(*by, "h", F.when(F.col("train"), "training").otherwise("evaluation").alias("origin_set")).agg(share("cov50"), share("cov90"))
    return scores.join(found.withColumn("method", F.lit("nowcast")), [*by, "h", "origin_set", "method"], "left")


def scoreboard(scores: DataFrame, horizons: tuple[int, ...], by: tuple[str, ...] = STREAM) -> DataFrame:
    """Relative bias of evaluation origins, a column for each age, and whether the nowcast beats both others at each age."""
    rows = scores.where((F.col("origin_set") == "evaluation") & F.col("h").isin(*horizons))
    wide = rows.groupBy(*by, "h").pivot("method", list(METHODS)).agg(F.max("rel_bias"))
    return wide.withColumn("nowcast_wins", (F.abs("nowcast") < F.abs("naive")) & (F.abs("nowcast") < F.abs("one_step")))


def coverage(intervals: DataFrame, by: tuple[str, ...] = STREAM) -> DataFrame:
    """Share of evaluation rows inside the intervals, for each key and in all (key null)."""
    rows = intervals.where(~F.col("train"))
    return rows.groupingSets([[F.col(c) for c in by], []], *by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("cov90").cast("double")).alias("cov90"), F.avg(F.col("cov50").cast("double")).alias("cov50"))


def coverage_gate(pooled: DataFrame, low: float = 0.80, high: float = 0.97) -> DataFrame:
    """One row: whether every key's 90 % coverage is in the band."""
    return pooled.agg(F.bool_and(F.col("cov90").between(low, high)).alias("passed"), F.min("cov90").alias("least"), F.max("cov90").alias("most"))


def bias_gate(scores: DataFrame, streams: tuple[str, ...], most_age: int = 12) -> DataFrame:
    """One row: whether the nowcast's bias is under the naive one's in all the streams' ages."""
    rows = scores.where(F.col("stream").isin(*streams) & (F.col("h") <= most_age) & (F.col("origin_set") == "evaluation"))
    pairs = rows.groupBy("stream", "h").agg(*[F.max(F.when(F.col("method") == m, F.abs("rel_bias"))).alias(m) for m in ("naive", "nowcast")])
    return pairs.agg(F.bool_and(F.col("nowcast") < F.col("naive")).alias("passed"), F.count(F.lit(1)).alias("n"))
