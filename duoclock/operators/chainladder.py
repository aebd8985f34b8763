"""Development factors, maturity and nowcasts, for the cutoffs that are asked for.

A cohort's count within d months never changes by censoring at a cutoff that admits it, so the factor at cutoff T for
delay d is a sum over cohorts t <= T - d - 1. Sums along cohorts are kept as one array for each key and delay; any cutoff and
window is then the difference of two of their places, and a window without records is doubled by looking further back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DelayConfig
from .triangle import STREAM


def widths(window: int, history: int) -> list[int]:
    """The window and its doublings until they hold all history."""
    out = [window]
    while out[-1] < history:
        out.append(out[-1] * 2 if out[-1] else 12)
    return out


def prefix_sums(pairs: DataFrame, by: tuple[str, ...], first: int, *values: str) -> DataFrame:
    """(keys, d, values...): for each delay the values' running sums along cohorts, an array whose place i sums cohorts first to first + i - 1."""
    over = Window.partitionBy(*by, "d").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = pairs.select(*by, "d", "t", *[F.sum(v).over(over).alias(v) for v in values])
    per = sums.groupBy(*by, "d").agg(F.array_sort(F.collect_list(F.struct("t", *values))).alias("s"))
    return per.select(*by, "d", *[F.concat(F.array(F.lit(0).cast("bigint")), F.col(f"s.{v}")).alias(v) for v in values])


def between(sums: str, first: int, low: Column, high: Column) -> Column:
    """The sum over cohorts low to high, those before the first being empty."""
    at = lambda t: F.get(F.col(sums), F.least(F.greatest(t - first + 1, F.lit(0)), F.size(sums) - 1))
    return at(high) - at(low - 1)


def _lookup(cfg: DelayConfig, window: int) -> tuple[Column, Column]:
    """lam and used of a row with d, cutoff and sums c0 and c1."""
    last, lam, used = F.col("cutoff") - F.col("d") - 1, F.lit(None).cast("double"), F.lit(None).cast("int")
    for size in reversed(widths(window, cfg.cutoff - cfg.t0)):
        below = between("c0", cfg.t0, last - size, last)
        lam = F.when(below > 0, between("c1", cfg.t0, last - size, last) / below).otherwise(lam)
        used = F.when(below > 0, F.lit(size)).otherwise(used)
    return F.greatest(F.coalesce(lam, F.lit(1.0)), F.lit(1.0)), used


def _at_cutoffs(cum: DataFrame, cfg: DelayConfig, by: tuple[str, ...], cutoffs: Column | None) -> DataFrame:
    """(keys, cutoff, d, c0, c1): the sums over cohorts of c(d) and c(d + 1), for each cutoff that shows d + 1 of some cohort."""
    pairs = cum.select(*by, "t", "d", F.col("c").alias("c0"), F.lead("c").over(Window.partitionBy(*by, "t").orderBy("d")).alias("c1"))
    pairs = pairs.where((F.col("d") < cfg.max_delay) & (F.col("t") + F.col("d") + 1 <= cfg.cutoff))
    wanted = F.sequence(F.lit(cfg.t0 + 1), F.lit(cfg.cutoff)) if cutoffs is None else cutoffs
    return prefix_sums(pairs, by, cfg.t0, "c0", "c1").select(*by, "d", "c0", "c1", F.explode(wanted).alias("cutoff")).where(F.col("cutoff") - F.col("d") - 1 >= cfg.t0)


def span(first: int, last: int | None = None) -> Column:
    """The cutoffs from first to last, or first alone."""
    return F.sequence(F.lit(first), F.lit(first if last is None else last))


def dev_factors(cum: DataFrame, cfg: DelayConfig, window: int | None = None, by: tuple[str, ...] = STREAM, cutoffs: Column | None = None) -> DataFrame:
    """(keys, cutoff, d, lam, used): sum of c(d+1) over sum of c(d), over the last window + 1 cohorts that show both.

    A window without records doubles; used is the one taken (null: none had any, and lam is 1). lam is 1 at least.
    cutoffs: an array of those wanted; all, if None.
    """
    lam, used = _lookup(cfg, cfg.window if window is None else window)
    return _at_cutoffs(cum, cfg, by, cutoffs).select(*by, "cutoff", "d", lam.alias("lam"), used.alias("used"))


def maturity(factors: DataFrame, cfg: DelayConfig, by: tuple[str, ...] = STREAM) -> DataFrame:
    """(keys, cutoff, d, lam, F): F(d) is the product of 1/lam from d on, F(max_delay) = 1; factors of unseen delays are 1."""
    per = factors.groupBy(*by, "cutoff").agg(F.map_from_entries(F.collect_list(F.struct("d", "lam"))).alias("m"))
    grid = per.select(*by, "cutoff", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_delay))).alias("d"), "m")
    lam = grid.select(*by, "cutoff", "d", F.coalesce(F.element_at("m", F.col("d")), F.lit(1.0)).alias("lam"))
    rest = Window.partitionBy(*by, "cutoff").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return lam.select(*by, "cutoff", "d", F.when(F.col("d") < cfg.max_delay, F.col("lam")).alias("lam"), F.exp(-F.sum(F.ln("lam")).over(rest)).alias("F"))


def fit(cum: DataFrame, cfg: DelayConfig, window: int | None = None, by: tuple[str, ...] = STREAM, cutoffs: Column | None = None) -> DataFrame:
    return maturity(dev_factors(cum, cfg, window, by, cutoffs), cfg, by)


def fit_windows(cum: DataFrame, cfg: DelayConfig, windows: dict[str, int], by: tuple[str, ...] = STREAM, cutoffs: Column | None = None) -> DataFrame:
    """(keys, window, cutoff, d, lam, F) for several windows from the same sums."""
    rows = _at_cutoffs(cum, cfg, by, cutoffs)
    each = F.array(*[F.struct(F.lit(name).alias("window"), _lookup(cfg, w)[0].alias("lam")) for name, w in windows.items()])
    factors = rows.select(*by, "cutoff", "d", F.explode(each).alias("x")).select(*by, "x.window", "cutoff", "d", "x.lam")
    return maturity(factors, cfg, (*by, "window"))


def one_step(cum: DataFrame, cfg: DelayConfig, window: int | None = None, by: tuple[str, ...] = STREAM, cutoffs: Column | None = None) -> DataFrame:
    """(keys, cutoff, d, F1): share of the final count seen by d, over the mature cohorts of the window; rises to 1 at max_delay."""
    w = cfg.window if window is None else window
    known = cum.where(F.col("t") + cfg.max_delay <= cfg.cutoff).withColumn("last", F.max("c").over(Window.partitionBy(*by, "t")))
    wanted = F.sequence(F.lit(cfg.t0 + cfg.max_delay), F.lit(cfg.cutoff)) if cutoffs is None else cutoffs
    rows = prefix_sums(known, by, cfg.t0, "c", "last").select(*by, "d", "c", "last", F.explode(wanted).alias("cutoff"))
    end = F.col("cutoff") - cfg.max_delay
    below = between("last", cfg.t0, end - w, end)
    ratio = rows.where(end >= cfg.t0).select(*by, "cutoff", "d", F.when(below > 0, between("c", cfg.t0, end - w, end) / below).otherwise(1.0).alias("r"))
    rising = Window.partitionBy(*by, "cutoff").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return ratio.select(*by, "cutoff", "d", F.when(F.col("d") == cfg.max_delay, 1.0).otherwise(F.least(F.max("r").over(rising), F.lit(1.0))).alias("F1"))


def nowcast(cum: DataFrame, curves: DataFrame, cfg: DelayConfig, lag: int, by: tuple[str, ...] = STREAM, keep: tuple[str, ...] = ("F",)) -> DataFrame:
    """(keys, cutoff, t, h, c_obs, F, n_hat) of the last lag + 1 cohorts at each cutoff that has a curve.

    h is the cohort's age, max_delay at most. A cohort's count at age h is one row of `cum`, so each cutoff is an
    equi-join. degenerate: nothing received yet, so n_hat is 0.
    """
    rows = curves.select(*by, "cutoff", F.explode(F.sequence(F.lit(0), F.lit(lag))).alias("age"), "d", *keep).where(F.col("d") == F.least("age", F.lit(cfg.max_delay)))
    rows = rows.select(*by, "cutoff", (F.col("cutoff") - F.col("age")).alias("t"), "d", *keep).where(F.col("t") >= cfg.t0)
    joined = rows.join(cum, [*by, "t", "d"])
    return joined.select(*by, "cutoff", "t", F.col("d").alias("h"), F.col("c").alias("c_obs"), *keep, (F.col("c") / F.col("F")).alias("n_hat"), (F.col("c") == 0).alias("degenerate"))


def undercount(curves: DataFrame) -> DataFrame:
    """Share of records not yet received by d."""
    return curves.withColumn("undercount", 1 - F.col("F"))
