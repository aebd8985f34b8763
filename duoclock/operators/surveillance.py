"""Early warning over many streams: seasonal z-scores in three arms, alarms, gains and matched specificity.

Arms: `naive` compares what arrived in a month with developed seasons, `naive_matched` with those seasons' own first
month, `nowcast` compares both after dividing by the pooled maturity.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DelayConfig
from .descriptive import named, quantiles

ARMS = ("naive", "naive_matched", "nowcast")

_QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def eligible_streams(cum: DataFrame, cfg: DelayConfig, by: tuple[str, ...]) -> DataFrame:
    """(keys, rows, peak): streams with enough records, and enough in some run of months by their completed counts (hindsight)."""
    done = cum.where(F.col("d") == cfg.max_delay)
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(-(cfg.peak_months - 1), 0)
    order = Window.partitionBy(*by).orderBy("t")
    rolled = done.withColumn("roll", F.sum("c").over(w)).withColumn("i", F.row_number().over(order))
    peaks = rolled.groupBy(*by).agg(F.sum("c").alias("rows"), F.max(F.when(F.col("i") >= cfg.peak_months, F.col("roll"))).alias("peak"))
    return peaks.where((F.col("rows") >= cfg.min_stream_rows) & (F.col("peak") >= cfg.min_stream_peak))


def z_series(cum: DataFrame, pooled: DataFrame, cfg: DelayConfig, by: tuple[str, ...]) -> DataFrame:
    """mu, sd and z of each arm at every cutoff that has all base years; pooled: (cutoff, d, F).

    A stream's own first-month and developed counts are two columns on its month axis, so the base years are lags of
    a window over it: no join but that with the pooled curve.
    """
    years, d_max = cfg.base_years, cfg.max_delay
    ages = [min(12 * k, d_max) for k in range(1, years + 1)]
    picks = {f"a{a}": F.max(F.when(F.col("d") == a, F.col("c"))) for a in sorted({0, *ages})}
    wide = cum.where(F.col("d").isin(*{0, *ages})).groupBy(*by, "t").agg(*[c.alias(k) for k, c in picks.items()])
    order = Window.partitionBy(*by).orderBy("t")
    past = lambda age, k: F.lag(f"a{age}", 12 * k).over(order)
    rows = wide.select(
        *by, F.col("t").alias("cutoff"), F.col("a0").alias("obs"),
        F.array(*[past(a, k).cast("double") for k, a in enumerate(ages, 1)]).alias("developed"),
        F.array(*[past(0, k).cast("double") for k in range(1, years + 1)]).alias("first"),
    ).where(F.col("cutoff") >= cfg.t0 + 12 * years)
    curve = pooled.groupBy("cutoff").agg(*[F.max(F.when(F.col("d") == a, F.greatest("F", F.lit(1e-9)))).alias(f"f{a}") for a in sorted({0, *ages})])
    rows = rows.join(F.broadcast(curve), "cutoff")  # one row for each month of the snapshot
    rows = rows.withColumn("nowcast_base", F.array(*[F.col("developed")[i] / F.col(f"f{a}") for i, a in enumerate(ages)]))

    def stats(arm: str, base: str, current: Column, extra: Column | None) -> None:
        nonlocal rows
        total = lambda f: F.aggregate(base, F.lit(0.0), lambda s, x: s + f(x))
        rows = rows.withColumn(f"mu_{arm}", total(lambda x: x) / years)
        mu = F.col(f"mu_{arm}")
        spread = F.sqrt(total(lambda x: (x - mu) * (x - mu)) / (years - 1)) if years > 1 else F.lit(0.0)
        sd = F.greatest(spread, F.sqrt(F.greatest(mu, F.lit(1.0))))
        rows = rows.withColumn(f"sd_{arm}", sd if extra is None else F.sqrt(sd * sd + mu * extra))
        rows = rows.withColumn(f"z_{arm}", (current - mu) / F.col(f"sd_{arm}"))

    rows = rows.withColumn("now", F.col("obs") / F.col("f0"))
    stats("naive", "developed", F.col("obs"), None)
    stats("naive_matched", "first", F.col("obs"), None)
    stats("nowcast", "nowcast_base", F.col("now"), 1 / F.col("f0") - 1)
    return rows.select(*by, "cutoff", "obs", F.col("now").alias("nowcast"), *[f"{x}_{arm}" for arm in ARMS for x in ("mu", "sd", "z")])


def alarm_levels(z: DataFrame, by: tuple[str, ...], in_a_row: int = 2) -> DataFrame:
    """(keys, cutoff, level_<arm>): the lowest z of the last `in_a_row` months, where all are known; an alarm at any threshold under it."""
    order = Window.partitionBy(*by).orderBy("cutoff")

    def level(arm: str) -> Column:
        values = [F.col(f"z_{arm}"), *(F.lag(f"z_{arm}", k).over(order) for k in range(1, in_a_row))]
        known = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
        return F.when(known, F.array_min(F.array(*values)))

    return z.select(*by, "cutoff", *[level(a).alias(f"level_{a}") for a in ARMS])


def first_alarms(z: DataFrame, cfg: DelayConfig, by: tuple[str, ...], thresholds: dict[str, float] | None = None, in_a_row: int = 2) -> DataFrame:
    """(keys, tau_<arm>): the last of the first months in a row over the threshold; null without an alarm."""
    bar = {a: cfg.z_threshold for a in ARMS} | (thresholds or {})
    return alarm_levels(z, by, in_a_row).groupBy(*by).agg(*[F.min(F.when(F.col(f"level_{a}") > bar[a], F.col("cutoff"))).alias(f"tau_{a}") for a in ARMS])


def matched_thresholds(levels: DataFrame, cfg: DelayConfig, by: tuple[str, ...], tolerance: float = 1e-3) -> DataFrame:
    """(arm, target, threshold): the bar at which each naive arm alarms in as many streams as the nowcast arm.

    The highest point of a bisection of [0, z_threshold] that still does; z_threshold itself if that is low enough.
    The bisection's end is a multiple of its last step, just under the target-th largest of the streams' highest levels.
    """
    steps, width = 0, cfg.z_threshold
    while width > tolerance:
        width, steps = width / 2, steps + 1
    peaks = levels.groupBy(*by).agg(*[F.max(f"level_{a}").alias(f"peak_{a}") for a in ARMS])
    target = peaks.agg(F.count_if(F.col("peak_nowcast") > cfg.z_threshold).alias("target"))
    each = peaks.select(F.expr("stack(2, 'naive', peak_naive, 'naive_matched', peak_naive_matched) AS (arm, peak)"))
    last = 1 << steps
    point = F.greatest(F.lit(0), F.least(F.lit(last), (F.ceil(F.coalesce("peak", F.lit(0.0)) / width) - 1))).cast("int")
    counts = each.groupBy("arm", point.alias("point")).agg(F.count(F.lit(1)).alias("n"))  # at most one row for each point of the grid
    reached = counts.withColumn("alarming", F.sum("n").over(Window.partitionBy("arm").orderBy(F.col("point").desc()))).crossJoin(F.broadcast(target))
    best = reached.groupBy("arm").agg(F.max("target").alias("target"), F.max(F.when(F.col("alarming") >= F.col("target"), F.col("point"))).alias("point"))
    return best.select("arm", "target", F.when(F.col("target") == 0, cfg.z_threshold).otherwise(F.coalesce(F.col("point") * width, F.lit(0.0))).alias("threshold"))


@dataclass(frozen=True)
class Case:
    """A named stream: records of these makes and families (None: all), judged over the months first..last."""

    name: str
    makes: tuple[str, ...] | None = None
    families: tuple[str, ...] | None = None
    first: int | None = None
    last: int | None = None

    def holds(self) -> Column:
        listed = [F.col(c).isin(*values) for c, values in (("make", self.makes), ("family", self.families)) if values is not None]
        return reduce(lambda a, b: a & b, listed, F.lit(True))


def with_cases(records: DataFrame, cases: tuple[Case, ...]) -> DataFrame:
    """A row for each case that a record is in."""
    return records.withColumn("case", F.explode(F.array_compact(F.array(*[F.when(c.holds(), c.name) for c in cases]))))


def case_window(rows: DataFrame, cases: tuple[Case, ...], month: str) -> DataFrame:
    """Only the months of each case's window."""
    inside = F.lit(False)
    for c in cases:
        bounds = [F.col("case") == c.name, *([F.col(month) >= c.first] if c.first is not None else []), *([F.col(month) <= c.last] if c.last is not None else [])]
        inside = inside | reduce(lambda a, b: a & b, bounds)
    return rows.where(inside)


def case_records(cum: DataFrame, z: DataFrame, cases: tuple[Case, ...], cfg: DelayConfig, min_surge: int = 5) -> DataFrame:
    """(case, peak, total, status, tau_<arm>, max_z_<arm>, outcome) over each case's window; a thin case is dropped, without alarms."""
    done = case_window(cum.where(F.col("d") == cfg.max_delay), cases, "t").groupBy("case").agg(F.max("c").alias("peak"), F.sum("c").alias("total"))
    inside = case_window(z, cases, "cutoff")
    found = inside.groupBy("case").agg(*[F.max(f"z_{a}").alias(f"max_z_{a}") for a in ARMS]).join(first_alarms(inside, cfg, ("case",)), "case")
    now, naive = F.col("tau_nowcast").isNotNull(), F.col("tau_naive").isNotNull()
    outcome = F.when(now & naive, "both").when(now, "nowcast only").when(naive, "comparator only").otherwise("neither alarms")
    thick = F.col("peak") >= min_surge
    rows = done.join(found, "case", "left")
    return rows.select("case", "peak", "total", F.when(thick, "evaluated").otherwise("dropped").alias("status"), *[F.when(thick, F.col(c)).alias(c) for c in found.columns[1:]], F.when(thick, outcome).alias("outcome"))


def gains(alarms: DataFrame) -> DataFrame:
    """Months by which the nowcast arm is earlier; null unless both alarm."""
    return alarms.withColumns({f"delta_vs_{a}": F.col(f"tau_{a}") - F.col("tau_nowcast") for a in ("naive", "naive_matched")})


def gain_summary(gained: DataFrame, within: int | None = None) -> DataFrame:
    """A row for each comparator: how gains are spread, of all or of those of at most `within` months."""
    rows = gained.select(F.expr("stack(2, 'naive', delta_vs_naive, 'naive_matched', delta_vs_naive_matched) AS (arm, delta)")).where("delta IS NOT NULL")
    rows = rows if within is None else rows.where(F.abs("delta") <= within)
    share = lambda c: F.avg(c.cast("double"))
    d = F.col("delta")
    return rows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean"), quantiles("delta", _QUARTILES), F.min("delta").alias("min"), F.max("delta").alias("max"),
        share(d >= 1).alias("share_gain"), share(d == 0).alias("share_zero"), share(d < 0).alias("share_negative"),
    ).withColumns(named(_QUARTILES)).drop("quantiles")


def alarm_rates(alarms: DataFrame) -> DataFrame:
    """One row: share of streams that alarm in each arm, and how many in one arm only."""
    on = {a: F.col(f"tau_{a}").isNotNull() for a in ARMS}
    return alarms.agg(
        F.count(F.lit(1)).alias("streams"), *[F.avg(on[a].cast("double")).alias(f"rate_{a}") for a in ARMS],
        F.count_if(on["nowcast"] & ~on["naive"]).alias("nowcast_only"), F.count_if(on["naive"] & ~on["nowcast"]).alias("naive_only"), F.count_if(~on["naive"] & ~on["nowcast"]).alias("neither"),
    )


def case_status(cum: DataFrame, alarms: DataFrame, cfg: DelayConfig, by: tuple[str, ...], min_surge: int = 5) -> DataFrame:
    """Named cases: too thin to judge, or evaluated, and which of the nowcast and naive arms alarm."""
    done = cum.where(F.col("d") == cfg.max_delay).groupBy(*by).agg(F.max("c").alias("peak"), F.sum("c").alias("total"))
    now, naive = F.col("tau_nowcast").isNotNull(), F.col("tau_naive").isNotNull()
    outcome = F.when(now & naive, "both").when(now, "nowcast only").when(naive, "comparator only").otherwise("neither alarms")
    return done.join(alarms, [*by], "left").withColumn("status", F.when(F.col("peak") < min_surge, "dropped").otherwise("evaluated")).withColumn("outcome", outcome)
