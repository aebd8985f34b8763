"""The data behind figures and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DelayConfig
from ..operators.descriptive import at_horizons, named, quantiles
from ..operators.triangle import STREAM

ATLAS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def milestones(curves: DataFrame, by: tuple[str, ...] = STREAM, marks: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """The first delay by which each share has come in."""
    return curves.groupBy(*by).agg(*[F.min(F.when(F.col("F") >= q, F.col("d"))).alias(f"d{round(q * 100)}") for q in marks])


def delay_profile(curve: DataFrame) -> DataFrame:
    """An ECDF with each level's median delay."""
    median = F.min(F.when(F.col("F") >= 0.5, F.col("d"))).over(Window.partitionBy("level"))
    return curve.withColumn("median_d", median)


def visibility_deficit(curves: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Share still to come after each horizon."""
    return at_horizons(curves.withColumn("deficit", 1 - F.col("F")), horizons, "stream", "deficit", "deficit_")


def heatmap(tri: DataFrame, cfg: DelayConfig, cohorts: int = 36) -> DataFrame:
    """The last cohorts' cells in logs; what the cutoff hides is null."""
    seen = F.col("t") + F.col("d") <= cfg.cutoff
    return tri.where(F.col("t") > cfg.cutoff - cohorts).select("stream", "t", "d", F.when(seen, F.log10(F.col("n") + 1)).alias("log_n"))


def nowcast_gap(points: DataFrame, stream: str = "severe", cohorts: int = 24) -> DataFrame:
    """What is still to come of the last cohorts."""
    order = Window.partitionBy("cutoff").orderBy(F.col("t").desc())
    return points.where(F.col("stream") == stream).withColumn("k", F.row_number().over(order)).where(F.col("k") <= cohorts).select("cutoff", "t", "h", "c_obs", "n_hat", (F.col("n_hat") - F.col("c_obs")).alias("missing"))


def calibration(points: DataFrame) -> DataFrame:
    """Nowcast over what came in, where anything did."""
    return points.where("realized > 0").select("stream", "cutoff", "t", "h", (F.col("n_hat") / F.col("realized")).alias("ratio"))


def coverage_matrix(intervals: DataFrame) -> DataFrame:
    """Coverage of each stream and age, less what it should be."""
    return intervals.where("NOT train").groupBy("stream", "h").agg((F.avg(F.col("cov90").cast("double")) - 0.9).alias("gap90"), (F.avg(F.col("cov50").cast("double")) - 0.5).alias("gap50"))


def atlas(mature: DataFrame, curve: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """For each severity: records, their share, delay quantiles in days, and the share received by each horizon."""
    per = mature.groupBy(F.col("severity").cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"), quantiles("delay_days", ATLAS)).withColumns(named(ATLAS)).drop("quantiles")
    share = per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return share.join(at_horizons(curve, horizons), "level")


def atlas_glyphs(table: DataFrame, most_days: float = 1200.0) -> DataFrame:
    """Where each severity's delay quantiles stand on one axis from 0 to 1, in logs of days and one day."""
    at = lambda c: F.least(F.lit(1.0), F.log10(1 + F.greatest(F.col(c), F.lit(0.0))) / F.log10(F.lit(1 + most_days))).alias(f"x_{c}")
    return table.select("level", *[at(c) for c in ("p25", "p50", "p75", "p90")])


def narrative(audit: DataFrame, curves: DataFrame, deltas: DataFrame, board: DataFrame) -> DataFrame:
    """(place, line): what was found, in sentences; each from a table of one or a few rows."""
    share = F.round(100.0 * F.col("both_dates") / F.col("rows_kept"), 1)
    first = audit.select(F.lit(1).alias("place"), F.concat_ws("", F.lit("Of "), F.col("rows_kept"), F.lit(" rows of "), F.col("unique_ids"), F.lit(" records, "), share, F.lit(" % have both dates.")).alias("line"))
    known = curves.where("stream = 'all'").groupBy().agg(F.min(F.when(F.col("F") >= 0.5, F.col("d"))).alias("half"), F.min(F.when(F.col("F") >= 0.9, F.col("d"))).alias("most"))
    second = known.select(F.lit(2), F.concat_ws("", F.lit("Half of a cohort has come in after "), F.col("half"), F.lit(" months, and 90 % after "), F.col("most"), F.lit(".")))
    third = deltas.select(F.lit(3), F.concat_ws("", F.lit("Of the other specifications, "), F.col("variant"), F.lit(" moves maturity most: stream "), F.col("stream"), F.lit(" after "), F.col("h"), F.lit(" months.")))
    wins = board.agg(F.count_if("nowcast_wins").alias("won"), F.count(F.lit(1)).alias("n"))
    fourth = wins.select(F.lit(4), F.concat_ws("", F.lit("The nowcast is nearest in "), F.col("won"), F.lit(" of "), F.col("n"), F.lit(" streams and ages.")))
    return first.union(second).union(third).union(fourth)


def pooled_ecdf(curve: DataFrame) -> DataFrame:
    """All levels' curves as one, weighted by their records."""
    return curve.groupBy("d").agg((F.sum(F.col("F") * F.col("n")) / F.sum("n")).alias("F"))


def maturity_gap(curves: DataFrame, horizons: tuple[int, ...], base: str = "all") -> DataFrame:
    """Maturity at the horizons, and its distance from the pooled stream's."""
    rows = curves.where(F.col("d").isin(*horizons))
    pooled = F.max(F.when(F.col("stream") == base, F.col("F"))).over(Window.partitionBy("d"))
    return rows.select("stream", "d", "F", (F.col("F") - pooled).alias("gap"))


def robustness(deltas: DataFrame, largest: DataFrame, stream: str = "all", h: int = 1) -> DataFrame:
    """For each variant: maturity at one horizon, its change, and the largest change anywhere."""
    return deltas.where((F.col("stream") == stream) & (F.col("h") == h)).select("variant", "value", "delta_vs_base").join(largest, "variant")


def hazard_forest(table: DataFrame, key: str = "severity") -> DataFrame:
    return table.where(F.col("term").startswith(f"{key}_")).select("term", "hr", "hr_lo95", "hr_hi95").orderBy(F.col("term").desc())


def drift_belts(drifts: DataFrame, severities: tuple[int, ...] = (0, 3, -1), min_rows: int = 30) -> DataFrame:
    return drifts.where((F.col("n") >= min_rows) & F.col("severity").isin(*severities))


def detection_trace(z: DataFrame, alarms: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The arms' z of each stream with its alarm months."""
    return z.join(alarms, [*by])
