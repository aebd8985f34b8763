"""The same analysis under other specifications, in one plan where delays and windows are alike."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DelayConfig
from ..shared import stored
from .chainladder import fit, nowcast, span
from .intervals import replayed_intervals
from .triangle import cumulative, triangle, with_streams

BY = ("variant", "stream")


def burst_cells(records: DataFrame, cfg: DelayConfig) -> DataFrame:
    """(make, family, report_p, n, median_n): months with a batch of filings, against the median of the pair's months that have any."""
    return bursts_of(records.groupBy("make", "family", "report_p").agg(F.count(F.lit(1)).alias("n")), cfg)


def bursts_of(cells: DataFrame, cfg: DelayConfig) -> DataFrame:
    median = F.percentile("n", F.lit(0.5)).over(Window.partitionBy("make", "family"))
    return cells.withColumn("median_n", median).where((F.col("n") >= cfg.burst_count) & (F.col("n") > cfg.burst_ratio * F.greatest("median_n", F.lit(1.0))))


def without_bursts(records: DataFrame, cfg: DelayConfig) -> DataFrame:
    return records.join(burst_cells(records, cfg).select("make", "family", "report_p"), ["make", "family", "report_p"], "left_anti")


def by_elapsed_days(records: DataFrame, cfg: DelayConfig) -> DataFrame:
    """Delays in whole months of days_per_month days; the receipt month moves with them."""
    d = F.floor(F.col("delay_days") / cfg.days_per_month).cast("int")
    return records.withColumn("delay_m", d).withColumn("report_p", F.col("cohort_p") + d)


def variant_rows(records: DataFrame, cfg: DelayConfig, floor_year: int) -> DataFrame:
    """(variant, cohort_p, report_p, delay_m, severity, valid_delay, n): record cells under every specification that changes records.

    Records are scanned and counted once; bursts are found from the same counts, and each cell is labelled with the
    variants that it belongs to.
    """
    elapsed = F.floor(F.col("delay_days") / cfg.days_per_month).cast("int")
    keys = ["make", "family", "report_p", "cohort_p", "delay_m", "severity", "consumer", "valid_delay"]
    cells = records.withColumn("elapsed", elapsed).groupBy(*keys, "elapsed").agg(F.count(F.lit(1)).alias("n"))
    filed = cells.groupBy("make", "family", "report_p").agg(F.sum(F.when(F.col("consumer"), F.col("n"))).alias("filed")).where("filed IS NOT NULL")
    bursts = bursts_of(filed.withColumnRenamed("filed", "n"), cfg).select("make", "family", "report_p", F.lit(True).alias("burst"))
    flagged = cells.join(bursts, ["make", "family", "report_p"], "left")
    consumer, calendar = F.col("consumer"), (F.col("delay_m").alias("delay_m"), F.col("report_p").alias("report_p"))
    spec = lambda name, delay=calendar: F.struct(F.lit(name).alias("variant"), *delay)
    specs = F.array_compact(F.array(
        F.when(consumer, spec("base")), spec("all_channels"), F.when(consumer & (F.col("cohort_p") >= floor_year * 12), spec("above_floor")),
        F.when(consumer & F.col("burst").isNull(), spec("no_bursts")),
        F.when(consumer, spec("elapsed_days", (F.col("elapsed").alias("delay_m"), (F.col("cohort_p") + F.col("elapsed")).alias("report_p")))),
    ))
    return flagged.select(F.explode(specs).alias("v"), "cohort_p", "severity", "valid_delay", "n").select("v.*", "cohort_p", "severity", "valid_delay", "n")


def variant_triangle(records: DataFrame, cfg: DelayConfig, floor_year: int) -> DataFrame:
    """(variant, stream, t, d, n), stored: all that the variants need of the records."""
    return stored(triangle(with_streams(variant_rows(records, cfg, floor_year)), cfg, BY, "n"), "variant-triangle")


def specifications(tri: DataFrame, cfg: DelayConfig, short_delay: int) -> list[tuple[DataFrame, DelayConfig]]:
    """(running counts by variant and stream, settings): record variants together, then those that change the window or the delay cap."""
    cum = cumulative(tri, cfg, BY)
    named = lambda name: tri.where("variant = 'base'").withColumn("variant", F.lit(name))
    out = [(cum, cfg)]
    for name, window in (("short_window", cfg.short_window), ("all_history", cfg.cutoff - cfg.t0)):
        out.append((cumulative(named(name), cfg, BY), replace(cfg, window=window)))
    short = replace(cfg, max_delay=short_delay)
    return [*out, (cumulative(named("short_delay").where(F.col("d") <= short_delay), short, BY), short)]


def variant_curves(records: DataFrame, cfg: DelayConfig, short_delay: int, floor_year: int) -> DataFrame:
    """(variant, stream, d, F) at the cutoff."""
    parts = specifications(variant_triangle(records, cfg, floor_year), cfg, short_delay)
    return reduce(DataFrame.unionByName, [fit(cum, c, None, BY, span(c.cutoff)).select(*BY, "d", "F") for cum, c in parts])


def variant_records(records: DataFrame, cfg: DelayConfig, floor_year: int) -> DataFrame:
    """(variant, n, delta_vs_base): records with a valid delay under each specification; windows and caps leave them as they are."""
    counts = variant_rows(records, cfg, floor_year).where("valid_delay").groupBy("variant").agg(F.sum("n").alias("n"))
    others = F.when(F.col("variant") == "base", F.array(*map(F.lit, ("base", "short_window", "all_history", "short_delay")))).otherwise(F.array("variant"))
    rows = counts.select(F.explode(others).alias("variant"), "n")
    return rows.withColumn("delta_vs_base", F.col("n") - F.max(F.when(F.col("variant") == "base", F.col("n"))).over(Window.partitionBy(F.lit(1))))


def variant_bias(records: DataFrame, cfg: DelayConfig, short_delay: int, floor_year: int) -> DataFrame:
    """(variant, stream, h, n, rel_bias): nowcasts replayed under each specification, over evaluation origins where anything came in the end."""
    out = []
    for cum, c in specifications(variant_triangle(records, cfg, floor_year), cfg, short_delay):
        rows = nowcast(cum, fit(cum, c, None, BY, span(c.last_training_origin + 1, c.last_origin)), c, c.max_lag, BY)
        realized = cum.where(F.col("d") == c.max_delay).select(*BY, "t", F.col("c").alias("realized"))
        scored = rows.join(realized, [*BY, "t"]).where((F.col("realized") > 0) & F.col("h").isin(*c.horizons))
        out.append(scored.groupBy(*BY, "h").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n_hat") - F.col("realized")) / F.col("realized")).alias("rel_bias")))
    return reduce(DataFrame.unionByName, out)


def variant_coverage(records: DataFrame, cfg: DelayConfig, short_delay: int, floor_year: int) -> DataFrame:
    """(variant, stream, n, cov90): share of evaluation rows at the horizons inside simulated 90 % intervals, under each specification."""
    out = []
    for cum, c in specifications(variant_triangle(records, cfg, floor_year), cfg, short_delay):
        keyed = cum.select(F.concat_ws("/", *BY).alias("stream"), "t", "d", "c")
        found = replayed_intervals(keyed, c).where(~F.col("train") & (F.col("realized") > 0) & F.col("h").isin(*c.horizons))
        name = F.split("stream", "/")
        out.append(found.groupBy(name[0].alias("variant"), name[1].alias("stream")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("cov90").cast("double")).alias("cov90")))
    return reduce(DataFrame.unionByName, out)


def variant_deltas(curves: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(variant, stream, h, value, delta_vs_base): the base value is the window's row of variant base."""
    rows = curves.where(F.col("d").isin(*horizons)).select("variant", "stream", F.col("d").alias("h"), F.col("F").alias("value"))
    base = F.max(F.when(F.col("variant") == "base", F.col("value"))).over(Window.partitionBy("stream", "h"))
    return rows.withColumn("delta_vs_base", F.col("value") - base)


def largest_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("variant").agg(F.max(F.abs("delta_vs_base")).alias("max_delta"), F.count(F.lit(1)).alias("n"))


def worst_variant(deltas: DataFrame) -> DataFrame:
    """One row: the (variant, stream, h) that moves maturity most, ties by name."""
    moved = deltas.where("variant <> 'base'")
    best = moved.agg(F.min(F.struct((-F.abs("delta_vs_base")).alias("neg"), "variant", "stream", "h", "delta_vs_base")).alias("w"))
    return best.select("w.variant", "w.stream", "w.h", "w.delta_vs_base")
