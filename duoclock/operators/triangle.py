"""Reporting triangles in long form: keys, t (cohort), d (delay), n (records) or c (records up to d)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DelayConfig

STREAM = ("stream",)


def with_streams(records: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """A row for each stream that a record is in: all, Y0..Y3, severe (severity 1 and more), and named predicates."""
    labels = [F.lit("all"), F.concat(F.lit("Y"), F.col("severity").cast("string")), F.when(F.col("severity") >= 1, "severe")]
    labels += [F.when(c, name) for name, c in (extra or {}).items()]
    return records.withColumn("stream", F.explode(F.array_compact(F.array(*labels))))


def triangle(records: DataFrame, cfg: DelayConfig, by: tuple[str, ...] = STREAM, weight: str | None = None) -> DataFrame:
    """Counts of admitted records by keys, cohort and delay: one pre-aggregated shuffle. weight: a column of how many records a row stands for."""
    t, d = F.col("cohort_p"), F.col("delay_m")
    admitted = records.where(F.col("valid_delay") & t.between(cfg.t0, cfg.cutoff) & d.between(0, cfg.max_delay) & (F.col("report_p") <= cfg.cutoff))
    return admitted.groupBy(*by, t.alias("t"), d.alias("d")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))


def as_known_at(tri: DataFrame, cutoff: int | Column) -> DataFrame:
    """Only what had been received by the cutoff month."""
    return tri.where(F.col("t") + F.col("d") <= cutoff)


def dense(tri: DataFrame, cfg: DelayConfig, by: tuple[str, ...] = STREAM) -> DataFrame:
    """Every cell of every key, with 0 where nothing came: each key's cells as a map, looked up on its own grid."""
    cells = tri.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct((F.col("t") * (cfg.max_delay + 1) + F.col("d")).alias("at"), "n"))).alias("m"))
    grid = cells.select(*by, "m", F.explode(F.sequence(F.lit(cfg.t0), F.lit(cfg.cutoff))).alias("t")).select(*by, "m", "t", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_delay))).alias("d"))
    return grid.select(*by, "t", "d", F.coalesce(F.element_at("m", F.col("t") * (cfg.max_delay + 1) + F.col("d")), F.lit(0)).cast("bigint").alias("n"))


def cumulative(tri: DataFrame, cfg: DelayConfig, by: tuple[str, ...] = STREAM) -> DataFrame:
    """c: records of a cohort received within d months, on the dense grid. Cells after the cutoff hold what is known."""
    w = Window.partitionBy(*by, "t").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return dense(tri, cfg, by).select(*by, "t", "d", F.sum("n").over(w).alias("c"))
