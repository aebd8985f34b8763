"""What delays look like, on mature cohorts only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DelayConfig
from ..functions.months import month_year
from ..shared import stored

PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
QUARTILES = {k: PERCENTILES[k] for k in ("p25", "p50", "p75")}


def era(year: Column, cfg: DelayConfig) -> Column:
    """The era's first and last year; null outside all."""
    out = F.lit(None).cast("string")
    for a, b in cfg.eras:
        out = F.when((year >= a) & (year <= b), F.lit(f"{a}-{b}")).otherwise(out)
    return out


def mature_set(records: DataFrame, cfg: DelayConfig, consumer_only: bool = True, day_level: bool = False) -> DataFrame:
    """The gate all delay statistics go through: valid records of cohorts that have run their course."""
    good = F.col("valid_delay") & F.col("cohort_p").between(cfg.t0, cfg.mature_until) & (F.col("delay_days") <= cfg.day_cap if day_level else F.col("delay_m") <= cfg.max_delay)
    rows = records.where(good & F.col("consumer") if consumer_only else good)
    return rows.withColumn("cohort_year", month_year(F.col("cohort_p"))).withColumn("era", era(F.col("cohort_year"), cfg))


def quantiles(column: str, names: dict[str, float] = PERCENTILES) -> Column:
    """All exact quantiles as one array, from one map of values."""
    return F.percentile(column, F.array(*map(F.lit, names.values()))).alias("quantiles")


def named(names: dict[str, float] = PERCENTILES) -> dict[str, Column]:
    """A column for each place of that array."""
    return {k: F.col("quantiles")[i] for i, k in enumerate(names)}


def selected_quantiles(df: DataFrame, value: str, by: tuple[str, ...] = (), names: dict[str, float] = PERCENTILES) -> DataFrame:
    """(by..., n, a column for each quantile): exact quantiles of a column with any number of values, interpolated between neighbours.

    No group's values meet in one task: equal values are counted first, distinct ones are laid out by ranges of (by, value), counts
    are summed inside each range, and the totals of what comes before, a row for each range and group, are carried over. Only the values that
    stand at a wanted place, two a quantile, are kept then. Null values don't count; null keys are a group; no rows give none.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranges = stored(counts.repartitionByRange(*by, "v").withColumn("part", F.spark_partition_id()), "ranges")
    group = Window.partitionBy(*by)
    totals = ranges.groupBy(*by, "part").agg(F.sum("c").alias("here"))
    totals = totals.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("part").alias("_part"), F.sum("here").over(group).alias("n"), (F.sum("here").over(group.orderBy("part")) - F.col("here")).alias("before"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("part") == F.col("_part"))
    upto = F.sum("c").over(Window.partitionBy("part", *by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranges.withColumn("upto", upto).join(totals, same).withColumn("end", F.col("before") + F.col("upto")).withColumn("start", F.col("end") - F.col("c"))
    place = {k: q * (F.col("n") - 1) for k, q in names.items()}
    holds = lambda at: (F.col("start") <= at) & (at < F.col("end"))
    wanted = placed.where(reduce(Column.__or__, [holds(f(x)) for x in place.values() for f in (F.floor, F.ceil)]))
    ends = [F.max(F.when(holds(f(x)), F.col("v"))).alias(f"{k}_{side}") for k, x in place.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = wanted.groupBy(*by).agg(F.max("n").alias("n"), *ends)
    return found.where(F.col("n").isNotNull()).select(*by, "n", *[(F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * (x - F.floor(x))).alias(k) for k, x in place.items()])


def quantile_table(mature: DataFrame, cfg: DelayConfig, column: str = "delay_days") -> DataFrame:
    """Exact quantiles overall and by severity, channel and era; channels and eras of at least min_group rows. One expanded pass."""
    sets = [[], [F.col("severity")], [F.col("channel")], [F.col("era")]]
    rows = mature.select(F.col("severity").cast("string").alias("severity"), "channel", "era", column)
    out = rows.groupingSets(sets, "severity", "channel", "era").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), quantiles(column), F.avg(column).alias("mean")).withColumns(named())
    kind = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "severity").when(F.col("g") == 5, "channel").otherwise("era")
    out = out.withColumn("group", kind).withColumn("level", F.coalesce("severity", "channel", "era", F.lit("all")))
    return out.where((F.col("n") >= cfg.min_group) | F.col("group").isin("overall", "severity")).select("group", "level", "n", *PERCENTILES, "mean")


def ecdf(mature: DataFrame, by: str, cfg: DelayConfig) -> DataFrame:
    """(level, d, F, n): cumulative share of delays 0..max_delay for each level."""
    counts = mature.where(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("level"), F.col("delay_m").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("level").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("d", "c"))).alias("m"))
    grid = per.select("level", "n", "m", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_delay))).alias("d"))
    w = Window.partitionBy("level").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("level", "d", (F.sum(F.coalesce(F.element_at("m", F.col("d")), F.lit(0))).over(w) / F.col("n")).alias("F"), "n")


def at_horizons(curve: DataFrame, horizons: tuple[int, ...], by: str = "level", value: str = "F", prefix: str = "F") -> DataFrame:
    """One column for each horizon."""
    return curve.where(F.col("d").isin(*horizons)).groupBy(by).agg(*[F.max(F.when(F.col("d") == h, F.col(value))).alias(f"{prefix}{h}") for h in horizons])


def drift(mature: DataFrame, column: str = "delay_days", min_rows: int = 1) -> DataFrame:
    """Quantiles by cohort year for each severity and pooled (severity -1)."""
    out = mature.groupingSets([[F.col("cohort_year"), F.col("severity")], [F.col("cohort_year")]], "cohort_year", "severity").agg(F.count(F.lit(1)).alias("n"), quantiles(column, QUARTILES)).withColumns(named(QUARTILES)).drop("quantiles")
    return out.withColumn("severity", F.coalesce("severity", F.lit(-1))).where(F.col("n") >= min_rows)


def spec_grid(records: DataFrame, cfg: DelayConfig, floor_year: int) -> DataFrame:
    """Median day-level delay by severity under channels {all, consumer} x floor {none, year}: one pass, one row per specification."""
    rows = mature_set(records, cfg, consumer_only=False, day_level=True)
    flags = F.array(
        F.lit("all/none"), F.when(F.col("consumer"), "consumer/none"),
        F.when(F.col("cohort_p") >= floor_year * 12, "all/floor"), F.when(F.col("consumer") & (F.col("cohort_p") >= floor_year * 12), "consumer/floor"),
    )
    each = rows.select("severity", "delay_days", F.explode(F.array_compact(flags)).alias("spec"))
    return each.groupBy("spec", "severity").agg(F.count(F.lit(1)).alias("n"), F.percentile("delay_days", F.lit(0.5)).alias("median_days"))


def ks_two_sample(df: DataFrame, value: str, first: Column, second: Column) -> DataFrame:
    """(n1, n2, D, p): the largest distance of two empirical distributions, and its asymptotic p from Kolmogorov's series.

    Works on counts of distinct values, laid out by ranges of values: running sums are taken inside each range, and the
    ranges' totals, a row for each partition, are carried over from range to range.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count_if(first).alias("a"), F.count_if(second).alias("b"))
    ranges = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    listed = totals.agg(F.array_sort(F.collect_list(F.struct("part", "a", "b"))).alias("parts"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    before = lambda side: F.aggregate(F.filter("parts", lambda p: p["part"] < F.col("part")), F.lit(0).cast("bigint"), lambda s, p: s + p[side])
    w = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # the list is one row, as long as there are partitions
    placed = ranges.withColumns({"ra": F.sum("a").over(w), "rb": F.sum("b").over(w)}).crossJoin(F.broadcast(listed))
    gap = F.abs((F.col("ra") + before("a")) / F.col("n1") - (F.col("rb") + before("b")) / F.col("n2"))
    d = placed.select("n1", "n2", gap.alias("gap")).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max("gap").alias("D"))
    x = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))) * F.col("D")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * F.col("x") * F.col("x")))
    return d.withColumn("x", x).withColumn("p", F.when(F.col("x") < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))).drop("x")
