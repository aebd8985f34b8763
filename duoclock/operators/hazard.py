"""A discrete-time hazard of receipt: complementary log-log regression over person-period counts."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DelayConfig

KEYS = ("severity", "era", "channel", "family")


def top_families(mature: DataFrame, cfg: DelayConfig) -> DataFrame:
    """The most frequent families, ties by name."""
    return mature.groupBy("family").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "family").limit(cfg.top_families)


def with_top_families(mature: DataFrame, cfg: DelayConfig) -> DataFrame:
    """Families outside the top become OTHER."""
    top = top_families(mature, cfg).select("family", F.lit(True).alias("is_top"))
    return mature.join(F.broadcast(top), "family", "left").withColumn("family", F.when(F.col("is_top"), F.col("family")).otherwise("OTHER")).drop("is_top")


def person_periods(mature: DataFrame, cfg: DelayConfig) -> DataFrame:
    """(keys, d, events, at_risk) for every delay while anything is still to come."""
    counts = with_top_families(mature.where("era IS NOT NULL"), cfg).groupBy(*KEYS, F.col("delay_m").alias("d")).agg(F.count(F.lit(1)).alias("events"))
    cells = counts.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("d", "events"))).alias("m"))
    grid = cells.select(*KEYS, "m", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_delay))).alias("d")).select(*KEYS, "d", F.coalesce(F.element_at("m", F.col("d")), F.lit(0)).cast("bigint").alias("events"))
    later = Window.partitionBy(*KEYS).orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("at_risk", F.sum("events").over(later)).where("at_risk > 0")


def delay_bin(d: Column, cfg: DelayConfig, single: int, bins: tuple[tuple[int, int], ...]) -> Column:
    """Delays up to `single` each for itself, then the bins. The last delay must share a bin: there everything left arrives."""
    out = d.cast("string")
    for a, b in bins:
        out = F.when((d >= a) & (d <= b), F.lit(f"{a}-{b}")).otherwise(out)
    return out


def hazard_cells(periods: DataFrame, cfg: DelayConfig, single: int, bins: tuple[tuple[int, int], ...]) -> DataFrame:
    return periods.groupBy(delay_bin(F.col("d"), cfg, single, bins).alias("dbin"), *KEYS).agg(F.sum("events").alias("events"), F.sum("at_risk").alias("at_risk"))


def reference_levels(cells: DataFrame) -> DataFrame:
    """One row: the channel and family with the most at risk (ties: the greatest name)."""
    per = lambda c: cells.groupBy(c).agg(F.sum("at_risk").alias("s")).agg(F.max(F.struct("s", F.col(c).alias("level"))).alias("x")).select(F.col("x.level").alias(c))
    return per("channel").crossJoin(per("family"))


def fit_hazard(cells: DataFrame, reference: dict[str, str]) -> DataFrame:
    """(term, beta, se, hr, hr_lo95, hr_hi95, p) and the null and residual deviance of the binomial fit, weighted by those at risk.

    reference: the level of each of dbin, severity, era, channel and family that has no term. Levels are few.
    """
    spark, columns, names = cells.sparkSession, [], []
    levels = cells.agg(*[F.array_sort(F.collect_set(F.col(key).cast("string"))).alias(key) for key in reference]).first()
    for key, base in reference.items():
        for level in levels[key]:
            if level != base:
                names.append(f"{key}_{level}")
                columns.append(F.when(F.col(key).cast("string") == level, 1.0).otherwise(0.0).alias(f"x{len(names)}"))
    rows = cells.select((F.col("events") / F.col("at_risk")).alias("label"), F.col("at_risk").cast("double").alias("weight"), *columns)
    ready = VectorAssembler(inputCols=[f"x{i + 1}" for i in range(len(names))], outputCol="features").transform(rows)
    model = GeneralizedLinearRegression(family="binomial", link="cloglog", weightCol="weight", maxIter=50).fit(ready)
    summary = model.summary
    se, p = summary.coefficientStandardErrors, summary.pValues  # the intercept comes last in both
    out = [(n, float(b), float(s), float(q)) for n, b, s, q in zip([*names, "intercept"], [*model.coefficients, model.intercept], se, p, strict=True)]
    table = spark.createDataFrame(out, "term string, beta double, se double, p double")
    wald = lambda sign: F.exp(F.col("beta") + sign * 1.959963984540054 * F.col("se"))
    return table.select("term", "beta", "se", F.exp("beta").alias("hr"), wald(-1).alias("hr_lo95"), wald(1).alias("hr_hi95"), "p", F.lit(float(summary.deviance)).alias("deviance"), F.lit(float(summary.nullDeviance)).alias("null_deviance"))
