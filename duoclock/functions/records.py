"""Columns derived from one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DelayConfig
from .months import date_number, delay_days, month_index


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def yes_flag(text: Column) -> Column:
    return F.upper(stripped(text)) == "Y"


def severity_ladder(crash: Column, fire: Column, injured: Column, deaths: Column) -> Column:
    return F.when(deaths > 0, 3).when(injured > 0, 2).when(crash | fire, 1).otherwise(0)


def component_family(text: Column) -> Column:
    """The part before the first colon."""
    return stripped(F.substring_index(F.upper(stripped(text)), ":", 1))


def with_delays(records: DataFrame, cfg: DelayConfig, floor_year: int = 2003) -> DataFrame:
    """Months, delays and flags of records that have receipt, incident (dates) and channel. Missing dates: null delays, false flags."""
    true = lambda c: F.coalesce(c, F.lit(False))
    receipt, incident = F.col("receipt"), F.col("incident")
    timed = records.withColumns({
        "report_p": month_index(receipt), "cohort_p": month_index(incident), "delay_days": delay_days(receipt, incident),
        "ldate_i": date_number(receipt), "faildate_i": date_number(incident),
        "has_both_dates": receipt.isNotNull() & incident.isNotNull(), "consumer": true(F.col("channel").isin(*cfg.channels)),
    }).withColumn("delay_m", F.col("report_p") - F.col("cohort_p"))
    flagged = timed.withColumns({
        "neg_delay": true(F.col("delay_days") < 0),
        "pre_floor": true(F.col("cohort_p") < floor_year * 12),
        "beyond_cap": true(F.col("delay_m") > cfg.max_delay),
        "valid_delay": true(F.col("delay_days") >= 0),
    })
    return flagged.withColumns({
        "mature": F.col("valid_delay") & true(F.col("cohort_p") <= cfg.mature_until),
        "in_triangle": F.col("valid_delay") & ~F.col("beyond_cap") & true((F.col("report_p") <= cfg.cutoff) & (F.col("cohort_p") >= cfg.t0)),
    })
