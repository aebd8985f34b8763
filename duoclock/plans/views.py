"""Temporary views for SQL users: records, their triangle, and what is fitted to it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DelayConfig
from ..operators import backtest, chainladder, descriptive
from ..operators.triangle import cumulative, triangle, with_streams


def register(records: DataFrame, cfg: DelayConfig, prefix: str = "") -> list[str]:
    """records (flagged), mature_records, triangle, cumulative_triangle, factors, maturity, one_step and predictions, each with the prefix."""
    consumer = records.where("consumer")
    tri = triangle(with_streams(consumer), cfg)
    cum = cumulative(tri, cfg)
    views = {
        "records": records, "mature_records": descriptive.mature_set(records, cfg), "triangle": tri, "cumulative_triangle": cum, "factors": chainladder.dev_factors(cum, cfg),
        "maturity": chainladder.fit(cum, cfg), "one_step": chainladder.one_step(cum, cfg), "predictions": backtest.replay(cum, cfg),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
