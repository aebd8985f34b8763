"""Functions for SQL users: vectorised scalars and a nowcast as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import DelayConfig
from ..operators.chainladder import widths
from ..operators.intervals import negative_binomial_quantile


def nb_quantile(q: pd.Series, mean: pd.Series, phi: pd.Series) -> pd.Series:
    """The q point of counts with this mean and variance mean + mean^2 / phi."""
    return pd.Series(negative_binomial_quantile(q.to_numpy(float), mean.to_numpy(float), phi.to_numpy(float)))


def nowcaster(cfg: DelayConfig) -> type:
    """nowcast(TABLE(cells) PARTITION BY stream): a stream's running counts (stream, t, d, c) are fitted and nowcast at the cutoff.

    A partition is one stream's triangle, so it holds cohorts x delays rows, which come as Arrow batches in any order.
    """
    sizes, top, t0, cutoff = widths(cfg.window, cfg.cutoff - cfg.t0), cfg.max_delay, cfg.t0, cfg.cutoff

    class Nowcast:
        def __init__(self):
            self.batches = []

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            self.batches.append(batch)
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if not self.batches:
                return
            cells = pa.Table.from_batches(self.batches)
            t, d = (cells[name].to_numpy() for name in ("t", "d"))
            c = np.zeros((cutoff - t0 + 1, top + 1), np.int64)
            c[t - t0, d] = cells["c"].to_numpy()
            lam = np.ones(top)
            for at in range(top):
                end = cutoff - at - t0
                below = next((w for w in sizes if c[max(0, end - w - 1) : end, at].sum() > 0), None)
                if below is not None:
                    lam[at] = max(1.0, c[max(0, end - below - 1) : end, at + 1].sum() / c[max(0, end - below - 1) : end, at].sum())
            share = np.append(1 / np.cumprod(lam[::-1])[::-1], 1.0)
            h = np.arange(top + 1)
            seen = c[cutoff - t0 - h, h]
            yield pa.table({"stream": [cells["stream"][0].as_py()] * (top + 1), "cutoff": pa.array([cutoff] * (top + 1), pa.int32()), "t": pa.array(cutoff - h, pa.int32()), "h": pa.array(h, pa.int32()), "n_hat": seen / share, "missing": seen / share - seen})

    return Nowcast


def register(spark: SparkSession, cfg: DelayConfig) -> None:
    """nb_quantile(q, mean, phi) as a vectorised function and nowcast as a table function, for spark.sql."""
    spark.udf.register("nb_quantile", F.pandas_udf(nb_quantile, "double"))
    spark.udtf.register("nowcast", F.arrow_udtf(nowcaster(cfg), returnType="stream string, cutoff int, t int, h int, n_hat double, missing double"))
