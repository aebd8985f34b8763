"""The triangle as the state of a stream of records, in the order they are received."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..config import DelayConfig
from ..operators.chainladder import widths
from ..operators.triangle import STREAM, triangle, with_streams


def streaming_triangle(records: DataFrame, cfg: DelayConfig, by: tuple[str, ...] = STREAM) -> DataFrame:
    """Counts by keys, cohort and delay, kept as state; at most cohorts x delays rows a key, so it is bounded without a watermark."""
    return triangle(with_streams(records), cfg, by)


def late_records(records: DataFrame, cfg: DelayConfig) -> DataFrame:
    """What the delay cap leaves out, as a stream of its own instead of a silent drop."""
    return records.where(F.col("beyond_cap"))


def month_start(month: Column) -> Column:
    """The first moment of a month index."""
    return F.make_timestamp((month / 12).cast("int"), month % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def _counted(weight: str | None) -> Column:
    """Records of a group; weight: a column of how many records a row stands for."""
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")


def finished_cohorts(records: DataFrame, cfg: DelayConfig, weight: str | None = None) -> DataFrame:
    """(month, n): a cohort's records once no more are waited for. weight: a column of how many records a row stands for.

    The incident month is the event time, and the delay cap the lateness that is allowed: a record of a month that the
    watermark has passed is late and is left out, and a month is given out, once, when the watermark passes it.
    """
    timed = records.where("valid_delay").withColumn("month", month_start(F.col("cohort_p"))).withWatermark("month", f"{31 * (cfg.max_delay + 1)} days")
    return timed.groupBy("month").agg(_counted(weight))


def arrive(rows: DataFrame, folder: str, parts: list[Column]) -> None:
    """Write each part, in this order, as the next file of a landing folder; a stream of one file a batch then has them as its batches."""
    for part in parts:
        rows.where(part).repartition(1).write.mode("append").parquet(folder)


def dropped_late(query: StreamingQuery) -> tuple[int, int]:
    """Batches with data, and the (batch, group) pairs that the watermark kept from a finished query's state."""
    progress = query.recentProgress
    return sum(p["numInputRows"] > 0 for p in progress), sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])


def run_available(rows: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Process what is there and stop. each: gets every batch's rows; without it they are appended to Parquet files in folder/rows."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    return (writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{folder}/rows")).start()


def latest(spark: SparkSession, cells: DataFrame, keys: tuple[str, ...], folder: str) -> DataFrame:
    """A changing table's last state: each batch writes the rows that changed, and the last change of each key counts."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/part={number}")

    run_available(cells, folder, "update", keep).awaitTermination()
    changes = spark.read.schema(StructType([*cells.schema, StructField("batch", LongType())])).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    values = [c for c in cells.columns if c not in keys]
    return changes.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def _runs(threshold: float, consecutive: int) -> StatefulProcessor:
    """A class of this function's own, so that it travels whole to processes that don't know this package."""

    class Runs(StatefulProcessor):
        """Scores wait in a map until the watermark passes their month, and are then taken in the order of months, however they came."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "month int", "z double")
            self.run = handle.getValueState("run", "run int, last int")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            for frame in rows:
                for row in frame.itertuples():
                    self.waiting.updateValue((int(row.cutoff),), (None if pd.isna(row.z) else float(row.z),))
                    self.handle.registerTimer(int(row.month.timestamp() * 1000) - 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            passed = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs() + 1, unit="ms")
            upto = passed.year * 12 + passed.month - 1
            run, last = self.run.get() if self.run.exists() else (0, -1)
            found = []
            for month, z in sorted((k[0], v[0]) for k, v in self.waiting.iterator()):
                if month > upto:
                    break
                # a missing month ends a run
                run = (run + 1 if month == last + 1 else 1) if z is not None and z > threshold else 0
                last = month
                if run >= consecutive:
                    found.append((key[0], month, run))
                self.waiting.removeKey((month,))
            self.run.update((run, last))
            yield pd.DataFrame(found, columns=["stream", "cutoff", "run"]).astype({"cutoff": "int32", "run": "int32"})

        def close(self) -> None:
            pass

    return Runs()


def alarm_runs(scores: DataFrame, threshold: float, consecutive: int = 2, lateness: str = "0 seconds") -> DataFrame:
    """(stream, cutoff, run): months at which a stream's z has been over the threshold so many times in a row, from a stream of (stream, cutoff, z).

    Scores may come in any order and in any batches; those of a month that is over, and past the lateness, are left out, as are months before 1970.
    What waits for a stream is at most the months of its lateness and of a batch. Needs the RocksDB state store.
    """
    timed = scores.withColumn("month", month_start(F.col("cutoff"))).withWatermark("month", lateness)
    return timed.groupBy("stream").transformWithStateInPandas(_runs(threshold, consecutive), "stream string, cutoff int, run int", "Append", "EventTime")


def _development(cfg: DelayConfig, lag: int, first: int, last: int) -> StatefulProcessor:
    """A class of this function's own, as in _runs. first, last: the cutoffs that are given out."""
    t0, depth, held, sizes = cfg.t0, cfg.max_delay, max(cfg.max_delay, lag) + 1, widths(cfg.window, cfg.cutoff - cfg.t0)

    class Development(StatefulProcessor):
        """A key's triangle, taken on a month at a time.

        Cells wait in a map until the watermark passes their month. State: the counts of the youngest cohorts, and for each
        delay the running sums along cohorts of counts within d and d + 1 months. A month adds one place to each of
        them, and a factor is the difference of two places, however long the history is.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "month int, t int", "n bigint")
            self.sums = handle.getMapState("sums", "d int", "c0 array<bigint>, c1 array<bigint>")
            self.counts = handle.getValueState("counts", "last int, counts array<bigint>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            months = {}
            for frame in rows:
                for row in frame.itertuples():
                    self.waiting.updateValue((int(row.t + row.d), int(row.t)), (int(row.n),))
                    months[int(row.t + row.d)] = row.month
            for month in months.values():
                self.handle.registerTimer(int(month.timestamp() * 1000))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
            upto = min(passed.year * 12 + passed.month - 1, last)
            done, counts = self.counts.get() if self.counts.exists() else (t0 - 1, [])
            if upto <= done:
                return
            counts = list(counts)
            arrived = {k: v[0] for k, v in self.waiting.iterator() if k[0] <= upto}
            sums = {d: tuple(map(list, self.sums.getValue((d,)))) if self.sums.containsKey((d,)) else ([0], [0]) for d in range(depth)}
            found = []
            for month in range(done + 1, upto + 1):
                before = counts
                counts = [*before, 0][-held:]  # the youngest cohort stands last
                for age in range(min(depth + 1, len(counts))):
                    counts[-1 - age] += arrived.get((month, month - age), 0)
                for d in range(min(depth, len(counts) - 1)):
                    c0, c1 = sums[d]
                    c0.append(c0[-1] + before[-1 - d])
                    c1.append(c1[-1] + counts[-2 - d])
                if month >= first:
                    shares = self.shares(sums)
                    for age in range(min(lag + 1, len(counts))):
                        h = min(age, depth)
                        found.append((key[0], month, month - age, h, counts[-1 - age], counts[-1 - age] / shares[h]))
            for k in arrived:
                self.waiting.removeKey(k)
            for d, pair in sums.items():
                self.sums.updateValue((d,), pair)
            self.counts.update((upto, counts))
            if upto < last:  # a month without cells is an origin too
                self.handle.registerTimer(int(pd.Timestamp((upto + 1) // 12, (upto + 1) % 12 + 1, 1).timestamp() * 1000))
            yield pd.DataFrame(found, columns=["stream", "cutoff", "t", "h", "c_obs", "n_hat"]).astype({"cutoff": "int32", "t": "int32", "h": "int32", "c_obs": "int64", "n_hat": "float64"})

        def shares(self, sums: dict) -> list[float]:
            """The share received within 0 to depth months, from the newest place of the sums."""
            out = [1.0]
            for d in reversed(range(depth)):
                c0, c1 = sums[d]
                lam = 1.0
                for size in sizes:
                    low = max(0, len(c0) - 2 - size)
                    if c0[-1] > c0[low]:
                        lam = max(1.0, (c1[-1] - c1[low]) / (c0[-1] - c0[low]))
                        break
                out.append(out[-1] / lam)
            return out[::-1]

        def close(self) -> None:
            pass

    return Development()


def streaming_nowcast(records: DataFrame, cfg: DelayConfig, lag: int, first: int, last: int, lateness: str = "1 day", weight: str | None = None) -> DataFrame:
    """(stream, cutoff, t, h, c_obs, n_hat): at each month from first to last that the watermark has passed, the nowcast of its last lag + 1 cohorts.

    Receipt months are the event time. A month is over once the watermark is past its first day, which with the least lateness is as soon as
    a record of the next month has come; records of a month that is over are left out. Records are counted by cell before they
    meet a stream's state, so a stream's task gets a row a cell, and its state holds cohorts x delays numbers. Months before 1970 can't
    be told. weight: a column of how many records a row stands for. Needs the RocksDB state store.
    """
    t, d = F.col("cohort_p"), F.col("delay_m")
    admitted = records.where(F.col("valid_delay") & t.between(cfg.t0, cfg.cutoff) & d.between(0, cfg.max_delay) & (F.col("report_p") <= cfg.cutoff))
    timed = admitted.withColumn("month", month_start(F.col("report_p"))).withWatermark("month", lateness)
    cells = with_streams(timed).groupBy("month", "stream", t.cast("int").alias("t"), d.cast("int").alias("d")).agg(_counted(weight))
    shape = "stream string, cutoff int, t int, h int, c_obs bigint, n_hat double"
    return cells.groupBy("stream").transformWithStateInPandas(_development(cfg, lag, first, last), shape, "Append", "EventTime")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and maps need."""
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        yield


@contextmanager
def small_state(spark: SparkSession, partitions: int = 12) -> Iterator[None]:
    """Queries started inside have so many state partitions at most: for state of a bounded number of rows, as each partition costs a commit a batch."""
    name = "spark.sql.shuffle.partitions"
    with _setting(spark, name, str(min(partitions, int(spark.conf.get(name))))):
        yield
