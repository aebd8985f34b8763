"""Every query by name: its Spark plan, the shape of its result, and the DuckDB text that must give the same."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ORDERS as C
from ..functions import random, tables
from ..functions.months import month_label, parse_month_label
from ..functions.records import with_delays
from ..operators import audit, backtest, bootstrap, chainladder, descriptive, hazard, ingest, intervals, surveillance, variants
from ..operators.triangle import as_known_at, cumulative, dense, triangle, with_streams
from ..shared import new_folder, stored
from ..shipping import ship
from ..sources import sinks, tsv
from ..streaming import replay as stream
from . import oracle_draws as od
from . import oracles as o
from . import reports
from .adapter import FLOOR_YEAR, order_rows, records

PAIR = ("make", "family")
SHORT_DELAY = 8
#: Draws of the reduced replays of variants.
VARIANT_DRAWS = 60
Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """shape: 'name:type ...' with i whole number, f number (six places), s text, d date, b truth."""

    run: Run
    shape: str
    sql: str | None = None

    def _columns(self) -> list[list[str]]:
        return [c.split(":") for c in self.shape.split()]

    def spark(self, session: SparkSession, sf_dir: str) -> DataFrame:
        kinds = {"i": lambda c: c.cast("bigint"), "f": lambda c: F.round(c.cast("double"), 6) + 0.0, "s": lambda c: c.cast("string"), "d": lambda c: c.cast("date"), "b": lambda c: c.cast("boolean")}
        ship(session)
        return self.run(session, sf_dir).select(*[kinds[k](F.col(c)).alias(c) for c, k in self._columns()])

    def oracle(self) -> str | None:
        kinds = {"i": "CAST({0} AS BIGINT)", "f": "round(CAST({0} AS DOUBLE), 6) + 0.0", "s": "CAST({0} AS VARCHAR)", "d": "CAST({0} AS DATE)", "b": "CAST({0} AS BOOLEAN)"}
        if self.sql is None:
            return None
        head, _, body = self.sql.rpartition("\nSELECT ")
        return f"{head}\nSELECT " + ", ".join(f'{kinds[k].format(f"q.{_quoted(c)}")} AS {_quoted(c)}' for c, k in self._columns()) + f" FROM (SELECT {body}) q"


def _quoted(name: str) -> str:
    return f'"{name}"'


def _consumer(s: SparkSession, d: str) -> DataFrame:
    return records(s, d).where("consumer")


def _tri(s: SparkSession, d: str) -> DataFrame:
    return triangle(with_streams(_consumer(s, d)), C)


def _cum(s: SparkSession, d: str) -> DataFrame:
    return cumulative(_tri(s, d), C)


def _fit(s: SparkSession, d: str, cutoffs: Column | None = None) -> DataFrame:
    return chainladder.fit(_cum(s, d), C, cutoffs=cutoffs)


def _now(s: SparkSession, d: str, lag: int = 24) -> DataFrame:
    cum = _cum(s, d)
    return chainladder.nowcast(cum, chainladder.fit(cum, C, cutoffs=chainladder.span(C.cutoff)), C, lag)


def _points(s: SparkSession, d: str) -> DataFrame:
    return backtest.replay(_cum(s, d), C)


def _mature(s: SparkSession, d: str, **how) -> DataFrame:
    return descriptive.mature_set(records(s, d), C, **how)


def _pair_cum(s: SparkSession, d: str) -> DataFrame:
    return cumulative(triangle(_consumer(s, d).where("severity >= 1"), C, PAIR), C, PAIR)


def _z(s: SparkSession, d: str) -> DataFrame:
    cum = _pair_cum(s, d)
    kept = cum.join(surveillance.eligible_streams(cum, C, PAIR).select(*PAIR), [*PAIR], "left_semi")
    severe = triangle(_consumer(s, d).where("severity >= 1").withColumn("stream", F.lit("severe")), C)
    return surveillance.z_series(kept, chainladder.fit(cumulative(severe, C), C).select("cutoff", "d", "F"), C, PAIR)


def _gains(s: SparkSession, d: str) -> DataFrame:
    return surveillance.gains(surveillance.first_alarms(_z(s, d), C, PAIR))


def _undercount(s: SparkSession, d: str) -> DataFrame:
    fits = chainladder.fit_windows(_cum(s, d), C, {"24": 24, "12": 12, "all-history": C.cutoff - C.t0}, cutoffs=chainladder.span(C.cutoff))
    return chainladder.undercount(fits).withColumnRenamed("window", "W")


def _variants(s: SparkSession, d: str) -> DataFrame:
    return variants.variant_curves(records(s, d), C, SHORT_DELAY, FLOOR_YEAR)


def _periods(s: SparkSession, d: str) -> DataFrame:
    return hazard.person_periods(_mature(s, d), C)


def _hazard_cells(s: SparkSession, d: str) -> DataFrame:
    return hazard.hazard_cells(_periods(s, d), C, 6, o.HBINS)


def _hazard_fit(s: SparkSession, d: str) -> DataFrame:
    cells = stored(_hazard_cells(s, d), "hazard-cells")
    top = hazard.reference_levels(cells).first()
    return hazard.fit_hazard(cells, {"dbin": "0", "severity": "0", "era": f"{C.eras[-1][0]}-{C.eras[-1][1]}", "channel": top["channel"], "family": top["family"]})


def _scales(s: SparkSession, d: str, method: str = "multinomial") -> tuple[DataFrame, DataFrame, DataFrame]:
    return intervals.replayed_scales(_cum(s, d), C, method)


def _intervals(s: SparkSession, d: str, method: str = "multinomial") -> DataFrame:
    return intervals.replayed_intervals(_cum(s, d), C, method)


def _interval_scale(s: SparkSession, d: str, method: str = "multinomial") -> DataFrame:
    rows, kappa, phi = _scales(s, d, method)
    return kappa.join(phi.withColumnRenamed("phi", "phi_net"), "stream").join(intervals.phi_uncentred(rows), "stream").join(intervals.phi_centred(rows).withColumnRenamed("phi", "phi_centred"), "stream")


def _variant_bias(s: SparkSession, d: str) -> DataFrame:
    found = variants.variant_bias(records(s, d), C, SHORT_DELAY, FLOOR_YEAR)
    base = F.max(F.when(F.col("variant") == "base", F.col("rel_bias"))).over(Window.partitionBy("stream", "h"))
    return found.withColumn("delta_vs_base", F.col("rel_bias") - base)


def _by_method(plan: Callable[[SparkSession, str, str], DataFrame]) -> Run:
    """The plan's rows under each bootstrap method."""
    return lambda s, d: reduce(DataFrame.unionByName, [plan(s, d, m).withColumn("method", F.lit(m)) for m in bootstrap.METHODS])


def _live(s: SparkSession, d: str) -> DataFrame:
    """Intervals of the cohorts that still develop at the cutoff, with scales from the replay."""
    _, kappa, phi = _scales(s, d)
    cum, here = _cum(s, d), chainladder.span(C.cutoff)
    fits = chainladder.fit_windows(cum, C, {"long": C.window, "short": C.short_window}, cutoffs=here)
    of = lambda window: F.max(F.when(F.col("window") == window, F.col("F")))
    curves = fits.groupBy("stream", "cutoff", "d").agg(of("long").alias("F"), of("short").alias("F_short"))
    rows = chainladder.nowcast(cum, curves, C, 35, keep=("F", "F_short")).withColumn("stale", F.ln("F") - F.ln("F_short"))
    draws = bootstrap.prediction_draws(cum, curves, replace(C, seed=C.seed + 2), lag=35).select("stream", "cutoff", "t", "draws")
    return intervals.simulate(intervals.with_sigma(rows.join(draws, ["stream", "cutoff", "t"]), kappa), phi, C)


def _bands(s: SparkSession, d: str) -> DataFrame:
    """5 and 95 % points of the resampled nowcasts, by both methods, at every origin of the replay and the current cutoff."""
    cum, cutoffs = _cum(s, d), F.array_union(chainladder.span(C.first_origin, C.last_origin), chainladder.span(C.cutoff))
    curves = chainladder.fit(cum, C, cutoffs=cutoffs)
    parts = [bootstrap.prediction_draws(cum, curves, C, method).withColumn("method", F.lit(method)) for method in bootstrap.METHODS]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("method", "stream", "cutoff", "t", "h", "c_obs", bootstrap.band("draws", 0.05).alias("lo"), bootstrap.band("draws", 0.95).alias("hi"))


def _counter_draws(s: SparkSession, d: str) -> DataFrame:
    """Draws as columns, keyed by the order: a uniform, a normal, and counts whose law depends on the order's price."""
    key, price = (41, F.col("id")), F.col("o_totalprice")
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (price / 20000).alias("mean"), F.floor(price / 1000).cast("double").alias("n"))
    u = random.uniform(*key)
    return rows.select(
        "id", u.alias("u"), random.normal_quantile(u).alias("z"), random.poisson_quantile(u, F.col("mean")).alias("poisson"), random.binomial_quantile(u, F.col("n"), F.lit(0.3)).alias("binomial"),
        random.negative_binomial_draw(F.col("mean"), F.lit(2.5), *key).alias("negative_binomial"),
    )


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return backtest.metrics(_points(s, d))


def _recent_replay(s: SparkSession, d: str) -> DataFrame:
    """The triangle as known at an earlier month, from a stream of record files."""
    source = s.readStream.schema(s.read.parquet(f"{d}/lineitem.parquet").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/lineitem*.parquet")
    orders, parts = s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/part.parquet")
    rows = source.join(orders, source["l_orderkey"] == orders["o_orderkey"]).join(parts, source["l_partkey"] == parts["p_partkey"])
    typed = rows.select(
        F.col("o_orderdate").cast("date").alias("incident"), F.col("l_shipdate").cast("date").alias("receipt"), F.col("o_orderpriority").alias("channel"),
        F.when(F.col("l_quantity") >= 50, 3).when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("severity"),
    )
    cells = stream.streaming_triangle(with_delays(typed, C, FLOOR_YEAR).where("consumer"), C)
    return stream.latest(s, cells, ("stream", "t", "d"), new_folder(s, "cells"))


#: Months of receipts that come together in the replays of streams.
ARRIVAL = 6


def _arrived(s: SparkSession, d: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Flagged records as a stream of cells with their number n, a batch for each few months of receipts, in the order of receipt.

    All records are read and counted once, in parallel; what lands has a row a cell, so each batch is one small file however many records there are.
    """
    counted = records(s, d).where("report_p IS NOT NULL").groupBy("cohort_p", "report_p", "valid_delay", *more).agg(F.count(F.lit(1)).alias("n"))
    rows = stored(counted, "received")
    folder, month = new_folder(s, "landing"), F.col("report_p")
    stream.arrive(rows, folder, [month.between(m, m + ARRIVAL - 1) for m in range(C.t0, C.cutoff + ARRIVAL, ARRIVAL)])
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _finished(s: SparkSession, d: str) -> tuple[DataFrame, StreamingQuery]:
    rows, folder = stream.finished_cohorts(_arrived(s, d), C, "n"), new_folder(s, "finished")
    with stream.small_state(s):
        query = stream.run_available(rows, folder)
    query.awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{folder}/rows"), query


def _finished_cohorts(s: SparkSession, d: str) -> DataFrame:
    return _finished(s, d)[0].select(F.date_format("month", "yyyy-MM").alias("cohort"), "n")


def _late_drops(s: SparkSession, d: str) -> DataFrame:
    """What the watermark left out, by the query's own progress."""
    return s.createDataFrame([stream.dropped_late(_finished(s, d)[1])], "batches bigint, dropped bigint")


def _streaming_nowcast(s: SparkSession, d: str) -> DataFrame:
    """Nowcasts at every origin of the replay, given out by the stream as its months end."""
    arrived = _arrived(s, d, ("delay_m", "severity", "consumer")).where("consumer")
    rows, folder = stream.streaming_nowcast(arrived, C, C.max_lag, C.first_origin, C.last_origin, weight="n"), new_folder(s, "nowcasts")
    with stream.rocksdb(s), stream.small_state(s):
        stream.run_available(rows, folder).awaitTermination()
    return s.read.schema(rows.schema).parquet(f"{folder}/rows")


def _alarm_runs(s: SparkSession, d: str) -> DataFrame:
    """The alarm as a stateful operator over a stream of scores, a batch for each year of months."""
    scores = stored(_z(s, d).select(F.concat_ws("|", *PAIR).alias("stream"), F.col("cutoff").cast("int").alias("cutoff"), F.col("z_nowcast").alias("z")), "z")
    landing, folder = new_folder(s, "scores"), new_folder(s, "alarm-runs")
    stream.arrive(scores, landing, [F.col("cutoff").between(m, m + 11) for m in range(C.t0, C.cutoff + 1, 12)])
    runs = stream.alarm_runs(s.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(landing), C.z_threshold)
    with stream.rocksdb(s):
        stream.run_available(runs, folder).awaitTermination()
    return s.read.schema(runs.schema).parquet(f"{folder}/rows")


CASES = (
    surveillance.Case("one make", makes=("Brand#4",)), surveillance.Case("two families", families=("PROMO", "LARGE"), first=C.t0 + 60),
    surveillance.Case("both named", ("Brand#17", "Brand#7"), ("STANDARD",)), surveillance.Case("every stream", last=C.cutoff - 6),
)


def _case_cum(s: SparkSession, d: str) -> DataFrame:
    rows = surveillance.with_cases(_consumer(s, d).where("severity >= 1"), CASES)
    return cumulative(triangle(rows, C, ("case",)), C, ("case",))


def _case_z(s: SparkSession, d: str) -> DataFrame:
    severe = triangle(_consumer(s, d).where("severity >= 1").withColumn("stream", F.lit("severe")), C)
    return surveillance.z_series(_case_cum(s, d), chainladder.fit(cumulative(severe, C), C).select("cutoff", "d", "F"), C, ("case",))


def _matched_gains(s: SparkSession, d: str) -> DataFrame:
    """Gains where the naive arms alarm as often as the nowcast arm."""
    z = stored(_z(s, d), "z")
    bars = {r["arm"]: r["threshold"] for r in surveillance.matched_thresholds(surveillance.alarm_levels(z, PAIR), C, PAIR).collect()}
    return surveillance.gains(surveillance.first_alarms(z, C, PAIR, bars))


def _udtf_nowcast(s: SparkSession, d: str) -> DataFrame:
    tables.register(s, C)
    _cum(s, d).select("stream", F.col("t").cast("int").alias("t"), F.col("d").cast("int").alias("d"), "c").createOrReplaceTempView("to_nowcast")
    return s.sql("SELECT * FROM nowcast(TABLE(to_nowcast) PARTITION BY stream)")


def _gate_log(s: SparkSession, d: str) -> DataFrame:
    """Gates appended to the log and read back."""
    folder = new_folder(s, "gates")
    bias = backtest.bias_gate(_metrics(s, d), ("all", "severe"))
    sinks.append_gates(sinks.gate(bias, "replay", "bias", "passed", "concat(n, ' streams and ages')"), folder)
    sinks.append_gates(sinks.gate(ingest.row_audit(order_rows(s, d)), "ingest", "rows", "rows_kept > 0", "concat(rows_kept, ' rows')"), folder)
    return sinks.read_gates(s, folder)


def _audit_log(s: SparkSession, d: str) -> DataFrame:
    """Audits of different columns appended to one log, read back and extracted."""
    folder, flagged = new_folder(s, "audits"), _collapsed(s, d)
    sinks.append_audit(ingest.row_audit(order_rows(s, d)), folder, "rows")
    sinks.append_audit(ingest.record_audit(flagged), folder, "records")
    sinks.append_audit(ingest.beyond_cap_by_severity(records(s, d)), folder, "beyond_cap", "severity")
    return sinks.read_audit(s, folder)


def _narrative(s: SparkSession, d: str) -> DataFrame:
    curves = _fit(s, d, chainladder.span(C.cutoff))
    worst = variants.worst_variant(variants.variant_deltas(_variants(s, d), C.horizons))
    return reports.narrative(ingest.row_audit(order_rows(s, d)), curves, worst, backtest.scoreboard(_metrics(s, d), C.horizons))


_TSV_LINE = {1: "cast(l_orderkey AS string)", 3: "concat(' ', lower(p_brand), ' ')", 5: "''", 6: "CASE WHEN l_returnflag = 'A' THEN ' y ' ELSE 'N' END", 7: "date_format(o_orderdate, 'yyyyMMdd')", 8: "'N'", 9: "CASE WHEN l_returnflag = 'R' THEN '2' WHEN l_linenumber = 6 THEN 'NaN' WHEN l_linenumber = 5 THEN '99999999999999999999' ELSE 'x' END", 10: "CASE WHEN l_quantity >= 50 THEN '1' ELSE '' END", 11: "concat(lower(p_type), ':part:', cast(l_linenumber AS string))", 16: "concat(date_format(l_shipdate, 'yyyyMMdd'), CASE WHEN l_linenumber = 4 THEN '123' WHEN l_linenumber = 3 THEN '123456789123' ELSE '' END)", 20: "lower(o_orderpriority)"}


def _tsv(s: SparkSession, d: str) -> DataFrame:
    """Records written as text files, one field too few in some, read back by position and typed."""
    read = lambda n: s.read.parquet(f"{d}/{n}.parquet")
    rows = read("lineitem").join(read("orders"), F.expr("l_orderkey = o_orderkey")).join(read("part"), F.expr("l_partkey = p_partkey"))
    fields = [F.expr(_TSV_LINE.get(i, "'-'")) for i in range(tsv.N_FIELDS)]
    line = F.when(F.col("l_linenumber") == 7, F.concat_ws("\t", *fields[:-1])).otherwise(F.concat_ws("\t", *fields))
    folder = new_folder(s, "tsv")
    rows.select(line.alias("value")).write.text(folder)
    return tsv.typed_rows(tsv.scan_lines(s, folder))


_RATES = "rate_naive:f rate_naive_matched:f rate_nowcast:f"
_TAUS = "tau_naive:i tau_naive_matched:i tau_nowcast:i"
_P = "p25:f p50:f p75:f p90:f p95:f"
_DU_P = ", ".join(f"quantile_cont({{0}}, {q}) AS {k}" for k, q in descriptive.PERCENTILES.items()).format("delay_days")
_HCOLS = " ".join(f"F{h}:f" for h in C.horizons)


def _ecdf_sql(by: str) -> str:
    return "WITH " + o.FLG + o.mature() + f""",
cnt AS (SELECT {by}::VARCHAR AS level, delay_m AS d, count(*) AS k FROM mat WHERE {by} IS NOT NULL GROUP BY ALL)
SELECT level, d, sum(coalesce(k, 0)) OVER (PARTITION BY level ORDER BY d) / n AS F, n
FROM (SELECT level, sum(k) AS n FROM cnt GROUP BY level) CROSS JOIN range(0, {C.max_delay + 1}) g(d) LEFT JOIN cnt USING (level, d)"""


_GAIN = "count(*) AS n, avg(delta) AS mean, median(delta) AS median, quantile_cont(delta, 0.25) AS p25, quantile_cont(delta, 0.75) AS p75, min(delta) AS min, max(delta) AS max, avg((delta >= 1)::INT) AS share_gain, avg((delta = 0)::INT) AS share_zero, avg((delta < 0)::INT) AS share_negative"
_GAIN_ROWS = "SELECT 'naive' AS arm, delta_vs_naive AS delta FROM gns UNION ALL SELECT 'naive_matched', delta_vs_naive_matched FROM gns"
_GAIN_SHAPE = "arm:s n:i mean:f median:f p25:f p75:f min:i max:i share_gain:f share_zero:f share_negative:f"
_GRID = 1 << math.ceil(math.log2(C.z_threshold / 1e-3))
_STEP = C.z_threshold / _GRID

_VARIANTS = "WITH " + o.FLG + f""",
cons AS (SELECT * FROM flg WHERE consumer)""" + o.BURST + f""",
every AS (
  SELECT 'base' AS variant, severity, cohort_p, report_p, delay_m, valid_delay FROM cons
  UNION ALL SELECT 'all_channels', severity, cohort_p, report_p, delay_m, valid_delay FROM flg
  UNION ALL SELECT 'above_floor', severity, cohort_p, report_p, delay_m, valid_delay FROM cons WHERE cohort_p >= {FLOOR_YEAR * 12}
  UNION ALL SELECT 'no_bursts', severity, cohort_p, report_p, delay_m, valid_delay FROM cons ANTI JOIN burst USING (make, family, report_p)
  UNION ALL SELECT 'elapsed_days', severity, cohort_p, cohort_p + floor(delay_days / {C.days_per_month})::INT, floor(delay_days / {C.days_per_month})::INT, valid_delay FROM cons
), vstr AS (SELECT *, unnest(CASE WHEN severity >= 1 THEN ['all', 'Y' || severity, 'severe'] ELSE ['all', 'Y' || severity] END) AS stream FROM every)""" + o.cells("vstr", "variant, stream") + o.curve(by="variant, stream") + """,
bcum AS (SELECT stream, t, d, c FROM cum WHERE variant = 'base')""" + o.curve(C.short_window, p="sw", cum="bcum") + o.curve(C.cutoff - C.t0, p="ah", cum="bcum") + """,
bstr AS (SELECT * FROM vstr WHERE variant = 'base')""" + o.cells("bstr", "stream", SHORT_DELAY, "sd") + o.curve(d_max=SHORT_DELAY, p="sd", cum="sdcum") + f""",
vcur AS (
  SELECT variant, stream, d, F FROM cur WHERE cutoff = {C.cutoff} UNION ALL SELECT 'short_window', stream, d, F FROM swcur WHERE cutoff = {C.cutoff}
  UNION ALL SELECT 'all_history', stream, d, F FROM ahcur WHERE cutoff = {C.cutoff} UNION ALL SELECT 'short_delay', stream, d, F FROM sdcur WHERE cutoff = {C.cutoff}
), vdel AS (SELECT variant, stream, d AS h, F AS value, F - max(F) FILTER (WHERE variant = 'base') OVER (PARTITION BY stream, d) AS delta_vs_base FROM vcur WHERE d IN {C.horizons})"""
_H = f"d IN {C.horizons}"


def _case_sql() -> str:
    """Scores of the named cases: those of pairs, with the case in place of the make and without a test of size."""
    listed = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    holds = lambda c: " AND ".join([f"{k} IN {listed(v)}" for k, v in (("make", c.makes), ("family", c.families)) if v] or ["true"])
    rows = " UNION ALL ".join(f"SELECT * REPLACE ('{c.name}' AS make, '-' AS family) FROM flg WHERE consumer AND severity >= 1 AND {holds(c)}" for c in CASES)
    text = o.ALARMS.replace("sev AS (SELECT * FROM flg WHERE consumer AND severity >= 1)", f"sev AS ({rows})")
    inside = lambda month: " OR ".join(f"(make = '{c.name}'" + (f" AND {month} >= {c.first}" if c.first is not None else "") + (f" AND {month} <= {c.last}" if c.last is not None else "") + ")" for c in CASES)
    head, tail = text.split(" HAVING sum(c)", 1)
    text = head + tail[tail.index("\n)") :]
    text = text.replace("FROM zs WINDOW", f"FROM (SELECT * FROM zs WHERE {inside('cutoff')}) WINDOW")
    return "WITH " + text + f""",
dn AS (SELECT make, max(c) AS peak, sum(c) AS total FROM mcum WHERE d = {C.max_delay} AND ({inside('t')}) GROUP BY make),
mz AS (SELECT make, max(z_naive) AS max_z_naive, max(z_naive_matched) AS max_z_naive_matched, max(z_nowcast) AS max_z_nowcast FROM zs WHERE {inside('cutoff')} GROUP BY make)"""


_RUN3 = ", ".join(f"CASE WHEN lag(z_{a}, 2) OVER w IS NOT NULL THEN least(z_{a}, lag(z_{a}) OVER w, lag(z_{a}, 2) OVER w) END AS level_{a}" for a in ("naive", "naive_matched", "nowcast"))


#: Records by batch of receipt; `before` is the watermark that a batch's late records are held against, two batches back.
_STREAMED = o.FLG + f""",
arr AS (SELECT (report_p - {C.t0}) // {ARRIVAL} AS b, make_timestamp(cohort_p // 12, cohort_p % 12 + 1, 1, 0, 0, 0) AS m FROM flg WHERE valid_delay AND report_p >= {C.t0} AND (report_p - {C.t0}) // {ARRIVAL} <= {(C.cutoff + ARRIVAL - 1 - C.t0) // ARRIVAL}),
wm AS (SELECT b, seen, lag(seen, 2) OVER (ORDER BY b) AS before FROM (SELECT b, max(max(m)) OVER (ORDER BY b) - INTERVAL {31 * (C.max_delay + 1)} DAY AS seen FROM arr GROUP BY b))"""


def _variant_coverage_sql() -> str:
    few = replace(C, draws=VARIANT_DRAWS)
    base = lambda name, cum="bcum": f"SELECT '{name}/' || stream AS stream, t, d, c FROM {cum}"
    return od.variant_coverage(_VARIANTS, [
        ("va", "vacum", "SELECT variant || '/' || stream AS stream, t, d, c FROM cum", few), ("vb", "vbcum", base("short_window"), replace(few, window=C.short_window)),
        ("vc", "vccum", base("all_history"), replace(few, window=C.cutoff - C.t0)), ("vd", "vdcum", base("short_delay", "sdcum"), replace(few, max_delay=SHORT_DELAY)),
    ])


def _self_audit_sql() -> str:
    """The checks' cases and differences; factors and leakage by curves over all cutoffs and over what was known."""
    at, gap = C.last_origin, "coalesce(max({0}), 0)"
    checks = {
        "delays": ("date_diff('month', date_trunc('month', incident), date_trunc('month', receipt)) - delay_m", "flg WHERE has_both_dates"),
        "cells": ("n - m", "(SELECT sum(n) AS n FROM tri WHERE stream = 'all'), (SELECT count(*) AS m FROM flg WHERE consumer AND in_triangle)"),
        "factors": ("lam - plain", f"(SELECT * FROM fac WHERE cutoff = {at}) JOIN plain USING (stream, d)"),
        "maturity": ("greatest(0, F - coalesce(later, 1))", f"(SELECT F, lead(F) OVER (PARTITION BY stream ORDER BY d) AS later FROM cur WHERE cutoff = {at})"),
        "leakage": ("f.lam - k.lam", f"fac f JOIN kfac k USING (stream, cutoff, d) WHERE cutoff = {at}"),
        "nowcasts": ("c / F * F - c", f"cum JOIN cur USING (stream, d) WHERE cutoff = {at} AND t BETWEEN cutoff - {C.max_lag} AND cutoff AND d = least(cutoff - t, {C.max_delay})"),
    }
    plain = f"""plain AS (SELECT stream, a.d, greatest(1, sum(b.c) / sum(a.c)) AS plain FROM cum a JOIN cum b USING (stream, t) WHERE b.d = a.d + 1 AND a.t BETWEEN {at} - a.d - 1 - {C.window} AND {at} - a.d - 1 GROUP BY stream, a.d HAVING sum(a.c) > 0)"""
    known = o.cells(f"(SELECT * FROM str WHERE report_p <= {at})", p="k") + o.curve(p="k", cum="kcum")
    rows = " UNION ALL ".join(f"SELECT '{name}' AS \"check\", count(*) AS cases, {gap.format(f'abs({x})')} AS worst FROM {source}" for name, (x, source) in checks.items())
    return "WITH " + o.FIT + known + ", " + plain + f", checks AS ({rows})\nSELECT *, worst <= {audit.TOLERANCE} AS passed FROM checks"


def _audit_sql() -> str:
    """The audits' own texts, unpivoted."""
    parts, sources = [], {"rows": ("row_audit", None), "records": ("record_audit", None), "beyond_cap": ("beyond_cap_by_severity", "severity")}
    for step, (name, key) in sources.items():
        fields = [c.split(":") for c in QUERIES[name].shape.split()]
        for field, kind in fields:
            if field != key:
                value, text = (f'"{field}"::DOUBLE', "NULL::VARCHAR") if kind != "d" else ("NULL::DOUBLE", f'"{field}"::VARCHAR')
                parts.append(f"SELECT '{step}' AS step, {f'{key}::VARCHAR' if key else 'NULL::VARCHAR'} AS key, '{field}' AS field, {value} AS value, {text} AS text FROM {name}_rows")
    return "WITH " + ", ".join(f"{name}_rows AS ({QUERIES[name].sql})" for name, _ in sources.values()) + ", fields AS (" + " UNION ALL ".join(parts) + ")\nSELECT * FROM fields"


def _narrative_sql() -> str:
    """Sentences from the tables of the replay and of the variants, each in a statement of its own."""
    board = f"SELECT count(*) FILTER (WHERE abs(nowcast) < abs(naive) AND abs(nowcast) < abs(one_step)) AS won, count(*) AS n FROM (SELECT stream, h, max(rel_bias) FILTER (WHERE method = 'naive') AS naive, max(rel_bias) FILTER (WHERE method = 'one_step') AS one_step, max(rel_bias) FILTER (WHERE method = 'nowcast') AS nowcast FROM met WHERE origin_set = 'evaluation' AND h IN {C.horizons} GROUP BY ALL)"
    worst = _VARIANTS + " SELECT variant, stream, h FROM vdel WHERE variant <> 'base' ORDER BY abs(delta_vs_base) DESC, variant, stream, h LIMIT 1"
    known = f"SELECT min(d) FILTER (WHERE F >= 0.5) AS half, min(d) FILTER (WHERE F >= 0.9) AS most FROM cur WHERE cutoff = {C.cutoff} AND stream = 'all'"
    lines = [
        "SELECT 1 AS place, 'Of ' || count(*) || ' rows of ' || count(DISTINCT id) || ' records, ' || round(100.0::DOUBLE * count(*) FILTER (WHERE receipt IS NOT NULL AND incident IS NOT NULL) / count(*), 1) || ' % have both dates.' AS line FROM raw",
        f"SELECT 2, 'Half of a cohort has come in after ' || half || ' months, and 90 % after ' || most || '.' FROM ({known})",
        f"SELECT 3, 'Of the other specifications, ' || variant || ' moves maturity most: stream ' || stream || ' after ' || h || ' months.' FROM ({worst})",
        f"SELECT 4, 'The nowcast is nearest in ' || won || ' of ' || n || ' streams and ages.' FROM ({board})",
    ]
    return "WITH " + o.REPLAY + ", told AS (" + " UNION ALL ".join(lines) + ")\nSELECT * FROM told"


QUERIES: dict[str, Query] = {
    "nowcast_current": Query(
        lambda s, d: _now(s, d, C.max_delay).withColumn("cohort", month_label(F.col("t"))), "stream:s cutoff:i t:i cohort:s h:i c_obs:i F:f n_hat:f degenerate:b",
        "WITH " + o.FIT + f"\nSELECT stream, cutoff, u.t, (u.t // 12) || '-' || lpad((u.t % 12 + 1)::VARCHAR, 2, '0') AS cohort, d AS h, u.c AS c_obs, F, u.c / F AS n_hat, u.c = 0 AS degenerate FROM cur JOIN cum u USING (stream, d) WHERE cutoff = {C.cutoff} AND u.t = cutoff - d"),
    "record_flags": Query(
        lambda s, d: records(s, d).select("id", F.col("ord.*"), "*"), "id:i l_linenumber:i l_partkey:i l_suppkey:i report_p:i cohort_p:i delay_m:i delay_days:i severity:i has_both_dates:b neg_delay:b consumer:b pre_floor:b beyond_cap:b valid_delay:b mature:b in_triangle:b",
        "WITH " + o.FLG + "\nSELECT * FROM flg"),
    "collapse_by_id": Query(
        lambda s, d: ingest.collapse(order_rows(s, d)), "id:i receipt:d incident:d severity:i n_rows:i make:s channel:s family:s",
        "WITH " + o.REC + "\nSELECT id, min(receipt) AS receipt, first(incident ORDER BY l_linenumber, l_partkey, l_suppkey) AS incident, max(severity) AS severity, count(*) AS n_rows, first(make ORDER BY l_linenumber, l_partkey, l_suppkey) AS make, first(channel ORDER BY l_linenumber, l_partkey, l_suppkey) AS channel, first(family ORDER BY l_linenumber, l_partkey, l_suppkey) AS family FROM raw GROUP BY id"),
    "row_audit": Query(
        lambda s, d: ingest.row_audit(order_rows(s, d)), "rows_kept:i unique_ids:i receipt_missing:i incident_missing:i both_dates:i both_dates_share:f negative_delay:i receipt_min:d receipt_max:d",
        "WITH " + o.REC + "\nSELECT count(*) AS rows_kept, count(DISTINCT id) AS unique_ids, count(*) FILTER (WHERE receipt IS NULL) AS receipt_missing, count(*) FILTER (WHERE incident IS NULL) AS incident_missing, count(*) FILTER (WHERE receipt IS NOT NULL AND incident IS NOT NULL) AS both_dates, avg((receipt IS NOT NULL AND incident IS NOT NULL)::INT) AS both_dates_share, count(*) FILTER (WHERE receipt < incident) AS negative_delay, min(receipt) AS receipt_min, max(receipt) AS receipt_max FROM raw"),
    "record_audit": Query(
        lambda s, d: ingest.record_audit(_collapsed(s, d)), "records:i multi_row_records:i max_rows_per_id:i both_dates:i both_dates_share:f negative_delay:i consumer_records:i consumer_share:f pre_floor_records:i in_triangle_consumer:i mature_consumer:i beyond_cap_share:f",
        "WITH " + o.REC + ", one AS (SELECT id, min(receipt) AS receipt, first(incident ORDER BY l_linenumber, l_partkey, l_suppkey) AS incident, max(severity) AS severity, count(*) AS n_rows, first(channel ORDER BY l_linenumber, l_partkey, l_suppkey) AS channel FROM raw GROUP BY id)," + o.flagged("one", "flg") + "\nSELECT count(*) AS records, count(*) FILTER (WHERE n_rows > 1) AS multi_row_records, max(n_rows) AS max_rows_per_id, count(*) FILTER (WHERE has_both_dates) AS both_dates, avg(has_both_dates::INT) AS both_dates_share, count(*) FILTER (WHERE neg_delay) AS negative_delay, count(*) FILTER (WHERE consumer) AS consumer_records, avg(consumer::INT) AS consumer_share, count(*) FILTER (WHERE pre_floor) AS pre_floor_records, count(*) FILTER (WHERE consumer AND in_triangle) AS in_triangle_consumer, count(*) FILTER (WHERE consumer AND mature) AS mature_consumer, avg(beyond_cap::INT) FILTER (WHERE consumer AND mature) AS beyond_cap_share FROM flg"),
    "channel_top15": Query(lambda s, d: ingest.value_counts(order_rows(s, d), "channel", 15), "value:s n:i", "WITH " + o.REC + "\nSELECT channel AS value, count(*) AS n FROM raw GROUP BY 1 ORDER BY n DESC, value LIMIT 15"),
    "severity_counts": Query(lambda s, d: ingest.value_counts(order_rows(s, d), "severity"), "value:i n:i", "WITH " + o.REC + "\nSELECT severity AS value, count(*) AS n FROM raw GROUP BY 1"),
    "beyond_cap_by_severity": Query(
        lambda s, d: ingest.beyond_cap_by_severity(records(s, d)), "severity:i n:i beyond_cap_share:f",
        "WITH " + o.FLG + "\nSELECT severity, count(*) AS n, avg(beyond_cap::INT) AS beyond_cap_share FROM flg WHERE consumer AND mature GROUP BY GROUPING SETS ((severity), ())"),
    "tsv_round_trip": Query(
        _tsv, "odino:i receipt:d incident:d ldate_i:i make:s channel:s family:s severity:i crash:b fire:b injured:i deaths:i",
        "WITH " + o.REC + ", z AS (SELECT *, l_returnflag, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 7)\nSELECT l_orderkey AS odino, CASE WHEN l_linenumber NOT IN (3, 4) THEN l_shipdate::DATE END AS receipt, o_orderdate::DATE AS incident, CASE WHEN l_linenumber <> 3 THEN (strftime(l_shipdate, '%Y%m%d') || CASE WHEN l_linenumber = 4 THEN '123' ELSE '' END)::BIGINT END AS ldate_i, upper(p_brand) AS make, upper(o_orderpriority) AS channel, upper(p_type) AS family, CASE WHEN l_quantity >= 50 THEN 3 WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS severity, l_returnflag = 'A' AS crash, false AS fire, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS injured, CASE WHEN l_quantity >= 50 THEN 1 ELSE 0 END AS deaths FROM z"),
    "month_labels": Query(
        lambda s, d: records(s, d).select("cohort_p").distinct().withColumn("label", month_label(F.col("cohort_p"))).withColumn("back", parse_month_label(F.col("label"))), "cohort_p:i label:s back:i",
        "WITH " + o.FLG + "\nSELECT DISTINCT cohort_p, strftime(date_trunc('month', incident), '%Y-%m') AS label, cohort_p AS back FROM flg"),
    "delay_quantiles": Query(
        lambda s, d: descriptive.quantile_table(_mature(s, d, day_level=True), C), f"group:s level:s n:i {_P} mean:f",
        "WITH " + o.FLG + o.mature(day=True) + f"""\nSELECT * FROM (SELECT 'overall' AS "group", 'all' AS level, count(*) AS n, {_DU_P}, avg(delay_days) AS mean FROM mat UNION ALL SELECT 'severity', severity::VARCHAR, count(*), {_DU_P}, avg(delay_days) FROM mat GROUP BY severity
  UNION ALL SELECT 'channel', channel, count(*), {_DU_P}, avg(delay_days) FROM mat GROUP BY channel HAVING count(*) >= {C.min_group} UNION ALL SELECT 'era', coalesce(era, 'all'), count(*), {_DU_P}, avg(delay_days) FROM mat GROUP BY era HAVING count(*) >= {C.min_group})"""),
    "price_quantiles": Query(
        lambda s, d: descriptive.selected_quantiles(s.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", ("l_returnflag", "l_linestatus")), f"l_returnflag:s l_linestatus:s n:i {_P}",
        "\nSELECT l_returnflag, l_linestatus, count(*) AS n, " + ", ".join(f"quantile_cont(l_extendedprice::DOUBLE, {q}) AS {k}" for k, q in descriptive.PERCENTILES.items()) + " FROM lineitem GROUP BY ALL"),
    **{f"ecdf_{n}": Query(lambda s, d, by=by: descriptive.ecdf(_mature(s, d), by, C), "level:s d:i F:f n:i", _ecdf_sql(by)) for n, by in (("severity", "severity"), ("channel", "channel"), ("era", "era"))},
    "F_at_horizons": Query(
        lambda s, d: descriptive.at_horizons(descriptive.ecdf(_mature(s, d), "severity", C), C.horizons), f"level:s {_HCOLS}",
        "WITH " + _ecdf_sql("severity").removeprefix("WITH ").replace("\nSELECT level", ", e AS (SELECT level", 1) + ")\nSELECT level, " + ", ".join(f"max(F) FILTER (WHERE d = {h}) AS F{h}" for h in C.horizons) + " FROM e GROUP BY level"),
    "pooled_ecdf": Query(
        lambda s, d: reports.pooled_ecdf(descriptive.ecdf(_mature(s, d), "severity", C)), "d:i F:f",
        "WITH " + o.FLG + o.mature() + f"\nSELECT g.d, count(*) FILTER (WHERE delay_m <= g.d) / count(*) AS F FROM mat, range(0, {C.max_delay + 1}) g(d) GROUP BY g.d"),
    "delay_drift": Query(
        lambda s, d: descriptive.drift(_mature(s, d, day_level=True)), "cohort_year:i severity:i n:i p25:f p50:f p75:f",
        "WITH " + o.FLG + o.mature(day=True) + "\nSELECT cohort_year, coalesce(severity, -1) AS severity, count(*) AS n, quantile_cont(delay_days, 0.25) AS p25, quantile_cont(delay_days, 0.5) AS p50, quantile_cont(delay_days, 0.75) AS p75 FROM mat GROUP BY GROUPING SETS ((cohort_year, severity), (cohort_year))"),
    "spec_grid": Query(
        lambda s, d: descriptive.spec_grid(records(s, d), C, FLOOR_YEAR), "spec:s severity:i n:i median_days:f",
        "WITH " + o.FLG + o.mature(False, True) + f"\nSELECT spec, severity, count(*) AS n, median(delay_days) AS median_days FROM mat, (VALUES ('all/none', false, 0), ('consumer/none', true, 0), ('all/floor', false, {FLOOR_YEAR * 12}), ('consumer/floor', true, {FLOOR_YEAR * 12})) g(spec, narrow, low) WHERE (consumer OR NOT narrow) AND cohort_p >= low GROUP BY ALL"),
    "ks_statistic": Query(
        lambda s, d: descriptive.ks_two_sample(_mature(s, d, day_level=True), "delay_days", F.col("severity") == 3, F.col("severity") == 0), "n1:i n2:i D:f",
        "WITH " + o.FLG + o.mature(day=True) + ", v AS (SELECT delay_days AS v, count(*) FILTER (WHERE severity = 3) AS a, count(*) FILTER (WHERE severity = 0) AS b FROM mat GROUP BY 1)\nSELECT max(na) AS n1, max(nb) AS n2, max(abs(fa - fb)) AS D FROM (SELECT sum(a) OVER () AS na, sum(b) OVER () AS nb, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM v)"),
    "triangle_cells": Query(_tri, "stream:s t:i d:i n:i", "WITH " + o.BASE + "\nSELECT * FROM tri"),
    "triangle_dense": Query(lambda s, d: dense(_tri(s, d), C), "stream:s t:i d:i n:i", "WITH " + o.BASE + "\nSELECT * FROM grid"),
    "cumulative_triangle": Query(_cum, "stream:s t:i d:i c:i", "WITH " + o.BASE + "\nSELECT * FROM cum"),
    "censored_triangle": Query(lambda s, d: as_known_at(_tri(s, d), C.last_origin), "stream:s t:i d:i n:i", "WITH " + o.BASE + f"\nSELECT * FROM tri WHERE t + d <= {C.last_origin}"),
    "dev_factors_all_cutoffs": Query(lambda s, d: chainladder.dev_factors(_cum(s, d), C), "stream:s cutoff:i d:i lam:f used:i", "WITH " + o.FIT + "\nSELECT * FROM fac"),
    "maturity_curve": Query(_fit, "stream:s cutoff:i d:i lam:f F:f", "WITH " + o.FIT + "\nSELECT * FROM cur"),
    "onestep_curve": Query(lambda s, d: chainladder.one_step(_cum(s, d), C), "stream:s cutoff:i d:i F1:f", "WITH " + o.BASE + o.ONE + "\nSELECT * FROM one"),
    "nowcast_points": Query(
        lambda s, d: _now(s, d).withColumn("missing", F.col("n_hat") - F.col("c_obs")), "stream:s cutoff:i t:i h:i c_obs:i n_hat:f missing:f degenerate:b",
        "WITH " + o.FIT + f"\nSELECT stream, cutoff, t, d AS h, u.c AS c_obs, u.c / F AS n_hat, u.c / F - u.c AS missing, u.c = 0 AS degenerate FROM cum u JOIN cur USING (stream, d) WHERE cutoff = {C.cutoff} AND t BETWEEN cutoff - 24 AND cutoff AND d = least(cutoff - t, {C.max_delay})"),
    "undercount_curves": Query(
        _undercount, "W:s stream:s d:i F:f undercount:f",
        "WITH " + o.FIT + o.curve(12, p="a") + o.curve(C.cutoff - C.t0, p="b") + f"\nSELECT *, 1 - F AS undercount FROM (SELECT '24' AS W, stream, d, F FROM cur WHERE cutoff = {C.cutoff} UNION ALL SELECT '12', stream, d, F FROM acur WHERE cutoff = {C.cutoff} UNION ALL SELECT 'all-history', stream, d, F FROM bcur WHERE cutoff = {C.cutoff})"),
    "backtest_points": Query(_points, "stream:s cutoff:i t:i h:i c_obs:i n_hat:f n_one_step:f f_hat:f f_one_step:f stale:f realized:i train:b degenerate:b", "WITH " + o.REPLAY + "\nSELECT * FROM pts"),
    "backtest_metrics_point": Query(_metrics, "stream:s h:i method:s origin_set:s n:i rel_bias:f median_rel_bias:f mape:f rmse:f mean_realized:f", "WITH " + o.REPLAY + "\nSELECT * FROM met"),
    "scoreboard_pivot": Query(
        lambda s, d: backtest.scoreboard(_metrics(s, d), C.horizons), "stream:s h:i naive:f one_step:f nowcast:f nowcast_wins:b",
        "WITH " + o.REPLAY + f", piv AS (SELECT stream, h, max(rel_bias) FILTER (WHERE method = 'naive') AS naive, max(rel_bias) FILTER (WHERE method = 'one_step') AS one_step, max(rel_bias) FILTER (WHERE method = 'nowcast') AS nowcast FROM met WHERE origin_set = 'evaluation' AND h IN {C.horizons} GROUP BY ALL)\nSELECT *, abs(nowcast) < abs(naive) AND abs(nowcast) < abs(one_step) AS nowcast_wins FROM piv"),
    "bias_gate": Query(
        lambda s, d: backtest.bias_gate(_metrics(s, d), ("Y2", "Y3")), "passed:b n:i",
        "WITH " + o.REPLAY + "\nSELECT bool_and(nowcast < naive) AS passed, count(*) AS n FROM (SELECT stream, h, max(abs(rel_bias)) FILTER (WHERE method = 'naive') AS naive, max(abs(rel_bias)) FILTER (WHERE method = 'nowcast') AS nowcast FROM met WHERE stream IN ('Y2', 'Y3') AND h <= 12 AND origin_set = 'evaluation' GROUP BY ALL)"),
    "calibration_ratio": Query(lambda s, d: reports.calibration(_points(s, d)), "stream:s cutoff:i t:i h:i ratio:f", "WITH " + o.REPLAY + "\nSELECT stream, cutoff, t, h, n_hat / realized AS ratio FROM pts WHERE realized > 0"),
    "rolling24_eligibility": Query(lambda s, d: surveillance.eligible_streams(_pair_cum(s, d), C, PAIR), "make:s family:s rows:i peak:i", "WITH " + o._Z + "\nSELECT * FROM eli"),
    "z_series": Query(_z, "make:s family:s cutoff:i obs:i nowcast:f mu_naive:f sd_naive:f z_naive:f mu_naive_matched:f sd_naive_matched:f z_naive_matched:f mu_nowcast:f sd_nowcast:f z_nowcast:f", "WITH " + o._Z + "\nSELECT * FROM zs"),
    "alarm_levels": Query(lambda s, d: surveillance.alarm_levels(_z(s, d), PAIR), "make:s family:s cutoff:i level_naive:f level_naive_matched:f level_nowcast:f", "WITH " + o._LEVELS + "\nSELECT * FROM lev"),
    "first_alarms": Query(lambda s, d: surveillance.first_alarms(_z(s, d), C, PAIR), f"make:s family:s {_TAUS}", "WITH " + o.ALARMS + "\nSELECT * FROM alm"),
    "detection_gains": Query(_gains, f"make:s family:s {_TAUS} delta_vs_naive:i delta_vs_naive_matched:i", "WITH " + o.ALARMS + "\nSELECT * FROM gns"),
    "gain_summary": Query(lambda s, d: surveillance.gain_summary(_gains(s, d)), _GAIN_SHAPE, "WITH " + o.ALARMS + f"\nSELECT arm, {_GAIN} FROM ({_GAIN_ROWS}) WHERE delta IS NOT NULL GROUP BY arm"),
    "gain_summary_within12": Query(lambda s, d: surveillance.gain_summary(_gains(s, d), 12), _GAIN_SHAPE, "WITH " + o.ALARMS + f"\nSELECT arm, {_GAIN} FROM ({_GAIN_ROWS}) WHERE abs(delta) <= 12 GROUP BY arm"),
    "alarm_rates": Query(
        lambda s, d: surveillance.alarm_rates(surveillance.first_alarms(_z(s, d), C, PAIR)), f"streams:i {_RATES} nowcast_only:i naive_only:i neither:i",
        "WITH " + o.ALARMS + "\nSELECT count(*) AS streams, avg((tau_naive IS NOT NULL)::INT) AS rate_naive, avg((tau_naive_matched IS NOT NULL)::INT) AS rate_naive_matched, avg((tau_nowcast IS NOT NULL)::INT) AS rate_nowcast, count(*) FILTER (WHERE tau_nowcast IS NOT NULL AND tau_naive IS NULL) AS nowcast_only, count(*) FILTER (WHERE tau_naive IS NOT NULL AND tau_nowcast IS NULL) AS naive_only, count(*) FILTER (WHERE tau_naive IS NULL AND tau_nowcast IS NULL) AS neither FROM alm"),
    "matched_thresholds": Query(
        lambda s, d: surveillance.matched_thresholds(surveillance.alarm_levels(_z(s, d), PAIR), C, PAIR), "arm:s target:i threshold:f",
        "WITH " + o.ALARMS + f""",
pk AS (SELECT make, family, max(level_naive) AS naive, max(level_naive_matched) AS naive_matched, max(level_nowcast) AS nowcast FROM lev GROUP BY ALL),
tg AS (SELECT count(*) FILTER (WHERE nowcast > {C.z_threshold}) AS target FROM pk),
ar AS (SELECT 'naive' AS arm, naive AS peak FROM pk UNION ALL SELECT 'naive_matched', naive_matched FROM pk)
SELECT arm, target, CASE WHEN target = 0 THEN {C.z_threshold} ELSE (SELECT max(i) FROM range(0, {_GRID + 1}) g(i) WHERE i = 0 OR (SELECT count(*) FROM ar b WHERE b.arm = a.arm AND b.peak > i * {_STEP}) >= target) * {_STEP} END AS threshold FROM (SELECT DISTINCT arm, target FROM ar, tg) a"""),
    "matched_gain_summary": Query(
        lambda s, d: surveillance.gain_summary(_matched_gains(s, d)), _GAIN_SHAPE,
        "WITH " + o.ALARMS + f""",
pk AS (SELECT make, family, max(level_naive) AS naive, max(level_naive_matched) AS naive_matched, max(level_nowcast) AS nowcast FROM lev GROUP BY ALL),
tg AS (SELECT count(*) FILTER (WHERE nowcast > {C.z_threshold}) AS target FROM pk),
ar AS (SELECT 'naive' AS arm, naive AS peak FROM pk UNION ALL SELECT 'naive_matched', naive_matched FROM pk),
th AS (SELECT arm, CASE WHEN target = 0 THEN {C.z_threshold} ELSE (SELECT max(i) FROM range(0, {_GRID + 1}) g(i) WHERE i = 0 OR (SELECT count(*) FROM ar b WHERE b.arm = a.arm AND b.peak > i * {_STEP}) >= target) * {_STEP} END AS bar FROM (SELECT DISTINCT arm, target FROM ar, tg) a),
ma AS (SELECT make, family, min(cutoff) FILTER (WHERE level_naive > (SELECT bar FROM th WHERE arm = 'naive')) AS n1, min(cutoff) FILTER (WHERE level_naive_matched > (SELECT bar FROM th WHERE arm = 'naive_matched')) AS n2, min(cutoff) FILTER (WHERE level_nowcast > {C.z_threshold}) AS n0 FROM lev GROUP BY ALL)
SELECT arm, {_GAIN} FROM (SELECT 'naive' AS arm, n1 - n0 AS delta FROM ma UNION ALL SELECT 'naive_matched', n2 - n0 FROM ma) WHERE delta IS NOT NULL GROUP BY arm"""),
    "first_alarms_in_three": Query(
        lambda s, d: surveillance.first_alarms(_z(s, d), C, PAIR, in_a_row=3), f"make:s family:s {_TAUS}",
        "WITH " + o.ALARMS + f""", l3 AS (SELECT make, family, cutoff, {_RUN3} FROM zs WINDOW w AS (PARTITION BY make, family ORDER BY cutoff))
SELECT make, family, {", ".join(f"min(cutoff) FILTER (WHERE level_{a} > {C.z_threshold}) AS tau_{a}" for a in ("naive", "naive_matched", "nowcast"))} FROM l3 GROUP BY make, family"""),
    "alarm_runs": Query(
        _alarm_runs, "stream:s cutoff:i run:i",
        "WITH " + o.ALARMS + f""", ov AS (SELECT make || '|' || family AS stream, cutoff, cutoff - row_number() OVER (PARTITION BY make, family ORDER BY cutoff) AS island FROM zs WHERE z_nowcast > {C.z_threshold}),
rn AS (SELECT stream, cutoff, row_number() OVER (PARTITION BY stream, island ORDER BY cutoff) AS run FROM ov)
SELECT stream, cutoff, run FROM rn WHERE run >= 2"""),
    "detection_trace": Query(
        lambda s, d: (lambda z: reports.detection_trace(z, surveillance.first_alarms(z, C, PAIR), PAIR))(_z(s, d)), f"make:s family:s cutoff:i obs:i z_naive:f z_naive_matched:f z_nowcast:f {_TAUS}",
        "WITH " + o.ALARMS + "\nSELECT * FROM zs JOIN alm USING (make, family)"),
    "case_traces": Query(
        lambda s, d: surveillance.case_window(_case_z(s, d), CASES, "cutoff"), "case:s cutoff:i obs:i nowcast:f z_naive:f z_naive_matched:f z_nowcast:f",
        _case_sql() + "\nSELECT make AS \"case\", cutoff, obs, nowcast, z_naive, z_naive_matched, z_nowcast FROM zs WHERE make IN (SELECT make FROM dn) AND (make, cutoff) IN (SELECT make, cutoff FROM lev)"),
    "named_cases": Query(
        lambda s, d: surveillance.case_records(_case_cum(s, d), _case_z(s, d), CASES, C), f"case:s peak:i total:i status:s {_TAUS} max_z_naive:f max_z_naive_matched:f max_z_nowcast:f outcome:s",
        _case_sql() + """
SELECT make AS "case", peak, total, CASE WHEN peak < 5 THEN 'dropped' ELSE 'evaluated' END AS status,
  CASE WHEN peak >= 5 THEN tau_naive END AS tau_naive, CASE WHEN peak >= 5 THEN tau_naive_matched END AS tau_naive_matched, CASE WHEN peak >= 5 THEN tau_nowcast END AS tau_nowcast,
  CASE WHEN peak >= 5 THEN max_z_naive END AS max_z_naive, CASE WHEN peak >= 5 THEN max_z_naive_matched END AS max_z_naive_matched, CASE WHEN peak >= 5 THEN max_z_nowcast END AS max_z_nowcast,
  CASE WHEN peak < 5 THEN NULL WHEN tau_nowcast IS NOT NULL AND tau_naive IS NOT NULL THEN 'both' WHEN tau_nowcast IS NOT NULL THEN 'nowcast only' WHEN tau_naive IS NOT NULL THEN 'comparator only' ELSE 'neither alarms' END AS outcome
FROM dn LEFT JOIN alm USING (make) LEFT JOIN mz USING (make)"""),
    "late_records": Query(
        lambda s, d: stream.late_records(records(s, d), C).groupBy("cohort_p").agg(F.count(F.lit(1)).alias("n")), "cohort_p:i n:i",
        "WITH " + o.FLG + "\nSELECT cohort_p, count(*) AS n FROM flg WHERE beyond_cap GROUP BY cohort_p"),
    "finished_cohorts": Query(_finished_cohorts, "cohort:s n:i", "WITH " + _STREAMED + "\nSELECT strftime(m, '%Y-%m') AS cohort, count(*) AS n FROM arr JOIN wm USING (b) WHERE (before IS NULL OR m > before) AND m <= (SELECT max(seen) FROM wm) GROUP BY m"),
    "late_drops": Query(_late_drops, "batches:i dropped:i", "WITH " + _STREAMED + "\nSELECT count(DISTINCT b) AS batches, count(DISTINCT (b, m)) FILTER (WHERE m <= before) AS dropped FROM arr JOIN wm USING (b)"),
    "streaming_nowcast": Query(
        _streaming_nowcast, "stream:s cutoff:i t:i h:i c_obs:i n_hat:f",
        "WITH " + o.FIT + f"\nSELECT stream, cutoff, t, d AS h, u.c AS c_obs, u.c / F AS n_hat FROM cum u JOIN cur USING (stream, d) WHERE cutoff BETWEEN {C.first_origin} AND {C.last_origin} AND t BETWEEN cutoff - {C.max_lag} AND cutoff AND d = least(cutoff - t, {C.max_delay})"),
    "udtf_nowcast": Query(
        _udtf_nowcast, "stream:s cutoff:i t:i h:i n_hat:f missing:f",
        "WITH " + o.FIT + f"\nSELECT stream, cutoff, u.t, d AS h, u.c / F AS n_hat, u.c / F - u.c AS missing FROM cur JOIN cum u USING (stream, d) WHERE cutoff = {C.cutoff} AND u.t = cutoff - d"),
    "gate_log": Query(_gate_log, "step:s gate:s passed:b detail:s",
        "WITH " + o.REPLAY + ", pq AS (SELECT stream, h, max(abs(rel_bias)) FILTER (WHERE method = 'naive') AS naive, max(abs(rel_bias)) FILTER (WHERE method = 'nowcast') AS nowcast FROM met WHERE stream IN ('all', 'severe') AND h <= 12 AND origin_set = 'evaluation' GROUP BY ALL), gates AS (SELECT 'replay' AS step, 'bias' AS gate, bool_and(nowcast < naive) AS passed, count(*) || ' streams and ages' AS detail FROM pq UNION ALL SELECT 'ingest', 'rows', count(*) > 0, count(*) || ' rows' FROM raw)\nSELECT * FROM gates"),
    "self_audit": Query(
        lambda s, d: audit.self_audit(records(s, d), _tri(s, d), C, C.last_origin), "check:s cases:i worst:f passed:b", _self_audit_sql()),
    "narrative": Query(_narrative, "place:i line:s",
        _narrative_sql()),
    "hazard_forest": Query(lambda s, d: reports.hazard_forest(_hazard_fit(s, d)), "term:s hr:f hr_lo95:f hr_hi95:f"),
    "backtest_metrics": Query(
        lambda s, d: backtest.with_interval_coverage(_metrics(s, d), _intervals(s, d)), "stream:s h:i method:s origin_set:s n:i rel_bias:f median_rel_bias:f mape:f rmse:f mean_realized:f cov50:f cov90:f",
        od.METRICS),
    "atlas_glyphs": Query(
        lambda s, d: reports.atlas_glyphs(reports.atlas(_mature(s, d, day_level=True), descriptive.ecdf(_mature(s, d), "severity", C), C.horizons)), "level:s x_p25:f x_p50:f x_p75:f x_p90:f",
        "WITH " + o.FLG + o.mature(day=True) + "\nSELECT level, " + ", ".join(f"least(1, log10(1 + greatest({c}, 0)) / log10(1201)) AS x_{c}" for c in ("p25", "p50", "p75", "p90"))
        + " FROM (SELECT severity::VARCHAR AS level, quantile_cont(delay_days, 0.25) AS p25, quantile_cont(delay_days, 0.5) AS p50, quantile_cont(delay_days, 0.75) AS p75, quantile_cont(delay_days, 0.9) AS p90 FROM mat GROUP BY severity)"),
    "case_status": Query(
        lambda s, d: surveillance.case_status(_pair_cum(s, d), surveillance.first_alarms(_z(s, d), C, PAIR), C, PAIR), "make:s family:s peak:i total:i status:s outcome:s",
        "WITH " + o.ALARMS + f"\nSELECT make, family, max(c) AS peak, sum(c) AS total, CASE WHEN max(c) < 5 THEN 'dropped' ELSE 'evaluated' END AS status, CASE WHEN any_value(tau_nowcast) IS NOT NULL AND any_value(tau_naive) IS NOT NULL THEN 'both' WHEN any_value(tau_nowcast) IS NOT NULL THEN 'nowcast only' WHEN any_value(tau_naive) IS NOT NULL THEN 'comparator only' ELSE 'neither alarms' END AS outcome FROM mcum LEFT JOIN alm USING (make, family) WHERE d = {C.max_delay} GROUP BY make, family"),
    "burst_cells": Query(lambda s, d: variants.burst_cells(_consumer(s, d), C), "make:s family:s report_p:i n:i median_n:f", "WITH " + o.FLG + ", cons AS (SELECT * FROM flg WHERE consumer)" + o.BURST + "\nSELECT * FROM burst"),
    "burst_excluded_counts": Query(
        lambda s, d: variants.without_bursts(_consumer(s, d), C).groupBy("make").agg(F.count(F.lit(1)).alias("n")), "make:s n:i",
        "WITH " + o.FLG + ", cons AS (SELECT * FROM flg WHERE consumer)" + o.BURST + "\nSELECT make, count(*) AS n FROM cons ANTI JOIN burst USING (make, family, report_p) GROUP BY make"),
    "variant_maturity": Query(_variants, "variant:s stream:s d:i F:f", _VARIANTS + "\nSELECT * FROM vcur"),
    "variant_delta": Query(lambda s, d: variants.variant_deltas(_variants(s, d), C.horizons), "variant:s stream:s h:i value:f delta_vs_base:f", _VARIANTS + "\nSELECT * FROM vdel"),
    "robustness_table": Query(
        lambda s, d: (lambda x: reports.robustness(x, variants.largest_deltas(x)))(variants.variant_deltas(_variants(s, d), C.horizons)), "variant:s value:f delta_vs_base:f max_delta:f n:i",
        _VARIANTS + ", mx AS (SELECT variant, max(abs(delta_vs_base)) AS max_delta, count(*) AS n FROM vdel GROUP BY variant)\nSELECT variant, value, delta_vs_base, max_delta, n FROM vdel JOIN mx USING (variant) WHERE stream = 'all' AND h = 1"),
    "variant_records": Query(
        lambda s, d: variants.variant_records(records(s, d), C, FLOOR_YEAR), "variant:s n:i delta_vs_base:i",
        _VARIANTS + """, cnt AS (
  SELECT variant, count(*) AS n FROM every WHERE valid_delay GROUP BY variant UNION ALL SELECT unnest(['short_window', 'all_history', 'short_delay']), count(*) FROM every WHERE valid_delay AND variant = 'base')
SELECT variant, n, n - max(n) FILTER (WHERE variant = 'base') OVER () AS delta_vs_base FROM cnt"""),
    "variant_bias": Query(
        _variant_bias, "variant:s stream:s h:i n:i rel_bias:f delta_vs_base:f",
        _VARIANTS + ", vb AS (" + " UNION ALL ".join(
            f"SELECT {name} AS variant, l.stream, u.d AS h, count(*) AS n, avg((u.c / l.F - r.c) / r.c) AS rel_bias FROM {p}cur l JOIN {cum} u USING ({keys}, d) JOIN {cum} r USING ({keys}, t) "
            f"WHERE l.cutoff BETWEEN {C.last_training_origin + 1} AND {C.last_origin} AND u.d = least(l.cutoff - u.t, {top}) AND u.t BETWEEN l.cutoff - {C.max_lag} AND l.cutoff AND r.d = {top} AND r.c > 0 AND u.d IN {C.horizons} GROUP BY ALL"
            for name, p, cum, keys, top in (("l.variant", "", "cum", "variant, stream", C.max_delay), ("'short_window'", "sw", "bcum", "stream", C.max_delay), ("'all_history'", "ah", "bcum", "stream", C.max_delay), ("'short_delay'", "sd", "sdcum", "stream", SHORT_DELAY))
        ) + ")\nSELECT *, rel_bias - max(rel_bias) FILTER (WHERE variant = 'base') OVER (PARTITION BY stream, h) AS delta_vs_base FROM vb"),
    "variant_coverage": Query(lambda s, d: variants.variant_coverage(records(s, d), replace(C, draws=VARIANT_DRAWS), SHORT_DELAY, FLOOR_YEAR), "variant:s stream:s n:i cov90:f",
        _variant_coverage_sql()),
    "worst_variant": Query(
        lambda s, d: variants.worst_variant(variants.variant_deltas(_variants(s, d), C.horizons)), "variant:s stream:s h:i delta_vs_base:f",
        _VARIANTS + "\nSELECT variant, stream, h, delta_vs_base FROM vdel WHERE variant <> 'base' ORDER BY abs(delta_vs_base) DESC, variant, stream, h LIMIT 1"),
    "training_moments": Query(
        lambda s, d: intervals.training_moments(_points(s, d)), "stream:s h:i n:i bias:f total:f pending:f m2:f",
        "WITH " + o.REPLAY + "\nSELECT stream, h, count(*) AS n, avg((realized - n_hat) / n_hat) AS bias, avg(((realized - n_hat) / n_hat) ** 2) AS total, avg(greatest(n_hat - c_obs, 0) / n_hat ** 2) AS pending, avg(stale ** 2) AS m2 FROM pts WHERE train AND n_hat > 1e-9 GROUP BY stream, h"),
    "person_periods": Query(_periods, "severity:i era:s channel:s family:s d:i events:i at_risk:i", "WITH " + o.HAZ + "\nSELECT * FROM per"),
    "hazard_cells": Query(_hazard_cells, "dbin:s severity:i era:s channel:s family:s events:i at_risk:i", "WITH " + o.HC + "\nSELECT * FROM hz"),
    "reference_levels": Query(
        lambda s, d: hazard.reference_levels(_hazard_cells(s, d)), "channel:s family:s",
        "WITH " + o.HC + "\nSELECT (SELECT channel FROM hz GROUP BY channel ORDER BY sum(at_risk) DESC, channel DESC LIMIT 1) AS channel, (SELECT family FROM hz GROUP BY family ORDER BY sum(at_risk) DESC, family DESC LIMIT 1) AS family"),
    "hazard_fit": Query(_hazard_fit, "term:s beta:f se:f hr:f hr_lo95:f hr_hi95:f p:f deviance:f null_deviance:f"),
    "median_difference": Query(lambda s, d: bootstrap.median_difference(_mature(s, d, day_level=True), "delay_days", F.col("severity") == 3, F.col("severity") == 0), "diff:f lo95:f hi95:f"),
    "bootstrap_bands": Query(_bands, "method:s stream:s cutoff:i t:i h:i c_obs:i lo:f hi:f",
        od.BANDS),
    "interval_scale": Query(_interval_scale, "stream:s h:i kappa:f phi:f phi_centred:f phi_net:f",
        od.REPLAYED + od.scales("multinomial") + "\n" + od.SCALES.format(p="")),
    "replayed_intervals": Query(_intervals, "stream:s cutoff:i t:i h:i c_obs:i n_hat:f realized:i lo90:f lo50:f sim_median:f hi50:f hi90:f cov90:b cov50:b train:b",
        od.REPLAYED + od.intervals("multinomial") + "\nSELECT * FROM cov"),
    "coverage": Query(lambda s, d: backtest.coverage(_intervals(s, d)), "stream:s n:i cov90:f cov50:f",
        od.REPLAYED + od.intervals("multinomial") + "\n" + od.COVERAGE.format(p="")),
    "interval_scale_by_method": Query(_by_method(_interval_scale), "method:s stream:s h:i kappa:f phi:f phi_centred:f phi_net:f",
        od.by_method(od.scales, od.SCALES)),
    "replayed_intervals_by_method": Query(_by_method(_intervals), "method:s stream:s cutoff:i t:i h:i c_obs:i n_hat:f realized:i lo90:f lo50:f sim_median:f hi50:f hi90:f cov90:b cov50:b train:b",
        od.by_method(od.intervals, "SELECT * FROM {p}cov")),
    "coverage_by_method": Query(_by_method(lambda s, d, m: backtest.coverage(_intervals(s, d, m))), "method:s stream:s n:i cov90:f cov50:f",
        od.by_method(od.intervals, od.COVERAGE)),
    "coverage_gate": Query(lambda s, d: backtest.coverage_gate(backtest.coverage(_intervals(s, d))), "passed:b least:f most:f",
        od.REPLAYED + od.intervals("multinomial") + ", pool AS (" + od.COVERAGE.format(p="") + ")\nSELECT bool_and(cov90 BETWEEN 0.80 AND 0.97) AS passed, min(cov90) AS least, max(cov90) AS most FROM pool"),
    "coverage_matrix": Query(lambda s, d: reports.coverage_matrix(_intervals(s, d)), "stream:s h:i gap90:f gap50:f",
        od.COVERAGE_MATRIX),
    "live_intervals": Query(_live, "stream:s cutoff:i t:i h:i c_obs:i n_hat:f lo90:f lo50:f sim_median:f hi50:f hi90:f degenerate:b",
        od.live()),
    "counter_draws": Query(_counter_draws, "id:i u:f z:f poisson:i binomial:i negative_binomial:i", od.COUNTERS),
    "visibility_milestones": Query(
        lambda s, d: reports.milestones(_fit(s, d, chainladder.span(C.cutoff))), "stream:s d50:i d75:i d90:i d95:i",
        "WITH " + o.FIT + f"\nSELECT stream, min(d) FILTER (WHERE F >= 0.5) AS d50, min(d) FILTER (WHERE F >= 0.75) AS d75, min(d) FILTER (WHERE F >= 0.9) AS d90, min(d) FILTER (WHERE F >= 0.95) AS d95 FROM cur WHERE cutoff = {C.cutoff} GROUP BY stream"),
    "visibility_deficit": Query(
        lambda s, d: reports.visibility_deficit(_fit(s, d, chainladder.span(C.cutoff)), C.horizons), "stream:s " + " ".join(f"deficit_{h}:f" for h in C.horizons),
        "WITH " + o.FIT + "\nSELECT stream, " + ", ".join(f"1 - max(F) FILTER (WHERE d = {h}) AS deficit_{h}" for h in C.horizons) + f" FROM cur WHERE cutoff = {C.cutoff} GROUP BY stream"),
    "delay_profile": Query(
        lambda s, d: reports.delay_profile(descriptive.ecdf(_mature(s, d), "severity", C)), "level:s d:i F:f n:i median_d:i",
        "WITH " + _ecdf_sql("severity").removeprefix("WITH ").replace("\nSELECT level", ", e AS (SELECT level", 1) + ")\nSELECT *, min(d) FILTER (WHERE F >= 0.5) OVER (PARTITION BY level) AS median_d FROM e"),
    "triangle_heatmap": Query(
        lambda s, d: reports.heatmap(dense(_tri(s, d), C), C), "stream:s t:i d:i log_n:f",
        "WITH " + o.BASE + f"\nSELECT stream, t, d, CASE WHEN t + d <= {C.cutoff} THEN log10(n + 1) END AS log_n FROM grid WHERE t > {C.cutoff - 36}"),
    "nowcast_gap": Query(
        lambda s, d: reports.nowcast_gap(_now(s, d, 35)), "cutoff:i t:i h:i c_obs:i n_hat:f missing:f",
        "WITH " + o.FIT + f"\nSELECT cutoff, t, d AS h, u.c AS c_obs, u.c / F AS n_hat, u.c / F - u.c AS missing FROM cum u JOIN cur USING (stream, d) WHERE stream = 'severe' AND cutoff = {C.cutoff} AND t > cutoff - 24 AND d = least(cutoff - t, {C.max_delay})"),
    "atlas_table": Query(
        lambda s, d: reports.atlas(_mature(s, d, day_level=True), descriptive.ecdf(_mature(s, d), "severity", C), C.horizons), f"level:s n:i share:f p25:f p50:f p75:f p90:f {_HCOLS}",
        "WITH " + o.FLG + o.mature() + o.mature(day=True, name="matd") + "\nSELECT *, n / sum(n) OVER () AS share FROM (SELECT severity::VARCHAR AS level, count(*) AS n, quantile_cont(delay_days, 0.25) AS p25, quantile_cont(delay_days, 0.5) AS p50, quantile_cont(delay_days, 0.75) AS p75, quantile_cont(delay_days, 0.9) AS p90 FROM matd GROUP BY severity) JOIN (SELECT severity::VARCHAR AS level, " + ", ".join(f"count(*) FILTER (WHERE delay_m <= {h}) / count(*) AS F{h}" for h in C.horizons) + " FROM mat GROUP BY severity) USING (level)"),
    "maturity_gap": Query(
        lambda s, d: reports.maturity_gap(_fit(s, d, chainladder.span(C.cutoff)), C.horizons), "stream:s d:i F:f gap:f",
        "WITH " + o.FIT + f"\nSELECT stream, d, F, F - max(F) FILTER (WHERE stream = 'all') OVER (PARTITION BY d) AS gap FROM cur WHERE cutoff = {C.cutoff} AND {_H}"),
    "drift_belts": Query(
        lambda s, d: reports.drift_belts(descriptive.drift(_mature(s, d, day_level=True))), "cohort_year:i severity:i n:i p25:f p50:f p75:f",
        "WITH " + o.FLG + o.mature(day=True) + "\nSELECT * FROM (SELECT cohort_year, coalesce(severity, -1) AS severity, count(*) AS n, quantile_cont(delay_days, 0.25) AS p25, quantile_cont(delay_days, 0.5) AS p50, quantile_cont(delay_days, 0.75) AS p75 FROM mat GROUP BY GROUPING SETS ((cohort_year, severity), (cohort_year))) WHERE n >= 30 AND severity IN (0, 3, -1)"),
    "streaming_triangle": Query(_recent_replay, "stream:s t:i d:i n:i", "WITH " + o.BASE + "\nSELECT * FROM tri"),
}


QUERIES["audit_log"] = Query(lambda s, d: sinks.audit_fields(_audit_log(s, d)), "step:s key:s field:s value:f text:s", _audit_sql())


def _collapsed(s: SparkSession, d: str) -> DataFrame:
    return with_delays(ingest.collapse(order_rows(s, d)), C, FLOOR_YEAR)
