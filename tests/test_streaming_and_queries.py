"""The triangle kept by a stream, the registry, and every query on the smallest tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from duoclock.config import DelayConfig
from duoclock.operators.triangle import as_known_at
from duoclock.plans.queries import QUERIES
from duoclock.streaming import replay

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
SLOW = {"interval_scale_by_method", "replayed_intervals_by_method", "coverage_by_method", "variant_coverage", "backtest_metrics", "hazard_fit", "bootstrap_bands", "interval_scale", "replayed_intervals", "coverage", "coverage_gate", "coverage_matrix", "live_intervals"}


def test_stream_follows_the_batch(spark, tmp_path):
    """After each month's file the state is what the batch plan knows at that month."""
    cfg = DelayConfig(t0=0, cutoff=20, max_delay=4)
    rows = [(t, t + d, d, (t * 7 + d) % 4) for t in range(12) for d in range(5) for _ in range((t + d) % 3)]
    schema = "cohort_p int, report_p int, delay_m int, severity int, valid_delay boolean"
    frame = spark.createDataFrame([(*r, True) for r in rows], schema)
    from duoclock.operators.triangle import triangle, with_streams

    whole = triangle(with_streams(frame), cfg)
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    for month in (5, 10, 20):
        low = {5: -1, 10: 5, 20: 10}[month]
        frame.where(f"report_p > {low} AND report_p <= {month}").coalesce(1).write.parquet(f"{tmp_path}/in/{month}")
        seen = {}
        query = replay.run_available(replay.streaming_triangle(source, cfg), str(tmp_path), "complete", lambda df, _: seen.update({(r["stream"], r["t"], r["d"]): r["n"] for r in df.collect()}))  # noqa: B023
        query.awaitTermination()
        assert seen == {(r["stream"], r["t"], r["d"]): r["n"] for r in as_known_at(whole, month).collect()}


def test_streaming_nowcast_is_of_any_batches(spark, tmp_path):
    """However records are dealt to batches, every origin's nowcast is the batch plan's; a record of a month that is over changes nothing."""
    from pyspark.sql import functions as F

    from duoclock.operators import chainladder
    from duoclock.operators.triangle import cumulative, triangle, with_streams

    t0, first, last, lag = 24000, 24010, 24018, 8  # lag is over the largest delay
    cfg = DelayConfig(t0=t0, cutoff=last + 1, max_delay=4, window=2)
    # months without records, and a severity that comes late, so that windows double
    rows = [(t, t + d, d, (t * 7 + d) % 4 if t > 24008 else 0, True) for t in range(t0, last + 2) for d in range(5) for _ in range((t * 5 + d) % 4) if (t + d) % 6 and t + d <= last + 1]
    schema = "cohort_p int, report_p int, delay_m int, severity int, valid_delay boolean"
    frame = spark.createDataFrame(rows, schema)
    cum = cumulative(triangle(with_streams(frame), cfg), cfg)
    want = chainladder.nowcast(cum, chainladder.fit(cum, cfg, cutoffs=chainladder.span(first, last)), cfg, lag)
    want = sorted((r["stream"], r["cutoff"], r["t"], r["h"], r["c_obs"], round(r["n_hat"], 9)) for r in want.collect())
    assert len(want) > 100
    month, late = F.col("report_p"), [(24001, 24003, 2, 0, True)] * 50
    for number, parts in enumerate(([month > 0], [month <= 24006, month.between(24007, 24012), month > 24012])):
        landing, folder = f"{tmp_path}/in{number}", f"{tmp_path}/out{number}"
        replay.arrive(frame, landing, parts)
        if number:  # after its month is over
            replay.arrive(spark.createDataFrame(late, schema), landing, [month > 0])
        nowcasts = replay.streaming_nowcast(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing), cfg, lag, first, last)
        with replay.rocksdb(spark):
            replay.run_available(nowcasts, folder).awaitTermination()
        got = spark.read.schema(nowcasts.schema).parquet(f"{folder}/rows").collect()
        assert sorted((r["stream"], r["cutoff"], r["t"], r["h"], r["c_obs"], round(r["n_hat"], 9)) for r in got) == want


def test_audits_share_a_log(spark, tmp_path):
    from duoclock.sources import sinks

    path = str(tmp_path / "log")
    sinks.append_audit(spark.sql("SELECT 3L AS n, CAST(NULL AS double) AS share, named_struct('first', DATE'2001-02-03') AS range"), path, "a")
    sinks.append_audit(spark.sql("SELECT * FROM VALUES ('x', 'text'), (NULL, '') AS v(key, note)"), path, "b", "key")
    sinks.append_audit(spark.sql("SELECT 1 AS n").limit(0), path, "c")
    log = sinks.read_audit(spark, path)
    typed = log.select("step", sinks.audit_value("$.n", "bigint").alias("n"), sinks.audit_value("$.range.first", "date").alias("first"), sinks.audit_value("$.note", "bigint").alias("note"))
    assert sorted((r["step"], r["n"], str(r["first"]), r["note"]) for r in typed.collect()) == [("a", 3, "2001-02-03", None), ("b", None, "None", None), ("b", None, "None", None)]
    fields = {(r["step"], r["key"], r["field"]): (r["value"], r["text"]) for r in sinks.audit_fields(log).collect()}
    assert fields[("a", None, "n")] == (3.0, None) and fields[("a", None, "share")] == (None, None) and fields[("b", "x", "note")] == (None, "text") and fields[("b", None, "note")] == (None, "")


def test_self_audit_finds_what_is_wrong(spark):
    """A record that the triangle lacks, and delays that aren't the dates', fail their checks and no others."""
    from pyspark.sql import functions as F

    from duoclock.config import ORDERS
    from duoclock.operators import audit
    from duoclock.operators.triangle import triangle, with_streams
    from duoclock.plans.adapter import records

    rows = records(spark, SF)
    tri = triangle(with_streams(rows.where("consumer")), ORDERS)
    less = tri.withColumn("n", F.when((F.col("stream") == "all") & (F.col("d") == 0), F.col("n") - 1).otherwise(F.col("n")))
    shifted = rows.withColumn("delay_m", F.col("delay_m") + 1)
    assert {r["check"] for r in audit.self_audit(rows, less, ORDERS, ORDERS.last_origin).collect() if not r["passed"]} == {"cells"}
    assert {r["check"] for r in audit.self_audit(shifted, tri, ORDERS, ORDERS.last_origin).collect() if not r["passed"]} == {"delays"}


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "n_hat" in out.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_needs_the_llm_part():
    code = "import sys; sys.modules['duoclock.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.entry and not [q for q in e.queries() if q[:2] == 'op' or q == 'pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
    for path in (ROOT / "duoclock").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def plain(x):
    return round(x, 5) if isinstance(x, float) else str(x) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, name):
    q = QUERIES[name]
    df = q.spark(spark, SF)
    rows = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if q.oracle() is None:
        assert rows
        return
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(q.oracle())
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["interval_scale_by_method", "live_intervals", "coverage_by_method"])
def test_draws_against_sql(spark, name):
    test_query(spark, name)


def test_views(spark):
    from duoclock.config import ORDERS
    from duoclock.plans.adapter import records
    from duoclock.plans.views import register

    names = register(records(spark, SF), ORDERS, "v_")
    assert "v_maturity" in names
    top = spark.sql("SELECT m.stream, c.c / m.F AS n_hat FROM v_maturity m JOIN v_cumulative_triangle c ON c.stream = m.stream AND c.d = m.d AND c.t = m.cutoff - m.d WHERE m.cutoff = 24019 AND m.stream = 'all'")
    assert top.count() == ORDERS.max_delay + 1


def test_streams_land_as_counted_cells(spark, monkeypatch):
    """What lands has a row a cell, and every record is in one."""
    from pyspark.sql import functions as F

    from duoclock.plans import queries
    from duoclock.plans.adapter import records

    landed = []
    monkeypatch.setattr(queries.stream, "arrive", lambda rows, folder, parts: (landed.append(rows), rows.limit(0).write.parquet(folder)))
    queries._arrived(spark, SF)
    cells = landed[0].agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cohort_p", "report_p", "valid_delay").alias("cells"), F.sum("n").alias("n")).first()
    assert cells["rows"] == cells["cells"] and cells["n"] == records(spark, SF).where("report_p IS NOT NULL").count() > cells["rows"]
