"""Reading record files by position, collapsing them, and the gate logs."""

from __future__ import annotations

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from duoclock.config import DelayConfig
from duoclock.functions import months
from duoclock.functions.records import component_family, severity_ladder, stripped, with_delays, yes_flag
from duoclock.operators import ingest
from duoclock.sources import sinks, tsv


def line(n=51, **fields) -> str:
    values = ["-"] * n
    for name, value in fields.items():
        values[tsv.ORDINALS[name]] = value
    return "\t".join(values)


FULL = dict(odino="1", maketxt="acme", yeartxt="2001", crash="N", faildate="20200229", fire="N", injured="", deaths="", compdesc="ENGINE:FUEL:PUMP", ldate="20200301", cmpl_type="IVOQ")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("raw")
    big = [line(**FULL | {"odino": "9", "ldate": "20200105"})] * 4000
    files = {
        "R_1.txt": [line(**FULL | {"maketxt": "  café ", "ldate": "20200310", "faildate": ""}), "", line(50, odino="2"), line(**FULL | {"odino": "12a"}), line(**FULL | {"odino": "2", "crash": " y ", "injured": "x", "faildate": "99999999"})],
        "R_2.txt": [*big, line(**FULL | {"ldate": "20200301", "deaths": "1", "maketxt": "second"}), line(52, odino="3")],
        "R_3.txt": [line(**FULL | {"odino": "3", "compdesc": ' brakes "x" ', "injured": "2", "faildate": "2020013", "cmpl_type": "evoq"}), line(**FULL | {"odino": "2", "faildate": "20200101", "maketxt": ""})],
    }
    for name, rows in files.items():
        (out / name).write_bytes("\r\n".join(rows).encode("latin-1"))
    return out


def test_scan_and_collapse(spark, folder):
    lines = tsv.scan_lines(spark, f"{folder}/R_*.txt", expect_files=3)
    audit = {r["file"]: (r["lines"], r["bad_fieldcount"], r["kept"]) for r in tsv.parse_audit(lines).collect()}
    assert audit == {"R_1.txt": (4, 1, 3), "R_2.txt": (4002, 1, 4001), "R_3.txt": (2, 0, 2)}
    with pytest.raises(ValueError):
        tsv.scan_lines(spark, f"{folder}/R_*.txt", expect_files=7)
    rows = tsv.typed_rows(lines).withColumnRenamed("odino", "id")
    found = {r["id"]: r for r in ingest.collapse(rows).collect()}
    assert sorted(found) == [1, 2, 3, 9]
    one = found[1]
    assert (one["make"], one["n_rows"], one["severity"], one["receipt"], one["incident"]) == ("CAFÉ", 2, 3, datetime.date(2020, 3, 1), datetime.date(2020, 2, 29))
    two = found[2]
    assert (two["make"], two["crash"], two["severity"], two["incident"], two["injured"]) == ("ACME", True, 1, datetime.date(2020, 1, 1), 0)
    assert (found[3]["family"], found[3]["severity"], found[3]["incident"], found[3]["channel"]) == ('BRAKES "X"', 2, None, "EVOQ")
    assert (found[9]["n_rows"], found[9]["family"]) == (4000, "ENGINE")
    counts = ingest.row_audit(rows).first()
    assert (counts["rows_kept"], counts["unique_ids"], counts["incident_missing"]) == (4006, 4, 3)


def test_dirty_fields_are_missing(spark, tmp_path):
    """Numbers too large for their type, NaN, signs and texts never stop a job."""
    odd = ["20200101123", "99999999999999999999", "NaN", "inf", "-1", "1e3", " 2 ", "x", ""]
    rows = [line(**FULL | {"odino": str(i), "ldate": v, "faildate": v, "injured": v, "deaths": v}) for i, v in enumerate(odd)]
    rows.append(line(**FULL | {"odino": "99999999999999999999"}))
    (tmp_path / "dirty.txt").write_text("\n".join(rows))
    got = sorted(tsv.typed_rows(tsv.scan_lines(spark, f"{tmp_path}/dirty.txt")).collect(), key=lambda r: (r["odino"] is None, r["odino"]))
    assert [r["ldate_i"] for r in got] == [20200101123, None, None, None, -1, None, 2, None, None, 20200301]
    assert [r["injured"] for r in got] == [20200101123, 0, 0, 0, -1, 1000, 2, 0, 0, 0]
    assert [r["severity"] for r in got] == [3, 0, 0, 0, 0, 3, 3, 0, 0, 0]
    assert all(r["receipt"] is None for r in got[:-1]) and got[-1]["odino"] is None


def test_collapse_ignores_partitions(spark, folder):
    rows = tsv.typed_rows(tsv.scan_lines(spark, f"{folder}/R_*.txt")).withColumnRenamed("odino", "id").cache()
    assert sorted(map(str, ingest.collapse(rows).collect())) == sorted(map(str, ingest.collapse(rows.repartition(7)).collect()))


def test_checksums(spark, folder):
    for r in tsv.checksums(spark, f"{folder}/R_*.txt").collect():
        assert r["sha256"] == hashlib.sha256((folder / r["file"]).read_bytes()).hexdigest()


def test_scalars(spark):
    df = spark.createDataFrame([(" \tA b\n", True, False, 0, 0), (None, False, False, 1, 0), ("y", False, True, 1, 2)], "x string, crash boolean, fire boolean, injured int, deaths int")
    rows = df.select(stripped(F.col("x")), yes_flag(F.col("x")), component_family(F.concat("x", F.lit(" : z"))), severity_ladder(F.col("crash"), F.col("fire"), F.col("injured"), F.col("deaths"))).collect()
    assert [tuple(r) for r in rows] == [("A b", False, "A B", 1), ("", False, "", 2), ("y", True, "Y", 3)]


def test_months(spark):
    pairs = [(datetime.date(y, m, 15), datetime.date(y + k // 5, (m + k) % 12 + 1, 20)) for y in range(1995, 2026, 5) for m in (1, 6, 12) for k in range(12)]
    df = spark.createDataFrame(pairs, "a date, b date").withColumn("p", months.month_index(F.col("a")))
    rows = df.select("a", "b", "p", months.delay_months(F.col("b"), F.col("a")).alias("d"), months.month_label(F.col("p")).alias("s"), months.parse_month_label(months.month_label(F.col("p"))).alias("back"), months.date_number(F.col("a")).alias("n")).collect()
    for r in rows:
        a, b = r["a"], r["b"]
        assert r["d"] == 12 * (b.year - a.year) + b.month - a.month and r["back"] == r["p"] == a.year * 12 + a.month - 1
        assert r["s"] == f"{a:%Y-%m}" and r["n"] == int(f"{a:%Y%m%d}")


def test_flags(spark):
    cfg = DelayConfig()
    day = lambda s: datetime.date.fromisoformat(s) if s else None
    rows = [("2020-01-31", "2020-02-01", "VOQ"), ("2020-02-01", "2020-01-31", "VOQ"), (None, "2020-01-01", "X"), ("2000-01-01", "2003-02-01", None), ("2025-01-01", "2025-01-01", "IVOQ")]
    df = with_delays(spark.createDataFrame([(day(a), day(b), c) for a, b, c in rows], "incident date, receipt date, channel string"), cfg)
    got = [tuple(r) for r in df.select("delay_m", "delay_days", "valid_delay", "neg_delay", "consumer", "pre_floor", "beyond_cap", "mature", "in_triangle").collect()]
    assert got == [
        (1, 1, True, False, True, False, False, True, True), (-1, -1, False, True, True, False, False, False, False), (None, None, False, False, False, False, False, False, False),
        (37, 1127, True, False, False, True, True, True, False), (0, 0, True, False, True, False, False, False, True),
    ]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "é"), (2, 0.5, None)], "k int, x double, s string")
    document = json.loads(sinks.to_document(df, "k"))
    assert document == {"1": {"x": None, "s": "é"}, "2": {"x": 0.5, "s": None}}
    sinks.write_table(df, f"{tmp_path}/t")
    assert sinks.read_table(spark, f"{tmp_path}/t", "k int, x double, s string").count() == 2
    sinks.write_checkpoint(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    gates = sinks.gate(df.agg(F.count(F.lit(1)).alias("n")), "1", "rows", "n = 2", "concat('n=', n)")
    assert "| 1 | rows | PASS | n=2 |" in sinks.gates_markdown(gates)
