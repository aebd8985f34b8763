"""Both bootstrap methods over every origin."""

from __future__ import annotations

from duoclock.config import ORDERS as C
from duoclock.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
METHODS = {"cohort", "multinomial"}


def test_bands_at_every_origin(spark):
    got = {(r["method"], r["cutoff"]) for r in QUERIES["bootstrap_bands"].spark(spark, SF).select("method", "cutoff").distinct().collect()}
    assert got == {(m, t) for m in METHODS for t in [*range(C.first_origin, C.last_origin + 1), C.cutoff]}


def test_coverage_by_method(spark):
    rows = QUERIES["coverage_by_method"].spark(spark, SF).collect()
    assert len(rows) == 14 and {r["method"] for r in rows} == METHODS
    assert all(r["n"] > 0 and 0 <= r["cov90"] <= 1 for r in rows)
