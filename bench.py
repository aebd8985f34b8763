"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from duoclock.plans.queries import QUERIES

HEADLINE = [
    "tsv_round_trip", "collapse_by_id", "record_audit", "delay_quantiles", "ecdf_severity", "triangle_cells", "maturity_curve", "nowcast_current",
    "backtest_metrics_point", "z_series", "alarm_rates", "variant_delta", "hazard_cells", "coverage",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["nowcast_current"].spark(spark, sf_dir).count()  # compiles code and starts Python
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
