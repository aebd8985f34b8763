"""The driver's order tables as records with two clocks: an order is an incident, its shipping the receipt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ORDERS, DelayConfig
from ..functions.records import with_delays

FLOOR_YEAR = 1996


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, incident, receipt, severity, channel, make, family: one row for each line of an order."""
    read = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    lines = read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    orders = read("orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    parts = read("part", "p_partkey", "p_brand", "p_type")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select(
        F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
        F.col("o_orderdate").cast("date").alias("incident"), F.col("l_shipdate").cast("date").alias("receipt"),
        F.when(F.col("l_quantity") >= 50, 3).when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("severity"),
        F.col("o_orderpriority").alias("channel"), F.col("p_brand").alias("make"), F.col("p_type").alias("family"),
    )


def records(spark: SparkSession, sf_dir: str, cfg: DelayConfig = ORDERS) -> DataFrame:
    return with_delays(order_rows(spark, sf_dir), cfg, FLOOR_YEAR)
