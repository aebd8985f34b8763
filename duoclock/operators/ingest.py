"""Rows to records: collapse by id, and audits before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """One record per key: least receipt, first incident that isn't missing, greatest severity and counts, first texts; null keys go.

    "First" follows `order`; a text that is empty counts as present. One shuffle, pre-aggregated.
    """
    first = lambda c: F.expr(f"min_by({c}, {order}) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    has = set(rows.columns)
    aggregates = [F.min("receipt").alias("receipt"), first("incident"), F.max("severity").alias("severity"), F.count(F.lit(1)).cast("int").alias("n_rows")]
    aggregates += [first(c) for c in ("make", "yeartxt", "channel", "family") if c in has]
    aggregates += [F.max(c).alias(c) for c in ("deaths", "injured") if c in has] + [F.bool_or(c).alias(c) for c in ("crash", "fire") if c in has]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)


def row_audit(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row of counts over rows as they came."""
    both = F.col("receipt").isNotNull() & F.col("incident").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("rows_kept"), F.count_distinct(key).alias("unique_ids"),
        F.count_if(F.col("receipt").isNull()).alias("receipt_missing"), F.count_if(F.col("incident").isNull()).alias("incident_missing"),
        F.count_if(both).alias("both_dates"), F.avg(both.cast("double")).alias("both_dates_share"),
        F.count_if(F.date_diff("receipt", "incident") < 0).alias("negative_delay"),
        F.min("receipt").alias("receipt_min"), F.max("receipt").alias("receipt_max"),
        *[F.count_if(c).alias(f"{c}_rows") for c in ("crash", "fire") if c in rows.columns],
    )


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, n), the most frequent first, ties by value."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "value").limit(limit) if limit else counted


def record_audit(records: DataFrame) -> DataFrame:
    """One row of counts over flagged records."""
    consumer, mature = F.col("consumer"), F.col("consumer") & F.col("mature")
    return records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("n_rows") > 1).alias("multi_row_records"), F.max("n_rows").alias("max_rows_per_id"),
        F.count_if("has_both_dates").alias("both_dates"), F.avg(F.col("has_both_dates").cast("double")).alias("both_dates_share"),
        F.count_if("neg_delay").alias("negative_delay"), F.count_if(consumer).alias("consumer_records"), F.avg(consumer.cast("double")).alias("consumer_share"),
        F.count_if("pre_floor").alias("pre_floor_records"), F.count_if(consumer & F.col("in_triangle")).alias("in_triangle_consumer"), F.count_if(mature).alias("mature_consumer"),
        F.avg(F.when(mature, F.col("beyond_cap").cast("double"))).alias("beyond_cap_share"),
    )


def beyond_cap_by_severity(records: DataFrame) -> DataFrame:
    """Share beyond the delay cap of mature consumer records, by severity and in all (severity null)."""
    return records.where("consumer AND mature").groupingSets([[F.col("severity")], []], "severity").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("beyond_cap").cast("double")).alias("beyond_cap_share"))
