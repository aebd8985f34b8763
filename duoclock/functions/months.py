"""Month arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(date: Column) -> Column:
    """Calendar months since year 0: year * 12 + month - 1."""
    return F.year(date) * 12 + F.month(date) - 1


def month_year(p: Column) -> Column:
    return F.floor(p / 12).cast("int")


def month_of_year(p: Column) -> Column:
    return (F.pmod(p, F.lit(12)) + 1).cast("int")


def month_label(p: Column) -> Column:
    """YYYY-MM."""
    return F.concat(F.lpad(month_year(p).cast("string"), 4, "0"), F.lit("-"), F.lpad(month_of_year(p).cast("string"), 2, "0"))


def parse_month_label(label: Column) -> Column:
    parts = F.split(label, "-")
    return parts[0].cast("int") * 12 + parts[1].cast("int") - 1


def delay_months(receipt: Column, incident: Column) -> Column:
    """Calendar months between the two, whatever the days."""
    return month_index(receipt) - month_index(incident)


def delay_days(receipt: Column, incident: Column) -> Column:
    return F.date_diff(receipt, incident)


def date_number(date: Column) -> Column:
    """yyyymmdd."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)
