"""Sinks and sources for results: Parquet checkpoints, small CSV and JSON tables, and a log of gates."""

from __future__ import annotations

import json
import math
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GATES = "step string, gate string, passed boolean, detail string"


def write_checkpoint(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    return x


def to_document(df: DataFrame, key: str | None = None) -> str:
    """A small table as JSON: a list of rows, or rows by key; values that aren't finite become null."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return json.dumps(_plain({r.pop(key): r for r in rows} if key else rows), indent=2, ensure_ascii=False)


def read_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a JSON document that is a list of rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_gates(gates: DataFrame, path: str) -> None:
    """Add rows to the gate log; what is there stays. Each append is numbered by its time."""
    gates.select("step", "gate", "passed", "detail", F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(path)


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GATES + ", at timestamp").parquet(path).orderBy("at", "step", "gate")


def append_audit(audit: DataFrame, path: str, step: str, key: str | None = None) -> None:
    """Add an audit's rows to a log as VARIANT documents, so that audits with different columns share one table.

    key: a column that tells the rows apart; it isn't in the document. A null value is a null field; an audit without rows adds none.
    """
    fields = [c for c in audit.columns if c != key]
    document = F.parse_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    audit.select(F.lit(step).alias("step"), (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), document.alias("doc")).write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("step string, key string, doc variant").parquet(path)


def audit_value(path: str, kind: str) -> Column:
    """A typed value of a document, such as $.rows or $.range.first; null where it isn't there or isn't of that type."""
    return F.try_variant_get("doc", path, kind)


def audit_fields(audits: DataFrame) -> DataFrame:
    """(step, key, field, value, text): a row for each field of the documents; value where it is a number, text where it is a text."""
    named = audits.withColumnRenamed("key", "audit_key")
    each = named.lateralJoin(named.sparkSession.tvf.variant_explode(F.col("doc").outer())).select("step", "audit_key", F.col("key").alias("field"), "value")
    text = F.schema_of_variant("value") == "STRING"
    return each.select("step", F.col("audit_key").alias("key"), "field", F.when(~text, F.try_variant_get("value", "$", "double")).alias("value"), F.when(text, F.try_variant_get("value", "$", "string")).alias("text"))


# Characters that LaTeX reads as commands.
_LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}"}


def latex_table(df: DataFrame, caption: str, digits: int = 3) -> str:
    """A small table as a LaTeX tabular; numbers to so many places, null as a dash."""

    def cell(x) -> str:
        if x is None or (isinstance(x, float) and not math.isfinite(x)):
            return "--"
        return f"{x:.{digits}f}" if isinstance(x, float) else "".join(_LATEX.get(c, c) for c in str(x))

    lines = [" & ".join(map(cell, row)) + r" \\" for row in (df.columns, *df.collect())]
    align = "".join("l" if t == "string" else "r" for _, t in df.dtypes)
    return "\n".join([r"\begin{table}", rf"\caption{{{cell(caption)}}}", rf"\begin{{tabular}}{{{align}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}", r"\end{table}"]) + "\n"


def gates_markdown(gates: DataFrame) -> str:
    """The gates (step, gate, passed, detail) as a Markdown table."""
    rows = [f"| {r['step']} | {r['gate']} | {'PASS' if r['passed'] else 'FAIL'} | {r['detail']} |" for r in gates.select("step", "gate", "passed", "detail").collect()]
    return "\n".join(["| step | gate | status | detail |", "|---|---|---|---|", *rows]) + "\n"


def gate(df: DataFrame, step: str, name: str, passed: str, detail: str) -> DataFrame:
    """A row of the gate log from a one-row table; passed and detail are SQL expressions."""
    return df.select(F.lit(step).alias("step"), F.lit(name).alias("gate"), F.coalesce(F.expr(passed), F.lit(False)).alias("passed"), F.expr(detail).cast("string").alias("detail"))
