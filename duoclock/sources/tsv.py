"""Tab-delimited record files without a header, read by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import component_family, severity_ladder, stripped, yes_flag

# Fixed values of the record format: fields a line, and the places of those that are used.
N_FIELDS = 51
ORDINALS = {"odino": 1, "maketxt": 3, "yeartxt": 5, "crash": 6, "faildate": 7, "fire": 8, "injured": 9, "deaths": 10, "compdesc": 11, "ldate": 16, "cmpl_type": 20}


def scan_lines(spark: SparkSession, paths: str | list[str], n_fields: int = N_FIELDS, expect_files: int | None = None) -> DataFrame:
    """(file, ord, fields, bad): lines that aren't blank, in latin-1; ord sorts like (file, place). bad: another number of fields."""
    lines = spark.read.option("lineSep", "\n").text(paths).where("length(value) > 0")
    if expect_files is not None and (found := len(lines.inputFiles())) != expect_files:
        raise ValueError(f"expected {expect_files} files, found {found}")
    text = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), r"\r+$", "")
    named = lines.select(
        F.col("_metadata.file_name").alias("file"),
        F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).alias("ord"),
        text.alias("line"),
    )
    return named.where("line <> ''").select("file", "ord", F.split("line", "\t", -1).alias("fields")).withColumn("bad", F.size("fields") != n_fields)


def parse_audit(lines: DataFrame) -> DataFrame:
    """Lines, bad ones and kept ones of each file."""
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad_fieldcount"), F.count_if(~F.col("bad")).alias("kept"))


def typed_rows(lines: DataFrame, ordinals: dict[str, int] = ORDINALS) -> DataFrame:
    """One typed row for each good line; what can't be read is null, counts and texts that are missing are 0 and empty."""
    raw = lines.where(~F.col("bad")).select("file", "ord", *[F.get("fields", F.lit(i)).alias(k) for k, i in ordinals.items()])
    # a number that no bigint holds is as missing as one that can't be read
    count = lambda c: F.coalesce(F.expr(f"try_cast(try_cast(trim({c}) AS double) AS bigint)"), F.lit(0).cast("bigint"))
    date = lambda c: F.expr(f"try_cast({c} AS bigint)")
    typed = raw.select(
        "file", "ord",
        F.expr("try_cast(odino AS bigint)").alias("odino"),
        date("ldate").alias("ldate_i"), date("faildate").alias("faildate_i"),
        F.expr("CASE WHEN ldate RLIKE '^[0-9]{8}$' THEN cast(try_to_timestamp(ldate, 'yyyyMMdd') AS date) END").alias("receipt"),
        F.expr("CASE WHEN faildate RLIKE '^[0-9]{8}$' THEN cast(try_to_timestamp(faildate, 'yyyyMMdd') AS date) END").alias("incident"),
        yes_flag(F.col("crash")).alias("crash"), yes_flag(F.col("fire")).alias("fire"), count("injured").alias("injured"), count("deaths").alias("deaths"),
        F.upper(stripped(F.col("maketxt"))).alias("make"), stripped(F.col("yeartxt")).alias("yeartxt"), F.upper(stripped(F.col("cmpl_type"))).alias("channel"),
        component_family(F.col("compdesc")).alias("family"),
    )
    return typed.withColumn("severity", severity_ladder(F.col("crash"), F.col("fire"), F.col("injured"), F.col("deaths")))


def checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
