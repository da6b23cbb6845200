"""The two feeds, read with a declared schema from files or a catalog table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.schemas import EVENTS_FEED, GKG_FEED, conform


def read_events_feed(spark: SparkSession, location: str, format: str = "parquet") -> DataFrame:
    return _read(spark, location, format, EVENTS_FEED)


def read_gkg_feed(spark: SparkSession, location: str, format: str = "parquet") -> DataFrame:
    return _read(spark, location, format, GKG_FEED)


def _read(spark: SparkSession, location: str, format: str, schema: T.StructType) -> DataFrame:
    """``table`` reads a catalog table, ``csv``/``tsv`` files with a header line.

    Further columns of the source are never read. Delimited files are matched by
    header name, so their column order is free.
    """
    if format == "table":
        return conform(spark.table(location), schema)
    if format in ("csv", "tsv"):
        reader = spark.read.option("header", True).option("sep", "," if format == "csv" else "\t")
        return conform(reader.csv(location), schema)
    return conform(spark.read.format(format).load(location), schema)


def read_dirty_events_feed(
    spark: SparkSession, location: str, format: str = "tsv", columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of the events feed that can be used, and rejected lines with a reason."""
    return _read_dirty(spark, location, format, EVENTS_FEED, "SQLDATE", 1, columns)


def read_dirty_gkg_feed(
    spark: SparkSession, location: str, format: str = "tsv", columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of the knowledge-graph feed that can be used, and rejected lines with a reason."""
    return _read_dirty(spark, location, format, GKG_FEED, "date", 1_000_000, columns)


def _read_dirty(
    spark: SparkSession, location: str, format: str, schema: T.StructType, key: str, per_day: int, columns: list[str] | None
) -> tuple[DataFrame, DataFrame]:
    """Delimited lines as (rows, rejected), where one bad line does not end the run.

    ``columns`` names the fields of files without a header; else every file has the same
    header line, whose order of columns is free. A line is rejected
    if it has another number of fields ("bad line"), a value that is not of its column's
    type ("bad" and the column; the first in the schema's order), or a day that
    does not exist ("impossible day"). Empty fields are NULL; empty lines are skipped. A
    line is a row: fields hold no line ends.
    """
    lines = spark.read.text(location).where(F.trim("value") != "")
    separator = "," if format == "csv" else "\t"
    first = None if columns else lines.first()
    names = columns or (first.value.split(separator) if first else schema.fieldNames())
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_bad_line"]])
    options = {"sep": separator, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad_line"}
    texts = lines.where(F.col("value") != first.value) if first else lines
    parsed = texts.select("value", F.from_csv("value", F.lit(fields.simpleString()[7:-1].replace(":", " ")), options).alias("f"))
    typed = parsed.select("value", "f", *(F.col(f"f.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema))
    whole = F.floor(F.col(key) / per_day).cast("bigint")
    day = F.try_to_date(F.lpad(whole.cast("string"), 8, "0"), "yyyyMMdd")
    reason = F.when(F.col("f._bad_line").isNotNull(), "bad line")
    for f in schema:
        reason = reason.when(F.col(f.name).isNull() & F.col(f"f.`{f.name}`").isNotNull(), f"bad {f.name}")
    reason = reason.when(F.col(key).isNotNull() & day.isNull(), "impossible day")
    judged = typed.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(schema.fieldNames())
    return good, judged.where(F.col("reason").isNotNull()).select(F.col("value").alias("line"), "reason")
