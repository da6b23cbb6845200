"""Country attributes of rows by code, as the code was used on the row's day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def code_ranges(country_dim: DataFrame) -> DataFrame:
    """The dimension with ``first_day`` and ``last_day`` (both inclusive, NULL is open).

    An entry holds from its ``valid_from`` until the next entry of the code; the first one
    holds before that, too, so a known code has one entry on every day. Of entries with
    equal code and day the least by its other columns counts. NULL codes go.
    """
    rest = [c for c in country_dim.columns if c not in ("code", "valid_from")]
    unique = (
        country_dim.where(F.col("code").isNotNull())
        .groupBy("code", F.to_date("valid_from").alias("first_day"))
        .agg(F.min(F.struct(*rest)).alias("entry"))
    )
    by_day = Window.partitionBy("code").orderBy(F.col("first_day").asc_nulls_first())
    return unique.select(
        "code",
        F.when(F.row_number().over(by_day) > 1, F.col("first_day")).alias("first_day"),
        F.date_sub(F.lead("first_day").over(by_day), 1).alias("last_day"),
        "entry.*",
    )


def with_country(rows: DataFrame, country_dim: DataFrame, **columns: str) -> DataFrame:
    """LEFT JOIN of the dimension on ``country``; ``columns`` maps new names to its columns.

    A dimension with ``valid_from`` is matched as of ``event_date``: an equality join whose
    range condition picks one entry, so no row is repeated. Rows without a day get the
    entry of a code that has only one.
    """
    if "valid_from" not in country_dim.columns:
        dim = country_dim.select(F.col("code").alias("country"), *(F.col(c).alias(n) for n, c in columns.items()))
        return rows.join(dim, "country", "left")
    dim = code_ranges(country_dim).select(
        F.col("code").alias("__code"),
        F.col("first_day").alias("__first"),
        F.col("last_day").alias("__last"),
        *(F.col(c).alias(n) for n, c in columns.items()),
    )
    on = (
        (F.col("country") == F.col("__code"))
        & (F.col("__first").isNull() | (F.col("event_date") >= F.col("__first")))
        & (F.col("__last").isNull() | (F.col("event_date") <= F.col("__last")))
    )
    return rows.join(dim, on, "left").drop("__code", "__first", "__last")
