"""Date helpers: integer day keys and windows relative to ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

AsOf = dt.date | str | None


def as_of_day(as_of: AsOf) -> Column:
    """The run's day: a literal, or the session's current date when not given."""
    if as_of is None:
        return F.current_date()
    return F.lit(as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of))


def resolved_day(spark: SparkSession, as_of: AsOf) -> dt.date:
    """The run's day as a value: every job of a run then has the same one, also over midnight."""
    if as_of is None:
        return spark.range(1).select(F.current_date()).first()[0]
    return as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of)


def day_of_key(key: Column) -> Column:
    """yyyymmdd integer -> date. An impossible day raises under ANSI mode.

    Integer arithmetic stays inside generated code; parsing the key as text
    would build a string and run a formatter per row.
    """
    whole = key.cast("int")
    part = lambda by: F.floor(whole / by).cast("int")  # exact: 8 digits fit a double
    return F.make_date(part(10000), part(100) % 100, whole % 100)


def first_day_key(as_of: AsOf, days: int) -> Column:
    """yyyymmdd integer of the window's first day.

    It folds to a constant, so a comparison with the *raw* key column reaches
    the Parquet reader as a pushed filter.
    """
    return F.date_format(first_day(as_of, days), "yyyyMMdd").cast("bigint")


def first_day(as_of: AsOf, days: int) -> Column:
    """First day of an inclusive window that reaches ``days`` back."""
    return F.date_sub(as_of_day(as_of), days)
