"""Bounded per-group collection.

Every array that leaves a group here is cut by rank *before* it is collected.
Spark turns ``row_number() <= n`` into a limit on both sides of the shuffle
(WindowGroupLimit), so a group holding a third of all rows sends at most n rows
per map task and never meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The ``n`` first rows of each group in a total order, with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def distinct_values(
    df: DataFrame, keys: Sequence[str], value: str, n: int, name: str
) -> DataFrame:
    """Per group the ``n`` smallest distinct non-null values as a sorted array.

    A group without any value has no row, so a left join leaves NULL there.
    """
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    kept = first_n_per_group(distinct, keys, [F.col(value)], n)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def latest_day(df: DataFrame, column: str = "event_date") -> DataFrame:
    """Rows of the newest day.

    The maximum is a scalar subquery, so on a table partitioned by day only the
    newest partition is read.
    """
    newest = df.agg(F.max(column)).scalar()
    return df.where(F.col(column) == newest)
