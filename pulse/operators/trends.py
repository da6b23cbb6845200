"""Trends of country-day scores: rolling means, roll-up by region, shifts from the usual.

The input has one row per country and day, ``event_date, country, headline_count`` and a
score; a window therefore holds days of one country, however many events there were. Rows
without a score stay and count for nothing. Windows are measured in days, not rows: a day
without news leaves a gap and does not lengthen the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.operators.dimension import with_country

FLAT = 1e-9  # a deviation below this is rounding of equal values


def _days(first: int, last: int) -> Window:
    """Days from ``first`` to ``last`` around each row's day, within its country."""
    day = F.unix_date("event_date")
    return Window.partitionBy("country").orderBy(day).rangeBetween(first, last)


def rolling_mood(scores: DataFrame, score: str = "mood_score", days: int = 7) -> DataFrame:
    """Mean of the last ``days`` days up to each day, and how many of them had a score."""
    window = _days(1 - days, 0)
    return scores.select(
        "event_date",
        "country",
        score,
        F.avg(score).over(window).alias("rolling"),
        F.count(score).over(window).alias("days_seen"),
    )


def mood_shift(
    scores: DataFrame, score: str = "mood_score", days: int = 7, alert_at: float = 2.0
) -> DataFrame:
    """Change from the day before, and the z-score against the ``days`` days before.

    The change is NULL without a row for the day before. The z-score needs two earlier
    scores that differ; ``alert`` marks those of ``alert_at`` or more in size.
    """
    earlier = _days(-days, -1)
    spread = F.stddev_samp(score).over(earlier)
    z: Column = F.when(spread > FLAT, (F.col(score) - F.avg(score).over(earlier)) / spread)
    changed = scores.select(
        "event_date",
        "country",
        score,
        (F.col(score) - F.max(score).over(_days(-1, -1))).alias("change"),
        z.alias("z_score"),
    )
    return changed.withColumn("alert", F.coalesce(F.abs("z_score") >= alert_at, F.lit(False)))


def region_rollup(
    scores: DataFrame, country_dim: DataFrame, score: str = "mood_score", weight: str = "headline_count"
) -> DataFrame:
    """Weighted mean score per day for every country, every region and the whole.

    ``level`` says which; an upper level has NULL in the columns it sums over. A country
    that ``country_dim`` does not know has a NULL region of its own. Sums are combined on
    the map side, and rows are at most three times the country-days.
    """
    rows = with_country(scores, country_dim, region="region").withColumn(
        "__weight", F.when(F.col(score).isNotNull(), F.col(weight))
    )
    grouped = rows.groupingSets(
        [["event_date", "region", "country"], ["event_date", "region"], ["event_date"]],
        "event_date", "region", "country",
    )
    summed = grouped.agg(
        F.grouping_id().alias("__id"),
        F.sum(weight).alias("headline_count"),
        (F.sum(F.col(score) * F.col("__weight")) / F.nullif(F.sum("__weight"), F.lit(0))).alias("mood"),
    )
    level = F.when(F.col("__id") == 0, "country").when(F.col("__id") == 1, "region").otherwise("world")
    return summed.select("event_date", level.alias("level"), "region", "country", "headline_count", "mood")
