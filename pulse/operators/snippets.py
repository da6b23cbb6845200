"""What the pages behind the events say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.pages import canonical_url, opening_words
from pulse.operators.ranking import first_n_per_group
from pulse.operators.topics import DAY_COUNTRY

SNIPPET_CHARS = 300
SEPARATOR = " | "


def page_snippets(
    pages: DataFrame,
    chars: int | None = SNIPPET_CHARS,
    url: str = "url",
    html: str = "html",
    version: str | None = None,
) -> DataFrame:
    """(url_key, snippet), one row per address.

    Of several pages with one address the one with the greatest ``version`` counts (a crawl time, say; NULLs
    come first), with equal or no versions the one with the least snippet. The html is cut to its
    snippet on the scan side, and rows of one address are combined there, so only short rows are
    shuffled. Pages without an address or without text have no row.
    """
    order = F.col(version) if version else F.lit(0)
    short = pages.select(
        canonical_url(F.col(url)).alias("url_key"), opening_words(F.col(html), chars).alias("snippet"), order.alias("v")
    ).where(F.col("url_key").isNotNull())
    # pages without text go after they were combined: a filter before would read each page twice
    versions = short.groupBy("url_key", "v").agg(F.min("snippet").alias("snippet")).where(F.col("snippet").isNotNull())
    if not version:
        return versions.drop("v")
    rows = versions.groupBy("url_key").agg(F.max(F.struct("v", "snippet")).alias("row"))
    return rows.select("url_key", "row.snippet")


def with_snippets(
    events: DataFrame, pages: DataFrame, chars: int | None = SNIPPET_CHARS, url: str = "url", version: str | None = None
) -> DataFrame:
    """Events LEFT JOIN the snippets of their addresses; columns ``url_key`` and ``snippet`` are added or replaced.

    An address has one row on the right, so the join repeats no event, and a hot one is split by
    AQE on the events' side alone.
    """
    keyed = events.drop("snippet").withColumn("url_key", canonical_url(F.col(url)))
    return keyed.join(page_snippets(pages, chars, version=version), "url_key", "left").select(*keyed.columns, "snippet")


def country_snippets(events: DataFrame, n: int = 3) -> DataFrame:
    """(event_date, country, snippets): the ``n`` snippets with most events of a country-day.

    Ties go by the snippet. Events are counted on the map side and cut by rank before they meet.
    A country-day without a snippet has no row.
    """
    told = events.where(F.col("snippet").isNotNull()).groupBy(*DAY_COUNTRY, "snippet").agg(F.count("*").alias("n"))
    kept = first_n_per_group(told, DAY_COUNTRY, [F.col("n").desc(), F.col("snippet")], n)
    rows = F.array_sort(F.collect_list(F.struct("rank", "snippet")))
    return kept.groupBy(*DAY_COUNTRY).agg(F.array_join(rows["snippet"], SEPARATOR).alias("snippets"))
