"""Top themes and people per country-day.

A pair is a theme and a person of the same event, and counts are counts of
pairs. A theme's count is therefore multiplied by the number of
persons on its row, and a row that lacks either side counts for nothing. The
same numbers come from weights: a theme counts ``size(persons)``, a person
``size(themes)``. No pair is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.config import DEFAULTS, PulseConfig
from pulse.functions.dates import AsOf, first_day
from pulse.functions.text import entity_name, is_person
from pulse.operators.ingest import graph_entities, recent_located
from pulse.operators.ranking import first_n_per_group
from pulse.operators.skew import heavy_keys, spread_join
from pulse.operators.topics import DAY_COUNTRY

THEME, PERSON = "theme", "person"
# names of one url that one join task takes; each meets every country-day of the url
NAMES_PER_TASK = 50_000


def _exploded(df: DataFrame, keys: list[str], weighted: bool) -> DataFrame:
    """One row (kind, name, w) per entity of a row, from its two arrays.

    The two arrays become two rows with their weight, then their entries become rows;
    names are cut and lower-cased as columns, in generated code, not by a lambda per
    entry. A side without the other weighs 0 and goes before its entries are unrolled.
    """

    def side(kind: str, array: str, other: str) -> Column:
        weight = F.size(other) if weighted else F.lit(1)
        return F.struct(
            F.lit(kind).alias("kind"), F.col(array).alias("entries"), weight.cast("bigint").alias("w")
        )

    sides = F.array(side(THEME, "themes", "persons"), side(PERSON, "persons", "themes"))
    weighed = df.select(*keys, F.inline(sides)).where(F.col("w") > 0)
    entries = weighed.select(*keys, "kind", "w", F.explode("entries").alias("entry"))
    named = entries.select(*keys, "kind", entity_name(F.col("entry")).alias("name"), "w")
    return named.where((F.col("kind") == THEME) | is_person(F.col("name")))


def _top_lists(counts: DataFrame, n: int) -> DataFrame:
    """(day, country, kind, name, c) -> the two ranked arrays of a country-day."""
    top = first_n_per_group(
        counts, [*DAY_COUNTRY, "kind"], [F.desc("c"), F.col("name")], n
    )

    def ranked(kind: str) -> Column:
        of_kind = F.when(F.col("kind") == kind, F.struct("rank", "name", "c"))
        in_order = F.array_sort(F.collect_list(of_kind))
        return F.transform(in_order, lambda x: F.struct(x["name"].alias(kind), x["c"].alias("c")))

    lists = top.groupBy(*DAY_COUNTRY).agg(
        ranked(THEME).alias("top_themes"), ranked(PERSON).alias("top_people")
    )
    # a country-day needs themes; one without people keeps NULL
    return lists.where(F.size("top_themes") > 0).select(
        *DAY_COUNTRY,
        "top_themes",
        F.when(F.size("top_people") > 0, F.col("top_people")).alias("top_people"),
    )


def top_entities(
    enriched: DataFrame,
    as_of: AsOf = None,
    cfg: PulseConfig = DEFAULTS,
    weighted: bool = True,
) -> DataFrame:
    """Top lists from the enriched table: one scan, one pre-aggregated shuffle.

    ``weighted=False`` counts every mention once.
    """
    recent = enriched.where(F.col("event_date") >= first_day(as_of, cfg.recent_days))
    rows = _exploded(recent, DAY_COUNTRY, weighted)
    counts = rows.groupBy(*DAY_COUNTRY, "kind", "name").agg(F.sum("w").alias("c"))
    return _top_lists(counts, cfg.top_entities)


def top_entities_from_feeds(
    events: DataFrame, gkg_feed: DataFrame, as_of: AsOf = None, cfg: PulseConfig = DEFAULTS
) -> DataFrame:
    """The same lists straight from raw events and the knowledge graph.

    Both sides are reduced before they meet: events to a count per (url, day,
    country), graph rows to a weight per (url, kind, name). The count of a name is
    the sum over urls of the product, so the event x graph-row fan-out of the
    enriched table is never built, however often a url repeats on either side. A url
    with very many names is joined in several tasks, split by name.
    """
    per_url = (
        recent_located(events, as_of, cfg)
        .groupBy("url", *DAY_COUNTRY)
        .agg(F.count("*").alias("n"))
    )
    weights = (
        _exploded(graph_entities(gkg_feed, as_of, cfg), ["url"], weighted=True)
        .groupBy("url", "kind", "name")
        .agg(F.sum("w").alias("w"))
    )
    heavy = heavy_keys(weights, "url", "w", NAMES_PER_TASK)
    counts = (
        spread_join(per_url, weights, "url", "name", heavy)
        .groupBy(*DAY_COUNTRY, "kind", "name")
        .agg(F.sum(F.col("n") * F.col("w")).alias("c"))
    )
    return _top_lists(counts, cfg.top_entities)
