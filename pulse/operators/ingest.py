"""Events feed -> raw events; raw events + knowledge graph -> enriched events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.config import DEFAULTS, PulseConfig
from pulse.functions.dates import AsOf, day_of_key, first_day, first_day_key
from pulse.functions.text import entity_list
from pulse.operators.skew import PAIRS_PER_TASK, key_grid, spread_left_join

EVENT_COLUMNS = [
    "event_date", "country", "admin1", "lat", "lon",
    "EventCode", "EventBaseCode", "EventRootCode", "tone", "url",
]


def event_rows(feed: DataFrame) -> DataFrame:
    """Feed rows as events, with the first known place of the three actors."""

    def first_known(suffix: str):
        return F.coalesce(*(f"{who}Geo_{suffix}" for who in ("Action", "Actor1", "Actor2")))

    return feed.select(
        day_of_key(F.col("SQLDATE")).alias("event_date"),
        first_known("CountryCode").alias("country"),
        first_known("ADM1Code").alias("admin1"),
        first_known("Lat").alias("lat"),
        first_known("Long").alias("lon"),
        "EventCode",
        "EventBaseCode",
        "EventRootCode",
        F.col("AvgTone").alias("tone"),
        F.col("SOURCEURL").alias("url"),
    )


def ingest_events(feed: DataFrame, as_of: AsOf = None, cfg: PulseConfig = DEFAULTS) -> DataFrame:
    """Events of the last ``raw_days``."""
    # the bound is on the raw key, not on the derived date: it is pushed to the scan
    return event_rows(feed.where(F.col("SQLDATE") >= first_day_key(as_of, cfg.raw_days)))


def recent_located(events: DataFrame, as_of: AsOf, cfg: PulseConfig) -> DataFrame:
    """Events of the last ``recent_days`` that carry a country and a url."""
    return events.where(
        (F.col("event_date") >= first_day(as_of, cfg.recent_days))
        & F.col("country").isNotNull()
        & F.col("url").isNotNull()
    )


def _recent_graph(gkg_feed: DataFrame, as_of: AsOf, cfg: PulseConfig) -> DataFrame:
    return gkg_feed.where(
        (F.col("date") >= first_day_key(as_of, cfg.recent_days) * 1_000_000)
        & F.col("DocumentIdentifier").isNotNull()
    )


def graph_entities(
    gkg_feed: DataFrame, as_of: AsOf = None, cfg: PulseConfig = DEFAULTS, latest_only: bool = False
) -> DataFrame:
    """Knowledge-graph rows of the last ``recent_days`` as url + three capped arrays.

    The long delimited fields are split and capped here, on the scan side, so
    that only the kept entries are shuffled. ``latest_only`` keeps the newest
    row of each url, as the greatest (date, themes, persons, orgs); it is combined on
    the map side, so a repeated url costs one row per map task.
    """
    recent = _recent_graph(gkg_feed, as_of, cfg)
    arrays = recent.select(
        F.col("DocumentIdentifier").alias("url"),
        entity_list(F.col("V2Themes"), cfg.max_themes).alias("themes"),
        entity_list(F.col("V2Persons"), cfg.max_persons).alias("persons"),
        entity_list(F.col("V2Organizations"), cfg.max_orgs).alias("orgs"),
        "date",
    )
    if not latest_only:
        return arrays.drop("date")
    row = F.struct("date", "themes", "persons", "orgs")
    newest = arrays.groupBy("url").agg(F.max(row).alias("row"))
    return newest.select("url", "row.themes", "row.persons", "row.orgs")


def enrich_events(
    events: DataFrame,
    gkg_feed: DataFrame,
    as_of: AsOf = None,
    cfg: PulseConfig = DEFAULTS,
    latest_only: bool = False,
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Recent events LEFT JOIN knowledge graph on url, fields split to arrays.

    The join is many-to-many: an event is repeated for every graph row of its
    url. Urls whose events times graph rows are more than ``pairs_per_task`` are dealt
    over a grid of tasks, by sizes counted on the url columns alone. So neither a url
    with a third of the events nor one with a third of the graph rows, nor one that is
    small on both sides and large as a product, ends up in one task.
    """
    base = recent_located(events.select(*EVENT_COLUMNS), as_of, cfg)
    graph = graph_entities(gkg_feed, as_of, cfg, latest_only)
    urls = _recent_graph(gkg_feed, as_of, cfg).groupBy(F.col("DocumentIdentifier").alias("url"))
    rows = F.lit(1).cast("bigint") if latest_only else F.count("*")
    grid = key_grid(
        base.groupBy("url").agg(F.count("*").alias("n")), urls.agg(rows.alias("n")), "url", pairs_per_task
    )
    joined = spread_left_join(base, graph, "url", grid)
    nothing = F.array().cast("array<string>")
    arrays = (F.coalesce(c, nothing).alias(c) for c in ("themes", "persons", "orgs"))
    return joined.select(*EVENT_COLUMNS, *arrays)
