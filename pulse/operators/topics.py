"""Raw events -> one row per country and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse import fixed
from pulse.config import DEFAULTS, PulseConfig
from pulse.functions.dates import AsOf, first_day
from pulse.functions.text import fill, plain_number
from pulse.operators.ranking import first_n_per_group, latest_day

DAY_COUNTRY = ["event_date", "country"]
STATE = [*DAY_COUNTRY, "kind", "value"]


# kinds of a state: the day's numbers, an event code, a url
FACTS, CODE, URL = 0, 1, 2


def topic_states(events: DataFrame, cfg: PulseConfig = DEFAULTS) -> DataFrame:
    """What a country-day's topic is made of, as rows that add up: ``kind, value`` and numbers.

    One pass over the events. Each event becomes up to three rows, which are combined on
    the map side by (day, country, kind, value), so a country-day with a third of all
    events has no group of its own in the shuffle. Of codes and urls the smallest are kept
    by rank, on both sides of the shuffle.
    """
    state = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    known = lambda kind, column: F.when(F.col(column).isNotNull(), state(kind, F.col(column)))
    rows = F.array(
        state(FACTS, F.lit(None).cast("string")), known(CODE, "EventRootCode"), known(URL, "url")
    )
    unrolled = events.where(F.col("country").isNotNull()).select(
        *DAY_COUNTRY, "tone", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("state")
    )
    unrolled = unrolled.select(*DAY_COUNTRY, "state.*", F.when(F.col("state.kind") == FACTS, F.col("tone")).alias("tone"))
    summed = unrolled.groupBy(*STATE).agg(
        F.count("*").alias("n"),
        F.count("tone").alias("tone_count"),
        F.sum("tone").alias("tone_sum"),
        F.min("tone").alias("min_tone"),
        F.max("tone").alias("max_tone"),
    )
    return _kept(summed, cfg)


def merged_states(states: DataFrame, cfg: PulseConfig = DEFAULTS) -> DataFrame:
    """States of several sets of events as those of all: no event is read again."""
    total = [F.sum(c).alias(c) for c in ("n", "tone_count", "tone_sum")]
    ends = [F.min("min_tone").alias("min_tone"), F.max("max_tone").alias("max_tone")]
    return _kept(states.groupBy(*STATE).agg(*total, *ends), cfg)


def _kept(states: DataFrame, cfg: PulseConfig) -> DataFrame:
    most = max(cfg.max_codes, cfg.max_urls)
    ranked = first_n_per_group(states, [*DAY_COUNTRY, "kind"], [F.col("value")], most)
    cap = F.when(F.col("kind") == CODE, cfg.max_codes).otherwise(cfg.max_urls)
    return ranked.where((F.col("kind") == FACTS) | (F.col("rank") <= cap)).drop("rank")


def topics_of_states(states: DataFrame) -> DataFrame:
    """One row per country-day from its states, with the text document."""
    fact = lambda c: F.max(F.when(F.col("kind") == FACTS, F.col(c)))

    def values(kind: int):
        found = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))
        return F.when(F.size(found) > 0, found)

    made = states.groupBy(*DAY_COUNTRY).agg(
        fact("n").alias("headline_count"),
        (fact("tone_sum") / F.nullif(fact("tone_count"), F.lit(0))).alias("avg_tone"),
        fact("min_tone").alias("min_tone"),
        fact("max_tone").alias("max_tone"),
        values(CODE).alias("top_event_types"),
        values(URL).alias("sample_urls"),
    )
    return made.withColumn("topic_doc", topic_doc())


def country_topics(events: DataFrame, as_of: AsOf = None, cfg: PulseConfig = DEFAULTS) -> DataFrame:
    """Count, tone, event codes, sample urls and a text document per country-day.

    Arrays hold the smallest values, so the text is the same on every run. If a
    country-day has no url, no code or no tone, its ``topic_doc`` is NULL.
    """
    recent = events.where(F.col("event_date") >= first_day(as_of, cfg.recent_days))
    return topics_of_states(topic_states(recent, cfg))


def topic_doc():
    """The text document of a country-day."""
    return fill(
        fixed.TOPIC_DOC,
        country=F.col("country"),
        event_date=F.col("event_date"),
        headline_count=F.col("headline_count"),
        avg_tone=plain_number(F.col("avg_tone")),
        min_tone=plain_number(F.col("min_tone")),
        max_tone=plain_number(F.col("max_tone")),
        codes=F.array_join("top_event_types", fixed.CODE_SEPARATOR),
        urls=F.array_join("sample_urls", fixed.URL_SEPARATOR),
    )


def top_countries(topics: DataFrame, top_n: int = DEFAULTS.top_n) -> DataFrame:
    """The latest day's rows with most headlines; ties go by country.

    ORDER BY + LIMIT is planned as TakeOrderedAndProject: every task keeps n rows.
    """
    return latest_day(topics).orderBy(F.desc("headline_count"), "country").limit(top_n)


def today_for_analogs(topics: DataFrame, top_n: int = DEFAULTS.top_n) -> DataFrame:
    return top_countries(topics, top_n).select(*DAY_COUNTRY)
