"""Mood scores of the latest briefings and the feed of the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse import fixed
from pulse.config import DEFAULTS, PulseConfig
from pulse.functions.responses import blend_mood, parse_score
from pulse.functions.text import fill, readable_themes
from pulse.models.contracts import GenerationOptions, TextModel
from pulse.operators.dimension import with_country
from pulse.operators.inference import ask, spread_for_inference
from pulse.operators.ranking import latest_day
from pulse.operators.topics import DAY_COUNTRY


def sentiment_prompt():
    return fill(fixed.SENTIMENT_PROMPT, briefing=F.col("briefing_text"))


def summary_prompt():
    return fill(fixed.SUMMARY_PROMPT, country=F.col("country"))


def mood_context(briefings: DataFrame, topics: DataFrame, entities: DataFrame) -> DataFrame:
    """Latest briefings with their tone and themes; both may be missing."""
    newest = briefings.agg(F.max("event_date")).scalar()

    def on_newest(table: DataFrame, column: str) -> DataFrame:
        return table.where(F.col("event_date") == newest).select(*DAY_COUNTRY, column)

    return (
        latest_day(briefings)
        .join(on_newest(topics, "avg_tone"), DAY_COUNTRY, "left")
        .join(on_newest(entities, "top_themes"), DAY_COUNTRY, "left")
    )


def daily_mood(
    briefings: DataFrame,
    topics: DataFrame,
    entities: DataFrame,
    model: TextModel,
    cfg: PulseConfig = DEFAULTS,
    lenient: bool = False,
) -> DataFrame:
    """Score, blend with tone, summarise; a country without a score is left out.

    Rows without a score are dropped before the summary is asked for: the result
    is the same and no reply is paid for and thrown away.
    """
    context = mood_context(briefings, topics, entities)
    rows = spread_for_inference(context, DAY_COUNTRY, cfg.text_rows_per_task, at_most=cfg.top_n)
    scored = ask(
        rows,
        model,
        "sentiment",
        sentiment_prompt(),
        {"briefing": F.col("briefing_text")},
        GenerationOptions(cfg.temperature, cfg.max_tokens),
        "score_text",
    )
    score = parse_score(F.col("score_text"), lenient)
    blended = scored.withColumn("mood_score", blend_mood(score, F.col("avg_tone")))
    kept = blended.where(F.col("mood_score").isNotNull())
    facts = {
        "country": F.col("country"),
        "mood_score": F.col("mood_score"),
        "briefing": F.col("briefing_text"),
        "themes": readable_themes(F.array_join("top_themes.theme", fixed.ENTITY_SEPARATOR)),
    }
    summarised = ask(
        kept,
        model,
        "summary",
        summary_prompt(),
        facts,
        GenerationOptions(cfg.temperature, cfg.summary_tokens),
        "summary_ref",
    )
    return summarised.select(
        *DAY_COUNTRY, "mood_score", "top_themes", "briefing_text", "summary_ref"
    )


def mood_map_feed(
    mood: DataFrame, country_dim: DataFrame, cfg: PulseConfig = DEFAULTS
) -> DataFrame:
    """Latest mood per country with the map's codes, colour range and hover text.

    ``country_dim`` is (code, iso2, iso3, name, region), where ``code`` is what
    ``country`` holds (ISO-2 or FIPS); with ``valid_from`` it is matched by day. An unknown code keeps its row with NULL
    iso3. The join side is picked by size, so a small table is broadcast.
    """
    joined = with_country(latest_day(mood), country_dim, iso3="iso3", country_name="name", region="region")
    low, high = F.lit(cfg.mood_low), F.lit(cfg.mood_high)
    return joined.select(
        *DAY_COUNTRY,
        "iso3",
        "country_name",
        "region",
        "mood_score",
        F.least(F.greatest("mood_score", low), high).alias("mood_clamped"),
        low.alias("range_low"),
        high.alias("range_high"),
        F.lit(cfg.color_scale).alias("color_scale"),
        "top_themes",
        "briefing_text",
        "summary_ref",
    )
