"""Briefings of the latest day's top countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse import fixed
from pulse.config import DEFAULTS, PulseConfig
from pulse.functions.text import fill, readable_people, readable_themes, snippet
from pulse.models.contracts import GenerationOptions, TextModel
from pulse.operators.inference import ERROR, ask, spread_for_inference
from pulse.operators.topics import DAY_COUNTRY, top_countries


def briefing_context(
    topics: DataFrame,
    entities: DataFrame,
    analogs: DataFrame,
    cfg: PulseConfig = DEFAULTS,
    snippets: DataFrame | None = None,
) -> DataFrame:
    """Text inputs of a briefing, one row per top country of the latest day.

    ``snippets`` (``operators.snippets.country_snippets``) follow the headlines in the
    context, where there are some.

    Entities and analogs hold one row per country-day, so the left joins change
    no row count and the top-n cut can come first; only n rows are joined. The
    day is repeated on the other two tables, where it prunes partitions.
    """
    newest = topics.agg(F.max("event_date")).scalar()

    def on_newest(table: DataFrame, *columns: str) -> DataFrame:
        return table.where(F.col("event_date") == newest).select(*DAY_COUNTRY, *columns)

    top = top_countries(topics, cfg.top_n).select(
        *DAY_COUNTRY,
        "headline_count",
        snippet(F.col("topic_doc"), cfg.context_chars).alias("ctx"),
    )
    joined = top.join(on_newest(entities, "top_themes", "top_people"), DAY_COUNTRY, "left").join(
        on_newest(analogs, "analogs_txt"), DAY_COUNTRY, "left"
    )
    if snippets is not None:
        joined = joined.join(on_newest(snippets, "snippets"), DAY_COUNTRY, "left")
        joined = joined.withColumn("ctx", F.concat_ws("\n", "ctx", "snippets")).drop("snippets")
    themes = F.array_join("top_themes.theme", fixed.ENTITY_SEPARATOR)
    people = F.array_join("top_people.person", fixed.ENTITY_SEPARATOR)
    return joined.select(
        *DAY_COUNTRY,
        "headline_count",
        "ctx",
        F.coalesce("analogs_txt", F.lit(fixed.NO_ANALOGS)).alias("analogs_txt"),
        readable_themes(themes).alias("themes_nice"),
        readable_people(people).alias("people_nice"),
    )


def briefing_prompt():
    """Prompt column over the rows of ``briefing_context``."""
    return fill(
        fixed.BRIEFING_PROMPT,
        country=F.col("country"),
        themes=F.coalesce("themes_nice", F.lit(fixed.NO_ENTITIES)),
        people=F.coalesce("people_nice", F.lit(fixed.NO_ENTITIES)),
        context=F.col("ctx"),
        analogs=F.col("analogs_txt"),
    )


def briefing_replies(
    topics: DataFrame,
    entities: DataFrame,
    analogs: DataFrame,
    model: TextModel,
    cfg: PulseConfig = DEFAULTS,
    snippets: DataFrame | None = None,
) -> DataFrame:
    """(event_date, country, briefing_text, error), a row for every country that was asked about."""
    context = briefing_context(topics, entities, analogs, cfg, snippets)
    rows = spread_for_inference(context, DAY_COUNTRY, cfg.text_rows_per_task, at_most=cfg.top_n)
    facts = {
        "country": F.col("country"),
        "headline_count": F.col("headline_count"),
        "themes": F.col("themes_nice"),
        "people": F.col("people_nice"),
        "context": F.col("ctx"),
        "analogs": F.col("analogs_txt"),
    }
    options = GenerationOptions(cfg.temperature, cfg.max_tokens)
    replied = ask(rows, model, "briefing", briefing_prompt(), facts, options, "briefing_text")
    return replied.select(*DAY_COUNTRY, "briefing_text", ERROR)


def daily_briefings(
    topics: DataFrame,
    entities: DataFrame,
    analogs: DataFrame,
    model: TextModel,
    cfg: PulseConfig = DEFAULTS,
    snippets: DataFrame | None = None,
) -> DataFrame:
    """(event_date, country, briefing_text); countries without a reply are left out."""
    replied = briefing_replies(topics, entities, analogs, model, cfg, snippets).drop(ERROR)
    return replied.where(F.col("briefing_text").isNotNull())
