"""The daily run: every table, in order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.config import DEFAULTS, PulseConfig
from pulse.functions.dates import AsOf, first_day_key, resolved_day
from pulse.models.contracts import EmbeddingModel, TextModel
from pulse.models.local import HashedTerms, TemplateText
from pulse.operators.briefings import daily_briefings
from pulse.operators.entities import top_entities_from_feeds
from pulse.operators.ingest import enrich_events, ingest_events
from pulse.operators.mood import daily_mood, mood_map_feed
from pulse.operators.topics import country_topics, today_for_analogs
from pulse.operators.vectors import embed_topics, find_analogs, nest_analogs
from pulse.plans.ledger import Ledger, files_of, fingerprint
from pulse.sinks.tables import TableStore
from pulse.sources.countries import iso_countries


def run_daily(
    events_feed: DataFrame,
    gkg_feed: DataFrame,
    store: TableStore,
    as_of: AsOf = None,
    cfg: PulseConfig = DEFAULTS,
    embedding: EmbeddingModel | None = None,
    text: TextModel | None = None,
    country_dim: DataFrame | None = None,
    analog_mode: str = "post",
    with_enriched: bool = True,
    since: AsOf = None,
    ledger: Ledger | None = None,
    feeds: str | None = None,
) -> dict[str, DataFrame]:
    """Build every table in ``store`` and return them by name.

    Each step writes its table and the next one reads it, so that a lost executor
    costs a task. The day is fixed once, at the start. Top entities
    are counted from the feeds, not from the enriched table, whose event x graph-row
    fan-out they do not need; ``with_enriched=False`` skips that table. Tables that
    do not need each other are written side by side, so that the last tasks of one
    do not leave the cluster idle.

    With ``since``, the first day that the feed brings anew, only days from then on are read
    from the feed and replaced in the raw events and topics; days that left their windows are
    dropped. The result is that of a whole run as long as older days did not change.

    With a ``ledger``, steps that are finished and whose inputs did not change are not run
    again: after a failure the run goes on where it stopped, and a changed parameter or feed
    runs what depends on it. ``feeds`` names the state of the two feeds; by default it is a
    digest of their files. Models count by their ``repr``, which should name their settings.
    """
    embedding = embedding or HashedTerms()
    text = text or TemplateText()
    country_dim = iso_countries(store.spark) if country_dim is None else country_dim
    as_of = resolved_day(store.spark, as_of)
    store.create()
    made: dict[str, DataFrame] = {}
    if ledger and feeds is None:
        feeds = fingerprint(files_of(events_feed), files_of(gkg_feed))

    def save(
        name: str, make: Callable[[], DataFrame], *reads: str, feed: bool = False, uses: object = None, write=store.overwrite
    ) -> DataFrame:
        if ledger:
            versions = [(n, ledger.version(n)) for n in reads]
            made_of = fingerprint(name, as_of, cfg, uses, versions, feeds if feed else None)
            made[name] = ledger.step(name, made_of, lambda: write(name, make()))
        else:
            made[name] = write(name, make())
        return made[name]

    new_days: list[dt.date] = []
    if since is not None:
        first = resolved_day(store.spark, since)
        new_days = [first + dt.timedelta(days=i) for i in range((as_of - first).days + 1)]

    def by_day(keep_days: int):
        """Writes the new days of a table and drops those that left its window."""

        def write(name: str, df: DataFrame) -> DataFrame:
            if since is None or not store.exists(name):
                return store.overwrite(name, df)
            store.replace_days(name, df.where(F.col("event_date") >= F.lit(new_days[0])), new_days)
            store.expire(name, as_of, keep_days)
            return store.read(name)

        return write

    def ingested() -> DataFrame:
        recent = events_feed
        if since is not None and store.exists("events_raw"):
            recent = recent.where(F.col("SQLDATE") >= first_day_key(new_days[0], 0))
        return ingest_events(recent, as_of, cfg)

    raw = save("events_raw", ingested, feed=True, uses=since, write=by_day(cfg.raw_days))

    def enriched() -> None:
        if with_enriched:
            save("events_enriched", lambda: enrich_events(raw, gkg_feed, as_of, cfg), "events_raw", feed=True)

    def documents() -> tuple[DataFrame, DataFrame]:
        def topics_of() -> DataFrame:
            events = raw
            if since is not None and store.exists("daily_country_topics"):
                events = raw.where(F.col("event_date") >= F.lit(new_days[0]))
            return country_topics(events, as_of, cfg)

        topics = save("daily_country_topics", topics_of, "events_raw", uses=since, write=by_day(cfg.recent_days))
        vectors = lambda: embed_topics(topics, embedding, cfg)
        return topics, save("news_embeddings", vectors, "daily_country_topics", uses=embedding)

    def top_lists() -> DataFrame:
        lists = lambda: top_entities_from_feeds(raw, gkg_feed, as_of, cfg)
        return save("daily_top_entities", lists, "events_raw", feed=True)

    with ThreadPoolExecutor(3) as pool:
        steps = [pool.submit(step) for step in (enriched, documents, top_lists)]
    _, (topics, vectors), entities = (step.result() for step in steps)

    today = save("today_for_analogs", lambda: today_for_analogs(topics, cfg.top_n), "daily_country_topics")
    searched = lambda: find_analogs(vectors, today, cfg, analog_mode)
    flat = save("daily_analogs_flat", searched, "news_embeddings", "today_for_analogs", uses=analog_mode)
    analogs = save("daily_analogs", lambda: nest_analogs(flat, cfg.analog_topk), "daily_analogs_flat")
    facts = ("daily_country_topics", "daily_top_entities")
    briefings = save(
        "daily_briefings", lambda: daily_briefings(topics, entities, analogs, text, cfg), *facts, "daily_analogs", uses=text
    )
    scored = lambda: daily_mood(briefings, topics, entities, text, cfg)
    mood = save("daily_mood", scored, *facts, "daily_briefings", uses=text)
    # small, and the dimension has no version: made each time
    made["mood_map_feed"] = store.overwrite("mood_map_feed", mood_map_feed(mood, country_dim, cfg))
    return made
