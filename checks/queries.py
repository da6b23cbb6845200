"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import AS_OF
from pulse import fixed
from pulse.functions.pages import canonical_url, opening_words
from pulse.functions.responses import blend_mood, parse_score, response_text
from pulse.functions.searches import register_searches
from pulse.functions.text import (
    capitalise,
    entity_list,
    plain_number,
    readable_people,
    readable_themes,
    snippet,
)
from pulse.models.batch import BatchEmbedding, BatchText, Calls
from pulse.models.local import HashedTerms, TemplateText
from pulse.operators import annindex, briefings, entities, ingest, mood, snippets, topics, trends, vectors
from pulse.operators.dimension import with_country
from pulse.operators.knn import topk_cosine
from pulse.plans.daily import run_daily
from pulse.plans.ledger import Ledger
from pulse.schemas import EVENTS_FEED, TABLES
from pulse.sinks.scratch import scratch_folder
from pulse.sinks.tables import TableStore, export, unexpired
from pulse.sources.feeds import read_dirty_events_feed, read_dirty_gkg_feed, read_events_feed
from pulse.streaming.country_day import (
    country_day_statistics,
    read_country_day,
    stream_country_day,
    stream_to_tables,
)

QUERY_TEXT = "Headlines about error and purchase in NATION_7"
SIMILAR_COUNTRY, SIMILAR_DAY = "C3", "2024-01-20"
EMBEDDING = HashedTerms()
TEXT = TemplateText()


# --- intermediate tables -------------------------------------------------------
def _raw(spark, d):
    return ingest.ingest_events(views.events_feed(spark, d), AS_OF)


def _enriched(spark, d, latest_only=False):
    return ingest.enrich_events(
        _raw(spark, d), views.gkg_feed(spark, d), AS_OF, latest_only=latest_only
    )


def _topics(spark, d):
    return topics.country_topics(_raw(spark, d), AS_OF)


def _entities(spark, d):
    return entities.top_entities_from_feeds(_raw(spark, d), views.gkg_feed(spark, d), AS_OF)


def _unreliable():
    """Raises for texts whose digest begins with 0, 1 or 2, and once for those with d, e or f.

    A closure, so that it travels to the executors by value.
    """

    def check():
        from hashlib import md5

        failed = set()

        def checked(texts):
            for text in texts:
                first = md5(text.encode()).hexdigest()[0]
                if first in "012":
                    raise ValueError("refused")
                if first in "def" and text not in failed:
                    failed.add(text)
                    raise ConnectionError("busy")

        return checked

    return check


class _Tables:
    """The tables of one daily run; those that are read more than once are stored."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.store = TableStore(spark, root=scratch_folder(spark, "tables"))

    @cached_property
    def topics(self) -> DataFrame:
        return self.store.overwrite("daily_country_topics", _topics(self.spark, self.d))

    @cached_property
    def embeddings(self) -> DataFrame:
        made = vectors.embed_topics(self.topics, EMBEDDING)
        return self.store.overwrite("news_embeddings", made)

    @cached_property
    def entities(self) -> DataFrame:
        return self.store.overwrite("daily_top_entities", _entities(self.spark, self.d))

    @cached_property
    def analogs_flat(self) -> DataFrame:
        return vectors.find_analogs(self.embeddings, topics.today_for_analogs(self.topics))

    @cached_property
    def analogs(self) -> DataFrame:
        return vectors.nest_analogs(self.analogs_flat)

    @cached_property
    def context(self) -> DataFrame:
        return briefings.briefing_context(self.topics, self.entities, self.analogs)

    @cached_property
    def briefings(self) -> DataFrame:
        made = briefings.daily_briefings(self.topics, self.entities, self.analogs, TEXT)
        return self.store.overwrite("daily_briefings", made)

    @cached_property
    def mood(self) -> DataFrame:
        made = mood.daily_mood(self.briefings, self.topics, self.entities, TEXT)
        return self.store.overwrite("daily_mood", made)


def _dated_analogs(spark, d, **options):
    base = views.dated_vectors(spark, d)
    today = topics.today_for_analogs(base)
    return vectors.find_analogs(base, today, keep_past_country=True, **options)


# --- flat, comparable shapes ---------------------------------------------------
def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    for name in arrays:
        df = df.withColumn(name, F.array_join(name, "|"))
    return df


def _pairs(df: DataFrame, **arrays: str) -> DataFrame:
    """array<struct<name, c>> -> 'name=c|name=c'."""
    for name, key in arrays.items():
        text = F.transform(name, lambda x: F.concat(x[key], F.lit("="), x["c"].cast("string")))
        df = df.withColumn(name, F.array_join(text, "|"))
    return df


def _fine(name: str, places: int = 10) -> Column:
    return F.round(name, places).alias(name)


def _topic_rows(df: DataFrame) -> DataFrame:
    return _joined(df, "top_event_types", "sample_urls").select(
        "event_date", "country", "headline_count", _fine("avg_tone"), _fine("min_tone"),
        _fine("max_tone"), "top_event_types", "sample_urls", "topic_doc",
    )


# --- queries ---------------------------------------------------------------------
def ingest_events(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select(
        *(c for c in ingest.EVENT_COLUMNS if c != "tone"), _fine("tone")
    )


def enrich_gkg(spark, d):
    return _joined(_enriched(spark, d), "themes", "persons", "orgs").withColumn(
        "tone", F.round("tone", 10)
    )


def enrich_gkg_latest(spark, d):
    return _joined(_enriched(spark, d, True), "themes", "persons", "orgs").withColumn(
        "tone", F.round("tone", 10)
    )


def enrich_gkg_hot(spark, d):
    """Enriched rows per country-day where one url has a third of the events and many graph rows.

    The url's rows are events times graph rows, so the result is counted, not returned.
    """
    raw = ingest.ingest_events(views.hot_events_feed(spark, d), AS_OF)
    made = ingest.enrich_events(raw, views.hot_gkg_feed(spark, d), AS_OF, pairs_per_task=20_000)
    hot = (F.col("url") == views.HOT_URL).alias("hot")
    sizes = (F.sum(F.size(c)).alias(f"n_{c}") for c in ("themes", "persons", "orgs"))
    return made.groupBy("event_date", "country", hot).agg(F.count("*").alias("n_rows"), *sizes)


def canonical_urls(spark, d):
    pages = views.table(spark, d, "pages")
    return pages.select("page_id", "url", canonical_url(F.col("url")).alias("url_key"))


def page_openings(spark, d):
    """The first 300 characters of every page, and all that it says."""
    pages = views.table(spark, d, "pages")
    words = lambda chars: opening_words(F.col("html"), chars)
    return pages.select("page_id", words(300).alias("snippet"), F.md5(words(None).cast("binary")).alias("whole"))


def _with_snippets(spark, d):
    raw = ingest.ingest_events(views.paged_events_feed(spark, d), AS_OF)
    return snippets.with_snippets(raw, views.table(spark, d, "pages"))


def event_snippets(spark, d):
    """Events per day, country and address, with what its page says."""
    events = _with_snippets(spark, d)
    return events.groupBy("event_date", "country", "url_key", "snippet").agg(F.count("*").alias("n"))


def country_snippets(spark, d):
    return snippets.country_snippets(_with_snippets(spark, d))


def gkg_fields(spark, d):
    return _gkg_fields(spark, d, 50, 30, 30)


def gkg_fields_uncapped(spark, d):
    """All entries of every field."""
    return _gkg_fields(spark, d, None, None, None)


def _gkg_fields(spark, d, themes, persons, orgs):
    feed = views.gkg_feed(spark, d)
    return feed.select(
        "date",
        "DocumentIdentifier",
        F.array_join(entity_list(F.col("V2Themes"), themes), "|").alias("themes"),
        F.array_join(entity_list(F.col("V2Persons"), persons), "|").alias("persons"),
        F.array_join(entity_list(F.col("V2Organizations"), orgs), "|").alias("orgs"),
    )


def country_topics(spark, d):
    return _topic_rows(_topics(spark, d))


def country_topics_from_states(spark, d):
    """Topics from the states of three parts of the events, none of which is read again."""
    raw = _raw(spark, d).where(F.col("event_date") >= F.lit(AS_OF - dt.timedelta(days=7)))
    part = F.coalesce(F.crc32("url") % 3, F.lit(0))
    states = [topics.topic_states(raw.where(part == k)) for k in range(3)]
    merged = topics.merged_states(states[0].unionAll(states[1]).unionAll(states[2]))
    return _topic_rows(topics.topics_of_states(merged))


def top_countries_latest(spark, d):
    return _topic_rows(topics.top_countries(_topics(spark, d)))


def today_for_analogs(spark, d):
    return topics.today_for_analogs(_topics(spark, d))


def news_embeddings(spark, d):
    text = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint"))
    made = vectors.embed_topics(_Tables(spark, d).topics, EMBEDDING)
    return made.withColumn("embedding", F.array_join(text.cast("array<string>"), ","))


def news_embeddings_batched(spark, d):
    """Vectors of a model in Python, which fails on some documents for good and on some once."""
    text = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint"))

    unreliable = _unreliable()

    def load():
        check = unreliable()

        def infer(texts):
            check(texts)
            return [[len(t), t.count("e"), t.count("7"), 1] for t in texts]

        return infer

    model = BatchEmbedding(load, batch_size=32, calls=Calls(attempts=2, pause_seconds=0.0))
    made = vectors.embedding_replies(_Tables(spark, d).topics, model)
    return made.withColumn("embedding", F.array_join(text.cast("array<string>"), ","))


def top_entities(spark, d):
    made = entities.top_entities(_enriched(spark, d), AS_OF)
    return _pairs(made, top_themes="theme", top_people="person")


def top_entities_from_feeds(spark, d):
    return _pairs(_entities(spark, d), top_themes="theme", top_people="person")


def top_entities_unweighted(spark, d):
    made = entities.top_entities(_enriched(spark, d), AS_OF, weighted=False)
    return _pairs(made, top_themes="theme", top_people="person")


def vector_topk(spark, d):
    """The 10 vectors nearest to the mean vector of every label."""
    base = views.table(spark, d, "embeddings")
    means = (
        base.select("label", F.posexplode("embedding"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("embedding"))
    )
    found = topk_cosine(base, means, 10, id="vec_id", anchor_id="label")
    return found.select(F.col("anchor_id").alias("label"), "vec_id", _fine("distance", 6), "rank")


def vector_topk_all(spark, d):
    """The 10 nearest of every vector (itself the first), by the plans for many anchors."""
    base = views.table(spark, d, "embeddings")
    anchors = base.select(F.col("vec_id").alias("anchor_id"), "embedding")
    found = topk_cosine(base, anchors, 10, id="vec_id", max_broadcast_anchors=0, max_base_bytes=0)
    return found.select("anchor_id", "vec_id", _fine("distance", 6), "rank")


def vector_topk_approx(spark, d):
    """Per label: whether the index finds 0.9 of the 10 nearest of every 100th vector, and ranks
    less than 0.85 of the base for that.

    The given vectors have no clusters, so three quarters of the cells are probed.
    """
    base = views.table(spark, d, "embeddings")
    anchors = base.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("anchor_id"), "label", "embedding")
    index = annindex.build_index(base, scratch_folder(spark, "index"), id="vec_id")
    probes = max(1, round(len(index.centroids) * 0.75))
    near = annindex.search_index(index, anchors, 10, probes=probes, id="vec_id").select("anchor_id", "vec_id", "distance")
    exact = topk_cosine(base, anchors, 10, id="vec_id").select("anchor_id", "vec_id", "distance")
    hits = exact.join(near.select("anchor_id", "vec_id", F.lit(1).alias("hit")), ["anchor_id", "vec_id"], "left")
    hits = hits.groupBy("anchor_id").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    scored = annindex.scored_rows(index, anchors, probes)
    all_rows = float(index.sizes.sum())
    each = anchors.select("anchor_id", "label").join(hits, "anchor_id").join(scored, "anchor_id")
    return each.groupBy("label").agg(
        F.count("*").alias("anchors"),
        (F.sum("hits") / F.sum("n") >= 0.9).alias("recall_reached"),
        (F.avg("rows") / all_rows < 0.85).alias("part_ranked"),
    )


def similar_to_day_post(spark, d):
    return _similar_to_day(spark, d, "post")


def similar_to_day_pre(spark, d):
    return _similar_to_day(spark, d, "pre")


def _similar_to_day(spark, d, mode):
    base = views.dated_vectors(spark, d)
    found = vectors.similar_to_day(base, SIMILAR_COUNTRY, SIMILAR_DAY, mode=mode)
    return found.withColumn("distance", F.round("distance", 6))


def similar_to_text(spark, d):
    found = vectors.similar_to_text(_Tables(spark, d).embeddings, QUERY_TEXT, EMBEDDING)
    return found.withColumn("distance", F.round("distance", 6))


def _searched_in_sql(spark, embeddings, call, mode="post"):
    """Rows of a table function over a view of the embeddings."""
    embeddings.createOrReplaceTempView("searched_embeddings")
    EMBEDDING.sql_function(spark, "embed_text")
    register_searches(spark, "searched_embeddings", "embed_text", mode=mode)
    found = spark.sql(f"SELECT * FROM {call}")
    return found.withColumn("distance", F.round("distance", 6))


def sql_similar_to_day_post(spark, d):
    call = f"similar_to_day('{SIMILAR_COUNTRY}', DATE '{SIMILAR_DAY}')"
    return _searched_in_sql(spark, views.dated_vectors(spark, d), call)


def sql_similar_to_day_pre(spark, d):
    call = f"similar_to_day('{SIMILAR_COUNTRY}', DATE '{SIMILAR_DAY}')"
    return _searched_in_sql(spark, views.dated_vectors(spark, d), call, "pre")


def sql_similar_to_text(spark, d):
    return _searched_in_sql(spark, _Tables(spark, d).embeddings, f"similar_to_text('{QUERY_TEXT}')")


def analogs_flat(spark, d):
    return _dated_analogs(spark, d).withColumn("distance", F.round("distance", 6))


def analogs_flat_pre(spark, d):
    return _dated_analogs(spark, d, mode="pre").withColumn("distance", F.round("distance", 6))


def analogs_nested(spark, d):
    nested = vectors.nest_analogs(_dated_analogs(spark, d).drop("past_country"))
    far = F.transform("analogs.distance", lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    return nested.select(
        "event_date", "country", F.size("analogs").alias("n_analogs"), "analogs_txt",
        F.array_join(far, ",").alias("distances"),
    )


def topic_analogs(spark, d):
    return _Tables(spark, d).analogs_flat.withColumn("distance", F.round("distance", 6))


def theme_clean(spark, d):
    feed = views.gkg_feed(spark, d)
    return feed.select("date", "DocumentIdentifier", readable_themes(F.col("V2Themes")).alias("themes_nice"))


def people_clean(spark, d):
    feed = views.gkg_feed(spark, d)
    return feed.select("date", "DocumentIdentifier", readable_people(F.col("V2Persons")).alias("people_nice"))


def capitalised(spark, d):
    pages = views.table(spark, d, "pages")
    return pages.select("page_id", *(capitalise(F.col(c)).alias(f"{c}_capitalised") for c in ("url", "html")))


def url_free_text(spark, d):
    pages = views.table(spark, d, "pages")
    text = F.concat(F.lit("seen at "), "url", F.lit(" by page "), F.col("page_id").cast("string"))
    whole = snippet(F.col("html"), None)
    return pages.select("page_id", snippet(text, 400).alias("snippet"), whole.alias("url_free"))


def number_text(spark, d):
    events = views.table(spark, d, "events")
    return events.select("event_id", plain_number(F.col("value") - 100).alias("value_text"))


def briefing_context(spark, d):
    return _Tables(spark, d).context


def briefing_prompt(spark, d):
    return _Tables(spark, d).context.select(
        "event_date", "country", briefings.briefing_prompt().alias("prompt")
    )


def response_normalise(spark, d):
    """Replies of every shape, from the turns of the conversations."""
    turns = views.table(spark, d, "conversations")
    text = F.col("text").alias("text")
    shape = F.col("turn") % 6
    reply = F.when(F.col("conv_id") % 7 == 0, F.to_json(F.struct(F.struct(text).alias("text"))))
    candidate = lambda content: F.to_json(
        F.struct(
            F.struct(F.array(F.struct(content.alias("content"))).alias("candidates")).alias(
                "ml_generate_text_result"
            )
        )
    )
    raw = (
        F.when(shape == 1, candidate(F.struct(F.array(F.struct(text)).alias("parts"))))
        .when(shape == 2, candidate(F.array(F.struct(text))))
        .when(
            shape == 3,
            F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content"))).alias("predictions"))),
        )
        .when(shape == 4, F.coalesce(reply, F.to_json(F.struct(text))))
        .when(shape == 5, F.concat(F.lit("no json: "), "text"))
    )
    flat = F.when(shape == 0, F.col("text"))
    return turns.select("conv_id", "turn", response_text(flat, raw).alias("reply"))


def score_parse(spark, d):
    return _scored(spark, d).select("event_id", "reply", parse_score(F.col("reply")).alias("score"))


def score_parse_lenient(spark, d):
    score = parse_score(F.col("reply"), lenient=True)
    return _scored(spark, d).select("event_id", "reply", score.alias("score"))


def _scored(spark, d):
    """A reply per event: a decimal, an integer, a signed one in a sentence, or none."""
    id, value = F.col("event_id"), F.col("value")
    text = value.cast("string")
    reply = (
        F.when(id % 11 == 0, F.lit(None))
        .when(id % 5 == 0, value.cast("int").cast("string"))
        .when(id % 3 == 0, F.concat(F.lit("Score: -"), text, F.lit(", or so.")))
        .otherwise(text)
    )
    return views.table(spark, d, "events").select("event_id", "value", reply.alias("reply"))


def mood_blend(spark, d):
    tone = (F.lit(50) - F.col("value")) / 10
    score = parse_score(F.col("reply"))
    return _scored(spark, d).select("event_id", blend_mood(score, tone).alias("mood_score"))


def daily_briefings(spark, d):
    return _Tables(spark, d).briefings


def daily_briefings_batched(spark, d):
    """Replies of a model in Python, which fails on some prompts for good and on some once."""
    unreliable = _unreliable()

    def load(task, options):
        from hashlib import md5

        check = unreliable()

        def infer(prompts):
            check(prompts)
            return [f"{options.max_output_tokens} {md5(p.encode()).hexdigest()}" for p in prompts]

        return infer

    tables = _Tables(spark, d)
    model = BatchText(load, calls=Calls(attempts=2, pause_seconds=0.0))
    return briefings.briefing_replies(tables.topics, tables.entities, tables.analogs, model)


def sentiment_prompt(spark, d):
    return _Tables(spark, d).briefings.select(
        "event_date", "country", mood.sentiment_prompt().alias("prompt")
    )


def summary_prompt(spark, d):
    return _Tables(spark, d).briefings.select(
        "event_date", "country", mood.summary_prompt().alias("prompt")
    )


def daily_mood(spark, d):
    return _pairs(_Tables(spark, d).mood, top_themes="theme")


def mood_map_feed(spark, d):
    feed = mood.mood_map_feed(_Tables(spark, d).mood, views.country_dim(spark, d))
    return _pairs(feed, top_themes="theme")


def _day_scores(spark, d):
    """A score per country-day of all raw events: the tenth of its mean tone."""
    raw = _raw(spark, d).where(F.col("country").isNotNull())
    counted = raw.groupBy("event_date", "country").agg(
        F.count("*").alias("headline_count"), (F.avg("tone") / 10).alias("mood_score")
    )
    return counted


def mood_trend(spark, d):
    return trends.rolling_mood(_day_scores(spark, d)).select(
        "event_date", "country", _fine("mood_score"), _fine("rolling"), "days_seen"
    )


def mood_shift(spark, d):
    return trends.mood_shift(_day_scores(spark, d)).select(
        "event_date", "country", _fine("mood_score"), _fine("change"), _fine("z_score", 8), "alert"
    )


def region_rollup(spark, d):
    rolled = trends.region_rollup(_day_scores(spark, d), views.country_dim(spark, d))
    return rolled.withColumn("mood", F.round("mood", 10))


def regions_dated(spark, d):
    """Events per day and region of their country on that day."""
    rows = with_country(_raw(spark, d), views.dated_country_dim(spark, d), region="region", iso3="iso3")
    return rows.groupBy("event_date", "region").agg(F.count("*").alias("n"), F.count("iso3").alias("known"))


def full_run(spark, d):
    """Every table of the daily run, written and read back; the feed is the result."""
    store = TableStore(spark, root=scratch_folder(spark, "daily"))
    made = run_daily(
        views.events_feed(spark, d),
        views.gkg_feed(spark, d),
        store,
        as_of=AS_OF,
        embedding=EMBEDDING,
        text=TEXT,
        country_dim=views.country_dim(spark, d),
    )
    return _pairs(made["mood_map_feed"], top_themes="theme")


def full_run_two_days(spark, d):
    """A run of the day before, then one that reads only the last day anew; equals one run."""
    store = TableStore(spark, root=scratch_folder(spark, "two-days"))
    before = AS_OF - dt.timedelta(days=1)
    events, graph, key = views.events_feed(spark, d), views.gkg_feed(spark, d), int(f"{AS_OF:%Y%m%d}")
    options = {"embedding": EMBEDDING, "text": TEXT, "country_dim": views.country_dim(spark, d)}
    known = events.where(F.col("SQLDATE") < key), graph.where(F.col("date") < key * 1_000_000)
    run_daily(*known, store, as_of=before, **options)
    made = run_daily(events, graph, store, as_of=AS_OF, since=AS_OF, **options)
    return _pairs(made["mood_map_feed"], top_themes="theme")


class _NoModel:
    """A text model that is down."""

    def generate(self, *_, **__):
        raise ConnectionError("the model is down")

    score = generate


def full_run_resumed(spark, d):
    """A run that stops at the text model, and a second one that goes on from there."""
    store = TableStore(spark, root=scratch_folder(spark, "resumed"))
    feeds = views.events_feed(spark, d), views.gkg_feed(spark, d)
    options = {"as_of": AS_OF, "embedding": EMBEDDING, "country_dim": views.country_dim(spark, d)}
    try:
        run_daily(*feeds, store, text=_NoModel(), ledger=Ledger(store), **options)
    except ConnectionError:
        pass
    again = Ledger(store)
    made = run_daily(*feeds, store, text=TEXT, ledger=again, **options)
    if again.ran != ["daily_briefings", "daily_mood"]:
        raise RuntimeError(f"steps were run twice: {again.ran}")
    return _pairs(made["mood_map_feed"], top_themes="theme")


def retention(spark, d):
    """Raw events that a 20-day retention keeps."""
    return unexpired(_raw(spark, d), AS_OF, 20).select(
        *(c for c in ingest.EVENT_COLUMNS if c != "tone"), _fine("tone")
    )


def stored_topics(spark, d):
    """Topics as the partitioned, sorted table gives them back."""
    return _topic_rows(_Tables(spark, d).topics)


def expired_partitions(spark, d):
    """Raw events left in the store once days older than 20 are dropped."""
    store = TableStore(spark, root=scratch_folder(spark, "expire"))
    store.overwrite("events_raw", _raw(spark, d))
    store.expire("events_raw", AS_OF, 20)
    left = store.read("events_raw")
    return left.groupBy("event_date").agg(F.count("*").alias("events"))


def exported_topics(spark, d):
    """Topics exported as JSON lines and read again."""
    path = scratch_folder(spark, "export")
    export(_topics(spark, d), path)
    return _topic_rows(spark.read.schema(TABLES["daily_country_topics"]).json(path))


def delimited_feed(spark, d):
    """Raw events from the feed written as tab-separated text."""
    path = scratch_folder(spark, "feed")
    views.events_feed(spark, d).write.option("header", True).option("sep", "\t").csv(path)
    raw = ingest.ingest_events(read_events_feed(spark, path, "tsv"), AS_OF)
    return raw.select(*(c for c in ingest.EVENT_COLUMNS if c != "tone"), _fine("tone"))


def _dirty_lines(feed: DataFrame, path: str, number: Column, key: str, day: str, value: str) -> None:
    """The feed as tab-separated lines; of every 50 one has an impossible day, one a bad number, one
    stops early."""
    names = feed.columns
    text = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ").alias(c) for c in names]
    kind = F.coalesce(number % 50, F.lit(0)).alias("kind")
    rows = feed.select(kind, *text)
    rows = rows.withColumn(key, F.when(F.col("kind") == 3, day).otherwise(F.col(key)))
    rows = rows.withColumn(value, F.when(F.col("kind") == 4, "x1").otherwise(F.col(value)))
    line = F.concat_ws("\t", *names)
    line = F.when(F.col("kind") == 5, F.concat_ws("\t", *names[:3])).otherwise(line)
    rows.select(line.alias("value")).write.text(path)


def delimited_feed_dirty(spark, d):
    """Events per day and country, and rejected lines by reason, of a feed with bad lines."""
    path = scratch_folder(spark, "dirty")
    number = F.substring_index("SOURCEURL", "/", -1).cast("bigint")
    feed = views.events_feed(spark, d)
    _dirty_lines(feed, path, number, "SQLDATE", "20240231", "AvgTone")
    good, rejected = read_dirty_events_feed(spark, path, columns=feed.columns)
    kept = ingest.ingest_events(good, AS_OF).groupBy("event_date", "country").agg(
        F.count("*").alias("n"), F.avg("tone").alias("avg_tone")
    )
    lost = rejected.groupBy("reason").agg(F.count("*").alias("n"))
    return kept.withColumn("reason", F.lit("")).unionByName(lost, allowMissingColumns=True).withColumn(
        "avg_tone", F.round("avg_tone", 8)
    )


def graph_feed_dirty(spark, d):
    """Graph rows per day and length of their themes, and rejected lines by reason."""
    path = scratch_folder(spark, "dirty")
    feed = views.gkg_feed(spark, d).select("DocumentIdentifier", "date", "V2Persons", "V2Organizations", "V2Themes")
    number = F.substring_index("DocumentIdentifier", "/", -1).cast("bigint")
    _dirty_lines(feed, path, number, "date", "20240231000000", "date")
    good, rejected = read_dirty_gkg_feed(spark, path, columns=feed.columns)
    kept = good.groupBy("date").agg(F.count("*").alias("n"), F.sum(F.length("V2Themes")).alias("theme_chars"))
    lost = rejected.groupBy("reason").agg(F.count("*").alias("n"))
    return kept.withColumn("reason", F.lit("")).unionByName(lost, allowMissingColumns=True)


def country_day_stream(spark, d):
    """Tone per country-day from a stream that has read the whole events table."""
    stream = spark.readStream.schema(views.SCHEMAS["events"]).parquet(f"{d}/events*.parquet")
    root = scratch_folder(spark, "stream")
    path = f"{root}/country_day"
    feed = views.as_feed(stream, spark, d)
    stream_country_day(feed, path, f"{root}/state", AS_OF).awaitTermination()
    return read_country_day(spark, path).select(
        "event_date", "country", "headline_count", _fine("avg_tone"), _fine("min_tone"),
        _fine("max_tone"),
    )


def country_day_stream_two_batches(spark, d):
    """Tone per country-day and rejected events of a feed that comes in two batches."""
    root = scratch_folder(spark, "batches")
    feed = views.shifted_events_feed(spark, d)
    store = TableStore(spark, root=f"{root}/tables")
    even = F.coalesce(F.crc32("SOURCEURL") % 2 == 0, F.lit(True))
    for part in (even, ~even):
        feed.where(part).write.mode("append").parquet(f"{root}/feed")
        stream = spark.readStream.schema(EVENTS_FEED).parquet(f"{root}/feed")
        stream_to_tables(stream, store, f"{root}/state", AS_OF).awaitTermination()
    kept = country_day_statistics(store).select(F.lit("kept").alias("kind"), "*")
    rejected = store.read("events_rejected").groupBy(F.col("reason").alias("kind"), "event_date", "country").agg(
        F.count("*").alias("headline_count"), F.avg("tone").alias("avg_tone"),
        F.min("tone").alias("min_tone"), F.max("tone").alias("max_tone"),
    )
    return kept.unionByName(rejected).select(
        "kind", "event_date", "country", "headline_count", _fine("avg_tone", 8), _fine("min_tone"), _fine("max_tone")
    )


QUERIES = {
    f.__name__: f
    for f in (
        ingest_events, enrich_gkg, enrich_gkg_latest, enrich_gkg_hot, canonical_urls, page_openings, event_snippets, country_snippets, gkg_fields, gkg_fields_uncapped, country_topics,
        country_topics_from_states,
        top_countries_latest, today_for_analogs, news_embeddings, news_embeddings_batched, top_entities,
        top_entities_from_feeds, top_entities_unweighted, vector_topk, vector_topk_all, vector_topk_approx, similar_to_day_post,
        similar_to_day_pre, similar_to_text, sql_similar_to_day_post, sql_similar_to_day_pre, sql_similar_to_text,
        regions_dated, analogs_flat, analogs_flat_pre, analogs_nested,
        topic_analogs, theme_clean, people_clean, capitalised, url_free_text, number_text,
        briefing_context, briefing_prompt, response_normalise, score_parse, score_parse_lenient,
        mood_blend, daily_briefings, daily_briefings_batched, sentiment_prompt, summary_prompt, daily_mood, mood_map_feed,
        mood_trend, mood_shift, region_rollup, full_run, full_run_two_days, full_run_resumed, retention, stored_topics, expired_partitions, exported_topics, delimited_feed,
        delimited_feed_dirty, graph_feed_dirty,
        country_day_stream, country_day_stream_two_batches,
    )
}
