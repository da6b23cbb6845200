"""One schema per table; sinks check frames against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE, STRING, LONG, DOUBLE = T.DateType(), T.StringType(), T.LongType(), T.DoubleType()
STRINGS = T.ArrayType(STRING)
FLOATS = T.ArrayType(T.FloatType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_DAY_COUNTRY = {"event_date": DATE, "country": STRING}
_EVENT = {
    **_DAY_COUNTRY,
    "admin1": STRING,
    "lat": DOUBLE,
    "lon": DOUBLE,
    "EventCode": STRING,
    "EventBaseCode": STRING,
    "EventRootCode": STRING,
    "tone": DOUBLE,
    "url": STRING,
}
_THEMES = T.ArrayType(_schema(theme=STRING, c=LONG))
_PEOPLE = T.ArrayType(_schema(person=STRING, c=LONG))
_ANALOG = {"past_date": DATE, "snippet": STRING, "distance": DOUBLE}

EVENTS_FEED = _schema(
    SQLDATE=LONG,
    ActionGeo_CountryCode=STRING,
    Actor1Geo_CountryCode=STRING,
    Actor2Geo_CountryCode=STRING,
    ActionGeo_ADM1Code=STRING,
    Actor1Geo_ADM1Code=STRING,
    Actor2Geo_ADM1Code=STRING,
    ActionGeo_Lat=DOUBLE,
    Actor1Geo_Lat=DOUBLE,
    Actor2Geo_Lat=DOUBLE,
    ActionGeo_Long=DOUBLE,
    Actor1Geo_Long=DOUBLE,
    Actor2Geo_Long=DOUBLE,
    EventCode=STRING,
    EventBaseCode=STRING,
    EventRootCode=STRING,
    AvgTone=DOUBLE,
    SOURCEURL=STRING,
)
GKG_FEED = _schema(
    date=LONG,
    DocumentIdentifier=STRING,
    V2Themes=STRING,
    V2Persons=STRING,
    V2Organizations=STRING,
)
COUNTRY_DIM = _schema(code=STRING, iso2=STRING, iso3=STRING, name=STRING, region=STRING)

TABLES: dict[str, T.StructType] = {
    "events_raw": _schema(**_EVENT),
    "events_enriched": _schema(**_EVENT, themes=STRINGS, persons=STRINGS, orgs=STRINGS),
    "daily_country_topics": _schema(
        **_DAY_COUNTRY,
        headline_count=LONG,
        avg_tone=DOUBLE,
        min_tone=DOUBLE,
        max_tone=DOUBLE,
        top_event_types=STRINGS,
        sample_urls=STRINGS,
        topic_doc=STRING,
    ),
    "news_embeddings": _schema(**_DAY_COUNTRY, topic_doc=STRING, embedding=FLOATS, id=STRING),
    "daily_top_entities": _schema(**_DAY_COUNTRY, top_themes=_THEMES, top_people=_PEOPLE),
    "today_for_analogs": _schema(**_DAY_COUNTRY),
    "daily_analogs_flat": _schema(**_DAY_COUNTRY, **_ANALOG),
    "daily_analogs": _schema(
        **_DAY_COUNTRY, analogs=T.ArrayType(_schema(**_ANALOG)), analogs_txt=STRING
    ),
    "daily_briefings": _schema(**_DAY_COUNTRY, briefing_text=STRING),
    "daily_mood": _schema(
        **_DAY_COUNTRY,
        mood_score=DOUBLE,
        top_themes=_THEMES,
        briefing_text=STRING,
        summary_ref=STRING,
    ),
    "mood_map_feed": _schema(
        **_DAY_COUNTRY,
        iso3=STRING,
        country_name=STRING,
        region=STRING,
        mood_score=DOUBLE,
        mood_clamped=DOUBLE,
        range_low=DOUBLE,
        range_high=DOUBLE,
        color_scale=STRING,
        top_themes=_THEMES,
        briefing_text=STRING,
        summary_ref=STRING,
    ),
}

# kept by the streams
STREAM_TABLES: dict[str, T.StructType] = {
    "events_rejected": _schema(**_EVENT, reason=STRING),
    "country_day_sums": _schema(
        **_DAY_COUNTRY, headline_count=LONG, tone_count=LONG, tone_sum=DOUBLE, min_tone=DOUBLE, max_tone=DOUBLE
    ),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of ``schema``; a missing column raises."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
