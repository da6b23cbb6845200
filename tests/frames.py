"""Hand-made feeds."""

import datetime as dt

from pulse.schemas import EVENTS_FEED, GKG_FEED, TABLES

AS_OF = dt.date(2024, 1, 30)
DAY = dt.date(2024, 1, 29)


def feed_event(**given):
    row = dict.fromkeys(EVENTS_FEED.fieldNames())
    row |= {
        "SQLDATE": 20240129,
        "ActionGeo_CountryCode": "A",
        "EventCode": "011",
        "EventBaseCode": "01",
        "EventRootCode": "01",
        "AvgTone": 1.0,
        "SOURCEURL": "u1",
    }
    return row | given


def events_feed(spark, *rows):
    return spark.createDataFrame([feed_event(**r) for r in rows], EVENTS_FEED)


def gkg_feed(spark, *rows):
    default = dict.fromkeys(GKG_FEED.fieldNames()) | {
        "date": 20240129000000,
        "DocumentIdentifier": "u1",
    }
    return spark.createDataFrame([default | r for r in rows], GKG_FEED)


def frame(spark, table, *rows):
    schema = TABLES[table]
    return spark.createDataFrame([dict.fromkeys(schema.fieldNames()) | r for r in rows], schema)


def plan_of(df):
    """Physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df):
    """Physical plan after adaptive execution."""
    df.collect()
    return plan_of(df)
