import datetime as dt

import pytest
from pyspark.sql import functions as F

from frames import AS_OF, DAY, events_feed, final_plan_of, frame, gkg_feed, plan_of
from pulse.functions.dates import day_of_key
from pulse.operators.ingest import enrich_events, ingest_events
from pulse.operators.skew import key_grid
from pulse.schemas import TABLES


def test_first_known_place(spark):
    def event(action, actor1, actor2):
        return {
            "ActionGeo_CountryCode": action, "Actor1Geo_CountryCode": actor1,
            "Actor2Geo_CountryCode": actor2, "Actor2Geo_Lat": 2.0,
        }

    feed = events_feed(
        spark, event("A", "B", "C"), event(None, "B", "C"), event(None, None, "C"),
        event(None, None, None),
    )
    rows = ingest_events(feed, AS_OF).collect()
    assert [r.country for r in rows] == ["A", "B", "C", None]
    assert {r.lat for r in rows} == {2.0}
    assert rows[0].event_date == DAY
    assert ingest_events(feed, AS_OF).schema == TABLES["events_raw"]


def test_window_is_inclusive(spark):
    feed = events_feed(spark, *({"SQLDATE": d} for d in (20231130, 20231201, 20240130, 20240201)))
    days = [r.event_date for r in ingest_events(feed, AS_OF).collect()]
    assert days == [dt.date(2023, 12, 1), dt.date(2024, 1, 30), dt.date(2024, 2, 1)]


def test_day_of_key_rejects_impossible_days(spark):
    good = spark.range(1).select(day_of_key(F.lit(20240229)).alias("d")).first().d
    assert good == dt.date(2024, 2, 29)
    with pytest.raises(Exception, match="(?i)date"):
        spark.range(1).select(day_of_key(F.col("id") + 20230229)).collect()


def test_date_bounds_reach_the_parquet_scan(spark, tmp_path):
    events_feed(spark, {}).write.parquet(str(tmp_path / "e"))
    gkg_feed(spark, {}).write.parquet(str(tmp_path / "g"))
    feed = spark.read.parquet(str(tmp_path / "e"))
    plan = plan_of(ingest_events(feed, AS_OF).select("event_date", "tone"))
    assert "GreaterThanOrEqual(SQLDATE,20231201)" in plan
    assert "ReadSchema: struct<SQLDATE:bigint,AvgTone:double>" in plan
    raw = ingest_events(feed, AS_OF)
    plan = plan_of(enrich_events(raw, spark.read.parquet(str(tmp_path / "g")), AS_OF))
    assert "GreaterThanOrEqual(date,20240123000000)" in plan


def event(url, country="A", day=DAY):
    return {"event_date": day, "country": country, "url": url, "tone": 1.0}


def test_enrich_keeps_fan_out_and_unmatched_events(spark):
    events = frame(
        spark, "events_raw", event("u1"), event("u1"), event("u2"), event(None),
        event("u1", country=None), event("u1", day=dt.date(2024, 1, 22)),
    )
    graph = gkg_feed(
        spark,
        {"V2Themes": "X,1;Y,2", "V2Persons": "Ann,1"},
        {"V2Themes": "Z,1", "date": 20240125000000},
        {"V2Themes": "old,1", "date": 20240122235959},
        {"V2Themes": "none,1", "DocumentIdentifier": None},
    )
    made = enrich_events(events, graph, AS_OF)
    rows = sorted((r.url, r.themes, r.persons, r.orgs) for r in made.collect())
    assert rows == [
        ("u1", ["X,1", "Y,2"], ["Ann,1"], []),
        ("u1", ["X,1", "Y,2"], ["Ann,1"], []),
        ("u1", ["Z,1"], [], []),
        ("u1", ["Z,1"], [], []),
        ("u2", [], [], []),
    ]
    latest = enrich_events(events, graph, AS_OF, latest_only=True).collect()
    assert sorted(r.themes for r in latest) == [[], ["X,1", "Y,2"], ["X,1", "Y,2"]]


def hot_feeds(spark, n, graph_rows):
    """A third of the events and of the graph rows share one url, a tenth another one without graph rows."""
    url = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id"))
    own = F.when(F.col("id") % 10 == 1, "alone").otherwise(url)
    events = spark.range(0, n, 1, 8).select(
        F.lit(DAY).alias("event_date"), F.lit("A").alias("country"), own.alias("url"),
        F.col("id").cast("double").alias("tone"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["events_raw"]
          if f.name not in ("event_date", "country", "url", "tone")),
    )
    graph = spark.range(0, graph_rows, 1, 8).select(
        F.lit(20240129000000).alias("date"), url.alias("DocumentIdentifier"),
        F.concat(F.lit("T"), F.col("id"), F.lit(",1")).alias("V2Themes"),
        F.lit("Ann,1").alias("V2Persons"), F.lit(None).cast("string").alias("V2Organizations"),
    )
    return events, graph


@pytest.mark.parametrize("latest", [False, True])
@pytest.mark.parametrize("pairs", [500, 10_000, 10**9])
def test_hot_url_gives_the_rows_of_a_plain_join(spark, pairs, latest):
    events, graph = hot_feeds(spark, 600, 60)
    made = enrich_events(events, graph, AS_OF, latest_only=latest, pairs_per_task=pairs)
    pairs_of = {}
    for r in graph.collect():
        pairs_of.setdefault(r.DocumentIdentifier, []).append(r.V2Themes)
    expected = []
    for r in events.collect():
        themes = pairs_of.get(r.url, [None])
        expected += [(r.tone, t) for t in ([max(themes)] if latest and themes[0] else themes)]
    key = lambda r: (r[0], r[1] or "")
    rows = [(r.tone, r.themes[0] if r.themes else None) for r in made.collect()]
    assert sorted(rows, key=key) == sorted(expected, key=key)


def test_hot_url_is_dealt_evenly(spark):
    """With AQE as it is by default; no task has more than three times the median rows."""
    events, graph = hot_feeds(spark, 3000, 300)
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "100000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        made = enrich_events(events, graph, AS_OF, pairs_per_task=500)
        plan = final_plan_of(made)
        sizes = [r.n for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    hot = sum(1 for i in range(3000) if i % 3 == 0 and i % 10 != 1)
    assert sum(sizes) == hot * 100 + 3000 - hot
    assert len(sizes) == 16 and max(sizes) <= 3 * sorted(sizes)[8]
    assert "LeftAnti" not in plan and "LeftOuter" in plan


def test_grid_of_sizes(spark):
    kind = "url string, n long"
    left = spark.createDataFrame([("even", 1000), ("events", 10**6), ("light", 10), ("lonely", 5 * 10**6)], kind)
    right = spark.createDataFrame([("even", 1000), ("events", 1), ("light", 10), ("graph", 3 * 10**6), ("one", 1)], kind)
    grid = {r.url: tuple(r)[1:] for r in key_grid(left, right, "url", 10_000).collect()}
    assert grid == {
        "even": (1000, 10, 10), "events": (1, 100, 1), "lonely": (0, 500, 1), "graph": (3 * 10**6, 1, 300),
    }
