from frames import AS_OF, events_feed
from pulse.operators.ingest import ingest_events
from pulse.operators.topics import country_topics
from pulse.config import PulseConfig
from pulse.schemas import EVENTS_FEED
from pulse.sinks.tables import TableStore
from pulse.streaming.country_day import (
    country_day_statistics,
    stream_to_tables,
    read_country_day,
    stream_country_day,
    stream_future_events,
    stream_raw_events,
)

STATS = ["event_date", "country", "headline_count", "avg_tone", "min_tone", "max_tone"]


def batches(spark):
    event = lambda day, country, tone: {
        "SQLDATE": day, "ActionGeo_CountryCode": country, "AvgTone": tone,
    }
    first = events_feed(
        spark, event(20240128, "A", 1.0), event(20240129, "A", 2.0), event(20240129, None, 9.0)
    )
    second = events_feed(
        spark, event(20240130, "B", -1.0), event(20240128, "A", 4.0), event(20231215, "C", 0.5),
        event(20231101, "A", 1.0),
    )
    return first, second


def rows(df):
    return sorted(df.select(STATS).collect(), key=str)


def test_stream_equals_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    feed = lambda: spark.readStream.schema(EVENTS_FEED).parquet(source)
    first, second = batches(spark)
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        stream_country_day(feed(), out, state, AS_OF).awaitTermination()
    # nothing new: a restart changes nothing
    stream_country_day(feed(), out, state, AS_OF).awaitTermination()
    batch = country_topics(
        ingest_events(first.unionAll(second), AS_OF), AS_OF, PulseConfig(recent_days=60)
    )
    streamed = read_country_day(spark, out)
    assert rows(streamed) == rows(batch)
    assert {r.country: r.headline_count for r in streamed.collect()}["C"] == 1


def test_a_repeated_batch_replaces_its_folder(spark, tmp_path):
    source, out = str(tmp_path / "feed"), str(tmp_path / "out")
    batches(spark)[0].coalesce(1).write.parquet(source)
    feed = lambda: spark.readStream.schema(EVENTS_FEED).parquet(source)
    # two runs without a common checkpoint both write batch 0
    for state in ("s1", "s2"):
        stream_country_day(feed(), out, str(tmp_path / state), AS_OF).awaitTermination()
    assert sum(r.headline_count for r in read_country_day(spark, out).collect()) == 2


def test_raw_events_are_appended_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    feed = lambda: spark.readStream.schema(EVENTS_FEED).parquet(source)
    for part in batches(spark):
        part.coalesce(1).write.mode("append").parquet(source)
        stream_raw_events(feed(), out, state, AS_OF).awaitTermination()
    first, second = batches(spark)
    expected = ingest_events(first.unionAll(second), AS_OF)
    back = spark.read.parquet(out).select(expected.columns)
    assert sorted(back.collect(), key=str) == sorted(expected.collect(), key=str)


def test_a_future_day_drops_no_later_event(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    feed = lambda: spark.readStream.schema(EVENTS_FEED).parquet(source)
    event = lambda day: {"SQLDATE": day, "ActionGeo_CountryCode": "A", "AvgTone": 1.0}
    for day in (20991231, 20240120, 20240121):
        events_feed(spark, event(day)).coalesce(1).write.mode("append").parquet(source)
        stream_country_day(feed(), out, state, AS_OF).awaitTermination()
    days = [str(r.event_date) for r in read_country_day(spark, out).orderBy("event_date").collect()]
    assert days == ["2024-01-20", "2024-01-21"]
    rejects = str(tmp_path / "rejects")
    stream_future_events(feed(), rejects, str(tmp_path / "state2"), AS_OF).awaitTermination()
    assert [str(r.event_date) for r in spark.read.parquet(rejects).collect()] == ["2099-12-31"]


def test_tables_of_a_stream(spark, tmp_path):
    """Late and future days are rejected, each batch counts once, folders stay few, expiry reads."""
    source, state = str(tmp_path / "feed"), str(tmp_path / "state")
    store = TableStore(spark, root=str(tmp_path / "tables"))
    feed = lambda: spark.readStream.schema(EVENTS_FEED).parquet(source)
    first, second = batches(spark)
    odd = events_feed(spark, {"SQLDATE": 20991231, "ActionGeo_CountryCode": "F"}, {"SQLDATE": None, "ActionGeo_CountryCode": "N"})
    for part in (first.unionAll(odd), second):
        part.coalesce(1).write.mode("append").parquet(source)
        stream_to_tables(feed(), store, state, AS_OF).awaitTermination()
    stream_to_tables(feed(), store, state, AS_OF).awaitTermination()
    batch = country_topics(ingest_events(first.unionAll(second), AS_OF), AS_OF, PulseConfig(recent_days=60))
    assert rows(country_day_statistics(store)) == rows(batch)
    rejected = {(str(r.event_date), r.reason) for r in store.read("events_rejected").collect()}
    assert rejected == {("2099-12-31", "future"), ("None", "no day"), ("2023-11-01", "late")}
    assert store.read("events_raw").count() == 6
    # a lost checkpoint: the batches come again and add nothing
    stream_to_tables(feed(), store, str(tmp_path / "other"), AS_OF).awaitTermination()
    assert rows(country_day_statistics(store)) == rows(batch)
    assert store.expire("events_raw", AS_OF, 1) == ["2023-12-15", "2024-01-28"]
    assert store.read("events_raw").count() == 3


def test_folders_of_a_long_stream(spark, tmp_path):
    source, state = str(tmp_path / "feed"), str(tmp_path / "state")
    store = TableStore(spark, root=str(tmp_path / "tables"))
    for k in range(7):
        events_feed(spark, {"AvgTone": float(k)}).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(EVENTS_FEED).parquet(source)
        stream_to_tables(feed, store, state, AS_OF, compact_every=3, keep_versions=2).awaitTermination()
    (row,) = country_day_statistics(store).collect()
    assert (row.headline_count, row.avg_tone, row.max_tone) == (7, 3.0, 6.0)
    assert store.read("events_raw").count() == 7
    assert len(list((tmp_path / "tables" / "country_day_sums" / "data").glob("version=*"))) <= 4
    assert len(store.manifest("events_raw").folders["2024-01-29"]) <= 3
    assert len(list((tmp_path / "tables" / "events_raw" / "data").glob("version=*"))) <= 5
