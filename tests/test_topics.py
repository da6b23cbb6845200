import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frames import AS_OF, DAY, frame, plan_of
from pulse.config import PulseConfig
from pulse.operators.topics import (
    country_topics,
    merged_states,
    today_for_analogs,
    top_countries,
    topic_states,
    topics_of_states,
)
from pulse.schemas import TABLES


def event(**given):
    return {"event_date": DAY, "country": "A", "EventRootCode": "01", "tone": 1.0, "url": "u"} | given


def test_country_day(spark):
    events = frame(
        spark, "events_raw",
        event(tone=1.0, url="u2"), event(tone=-2.5, url="u1", EventRootCode="02"),
        event(tone=None, url="u1", EventRootCode=None), event(country=None),
        event(event_date=dt.date(2024, 1, 22)),
    )
    made = country_topics(events, AS_OF)
    assert made.schema.simpleString() == TABLES["daily_country_topics"].simpleString()
    (row,) = made.collect()
    assert (row.headline_count, row.avg_tone, row.min_tone, row.max_tone) == (3, -0.75, -2.5, 1.0)
    assert row.top_event_types == ["01", "02"]
    assert row.sample_urls == ["u1", "u2"]
    assert row.topic_doc == (
        "Country: A | Date: 2024-01-29 | Headlines: 3 | Tone avg/min/max: -0.75/-2.5/1 | "
        "Top Event Codes: 01, 02 | Sample URLs: u1 | u2"
    )


def test_missing_parts_make_the_document_null(spark):
    events = frame(
        spark, "events_raw", event(country="no url", url=None),
        event(country="no code", EventRootCode=None), event(country="no tone", tone=None),
    )
    rows = {r.country: r for r in country_topics(events, AS_OF).collect()}
    assert len(rows) == 3
    assert all(r.topic_doc is None for r in rows.values())
    assert rows["no url"].sample_urls is None
    assert rows["no code"].top_event_types is None
    assert rows["no tone"].avg_tone is None


def test_arrays_are_cut_to_the_smallest(spark):
    events = frame(
        spark, "events_raw",
        *(event(url=f"u{i:02d}", EventRootCode=f"{i:02d}") for i in range(40) for _ in range(2)),
    )
    (row,) = country_topics(events, AS_OF).collect()
    assert row.headline_count == 80
    assert row.top_event_types == [f"{i:02d}" for i in range(20)]
    assert row.sample_urls == [f"u{i:02d}" for i in range(30)]


def test_ties_go_by_country_and_latest_day_only(spark):
    topic = lambda c, n, day=DAY: {"event_date": day, "country": c, "headline_count": n}
    topics = frame(
        spark, "daily_country_topics", topic("B", 2), topic("A", 2), topic("C", 9),
        topic("D", 1), topic("E", 99, dt.date(2024, 1, 28)),
    )
    assert [r.country for r in top_countries(topics, 3).collect()] == ["C", "A", "B"]
    assert today_for_analogs(topics, 2).columns == ["event_date", "country"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(25, 29), st.sampled_from("ABC")), min_size=1), st.integers(1, 5))
def test_top_n_size(spark, events, n):
    made = country_topics(
        frame(spark, "events_raw", *(event(event_date=dt.date(2024, 1, d), country=c) for d, c in events)),
        AS_OF,
        PulseConfig(top_n=n),
    )
    last = max(d for d, _ in events)
    groups = {c for d, c in events if d == last}
    assert today_for_analogs(made, n).count() == min(n, len(groups))


def test_plan(spark, tmp_path):
    path = str(tmp_path / "raw")
    frame(spark, "events_raw", event()).write.partitionBy("event_date").parquet(path)
    made = country_topics(spark.read.schema(TABLES["events_raw"]).parquet(path), AS_OF)
    plan = plan_of(made)
    assert plan.count("WindowGroupLimit") == 2  # both sides of the shuffle
    assert plan.count("FileScan") == 1
    assert "Python" not in plan
    assert "event_date" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    top = plan_of(top_countries(spark.read.schema(made.schema).parquet(path)))
    assert "TakeOrderedAndProject" in top
    assert "Subquery" in top.split("PartitionFilters: [", 1)[1]


def test_states_of_parts_add_up(spark):
    events = frame(
        spark, "events_raw", event(country=None), event(tone=None), event(url=None, EventRootCode=None),
        *(event(url=f"u{i:02d}", EventRootCode=f"{i:02d}", tone=i / 4, country="AB"[i % 2]) for i in range(90)),
    )
    parts = [topic_states(events.where(F.coalesce(F.crc32("url") % 3, F.lit(0)) == k)) for k in range(3)]
    states = parts[0].unionAll(parts[1]).unionAll(parts[2])
    merged = topics_of_states(merged_states(states))
    assert sorted(merged.collect()) == sorted(country_topics(events, AS_OF).collect())
    # bounded: the numbers, 20 codes and 30 urls of each country-day
    assert merged_states(states).count() == 2 * (1 + 20 + 30)
