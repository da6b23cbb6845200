import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from frames import AS_OF, DAY, events_feed, feed_event, frame, gkg_feed
from pulse import __main__ as command_line
from pulse.operators.ingest import ingest_events
from pulse.operators.mood import mood_map_feed
from pulse.plans.daily import run_daily
from pulse.plans.ledger import Ledger
from pulse.schemas import EVENTS_FEED, TABLES
from pulse.sinks.scratch import scratch_folder
from pulse.sinks.tables import ConcurrentWrite, TableStore, export, unexpired
from pulse.sources.feeds import read_dirty_events_feed, read_dirty_gkg_feed, read_events_feed, read_gkg_feed


@pytest.fixture(params=["root", "database"])
def store(request, spark, tmp_path):
    if request.param == "root":
        made = TableStore(spark, root=str(tmp_path / "tables"))
    else:
        made = TableStore(spark, database="pulse_test_" + tmp_path.name.replace("-", "_"))
    made.create()
    return made


def raw(spark, *days):
    return frame(
        spark, "events_raw",
        *({"event_date": d, "country": c, "tone": 1.0} for d in days for c in "CAB"),
    )


def test_overwrite_read_expire(spark, store):
    old, new = dt.date(2023, 12, 1), dt.date(2023, 11, 30)
    store.overwrite("events_raw", raw(spark, DAY))
    back = store.overwrite("events_raw", raw(spark, DAY, old, new))
    assert back.columns == TABLES["events_raw"].fieldNames()
    assert back.count() == 9
    assert unexpired(back, AS_OF, 60).count() == 6
    assert store.expire("events_raw", AS_OF, 60) == ["2023-11-30"]
    assert store.expire("events_raw", AS_OF, 60) == []
    assert sorted({r.event_date for r in store.read("events_raw").collect()}) == [old, DAY]


def test_files_are_partitioned_and_sorted(spark, tmp_path):
    store = TableStore(spark, root=str(tmp_path))
    store.overwrite("events_raw", raw(spark, DAY, dt.date(2024, 1, 28)))
    files = sorted(Path(tmp_path, "events_raw").glob("**/event_date=*/*.parquet"))
    assert {f.parent.name for f in files} == {"event_date=2024-01-28", "event_date=2024-01-29"}
    for file in files:
        countries = [r.country for r in spark.read.parquet(str(file)).collect()]
        assert countries == sorted(countries)
    store.overwrite("today_for_analogs", frame(spark, "today_for_analogs", {"event_date": DAY}))
    assert not list(Path(tmp_path, "today_for_analogs").glob("**/event_date=*"))


def test_a_heavy_day_is_written_by_several_tasks(spark, tmp_path):
    n = 20000
    heavy = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 10 == 0, F.lit(dt.date(2024, 1, 28))).otherwise(F.lit(DAY)).alias(
            "event_date"
        ),
        F.concat(F.lit("C"), F.col("id") % 50).alias("country"),
        F.sha2(F.col("id").cast("string"), 256).alias("url"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["events_raw"]
          if f.name not in ("event_date", "country", "url")),
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "200000")
    try:
        made = TableStore(spark, root=str(tmp_path)).overwrite("events_raw", heavy)
    finally:
        spark.conf.unset(key)
    files = list(Path(tmp_path, "events_raw").glob("**/event_date=2024-01-29/*.parquet"))
    assert len(files) > 2
    assert made.count() == n


def test_a_store_needs_one_place_and_the_right_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        TableStore(spark)
    with pytest.raises(ValueError, match="missing columns: country"):
        store = TableStore(spark, root=str(tmp_path))
        store.overwrite("today_for_analogs", raw(spark, DAY).drop("country"))


@pytest.mark.parametrize("format", ["parquet", "csv", "tsv", "json", "table"])
def test_feed_formats(spark, tmp_path, format):
    feed = events_feed(spark, {}, {"AvgTone": None, "SOURCEURL": "u,2"})
    columns = list(reversed(EVENTS_FEED.fieldNames()))
    source = feed.select(*columns).withColumn("AvgTone", feed.AvgTone)
    where = str(tmp_path / "feed")
    if format == "table":
        where = "feed_" + tmp_path.name
        source.write.mode("overwrite").saveAsTable(where)
    elif format in ("csv", "tsv"):
        source.write.option("header", True).option("sep", "," if format == "csv" else "\t").csv(where)
    else:
        source.write.format(format).save(where) if format == "parquet" else source.write.option(
            "ignoreNullFields", False
        ).json(where)
    back = read_events_feed(spark, where, format)
    assert back.schema == EVENTS_FEED
    key = lambda r: str(r)
    assert sorted(back.collect(), key=key) == sorted(feed.collect(), key=key)
    assert ingest_events(back, AS_OF).count() == 2


def test_export(spark, tmp_path):
    export(frame(spark, "daily_mood", {"event_date": DAY, "country": "A", "mood_score": 0.5}), str(tmp_path / "x"))
    lines = [line for f in (tmp_path / "x").glob("*.json") for line in f.read_text().splitlines()]
    assert [json.loads(line)["mood_score"] for line in lines] == [0.5]


def test_scratch_folder_is_new_each_time(spark):
    first, second = scratch_folder(spark, "a"), scratch_folder(spark, "a")
    assert first != second
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert shared is None or first.startswith(shared.rstrip("/"))


def test_daily_run(spark, store):
    rows = [
        {"SQLDATE": 20240125 + d, "ActionGeo_CountryCode": c, "AvgTone": float(d - i),
         "SOURCEURL": f"http://n.e/{c}{d}"}
        for d in range(6) for i, c in enumerate(["US", "DE", "FR"]) for _ in range(i + 1)
    ]
    graph = [
        {"DocumentIdentifier": f"http://n.e/{c}{d}", "V2Themes": "TAX_X,1;USPEC_Y,2",
         "V2Persons": "Ann Lee,1", "date": 20240125000000}
        for d in range(6) for c in ["US", "DE"]
    ]
    made = run_daily(events_feed(spark, *rows), gkg_feed(spark, *graph), store, AS_OF)
    assert set(made) == set(TABLES)
    for name, df in made.items():
        assert df.schema.simpleString() == TABLES[name].simpleString(), name
    feed = {r.country: r for r in made["mood_map_feed"].collect()}
    assert {c: r.iso3 for c, r in feed.items()} == {"US": "USA", "DE": "DEU", "FR": "FRA"}
    assert feed["US"].mood_score == 0.25
    assert made["events_enriched"].count() == 36
    assert made["today_for_analogs"].count() == 3
    assert made["daily_analogs"].count() == 3
    entities = {(r.country, r.event_date.day): r for r in made["daily_top_entities"].collect()}
    assert len(entities) == 12
    assert [tuple(x) for x in entities["DE", 30].top_people] == [("ann lee", 4)]
    again = mood_map_feed(store.read("daily_mood"), spark.createDataFrame([], "code string, iso3 string, name string, region string"))
    assert {r.iso3 for r in again.collect()} == {None}


def test_gkg_feed_from_files(spark, tmp_path):
    gkg_feed(spark, {"V2Themes": "a,1"}).write.parquet(str(tmp_path / "g"))
    assert read_gkg_feed(spark, str(tmp_path / "g")).count() == 1
    assert feed_event(AvgTone=2.0)["AvgTone"] == 2.0


def test_command_line(spark, tmp_path, monkeypatch):
    day = {"SQLDATE": 20240130, "ActionGeo_CountryCode": "US", "SOURCEURL": "http://n.e/1"}
    old = {**day, "SQLDATE": 20231201}
    events_feed(spark, day, old).write.parquet(str(tmp_path / "e"))
    graph = {"DocumentIdentifier": "http://n.e/1", "V2Themes": "A,1", "V2Persons": "Ann,1"}
    gkg_feed(spark, graph).write.parquet(str(tmp_path / "g"))
    argv = ["pulse", "--events", str(tmp_path / "e"), "--gkg", str(tmp_path / "g")]
    argv += ["--root", str(tmp_path / "t"), "--as-of", "2024-01-30", "--feed", str(tmp_path / "f")]
    monkeypatch.setattr("sys.argv", argv)
    command_line.main()
    feed = spark.read.json(str(tmp_path / "f")).collect()
    assert [(r.country, r.iso3) for r in feed] == [("US", "USA")]
    store = TableStore(spark, root=str(tmp_path / "t"))
    assert store.read("events_raw").count() == 2


def test_dirty_feeds(spark, tmp_path):
    header = "\t".join(["extra", *reversed(EVENTS_FEED.fieldNames())])

    def line(**given):
        row = feed_event(**given)
        return "\t".join(["e", *("" if row[c] is None else str(row[c]) for c in reversed(EVENTS_FEED.fieldNames()))])

    lines = [
        line(), line(SQLDATE=None), line(SQLDATE=20240230), line(SQLDATE="2024x"), line(AvgTone="warm"), "a\tb", line() + "\tmore",
        "", line(SQLDATE=99), line(AvgTone=None),
    ]
    for k, part in enumerate((lines[:5], lines[5:])):
        (tmp_path / f"f{k}.tsv").write_text("\n".join([header, *part]) + "\n")
    good, rejected = read_dirty_events_feed(spark, str(tmp_path))
    assert good.schema == EVENTS_FEED and good.count() == 3
    reasons = sorted(r.reason for r in rejected.collect())
    assert reasons == ["bad AvgTone", "bad SQLDATE", "bad line", "bad line", "impossible day", "impossible day"]
    assert {r.line for r in rejected.where("reason = 'bad line'").collect()} == {"a\tb", line() + "\tmore"}
    assert rejected.count() == 6
    (tmp_path / "g.csv").write_text("date,DocumentIdentifier,V2Themes,V2Persons,V2Organizations\n20241301000000,u,a,b,c\n20240101000000,u,a,,c\n")
    good, rejected = read_dirty_gkg_feed(spark, str(tmp_path / "g.csv"), "csv")
    assert [(r.V2Themes, r.V2Persons) for r in good.collect()] == [("a", None)]
    assert [r.reason for r in rejected.collect()] == ["impossible day"]
    with pytest.raises(ValueError, match="missing columns"):
        read_dirty_gkg_feed(spark, str(tmp_path / "f0.tsv"))


# --- versions ------------------------------------------------------------------------
def days_of(df):
    return sorted(str(r.event_date) for r in df.select("event_date").distinct().collect())


def test_only_given_days_are_replaced(spark, store):
    one, two, three = (dt.date(2024, 1, d) for d in (27, 28, 29))
    store.overwrite("events_raw", raw(spark, one, two))
    lone = raw(spark, two, three).where("country = 'A'")
    back = store.replace_days("events_raw", lone)
    assert [(r.event_date, r.n) for r in back.groupBy("event_date").agg(F.count("*").alias("n")).orderBy("event_date").collect()] == [
        (one, 3), (two, 1), (three, 1)
    ]
    # a given day without rows is emptied
    assert days_of(store.replace_days("events_raw", lone.where("false"), [two])) == ["2024-01-27", "2024-01-29"]
    with pytest.raises(ValueError, match="no days"):
        store.replace_days("today_for_analogs", lone)
    fresh = frame(spark, "daily_mood", {"event_date": one, "country": "A"})
    assert store.replace_days("daily_mood", fresh).count() == 1


@pytest.fixture
def folder(spark, tmp_path):
    return TableStore(spark, root=str(tmp_path / "tables"))


def test_a_job_that_dies_before_the_switch_changes_nothing(spark, folder, monkeypatch):
    folder.overwrite("events_raw", raw(spark, DAY))
    before = folder.read("events_raw")

    def dies(*_):
        raise RuntimeError("killed")

    for write in (folder.overwrite, folder.replace_days):
        with monkeypatch.context() as m:
            m.setattr(TableStore, "_commit", dies)
            with pytest.raises(RuntimeError, match="killed"):
                write("events_raw", raw(spark, dt.date(2024, 1, 1)))
        assert days_of(folder.read("events_raw")) == days_of(before) == ["2024-01-29"]
    # the files it left behind go, the table stays
    assert len(folder.vacuum("events_raw")) == 2
    assert before.count() == 3


def test_readers_keep_their_version(spark, folder):
    first = folder.overwrite("events_raw", raw(spark, DAY))
    folder.overwrite("events_raw", raw(spark, dt.date(2024, 1, 28)))
    folder.expire("events_raw", AS_OF, 1)
    assert days_of(first) == days_of(folder.read("events_raw", 1)) == ["2024-01-29"]
    assert folder.read("events_raw").count() == 0 and folder.versions("events_raw") == [1, 2, 3]
    assert len(folder.vacuum("events_raw", keep=2)) == 1
    assert folder.versions("events_raw") == [2, 3] and days_of(folder.read("events_raw", 2)) == ["2024-01-28"]
    with pytest.raises(FileNotFoundError):
        folder.read("daily_mood")


def test_a_writer_that_comes_second_raises(spark, folder, monkeypatch):
    folder.overwrite("events_raw", raw(spark, DAY))
    staged = TableStore._staged

    def meanwhile(self, name, df, token=None):
        monkeypatch.setattr(TableStore, "_staged", staged)
        folder.overwrite("events_raw", raw(spark, dt.date(2024, 1, 28)))
        return staged(self, name, df, token)

    monkeypatch.setattr(TableStore, "_staged", meanwhile)
    with pytest.raises(ConcurrentWrite):
        folder.replace_days("events_raw", raw(spark, dt.date(2024, 1, 27)))
    assert days_of(folder.read("events_raw")) == ["2024-01-28"]


def test_batches_are_appended_once_and_compacted(spark, folder):
    for number in (0, 1, 1, 0):
        folder.append("events_raw", raw(spark, DAY), "s", number)
    folder.append("events_raw", raw(spark, None), "other", 0)
    assert folder.read("events_raw").count() == 9
    assert folder.compact("events_raw") == ["2024-01-29"] and folder.compact("events_raw") == []
    assert len(folder.manifest("events_raw").folders["2024-01-29"]) == 1
    folder.append("events_raw", raw(spark, DAY), "s", 1)
    assert folder.read("events_raw").count() == 9
    assert folder.read("events_raw").where("event_date is null").count() == 3
    assert folder.expire("events_raw", AS_OF, 0) == ["2024-01-29"]


# --- runs ------------------------------------------------------------------------------
def run_feeds(spark, tmp_path, last=30):
    events = [
        {"SQLDATE": 20240120 + d, "ActionGeo_CountryCode": c, "AvgTone": float(d - i), "SOURCEURL": f"http://n.e/{c}{d}"}
        for d in range(last - 19) for i, c in enumerate(["US", "DE"]) for _ in range(i + 1)
    ]
    graph = [
        {"DocumentIdentifier": f"http://n.e/{c}{d}", "V2Themes": "TAX_X,1", "V2Persons": "Ann Lee,1", "date": (20240120 + d) * 1000000}
        for d in range(last - 19) for c in ["US", "DE"]
    ]
    made = []
    for name, df in (("e", events_feed(spark, *events)), ("g", gkg_feed(spark, *graph))):
        path = str(tmp_path / f"{name}{last}")
        df.write.parquet(path)
        made.append(spark.read.schema(df.schema).parquet(path))
    return made


def table_rows(made):
    return {n: sorted(map(str, df.collect())) for n, df in made.items()}


def test_two_days_equal_one_run(spark, store, tmp_path):
    yesterday, today = run_feeds(spark, tmp_path, 29), run_feeds(spark, tmp_path)
    run_daily(*yesterday, store, dt.date(2024, 1, 29))
    two = run_daily(*today, store, AS_OF, since=AS_OF)
    one = run_daily(*today, TableStore(spark, root=str(tmp_path / "one")), AS_OF)
    assert table_rows(two) == table_rows(one)


def test_a_run_goes_on_where_it_stopped(spark, folder, tmp_path):
    feeds = run_feeds(spark, tmp_path)

    class Broken:
        def generate(self, *_, **__):
            raise RuntimeError("no model")

        def score(self, *_, **__):
            raise RuntimeError("no model")

    with pytest.raises(Exception):  # noqa: B017, PT011
        run_daily(*feeds, folder, AS_OF, text=Broken(), ledger=Ledger(folder))
    topics_version = folder.manifest("daily_country_topics").number
    second = Ledger(folder)
    made = run_daily(*feeds, folder, AS_OF, ledger=second)
    assert second.ran == ["daily_briefings", "daily_mood"]
    assert folder.manifest("daily_country_topics").number == topics_version
    plain = run_daily(*feeds, TableStore(spark, root=str(tmp_path / "plain")), AS_OF)
    assert table_rows(made) == table_rows(plain)
    # a changed feed runs what depends on it; nothing changed, nothing runs
    third, fourth = Ledger(folder), Ledger(folder)
    run_daily(*feeds, folder, AS_OF, ledger=third)
    assert third.ran == []
    run_daily(feeds[0], feeds[1].limit(0), folder, AS_OF, ledger=fourth, feeds="new")
    assert "daily_top_entities" in fourth.ran and "daily_briefings" in fourth.ran
    with pytest.raises(ValueError, match="root"):
        Ledger(TableStore(spark, database="x"))
