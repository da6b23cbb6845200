import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import DAY, frame, plan_of
from pulse.config import PulseConfig
from pulse.models.batch import BatchEmbedding, BatchText, Calls
from pulse.models.local import TemplateText
from pulse.operators.briefings import briefing_context, briefing_replies, daily_briefings
from pulse.operators.inference import spread_for_inference
from pulse.operators.mood import daily_mood, mood_map_feed
from pulse.schemas import COUNTRY_DIM, TABLES
from pulse.sources.countries import fips_countries, iso_countries

CFG = PulseConfig(top_n=3, text_rows_per_task=2)


def tables(spark, n=5, entities=True):
    def topic(i, day=DAY):
        return {
            "event_date": day, "country": f"C{i}", "headline_count": 100 - i, "avg_tone": -2.0,
            "topic_doc": f"doc {i} http://a.b/{i} end",
        }

    topics = frame(
        spark, "daily_country_topics", *map(topic, range(n)), topic(0, dt.date(2024, 1, 28))
    )
    ents = frame(
        spark, "daily_top_entities",
        {"event_date": DAY, "country": "C0", "top_themes": [("uspec_war_x", 3), ("tax_a", 1)],
         "top_people": [("ann lee", 2)]},
        {"event_date": dt.date(2024, 1, 28), "country": "C1", "top_themes": [("old", 1)]},
    )
    analogs = frame(
        spark, "daily_analogs", {"event_date": DAY, "country": "C1", "analogs_txt": "2024-01-01: a"}
    )
    return topics, ents, analogs


def test_briefing_context(spark):
    rows = {r.country: r for r in briefing_context(*tables(spark), CFG).collect()}
    assert sorted(rows) == ["C0", "C1", "C2"]
    assert rows["C0"].themes_nice == "War X, Tax A"
    assert rows["C0"].people_nice == "Ann Lee"
    assert rows["C0"].ctx == "doc 0  end"
    assert (rows["C0"].analogs_txt, rows["C1"].analogs_txt) == ("None", "2024-01-01: a")
    assert rows["C1"].themes_nice == ""


def test_template_briefings(spark):
    made = daily_briefings(*tables(spark), TemplateText(), CFG)
    assert made.schema.simpleString() == TABLES["daily_briefings"].simpleString()
    text = {r.country: r.briefing_text for r in made.collect()}
    assert text["C0"] == (
        "[What happened] 100 headlines in C0. doc 0  end\n"
        "[Key drivers] War X, Tax A\n[Impact] Ann Lee\n[Watch next] None"
    )
    assert "Python" not in plan_of(made)


@pytest.mark.parametrize(
    "text, score",
    [("peace deal after war", "0.25"), ("War, riot; peace", "-0.25"), ("nothing", "0.00"),
     ("war war war", "-0.75"), ("growth", "0.50")],
)
def test_tone_words(spark, text, score):
    column = TemplateText()._sentiment({"briefing": F.col("b")})
    assert spark.range(1).select(F.lit(text).alias("b")).select(column).first()[0] == score


def counting(spark, reply):
    """A model that counts the prompts it is asked."""
    asked = spark.sparkContext.accumulator(0)

    def load(task, options):
        def infer(prompts):
            asked.add(len(prompts))
            return [reply(task, p, options) for p in prompts]

        return infer

    return asked, load


def test_each_row_is_asked_once_and_only_top_rows(spark):
    reply = lambda task, p, o: {
        "briefing": None if "code C1." in p else f"news {o.max_output_tokens}",
        "sentiment": "1" if "C2" in p else "0.5",
        "summary": f"mood {o.max_output_tokens}",
    }[task]
    asked, load = counting(spark, reply)
    topics, ents, analogs = tables(spark, n=40)
    briefings = daily_briefings(topics, ents, analogs, BatchText(load), CFG)
    rows = {r.country: r.briefing_text for r in briefings.collect()}
    assert rows == {"C0": "news 300", "C2": "news 300"}  # no reply, no row
    assert asked.value == 3
    stored = frame(
        spark, "daily_briefings",
        *({"event_date": DAY, "country": c, "briefing_text": f"about {c}"} for c in ("C0", "C2", "X")),
    )
    mood = daily_mood(stored, topics, ents, BatchText(load), CFG)
    assert mood.schema.simpleString() == TABLES["daily_mood"].simpleString()
    (row,) = mood.collect()  # C2 answers an integer, X has no tone
    assert (row.country, row.mood_score, row.summary_ref) == ("C0", 0.15, "mood 60")
    assert asked.value == 3 + 3 + 1
    lenient = daily_mood(stored, topics, ents, BatchText(load), CFG, lenient=True)
    assert sorted(r.country for r in lenient.collect()) == ["C0", "C2"]


def test_json_replies(spark):
    _, load = counting(spark, lambda task, p, o: '{"predictions":[{"content":"from json"}]}')
    made = daily_briefings(*tables(spark), BatchText(load, json_replies=True), CFG)
    assert {r.briefing_text for r in made.collect()} == {"from json"}


def test_batch_embedding(spark):
    sizes = spark.sparkContext.accumulator(0)

    def load():
        def infer(texts):
            assert len(texts) <= 2
            sizes.add(1)
            return [[float(len(t)), 0.0, 0.0] for t in texts]

        return infer

    model = BatchEmbedding(load, batch_size=2)
    df = spark.createDataFrame([("a",), (None,), ("ccc",), ("dd",)], "t string").coalesce(1)
    rows = [r[0] for r in df.select(model.embed(F.col("t"))).collect()]
    assert rows == [[1.0, 0.0, 0.0], None, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]
    assert sizes.value == 2


def test_wrong_number_of_replies_is_an_error(spark):
    model = BatchText(lambda task, options: lambda prompts: ["one"] * (len(prompts) + 1))
    with pytest.raises(Exception, match="another number of replies"):
        daily_briefings(*tables(spark), model, CFG).collect()


def test_calls_hold_texts_of_about_one_length():
    calls = Calls(batch_size=3, batch_chars=100)
    lengths = np.array([90, 1, 40, 2, 3, 41, 500, 4, 0])
    cut = [lengths[places].tolist() for places in calls.cut(lengths)]
    assert cut == [[0, 1, 2], [3, 4], [40, 41], [90], [500]]
    assert sum(cut, []) == sorted(lengths)
    assert list(calls.cut(lengths[:0])) == []


def test_failed_calls_are_repeated_then_halved():
    asked = []

    def infer(texts):
        asked.append(list(texts))
        if "bad" in texts:
            raise RuntimeError("no")
        if asked.count(texts) == 1:
            raise ConnectionError("busy")
        return [t.upper() for t in texts]

    made = list(Calls(attempts=2, pause_seconds=0).replies(infer, ["a", "b", "bad", "c"]))
    assert made == [("A", None), ("B", None), (None, "RuntimeError: no"), ("C", None)]
    assert [len(a) for a in asked] == [4, 4, 2, 2, 2, 2, 1, 1, 1, 1]
    with pytest.raises(ValueError, match="another number"):
        list(Calls().replies(lambda texts: [], ["a"]))


def test_errors_are_reported(spark):
    def load(task, options):
        def infer(prompts):
            if any("code C1." in p for p in prompts):
                raise ValueError("refused")
            return ["fine"] * len(prompts)

        return infer

    model = BatchText(load, calls=Calls(attempts=1, pause_seconds=0))
    made = briefing_replies(*tables(spark), model, CFG)
    rows = {r.country: (r.briefing_text, r.error) for r in made.collect()}
    assert rows == {
        "C0": ("fine", None), "C1": (None, "briefing: ValueError: refused"), "C2": ("fine", None)
    }
    assert sorted(r.country for r in daily_briefings(*tables(spark), model, CFG).collect()) == ["C0", "C2"]
    local = briefing_replies(*tables(spark), TemplateText(), CFG)
    assert {r.error for r in local.collect()} == {None}


def test_the_barrier_is_sized_by_rows(spark):
    keys = ["event_date", "country"]
    rows = spark.range(95).selectExpr("date'2024-01-01' as event_date", "cast(id as string) as country").coalesce(1)
    # AQE would join small partitions; the number asked for is in the plan
    plan = lambda **how: plan_of(spread_for_inference(rows, keys, 10, **how))
    assert "REPARTITION_BY_NUM" in plan() and ", 10)" in plan() and ", 3)" in plan(at_most=25)
    assert spread_for_inference(rows, keys, 10).count() == 95
    assert spread_for_inference(rows.limit(0), keys, 10).count() == 0


def mood_rows(spark):
    row = lambda c, m, day=DAY: {"event_date": day, "country": c, "mood_score": m}
    return frame(
        spark, "daily_mood", row("DE", 0.5), row("FR", -3.0), row("??", 0.1),
        row("US", 0.2, dt.date(2024, 1, 1)),
    )


def test_map_feed(spark):
    feed = mood_map_feed(mood_rows(spark), iso_countries(spark))
    assert feed.schema.simpleString() == TABLES["mood_map_feed"].simpleString()
    rows = {r.country: r for r in feed.collect()}
    assert sorted(rows) == ["??", "DE", "FR"]
    assert (rows["DE"].iso3, rows["DE"].country_name) == ("DEU", "Germany")
    assert rows["??"].iso3 is None
    assert (rows["FR"].mood_score, rows["FR"].mood_clamped) == (-3.0, -1.0)
    assert (rows["FR"].range_low, rows["FR"].range_high, rows["FR"].color_scale) == (-1, 1, "RdYlGn")
    assert "BroadcastHashJoin" in plan_of(feed)


def test_country_dimensions(spark):
    iso = iso_countries(spark)
    assert iso.schema == COUNTRY_DIM
    assert iso.count() == iso.select("code").distinct().count() > 200
    fips = spark.createDataFrame([("GM", "DE"), ("GA", "GM")], "fips string, iso2 string")
    dim = {r.code: r.iso3 for r in fips_countries(iso, fips).collect()}
    assert dim == {"GM": "DEU", "GA": "GMB"}


def test_countries_of_the_day(spark, tmp_path):
    """An entry holds until the next one, the first before that too; ties and nulls are defined."""
    import datetime as dt

    from pulse.operators.dimension import with_country
    from pulse.sources.countries import read_countries

    lines = ["code,iso2,region,valid_from", "GM,DE,Europe,2020-01-01", "GM,GM,Africa,2024-01-10", "GM,ZZ,Zone,2024-01-10"]
    lines += ["UK,GB,Europe,", ",FR,Europe,2020-01-01"]
    path = tmp_path / "codes.csv"
    path.write_text("\n".join(lines))
    dim = read_countries(spark, str(path))
    day = lambda n: dt.date(2024, 1, n)
    rows = [("GM", day(9)), ("GM", day(10)), ("GM", dt.date(1990, 1, 1)), ("UK", day(1)), ("UK", None), ("GM", None), ("XX", day(1)), (None, day(1))]
    found = with_country(spark.createDataFrame(rows * 2, "country string, event_date date"), dim, region="region", iso3="iso3").collect()
    assert len(found) == 16
    assert {(r.country, r.event_date): (r.region, r.iso3) for r in found} == {
        ("GM", day(9)): ("Europe", "DEU"), ("GM", day(10)): ("Africa", "GMB"), ("GM", dt.date(1990, 1, 1)): ("Europe", "DEU"),
        ("UK", day(1)): ("Europe", "GBR"), ("UK", None): ("Europe", "GBR"), ("GM", None): (None, None),
        ("XX", day(1)): (None, None), (None, day(1)): (None, None),
    }
