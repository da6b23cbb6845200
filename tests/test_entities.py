from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from frames import AS_OF, DAY, final_plan_of, frame, gkg_feed, plan_of
from pulse.operators import entities
from pulse.operators.entities import top_entities, top_entities_from_feeds
from pulse.operators.ingest import enrich_events
from pulse.operators.skew import heavy_keys
from pulse.schemas import TABLES


def enriched(spark, *rows):
    made = [
        {"event_date": DAY, "country": c, "themes": t, "persons": p, "orgs": []} for c, t, p in rows
    ]
    return frame(spark, "events_enriched", *made)


def lists(df):
    return {
        r.country: (
            [tuple(x) for x in r.top_themes],
            None if r.top_people is None else [tuple(x) for x in r.top_people],
        )
        for r in df.collect()
    }


def test_weights(spark):
    rows = enriched(spark, ("A", ["X,1", "X,2"], ["abc,1", "def,2", "ghi,3"]))
    assert lists(top_entities(rows, AS_OF)) == {"A": ([("x", 6)], [("abc", 2), ("def", 2), ("ghi", 2)])}
    plain = lists(top_entities(rows, AS_OF, weighted=False))
    assert plain == {"A": ([("x", 2)], [("abc", 1), ("def", 1), ("ghi", 1)])}


def test_rows_without_a_partner_count_for_nothing(spark):
    rows = enriched(
        spark, ("A", ["x,1"], []), ("B", [], ["ann,1"]), ("C", ["x,1", ",2"], ["al,1", "Facebook,2"])
    )
    # short and banned names still weigh as persons of the row, but are not listed
    assert lists(top_entities(rows, AS_OF)) == {"C": ([("", 2), ("x", 2)], None)}
    assert lists(top_entities(rows, AS_OF, weighted=False)) == {
        "A": ([("x", 1)], None),
        "C": ([("", 1), ("x", 1)], None),
    }


def literal(rows):
    """Pairs of every row, counted."""
    themes, people = {}, {}
    name = lambda entry: entry.split(",")[0].lower()
    for country, ts, ps in rows:
        for t in ts:
            for p in ps:
                themes.setdefault(country, Counter())[name(t)] += 1
                if len(name(p)) >= 3 and name(p) != "twitter":
                    people.setdefault(country, Counter())[name(p)] += 1
    top = lambda c: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:10]
    return {c: (top(t), top(people[c]) if c in people else None) for c, t in themes.items()}


entry = st.sampled_from([f"{n},{i}" for n in ["Ann", "bob", "Twitter", "al", ""] for i in (1, 2)])
sample = st.lists(
    st.tuples(st.sampled_from("AB"), st.lists(entry, max_size=4), st.lists(entry, max_size=4)),
    min_size=1,
    max_size=8,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sample)
def test_weighted_counts_are_pair_counts(spark, rows):
    assert lists(top_entities(enriched(spark, *rows), AS_OF)) == literal(rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("AB"), st.sampled_from("uvw")), min_size=1, max_size=8),
    st.lists(
        st.tuples(st.sampled_from("uvw"), st.lists(entry, max_size=3), st.lists(entry, max_size=3)),
        min_size=1,
        max_size=6,
    ),
)
def test_feeds_and_enriched_table_agree(spark, events, graph):
    raw = frame(
        spark, "events_raw", *({"event_date": DAY, "country": c, "url": u} for c, u in events)
    )
    feed = gkg_feed(
        spark,
        *(
            {"DocumentIdentifier": u, "V2Themes": ";".join(t), "V2Persons": ";".join(p)}
            for u, t, p in graph
        ),
    )
    literal_way = lists(top_entities(enrich_events(raw, feed, AS_OF), AS_OF))
    assert lists(top_entities_from_feeds(raw, feed, AS_OF)) == literal_way


def test_a_url_with_many_names_is_split(spark, monkeypatch):
    monkeypatch.setattr(entities, "NAMES_PER_TASK", 7)
    raw = frame(
        spark, "events_raw",
        *({"event_date": DAY, "country": c, "url": u} for c in "AB" for u in ("hot", "u1", "none")),
    )
    rows = [("hot", [f"t{i},1"], [f"person {i % 13},1", "ann,2"]) for i in range(40)]
    rows += [("u1", ["t1,1"], ["ann,1"]), ("other", ["t1,1"], ["ann,1"])]
    feed = gkg_feed(
        spark,
        *(
            {"DocumentIdentifier": u, "V2Themes": ";".join(t), "V2Persons": ";".join(p)}
            for u, t, p in rows
        ),
    )
    enriched_way = lists(top_entities(enrich_events(raw, feed, AS_OF), AS_OF))
    assert lists(top_entities_from_feeds(raw, feed, AS_OF)) == enriched_way
    assert enriched_way["A"][1][0] == ("ann", 41)
    weights = spark.createDataFrame([("a", i, f"n{i}") for i in range(20)] + [("b", 1, "n")], "url string, w int, name string")
    assert heavy_keys(weights, "url", "w", 7).collect() == [("a", 3)]
    plan = final_plan_of(top_entities_from_feeds(raw, feed, AS_OF))
    assert "Reused" in plan  # the count per url shares the shuffle of the weights


def test_plan(spark):
    rows = enriched(spark, ("A", ["x,1"], ["ann,1"]))
    made = top_entities(rows, AS_OF)
    assert made.schema.simpleString() == TABLES["daily_top_entities"].simpleString()
    plan = plan_of(made)
    assert plan.count("Generate") == 2  # one scan feeds both kinds
    assert "transform" not in plan.split("Generate explode", 1)[1]
    assert plan.count("WindowGroupLimit") == 2
    assert "partial_sum" in plan
    assert "Python" not in plan


def test_every_heavy_key_is_split(spark):
    weights = frame_of_many(spark)
    assert heavy_keys(weights, "url", "w", 2).count() == 1200


def frame_of_many(spark):
    return spark.range(3600).selectExpr("cast(id % 1200 as string) as url", "1L as w")
