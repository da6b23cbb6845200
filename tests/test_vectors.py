import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from frames import DAY, frame, plan_of
from pulse.config import PulseConfig
from pulse.models.local import HashedTerms
from pulse.operators import annindex, knn
from pulse.operators.knn import cosine_distance, topk_cosine
from pulse.operators.vectors import (
    embed_topics,
    find_analogs,
    nest_analogs,
    similar_to_day,
    similar_to_text,
)
from pulse.schemas import TABLES

SCHEMA = "id string, embedding array<float>, day date"


def vectors(n, seed, dims=4, duplicates=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        same = duplicates and rows and rng.random() < 0.3
        vector = rows[-1][1] if same else [rng.uniform(-1, 1) for _ in range(dims)]
        rows.append((f"v{i:04d}", vector, dt.date(2024, 1, 1 + i % 28)))
    return rows


def brute_force(spark, base, anchors, k, earlier=False):
    b, a = (spark.createDataFrame(rows, SCHEMA) for rows in (base, anchors))
    pairs = a.select(F.col("id").alias("anchor"), F.col("embedding").alias("q"), F.col("day").alias("ad")).join(
        b, F.col("day") < F.col("ad") if earlier else F.lit(True)
    )
    scored = pairs.select("anchor", "id", F.round(cosine_distance(F.col("q"), F.col("embedding")), 9).alias("d"))
    best = {}
    for anchor, id, d in scored.collect():
        best.setdefault(anchor, []).append((d, id))
    return {anchor: sorted(found)[:k] for anchor, found in best.items()}


def found(df):
    rows = {}
    for r in df.orderBy("anchor_id", "rank").collect():
        rows.setdefault(r.anchor_id, []).append((r.distance, r.id))
    return rows


@pytest.mark.parametrize("plan", ["few", "small base", "stream", "lanes"])
@pytest.mark.parametrize("earlier", [False, True])
def test_all_plans_equal_brute_force(spark, monkeypatch, plan, earlier):
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(knn, "LANE_ANCHORS", 5 if plan == "lanes" else 100)
    base, anchors = vectors(200, 1), vectors(17, 2)
    b = spark.createDataFrame(base, SCHEMA).repartition(5)
    a = spark.createDataFrame(anchors, SCHEMA).withColumnRenamed("id", "anchor_id")
    days = {"base_day": "day", "anchor_day": "day"} if earlier else {}
    sizes = {"max_broadcast_anchors": 100 if plan == "few" else 3, "max_base_bytes": 1 << 20 if plan == "small base" else 0}
    made = topk_cosine(b, a, 7, payload=["day"], **sizes, **days)
    assert found(made) == brute_force(spark, base, anchors, 7, earlier)
    physical = plan_of(made)
    assert ("Union" in physical) == (plan in ("stream", "lanes")) and "CoGroup" not in physical
    # the base is dealt once, unless there are lanes
    assert physical.count("Generate explode") == {"few": 0, "small base": 0, "stream": 2, "lanes": 2}[plan]


def test_many_anchors_of_another_type_and_without_vectors(spark):
    rows = [(i, [1.0, float(i)]) for i in range(40)] + [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0])]
    b = spark.createDataFrame([(f"b{i}", v) for i, v in rows], "id string, embedding array<double>")
    a = spark.createDataFrame(rows, "anchor_id long, embedding array<double>")
    made = [topk_cosine(b, a, 2, max_broadcast_anchors=1, max_base_bytes=n) for n in (0, 1 << 20)]
    got = [{r.anchor_id: r.id for r in m.where("rank = 1").collect()} for m in made]
    assert got[0] == got[1] == {i: f"b{i}" for i in range(40)}
    assert topk_cosine(b.limit(0), a, 2, max_broadcast_anchors=1).collect() == []


def test_no_pair_becomes_a_row(spark):
    b = spark.createDataFrame(vectors(50, 3), SCHEMA)
    a = b.withColumnRenamed("id", "anchor_id").limit(4)
    plan = plan_of(topk_cosine(b, a, 3))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the base is not shuffled
    assert plan.count("WindowGroupLimit") == 2


def test_unusable_vectors_take_no_part(spark):
    base = [("a", [1.0, 0.0], DAY), ("b", None, DAY), ("c", [0.0, 0.0], DAY), ("d", [], DAY)]
    anchors = [("x", [2.0, 0.0], DAY), ("y", None, DAY), ("z", [0.0, 0.0], DAY)]
    made = topk_cosine(
        spark.createDataFrame(base, SCHEMA),
        spark.createDataFrame(anchors, SCHEMA).withColumnRenamed("id", "anchor_id"),
        3,
    )
    assert found(made) == {"x": [(0.0, "a")]}


@pytest.mark.parametrize("few", [True, False])
def test_non_finite_vectors_hide_no_neighbour(spark, few):
    nan, inf = float("nan"), float("inf")
    base = [(f"n{i}", [nan, 1.0], DAY) for i in range(5)] + [("i", [inf, 1.0], DAY)]
    base += [(f"v{i}", [1.0, float(i)], DAY) for i in range(7)]
    made = topk_cosine(
        spark.createDataFrame(base, SCHEMA).coalesce(1),
        spark.createDataFrame([("x", [1.0, 0.0], DAY)], SCHEMA).withColumnRenamed("id", "anchor_id"),
        10,
        max_broadcast_anchors=10 if few else 0,
        max_base_bytes=0,
    )
    assert [id for _, id in found(made)["x"]] == [f"v{i}" for i in range(7)]


@pytest.mark.parametrize("base", [[[1.0, 0.0, 0.0], [5.0]], [[1.0, 0.0, 0.0]]])
def test_ragged_vectors_raise(spark, base):
    rows = [(f"v{i}", v, DAY) for i, v in enumerate(base)]
    made = topk_cosine(
        spark.createDataFrame(rows, SCHEMA).coalesce(1),
        spark.createDataFrame([("x", [1.0, 0.0], DAY)], SCHEMA).withColumnRenamed("id", "anchor_id"),
        3,
    )
    with pytest.raises(Exception, match="length"):
        made.collect()


def test_many_equal_distances_go_by_id(spark):
    base = [(f"v{i:03d}", [1.0, 0.0], DAY) for i in reversed(range(300))]
    made = topk_cosine(
        spark.createDataFrame(base, SCHEMA).repartition(7),
        spark.createDataFrame([("x", [1.0, 1.0], DAY)], SCHEMA).withColumnRenamed("id", "anchor_id"),
        3,
    )
    assert [id for _, id in found(made)["x"]] == ["v000", "v001", "v002"]


def embeddings(spark, *rows):
    made = [
        {
            "event_date": dt.date(2024, 1, day), "country": c, "topic_doc": f"{c}{day} http://x y",
            "embedding": [float(x) for x in v], "id": f"{c}-2024-01-{day:02d}",
        }
        for day, c, v in rows
    ]
    return frame(spark, "news_embeddings", *made)


def crowded(spark):
    """The anchor's nine nearest neighbours are of its own day."""
    same = [(20, f"S{i}", (1, 0.01 * i)) for i in range(9)]
    past = [(10 + i, f"P{i}", (0.3, 1 + i)) for i in range(6)]
    return embeddings(spark, (20, "A", (1, 0)), *same, *past)


def test_same_day_rows_use_up_places(spark):
    base = crowded(spark)
    today = frame(spark, "today_for_analogs", {"event_date": dt.date(2024, 1, 20), "country": "A"})
    assert find_analogs(base, today).count() == 0
    pre = find_analogs(base, today, mode="pre", keep_past_country=True)
    assert [r.past_country for r in pre.orderBy("distance").collect()] == ["P0", "P1", "P2", "P3", "P4"]
    assert similar_to_day(base, "A", "2024-01-20").count() == 0
    assert similar_to_day(base, "A", "2024-01-20", mode="pre").count() == 6
    assert similar_to_day(base, "unknown", "2024-01-20").count() == 0
    with pytest.raises(ValueError):
        find_analogs(base, today, mode="both")


def test_batched_search_equals_one_search_per_anchor(spark):
    rng = random.Random(5)
    rows = [
        (day, c, [rng.uniform(-1, 1) for _ in range(3)]) for day in range(1, 15) for c in "ABC"
    ]
    base = embeddings(spark, *rows).cache()
    today = base.where("event_date = '2024-01-14'").select("event_date", "country")
    batched = {
        (r.country, r.past_date, r.distance) for r in find_analogs(base, today).collect()
    }
    single = set()
    for c in "ABC":
        hits = similar_to_day(base, c, "2024-01-14").where("event_date < '2024-01-14'")
        nearest = hits.orderBy("distance", "id").limit(5).collect()
        single |= {(c, r.event_date, r.distance) for r in nearest}
    assert batched == single
    pre = find_analogs(base, today, mode="pre")
    assert pre.schema.simpleString() == TABLES["daily_analogs_flat"].simpleString()
    assert pre.count() >= len(batched)


def test_nested_analogs(spark):
    def row(day, text, distance, country="A"):
        return {
            "event_date": DAY, "country": country, "past_date": dt.date(2024, 1, day),
            "snippet": text, "distance": distance,
        }

    flat = frame(
        spark, "daily_analogs_flat", row(3, "c", 0.3), row(1, "a", 0.1), row(2, "b", 0.3),
        row(4, None, 0.2), row(9, "z", 0.9, "B"),
    )
    rows = {r.country: r for r in nest_analogs(flat, 3).collect()}
    assert [x.past_date.day for x in rows["A"].analogs] == [1, 4, 2]
    assert rows["A"].analogs_txt == "2024-01-01: a\n- 2024-01-02: b"
    assert rows["B"].analogs_txt == "2024-01-09: z"
    as_text = flat.withColumn("event_date", F.col("event_date").cast("string"))
    assert nest_analogs(as_text).schema.simpleString() == TABLES["daily_analogs"].simpleString()


def topic(country, text):
    return {"event_date": DAY, "country": country, "topic_doc": text}


def test_embeddings_and_text_search(spark):
    topics = frame(
        spark, "daily_country_topics", topic("A", "flood relief in the north"),
        topic("B", "FLOOD: relief, in the north!"), topic("C", "election results"), topic("D", None),
        topic("E", "x" * 2999 + " tail"),
    )
    made = embed_topics(topics, HashedTerms(32)).cache()
    rows = {r.country: r for r in made.collect()}
    assert rows["A"].id == "A-2024-01-29"
    assert rows["A"].embedding == rows["B"].embedding
    assert sum(x * x for x in rows["C"].embedding) == pytest.approx(1, abs=1e-6)
    assert rows["D"].embedding is None
    assert len(rows["E"].topic_doc) == 3000
    hits = similar_to_text(made, "north flood relief the in", HashedTerms(32), k=2)
    assert [(r.country, r.distance) for r in hits.orderBy("id").collect()] == [("A", 0.0), ("B", 0.0)]
    assert hits.columns == ["event_date", "country", "topic_doc", "distance", "id"]
    assert "Python" not in plan_of(embed_topics(topics, HashedTerms()))


def test_empty_query_text_finds_nothing(spark):
    made = embed_topics(frame(spark, "daily_country_topics", topic("A", "x")), HashedTerms())
    assert similar_to_text(made, " - ", HashedTerms()).count() == 0


def test_configured_sizes(spark):
    base = embeddings(spark, *[(d, "A", (1, d)) for d in range(1, 21)])
    today = frame(spark, "today_for_analogs", {"event_date": dt.date(2024, 1, 20), "country": "A"})
    made = find_analogs(base, today, PulseConfig(vector_top_k=4, analog_topk=2, analog_snip_chars=3))
    assert [r.snippet for r in made.orderBy("distance").collect()] == ["A19", "A18"]


# --- approximate search ----------------------------------------------------------------
def clustered(n, seed, groups=20, dims=8):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    rows = [(f"v{i:04d}", [c + rng.gauss(0, 0.05) for c in centres[i % groups]], DAY) for i in range(n)]
    return [*rows, ("null", None, DAY), ("zero", [0.0] * dims, DAY), ("nan", [float("nan")] * dims, DAY)]


@pytest.mark.parametrize("part_rows", [100_000, 10])
def test_index_finds_the_neighbours(spark, tmp_path, monkeypatch, part_rows):
    monkeypatch.setattr(annindex, "PART_ROWS", part_rows)
    rows = clustered(600, 3)
    base = spark.createDataFrame(rows, SCHEMA)
    anchors = spark.createDataFrame(rows[:40] + rows[-3:], SCHEMA).withColumnRenamed("id", "anchor_id")
    index = annindex.build_index(base, str(tmp_path / "i"))
    assert index.sizes.sum() == 600 and len(index.centroids) == 25
    again = annindex.open_index(spark, str(tmp_path / "i"))
    assert (again.centroids == index.centroids).all() and (again.sizes == index.sizes).all()
    exact = found(topk_cosine(base, anchors, 5))
    near = found(annindex.search_index(again, anchors, 5, probes=3))
    hits = sum(len(set(exact[a]) & set(near.get(a, []))) for a in exact)
    assert len(exact) == 40 and hits >= 0.9 * 5 * 40
    scored = {r.anchor_id: r["rows"] for r in annindex.scored_rows(again, anchors, 3).collect()}
    assert len(scored) == 40 and sum(scored.values()) < 0.3 * 600 * 40
    # all cells: the exact search
    assert found(annindex.search_index(again, anchors, 5, probes=25)) == exact


def test_index_of_equal_vectors_and_of_nothing(spark, tmp_path):
    rows = [(f"v{i}", [1.0, 0.0], DAY) for i in range(30)]
    base = spark.createDataFrame(rows, SCHEMA)
    index = annindex.build_index(base, str(tmp_path / "i"), cells=4)
    anchors = base.limit(1).withColumnRenamed("id", "anchor_id")
    assert [id for _, id in found(annindex.search_index(index, anchors, 3, probes=4))["v0"]] == ["v0", "v1", "v10"]
    empty = annindex.build_index(base.limit(0), str(tmp_path / "e"))
    assert annindex.search_index(empty, anchors, 3).collect() == []


def test_searches_as_sql_table_functions(spark):
    """The same rows as the functions of DataFrames, planned without Python; odd vectors take no part."""
    from pulse.functions.searches import register_searches
    from pulse.models.local import HashedTerms
    from pulse.operators.vectors import similar_to_day, similar_to_text

    model = HashedTerms(8)
    texts = ["war and peace", "peace deal", "Élan über alles", "", "war", "peace and war, peace"]
    rows = [(dt.date(2024, 1, 1 + i % 3), f"C{i % 4}", f"{t} {i}" if t else "", f"id{i}") for i, t in enumerate(texts * 4)]
    base = spark.createDataFrame(rows, "event_date date, country string, topic_doc string, id string")
    base = base.withColumn("embedding", model.embed(F.col("topic_doc")))
    odd = spark.createDataFrame(
        [(dt.date(2024, 1, 2), "C9", "odd", f"odd{i}", v) for i, v in enumerate([None, [], [float("nan")] * 8, [0.0] * 8])],
        "event_date date, country string, topic_doc string, id string, embedding array<float>",
    )
    table = base.unionByName(odd).cache()
    table.createOrReplaceTempView("test_embeddings")
    model.sql_function(spark, "test_embed")
    embedded = base.select(F.col("embedding").alias("a"), F.expr("test_embed(topic_doc)").alias("b"))
    assert embedded.where("not a <=> b").count() == 0
    plain = lambda df: sorted((r.id, round(r.distance, 6)) for r in df.collect())
    for mode in ("post", "pre"):
        register_searches(spark, "test_embeddings", "test_embed", k=7, mode=mode)
        found = spark.sql("SELECT * FROM similar_to_day('C1', DATE '2024-01-02')")
        assert found.columns == ["event_date", "country", "topic_doc", "distance", "id"]
        assert plain(found) == plain(similar_to_day(table, "C1", "2024-01-02", 7, mode)) != []
    asked = spark.sql("SELECT * FROM similar_to_text('peace in our time')")
    assert plain(asked) == plain(similar_to_text(table, "peace in our time", model, 7)) != []
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "MapInArrow" not in plan
    for call in ("similar_to_text(NULL)", "similar_to_text('')", "similar_to_day('none', DATE '2024-01-02')"):
        assert spark.sql(f"SELECT * FROM {call}").count() == 0
    with pytest.raises(ValueError):
        register_searches(spark, mode="other")
