"""Rolling means, shifts and roll-ups on hand-made country-days."""

import datetime as dt

from pulse.operators.trends import mood_shift, region_rollup, rolling_mood


def _scores(spark, *rows):
    data = [(dt.date(2024, 1, d), c, n, m) for d, c, n, m in rows]
    return spark.createDataFrame(data, "event_date date, country string, headline_count long, mood_score double")


def test_rolling_counts_days_not_rows(spark):
    df = _scores(spark, (1, "A", 1, 1.0), (2, "A", 1, None), (7, "A", 1, 3.0), (9, "A", 1, 5.0), (9, "B", 1, 9.0))
    found = {(r.country, r.event_date.day): (r.rolling, r.days_seen) for r in rolling_mood(df).collect()}
    assert found == {("A", 1): (1.0, 1), ("A", 2): (1.0, 1), ("A", 7): (2.0, 2), ("A", 9): (4.0, 2), ("B", 9): (9.0, 1)}


def test_shift_needs_the_day_before_and_a_spread(spark):
    df = _scores(spark, (1, "A", 1, 1.0), (2, "A", 1, 3.0), (3, "A", 1, 9.0), (5, "A", 1, 9.0), (1, "B", 1, 1.0), (2, "B", 1, 1.0), (3, "B", 1, 5.0))
    found = {(r.country, r.event_date.day): (r.change, r.z_score and round(r.z_score, 4), r.alert) for r in mood_shift(df).collect()}
    assert found["A", 1] == (None, None, False)
    assert found["A", 2] == (2.0, None, False)
    assert found["A", 3] == (6.0, 4.9497, True)
    assert found["A", 5][0] is None
    assert found["B", 3] == (4.0, None, False)


def test_rollup_levels_are_weighted(spark):
    df = _scores(spark, (1, "A", 1, 1.0), (1, "B", 3, 5.0), (1, "C", 4, None), (1, "X", 2, 2.0))
    dim = spark.createDataFrame([("A", "R"), ("B", "R"), ("C", "S")], "code string, region string")
    found = {(r.level, r.region, r.country): (r.headline_count, r.mood) for r in region_rollup(df, dim).collect()}
    assert found == {
        ("country", "R", "A"): (1, 1.0), ("country", "R", "B"): (3, 5.0), ("country", "S", "C"): (4, None),
        ("country", None, "X"): (2, 2.0), ("region", "R", None): (4, 4.0), ("region", "S", None): (4, None),
        ("region", None, None): (2, 2.0), ("world", None, None): (10, 20 / 6),
    }
