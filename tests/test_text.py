import pytest
from pyspark.sql import functions as F

from pulse.functions import text as t
from pulse.functions.responses import blend_mood, parse_score, response_text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "field, expected",
    [
        ("A,1; ;B,2;", ["A,1", "B,2"]),
        ("\tA,1 ;B", ["A,1", "B"]),
        (" A　; ", ["A"]),
        ("", []),
        (None, []),
        ("a;b;c;d", ["a", "b", "c"]),
    ],
)
def test_entity_list(spark, field, expected):
    column = t.entity_list(F.col("f").cast("string"), 3)
    assert one(spark, column, f=field) == expected


@pytest.mark.parametrize(
    "entry, expected", [("NAME,offset", "name"), (",5", ""), ("Plain", "plain"), ("A B ,1", "a b ")]
)
def test_entity_name(spark, entry, expected):
    assert one(spark, t.entity_name(F.col("e")), e=entry) == expected


@pytest.mark.parametrize(
    "name, kept", [("al", False), ("ali", True), ("facebook", False), ("facebook inc", True)]
)
def test_is_person(spark, name, kept):
    assert one(spark, t.is_person(F.col("n")), n=name) is kept


@pytest.mark.parametrize(
    "themes, expected",
    [
        ("USPEC_POLICY, WB_12_TAX_FNCACT_LEADER, CRISISLEX_T03", "Policy, Tax Leader, Crisis Response"),
        ("wb_x_y", "Wb X Y"),
        ("  epu_policy ", "Epu Policy"),
        (None, ""),
    ],
)
def test_readable_themes(spark, themes, expected):
    assert one(spark, t.readable_themes(F.col("x").cast("string")), x=themes) == expected


@pytest.mark.parametrize(
    "people, expected",
    [
        ("ann lee, los angeles, bo ray", "Ann Lee, Bo Ray"),
        ("ann lee, los angeles", "Ann Lee,"),
        ("los angelesque", "Los Angelesque"),
        (None, ""),
    ],
)
def test_readable_people(spark, people, expected):
    assert one(spark, t.readable_people(F.col("x").cast("string")), x=people) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("o-neil, bar", "O-Neil, Bar"),
        ("FOO_bar/baz", "Foo_Bar/Baz"),
        ("o'neil", "O'neil"),
        ("élan  a\tb", "Élan  A\tB"),
        ("", ""),
    ],
)
def test_capitalise(spark, text, expected):
    assert one(spark, t.capitalise(F.col("x")), x=text) == expected


@pytest.mark.parametrize(
    "value, expected",
    [(1.0, "1"), (0.5, "0.5"), (-3.456, "-3.46"), (100.0, "100"), (4.345, "4.35"), (-0.001, "0"),
     (12345678.9, "12345678.9"), (10.10, "10.1")],
)
def test_plain_number(spark, value, expected):
    assert one(spark, t.plain_number(F.col("x")), x=value) == expected


def test_fill_is_null_when_a_slot_is(spark):
    column = t.fill("a {x} b {y}", x=F.col("x"), y=F.col("y").cast("string"))
    assert one(spark, column, x=1, y="z") == "a 1 b z"
    assert one(spark, column, x=1, y=None) is None


def test_snippet_strips_every_url_before_the_cut(spark):
    text = "x http://a.b/c y https://d.e z"
    assert one(spark, t.snippet(F.col("x"), 5), x=text) == "x  y "


@pytest.mark.parametrize(
    "reply, score",
    [("-0.75", -0.75), ("Score: 0.3.", 0.3), ("1", None), ("-1", None), (None, None), ("", None),
     ("about 12.5 of 20", 12.5)],
)
def test_parse_score(spark, reply, score):
    assert one(spark, parse_score(F.col("x").cast("string")), x=reply) == score


def test_parse_score_lenient(spark):
    assert one(spark, parse_score(F.col("x"), lenient=True), x="-1") == -1.0


@pytest.mark.parametrize(
    "sentiment, tone, mood",
    [(0.5, -3.456, 0.0772), (None, 2.0, None), (1.0, None, None), (5.0, 100.0, 7.5)],
)
def test_blend_mood(spark, sentiment, tone, mood):
    column = blend_mood(F.col("s").cast("double"), F.col("t").cast("double"))
    assert one(spark, column, s=sentiment, t=tone) == mood


@pytest.mark.parametrize(
    "text, raw, expected",
    [
        ("flat", '{"text": "raw"}', "flat"),
        (None, '{"predictions":[{"content":"a"}]}', "a"),
        (None, '{"text": "b"}', "b"),
        (None, '{"text": {"no": "scalar"}}', None),
        (None, '{"text": null}', None),
        (None, '{"ml_generate_text_result":{"candidates":[{"content":{"parts":[{"text":"c"}]}}]}}', "c"),
        (None, '{"ml_generate_text_result":{"candidates":[{"content":[{"text":"d"}]}]}}', "d"),
        (None, "not json", None),
        (None, None, None),
    ],
)
def test_response_text(spark, text, raw, expected):
    column = response_text(F.col("t").cast("string"), F.col("r").cast("string"))
    assert one(spark, column, t=text, r=raw) == expected
