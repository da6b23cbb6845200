import pytest
from pyspark.sql import functions as F

from frames import DAY, plan_of
from pulse.config import PulseConfig
from pulse.functions.pages import canonical_url, opening_words
from pulse.operators.briefings import briefing_context
from pulse.operators.snippets import country_snippets, page_snippets, with_snippets
from test_models import tables

EVENT = "event_date date, country string, url string, tone double"


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://a.org/b", "a.org/b"),
        ("HTTPS://www.A.org:443/b/", "a.org/b"),
        ("http://me:pw@a.org:80", "a.org"),
        ("https://a.org./Case/?b=2&a=1&utm_source=x&ref=y&&reference=z#top", "a.org/Case?a=1&b=2&reference=z"),
        ("http://a.org:8080//x//", "a.org:8080//x"),
        ("ftp://a.org/b", "ftp://a.org/b"),
        ("  http://a.org/b ", "a.org/b"),
        ("http://a.org?", "a.org"),
        (" no address ", "no address"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, key):
    assert one(spark, url, canonical_url) == key


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>no</title></head><body><nav>no</nav><p>one<b>two</b> three<p>four</body>", "onetwo three four"),
        ("<p>no</p><article class=x><h1>no</h1>yes &amp;lt; &lt;&nbsp;&#39;<!-- no --><script>'<p>no'</script></article>no", "yes &lt; < '"),
        ("<header>no</header>yes<header>no, and never closed <p>no", "yes"),
        ("a < b, c > d <<<i>e</i>", "a d <<e"),
        ("\t<br>\n", None),
        ("", None),
        (None, None),
    ],
)
def test_opening_words(spark, html, text):
    assert one(spark, html, lambda x: opening_words(x, None)) == text


def test_openings_are_cut_at_a_space(spark):
    cut = lambda text, chars: one(spark, text, lambda x: opening_words(x, chars))
    assert [cut("ab cd ef", n) for n in (1, 2, 4, 5, 7, 8, 9)] == ["a", "ab", "ab", "ab cd", "ab cd", "ab cd ef", "ab cd ef"]
    broken = "<form " * 50_000 + "<nav>" * 50_000
    assert cut("x" + broken, 10) == "x"  # one pass per pattern


def test_one_snippet_per_address(spark):
    rows = [("http://a.org/1", "b", 1), ("https://www.a.org/1/", "a", 2), ("http://a.org/1", "c", 2), ("http://a.org/1", "z", None),
            ("http://a.org/2", None, 1), ("http://a.org/3", "<nav>x</nav>", 1), (None, "q", 1)]
    pages = spark.createDataFrame(rows, "url string, html string, day int")
    assert [tuple(r) for r in page_snippets(pages).collect()] == [("a.org/1", "a")]
    assert [tuple(r) for r in page_snippets(pages, version="day").collect()] == [("a.org/1", "a")]
    assert page_snippets(pages.limit(0)).count() == 0
    events = [(DAY, "A", "http://A.org/1?utm_medium=x", 1.0)] * 3 + [(DAY, "A", None, 1.0), (DAY, "B", "http://a.org/2", 1.0)]
    made = with_snippets(spark.createDataFrame(events, EVENT).withColumn("snippet", F.lit("old")), pages)
    assert sorted((r.country, r.snippet) for r in made.collect() if r.snippet) == [("A", "a")] * 3 and made.count() == 5
    assert "Python" not in plan_of(made)


def test_country_snippets_reach_the_briefing(spark):
    rows = [(DAY, "C0", s) for s in "bbaaacde"] + [(DAY, "C1", None)]
    told = country_snippets(spark.createDataFrame(rows, "event_date date, country string, snippet string"))
    assert [tuple(r) for r in told.collect()] == [(DAY, "C0", "a | b | c")]
    context = briefing_context(*tables(spark), PulseConfig(top_n=3), told)
    assert {r.country: r.ctx for r in context.collect()} == {
        "C0": "doc 0  end\na | b | c", "C1": "doc 1  end", "C2": "doc 2  end"
    }
