"""Deterministic local models, built from column expressions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pulse.functions.binding import bind
from pulse.functions.text import fill
from pulse.models.contracts import GenerationOptions

GOOD_WORDS = [
    "agreement", "aid", "boost", "calm", "ceasefire", "deal", "gain", "growth", "hope",
    "improve", "peace", "progress", "purchase", "recovery", "relief", "rescue", "signup",
    "stable", "success", "support",
]
BAD_WORDS = [
    "attack", "collapse", "conflict", "crash", "crisis", "death", "disaster", "error",
    "fear", "fraud", "kill", "loss", "outbreak", "protest", "riot", "sanction", "threat",
    "unrest", "violence", "war",
]
BRIEFING = (
    "[What happened] {headline_count} headlines in {country}. {context}\n"
    "[Key drivers] {themes}\n"
    "[Impact] {people}\n"
    "[Watch next] {analogs}"
)
SUMMARY = "News mood for {country} is {mood} on themes {themes}."


@dataclass(frozen=True)
class HashedTerms:
    """Hashed term counts, normalised to unit length.

    A term is a maximal run of letters and digits, lower-cased; its place in the vector
    comes from its MD5, so any engine can compute the same vector.
    """

    dims: int = 64

    def embed(self, text: Column) -> Column:
        terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
        places = F.transform(terms, self._place)
        unit = bind(places, lambda p: bind(self._counts(p), _unit))
        return F.when(text.isNotNull(), unit)

    def sql_function(self, spark: SparkSession, name: str = "embed_text") -> None:
        """The same vector as a temporary SQL function of a text."""
        spark.sql(rf"""
            CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS ARRAY<FLOAT> RETURN
            SELECT CASE WHEN t IS NOT NULL THEN transform(counts, x -> CAST(x / greatest(
                     sqrt(aggregate(counts, 0D, (total, y) -> total + y * y)), 1D) AS FLOAT)) END
            FROM (SELECT transform(sequence(0, {self.dims} - 1), d ->
                    CAST(size(filter(places, p -> p = d)) AS DOUBLE)) AS counts
              FROM (SELECT transform(filter(split(lower(t), r'[^\p{{L}}\p{{N}}]+'), w -> w <> ''), w ->
                      CAST(conv(substring(md5(w), 1, 8), 16, 10) AS BIGINT) % {self.dims}) AS places))""")

    def _place(self, term: Column) -> Column:
        return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % self.dims

    def _counts(self, places: Column) -> Column:
        dims = F.sequence(F.lit(0), F.lit(self.dims - 1))
        return F.transform(
            dims, lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double")
        )


def _unit(counts: Column) -> Column:
    """Unit length; without terms the zero vector stays, which no search returns."""
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda total, x: total + x * x))
    return bind(
        F.greatest(length, F.lit(1.0)),
        lambda n: F.transform(counts, lambda x: (x / n).cast("float")),
    )


@dataclass(frozen=True)
class TemplateText:
    """Fills fixed sentences from the facts; scores by counting tone words."""

    good: list[str] = field(default_factory=lambda: GOOD_WORDS)
    bad: list[str] = field(default_factory=lambda: BAD_WORDS)

    def generate(
        self, task: str, prompt: Column, facts: Mapping[str, Column], options: GenerationOptions
    ) -> Column:
        reply = {
            "briefing": self._briefing,
            "sentiment": self._sentiment,
            "summary": self._summary,
        }[task](facts)
        words = F.slice(F.split(reply, " "), 1, options.max_output_tokens)
        text = F.when(prompt.isNotNull(), F.array_join(words, " "))
        return F.struct(text.alias("text"), F.lit(None).cast("string").alias("raw"))

    def _briefing(self, facts: Mapping[str, Column]) -> Column:
        return fill(BRIEFING, **facts)

    def _sentiment(self, facts: Mapping[str, Column]) -> Column:
        """(good - bad) / (good + bad + 1) with two decimals, cut towards zero."""
        words = F.split(F.lower(facts["briefing"]), r"[^\p{L}]+")

        def score(words: Column) -> Column:
            good = F.size(F.filter(words, lambda w: w.isin(self.good)))
            bad = F.size(F.filter(words, lambda w: w.isin(self.bad)))
            return F.struct(good.alias("good"), bad.alias("bad"))

        return bind(bind(words, score), lambda n: _as_decimal(n["good"], n["bad"]))

    def _summary(self, facts: Mapping[str, Column]) -> Column:
        score = facts["mood_score"]
        mood = F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")
        return fill(
            SUMMARY,
            country=facts["country"],
            mood=mood,
            themes=F.coalesce(F.nullif(facts["themes"], F.lit("")), F.lit("none")),
        )


def _as_decimal(good: Column, bad: Column) -> Column:
    hundredths = F.floor(F.abs(good - bad) * 100 / (good + bad + 1)).cast("int")
    return F.concat(
        F.when(good < bad, "-").otherwise(""),
        F.floor(hundredths / 100).cast("string"),
        F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"),
    )
