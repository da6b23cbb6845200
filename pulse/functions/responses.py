"""Reading model responses: JSON fallback and score parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulse import fixed
from pulse.functions.binding import bind


def json_scalar(document: Column, path: str) -> Column:
    """Scalar at ``path`` of a variant as text; NULL for objects, arrays, JSON null."""

    def scalar(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        return F.when(~nested, F.try_variant_get(value, "$", "string"))

    return bind(F.try_variant_get(document, path, "variant"), scalar)


def response_text(text: Column, raw: Column) -> Column:
    """The flat text if there is one, else the first path of ``raw`` that holds text."""

    def first_scalar(document: Column) -> Column:
        return F.coalesce(*(json_scalar(document, path) for path in fixed.RESPONSE_PATHS))

    return F.coalesce(text, bind(F.try_parse_json(raw), first_scalar))


def parse_score(reply: Column, lenient: bool = False) -> Column:
    """First signed decimal of a reply; NULL if there is none.

    A decimal point is required, so ``"1"`` gives NULL; ``lenient`` takes
    integers as well.
    """
    pattern = fixed.LENIENT_SCORE_PATTERN if lenient else fixed.SCORE_PATTERN
    return F.regexp_substr(reply, F.lit(pattern)).try_cast("double")


def blend_mood(sentiment: Column, avg_tone: Column) -> Column:
    """Mean of the sentiment and a tenth of the tone, unclamped; NULL if either is."""
    mean = (sentiment.try_cast("double") + avg_tone.try_cast("double") / 10) / 2
    # the inner round drops floating-point noise, so that a half is rounded up reliably
    return F.round(F.round(mean, 9), 4)
