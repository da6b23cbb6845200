"""Text helpers, all built from JVM-side column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulse import fixed


def trim_ws(text: Column) -> Column:
    """Trim every kind of whitespace (Spark's ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def fill(template: str, **values: Column) -> Column:
    """Template with ``{name}`` slots -> concat expression; NULL if any slot is NULL."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def plain_number(value: Column, places: int = 2) -> Column:
    """Rounded number as text without exponent or trailing zeros.

    The step through DECIMAL drops the last bits of a floating-point sum, which
    depend on the order in which partial sums are merged; the text is therefore
    the same on every run.
    """
    rounded = F.round(value.cast("decimal(28,9)"), places).cast("string")
    return F.regexp_replace(rounded, r"\.?0+$", "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, fixed.URL_PATTERN, "")


def snippet(text: Column, chars: int | None) -> Column:
    """Text without URLs, cut to ``chars`` characters; None cuts nothing."""
    free = strip_urls(text)
    return free if chars is None else F.substring(free, 1, chars)


def capitalise(text: Column) -> Column:
    """Capitalise after whitespace *and* punctuation, lower-case the rest.

    Spark's ``initcap`` starts a word after a space only, so the text is cut
    behind every delimiter and each piece is capitalised on its own.
    """
    pieces = F.split(text, f"(?<={fixed.WORD_DELIMITERS})")
    return F.array_join(F.transform(pieces, F.initcap), "")


def readable_themes(themes: Column) -> Column:
    """Comma list of taxonomy tokens -> readable phrases; NULL -> ''."""
    text = F.lower(F.coalesce(themes, F.lit("")))
    for pattern, replacement in fixed.THEME_REWRITES:
        text = F.regexp_replace(text, pattern, replacement)
    return capitalise(trim_ws(text))


def readable_people(people: Column) -> Column:
    """Comma list of names -> capitalised names without place noise; NULL -> ''."""
    text = F.regexp_replace(F.coalesce(people, F.lit("")), fixed.PEOPLE_NOISE, "")
    return capitalise(trim_ws(text))


def entity_list(field: Column, limit: int | None) -> Column:
    """``'A,1; B,2;'`` -> ``['A,1', 'B,2']``: trimmed, empties removed, capped unless None."""
    items = F.transform(F.split(F.coalesce(field, F.lit("")), ";"), trim_ws)
    kept = F.filter(items, lambda item: item != "")
    return kept if limit is None else F.slice(kept, 1, limit)


def entity_name(entry: Column) -> Column:
    """``'NAME,offset'`` -> ``'name'``."""
    return F.lower(F.substring_index(entry, ",", 1))


def is_person(name: Column) -> Column:
    """Noise filter for people: long enough and not a social network."""
    return (F.length(name) >= fixed.MIN_PERSON_CHARS) & ~name.isin(fixed.SOCIAL_NETWORKS)
