"""Urls as keys and the opening words of a page, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulse.functions.binding import bind

URL_PARTS = r"^[ \t\r\n]*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(?:utm_[^=]*|fbclid|gclid|ref)(?:=|$)"
# parts of a page that are not what it says: removed with all their contents, the raw ones first
AWAY = "script style head nav header footer aside form noscript h[1-6]".split()
INLINE = "a abbr b big cite code em font i mark q s small span strong sub sup u".split()
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·",
    "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&amp;": "&",  # last: an escaped reference stays as it is written
}
SPACE = r"[\x09-\x0D\x20]+"


def canonical_url(url: Column) -> Column:
    """The key under which spellings of one address meet.

    ``http`` and ``https`` are one; a user, ``www.``, a closing dot and the ports 80 and 443 go from
    the lower-cased host, slashes from the end of the path, tracking parameters and empty ones from the query, whose
    parameters are sorted; the fragment goes. The path keeps its case. Text without a scheme stays as it is,
    trimmed; NULL gives NULL.
    """
    part = lambda i: F.regexp_extract(url, URL_PARTS, i)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(2)), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r"\.?(?::(?:80|443)?)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.trim(part(3)), "/+$", "")
    asked = F.filter(F.split(F.trim(part(4)), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    prefix = F.when(scheme.isin("http", "https"), "").otherwise(F.concat(scheme, F.lit("://")))
    key = F.concat(prefix, host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme == "", F.trim(url)).otherwise(key)


def opening_words(html: Column, chars: int | None) -> Column:
    """The first ``chars`` characters of what a page says, cut at a space; NULL if it says nothing.

    That is the text of its first article, else of the page without its menus, headers, footers,
    forms and headings. An element that is never closed reaches to the end, so each pattern passes a page
    once, however broken it is. ``None`` cuts nothing.
    """
    text = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")
    for name in AWAY:
        text = F.regexp_replace(text, rf"(?is)<{name}\b.*?(?:</{name}\s*>|\z)", " ")
    text = bind(
        text,
        lambda t: bind(
            F.regexp_extract(t, r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|\z)", 1),
            lambda article: F.when(article == "", t).otherwise(article),
        ),
    )
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(INLINE)})\b[^<>]*>", "")
    text = F.regexp_replace(text, r"<[^<>]*>", " ")
    for reference, character in ENTITIES.items():
        text = F.replace(text, F.lit(reference), F.lit(character))
    text = F.trim(F.regexp_replace(text, SPACE, " "))

    def cut(t: Column) -> Column:
        if chars is not None:
            head = F.substring(t, 1, chars + 1)
            words = F.regexp_extract(head, r"(?s)^(.*) ", 1)
            short = F.when(words == "", F.substring(t, 1, chars)).otherwise(words)
            t = F.when(F.length(t) <= chars, t).otherwise(short)
        return F.when(t != "", t)

    return bind(text, cut)
