"""The same rows as ``checks.queries``, as SQL over the given tables.

Written in the literal form of each definition (double unnest, per-row
windows, one statement), not in the form the Spark operators use.
"""

from __future__ import annotations

from string import Formatter

from checks.queries import QUERY_TEXT, SIMILAR_COUNTRY, SIMILAR_DAY
from checks.views import HOT_URL
from pulse import fixed
from pulse.models.local import BAD_WORDS, BRIEFING, GOOD_WORDS, SUMMARY

DIMS = 64


# --- text building blocks --------------------------------------------------------
def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, **values: str) -> str:
    """Template -> ``||`` chain, which is NULL if any part is."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(lit(text))
        if name:
            parts.append(f"cast({values[name]} as varchar)")
    return "(" + " || ".join(parts) + ")"


def trim(x: str) -> str:
    return f"trim({x}, {lit(fixed.WHITESPACE)})"


def replace_all(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(replacement)}, 'g')"


def capitalise(x: str) -> str:
    d = fixed.WORD_DELIMITERS
    pieces = f"regexp_extract_all({x}, {lit('[^' + d[1:] + '*' + d + '|[^' + d[1:] + '+')})"
    # title case of a leading ß is Ss in Unicode; upper() gives the capital ẞ
    first = "case left(p, 1) when 'ß' then 'Ss' else upper(left(p, 1)) end"
    return (
        f"array_to_string(list_transform({pieces}, lambda p: "
        f"{first} || lower(substr(p, 2))), '')"
    )


def url_key(x: str) -> str:
    """Patterns and lists are written out here, not taken from the code under test."""
    parts = r"^[ \t\r\n]*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    part = lambda i: f"regexp_extract({x}, {lit(parts)}, {i})"
    host = f"regexp_replace(lower({part(2)}), '^.*@', '')"
    host = f"regexp_replace(regexp_replace({host}, '[.]?(:(80|443)?)?$', ''), '^www[.]', '')"
    asked = (
        f"list_sort(list_filter(string_split(trim({part(4)}), '&'), lambda p: p <> '' and not "
        "regexp_matches(p, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)')))"
    )
    return (
        f"case when {part(1)} = '' then trim({x}) else "
        f"case when lower({part(1)}) in ('http', 'https') then '' else lower({part(1)}) || '://' end || {host} || "
        f"regexp_replace(trim({part(3)}), '/+$', '') || "
        f"case when len({asked}) > 0 then '?' || array_to_string({asked}, '&') else '' end end"
    )


def page_text(x: str) -> str:
    text = f"regexp_replace({x}, '(?s)<!--.*?(-->|\\z)', ' ', 'g')"
    for name in "script style head nav header footer aside form noscript h[1-6]".split():
        text = f"regexp_replace({text}, '(?is)<{name}\\b.*?(</{name}\\s*>|\\z)', ' ', 'g')"
    article = "regexp_extract(t, '(?is)<article\\b[^>]*>(.*?)(?:</article\\s*>|\\z)', 1)"
    text = f"(select case when {article} = '' then t else {article} end from (select {text} as t))"
    inline = "a|abbr|b|big|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u"
    text = f"regexp_replace({text}, '(?i)</?({inline})\\b[^<>]*>', '', 'g')"
    text = f"regexp_replace({text}, '<[^<>]*>', ' ', 'g')"
    characters = (
        "nbsp= lt=< gt=> quot=\" #39=' apos=' copy=© middot=· hellip=… ndash=– mdash=— lsquo=‘ rsquo=’ ldquo=“ rdquo=” amp=&"
    )
    for name, character in (entry.split("=", 1) for entry in characters.split(" ")):
        text = f"replace({text}, '&{name};', {lit(character or ' ')})"
    return f"trim(regexp_replace({text}, '[\\x09-\\x0D\\x20]+', ' ', 'g'))"


def opening(text: str, chars: int) -> str:
    words = f"regexp_extract(left({text}, {chars + 1}), '(?s)^(.*) ', 1)"
    short = f"case when {words} = '' then left({text}, {chars}) else {words} end"
    return f"nullif(case when length({text}) <= {chars} then {text} else {short} end, '')"


def themes_nice(x: str) -> str:
    text = f"lower(coalesce({x}, ''))"
    for pattern, replacement in fixed.THEME_REWRITES:
        text = replace_all(text, pattern, replacement)
    return f"coalesce({capitalise(trim(text))}, '')"


def people_nice(x: str) -> str:
    text = replace_all(f"coalesce({x}, '')", fixed.PEOPLE_NOISE, "")
    return f"coalesce({capitalise(trim(text))}, '')"


def number(x: str) -> str:
    return (
        f"regexp_replace(cast(cast(round(cast({x} as decimal(28,9)), 2) as decimal(28,2)) "
        r"as varchar), '\.?0+$', '')"
    )


def snippet(x: str, chars: int) -> str:
    return f"substr({replace_all(x, fixed.URL_PATTERN, '')}, 1, {chars})"


def entities(x: str, limit: int | None = None) -> str:
    items = f"list_transform(string_split(coalesce({x}, ''), ';'), lambda e: {trim('e')})"
    return f"(list_filter({items}, lambda e: e <> ''))" + (f"[1:{limit}]" if limit else "")


def vector(x: str) -> str:
    """Hashed term counts of a text, unit length, as FLOAT[]."""
    terms = (
        f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    )
    places = (
        f"list_transform({terms}, lambda t: "
        f"cast('0x' || substr(md5(t), 1, 8) as bigint) % {DIMS})"
    )
    return (
        f"(select list_transform(c, lambda v: cast(v / greatest(n, 1.0) as float)) from "
        f"(select c, sqrt(list_sum(list_transform(c, lambda v: v * v))) as n from "
        f"(select list_transform(range({DIMS}), lambda d: "
        f"cast(len(list_filter(p, lambda q: q = d)) as double)) as c from "
        f"(select {places} as p))))"
    )


def distance(a: str, b: str) -> str:
    return f"round(list_cosine_distance(cast({a} as double[]), cast({b} as double[])), 9)"


def pairs(x: str, key: str) -> str:
    return (
        f"array_to_string(list_transform({x}, lambda e: e.{key} || '=' || cast(e.c as varchar)), "
        "'|') as " + x
    )


def score(x: str, pattern: str = fixed.SCORE_PATTERN) -> str:
    return f"try_cast(nullif(regexp_extract({x}, {lit(pattern)}), '') as double)"


def blend(sentiment: str, tone: str) -> str:
    mean = f"({sentiment} + {tone} / 10) / 2"
    return f"cast(round(cast({mean} as decimal(28,9)), 4) as double)"


def count_words(x: str, words: list[str]) -> str:
    listed = ", ".join(lit(w) for w in words)
    return f"len(list_filter({x}, lambda w: w in ({listed})))"


# --- tables of the daily run, as common table expressions -------------------------
def _geo(column: str, action: str, actor1: str, actor2: str) -> str:
    return (
        f"coalesce(case when event_id % 10 <> 0 then {action} end, "
        f"case when event_id % 50 <> 0 then {actor1} end, "
        f"case when event_id % 100 <> 0 then {actor2} end) as {column}"
    )


def _entries(step: int, first: int, name: str, separator: str) -> str:
    numbered = (
        f"list_transform(string_split(text, ' '), lambda w, k: {name} || ',' || (k - 1))"
    )
    kept = f"list_filter({numbered}, lambda e, k: (k - 1) % {step} = {first})"
    return f"array_to_string({kept}, {lit(separator)})"


_THEME = (
    "(case (k - 1) % 16 when 0 then 'USPEC_' || w when 4 then 'WB_12_' || w "
    "when 8 then 'TAX_FNCACT_' || w when 12 then 'CRISISLEX_' || w else w end)"
)
_PERSON = (
    "(case when (k - 1) % 30 = 1 then 'Los Angeles' when (k - 1) % 30 = 4 then 'Facebook' "
    "else w end)"
)
_IS_PERSON = (
    f"length(name) >= {fixed.MIN_PERSON_CHARS} and name not in "
    f"({', '.join(lit(n) for n in fixed.SOCIAL_NETWORKS)})"
)


def _top_lists(themes: str, people: str) -> str:
    """Two relations of (event_date, country, name, c) -> ranked lists."""

    def ranked(source: str, key: str) -> str:
        return f"""
          select event_date, country,
                 list({{'{key}': name, 'c': c}} order by c desc, name) as names
          from (select *, row_number() over (
                  partition by event_date, country order by c desc, name) as r
                from ({source}))
          where r <= 10 group by event_date, country"""

    return f"""
      select t.event_date, t.country, t.names as top_themes, p.names as top_people
      from ({ranked(themes, 'theme')}) t
      left join ({ranked(people, 'person')}) p using (event_date, country)"""


CTES: dict[str, str] = {
    "raw": f"""
      select cast(ts as date) as event_date,
        {_geo('country', 'n_name', 'r_name', 'c_mktsegment')},
        {_geo('admin1', "n_name || '-1'", "r_name || '-2'", "c_mktsegment || '-3'")},
        {_geo('lat', 'n_nationkey + 0.5::double', 'n_nationkey + 0.25::double',
              'n_nationkey + 0.125::double')},
        {_geo('lon', 'n_nationkey - 0.5::double', 'n_nationkey - 0.25::double',
              'n_nationkey - 0.125::double')},
        '0' || event_type || '11' as EventCode, '0' || event_type || '1' as EventBaseCode,
        case when event_id % 89 <> 0 then '0' || event_type end as EventRootCode,
        case when event_id % 83 <> 0 then (50 - value) / 10 end as tone,
        case when event_id % 97 <> 0
          then 'http://news.example/d/' || (event_id // 20) end as url
      from events join customer on user_id = c_custkey
      join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
      where cast(ts as date) >= date '2024-01-30' - 60""",
    "spelled": r"""
      select page_id, case page_id % 4
        when 1 then regexp_replace(url, '^https?://', 'HTTPS://WWW.')
        when 2 then regexp_replace(url, '#.*$', '') || case when contains(regexp_replace(url, '#.*$', ''), '?')
          then '&' else '?' end || 'utm_source=feed'
        when 3 then regexp_replace(url, '^(https?://[^/?#]+)', '\1:443')
        else url end as url from pages""",
    "paged": f"""
      select event_date, country, {url_key('u')} as url_key from (
        select r.event_date, r.country, coalesce(s.url, r.url) as u
        from raw r left join spelled s on r.url = 'http://news.example/d/' || s.page_id)""",
    "page_snippets": f"""
      select url_key, min(snippet) as snippet from (
        select {url_key('url')} as url_key, {opening('w', 300)} as snippet
        from (select url, {page_text('html')} as w from pages))
      where snippet is not null group by url_key""",
    "gkg_feed": f"""
      select (20240101 + doc_id % 30) * 1000000 + doc_id % 24 * 10000 as date,
        'http://news.example/d/' || (doc_id // 2) as DocumentIdentifier,
        {_entries(3, 0, _THEME, ';')} as V2Themes,
        case when doc_id % 7 <> 0 then {_entries(3, 1, _PERSON, '; ')} end as V2Persons,
        case when doc_id % 11 <> 0 then {_entries(3, 2, 'w', f' ;{chr(9)}')} end as V2Organizations
      from documents""",
    "graph": f"""
      select DocumentIdentifier as url, date, {entities('V2Themes', 50)} as themes,
        {entities('V2Persons', 30)} as persons, {entities('V2Organizations', 30)} as orgs
      from gkg_feed where date >= 20240123000000""",
    "recent": """
      select * from raw
      where event_date >= date '2024-01-23' and country is not null and url is not null""",
    "enriched": """
      select r.*, coalesce(themes, []) as themes, coalesce(persons, []) as persons,
        coalesce(orgs, []) as orgs
      from recent r left join graph using (url)""",
    "enriched_latest": """
      select r.*, coalesce(themes, []) as themes, coalesce(persons, []) as persons,
        coalesce(orgs, []) as orgs
      from recent r left join (
        select * from (select *, row_number() over (partition by url
          order by date desc, themes desc, persons desc, orgs desc) as r from graph)
        where r = 1) g on r.url = g.url""",
    "marked": """
      select *, coalesce(cast(split_part(url, '/', 5) as bigint) % 50, 0) as k from raw""",
    "pairs": """
      select event_date, country, lower(split_part(t, ',', 1)) as theme,
        lower(split_part(p, ',', 1)) as person
      from (select event_date, country, t, unnest(persons) as p
            from (select event_date, country, persons, unnest(themes) as t from enriched))""",
    "entities": _top_lists(
        "select event_date, country, theme as name, count(*) as c from pairs group by all",
        "select event_date, country, name, count(*) as c from "
        f"(select event_date, country, person as name from pairs) where {_IS_PERSON} group by all",
    ),
    "plain_entities": _top_lists(
        "select event_date, country, name, count(*) as c from (select event_date, country, "
        "lower(split_part(unnest(themes), ',', 1)) as name from enriched) group by all",
        "select event_date, country, name, count(*) as c from (select event_date, country, "
        "lower(split_part(unnest(persons), ',', 1)) as name from enriched) "
        f"where {_IS_PERSON} group by all",
    ),
    "country_day": """
      select event_date, country, count(*) as headline_count, avg(tone) as avg_tone,
        min(tone) as min_tone, max(tone) as max_tone,
        (list_sort(list(distinct EventRootCode)
          filter (where EventRootCode is not null)))[1:20] as top_event_types,
        (list_sort(list(distinct url) filter (where url is not null)))[1:30] as sample_urls
      from raw where country is not null and event_date >= date '2024-01-23'
      group by event_date, country""",
    "topics": "select *, "
    + fill(
        fixed.TOPIC_DOC,
        country="country",
        event_date="event_date",
        headline_count="headline_count",
        avg_tone=number("avg_tone"),
        min_tone=number("min_tone"),
        max_tone=number("max_tone"),
        codes=f"array_to_string(top_event_types, {lit(fixed.CODE_SEPARATOR)})",
        urls=f"array_to_string(sample_urls, {lit(fixed.URL_SEPARATOR)})",
    )
    + " as topic_doc from country_day",
    "top": """
      select * from topics where event_date = (select max(event_date) from topics)
      order by headline_count desc, country limit 80""",
    "embedded": f"""
      select event_date, country, doc as topic_doc, case when doc is not null
        then {vector('doc')} end as embedding, country || '-' || event_date as id
      from (select event_date, country, substr(topic_doc, 1, 3000) as doc from topics)""",
    "dated": """
      select cast(date '2024-01-01' + cast(vec_id % 30 as integer) as date) as event_date,
        'C' || (vec_id // 30) as country,
        'Vector ' || vec_id || ' at https://news.example/v/' || vec_id || ' of ' || label
          as topic_doc,
        embedding, label as headline_count,
        'C' || (vec_id // 30) || '-' ||
          cast(date '2024-01-01' + cast(vec_id % 30 as integer) as date) as id
      from embeddings""",
    "dated_today": """
      select event_date, country, id, embedding from dated
      where event_date = (select max(event_date) from dated)
      order by headline_count desc, country limit 80""",
    "topic_today": "select t.event_date, t.country, e.id, e.embedding from top t "
    "join embedded e using (event_date, country)",
}


def _analogs(base: str, today: str, pre: bool = False) -> str:
    past = f"""
      select a.event_date, a.country, a.id as anchor, b.event_date as past_date,
        b.country as past_country, b.id, {snippet('b.topic_doc', 400)} as snippet,
        {distance('a.embedding', 'b.embedding')} as distance
      from {today} a, {base} b
      where a.embedding is not null and b.embedding is not null
        {'and b.event_date < a.event_date' if pre else ''}"""
    return f"""
      select event_date, country, past_date, past_country, snippet, distance from (
        select *, row_number() over (partition by anchor order by distance, id) as kept from (
          select *, row_number() over (partition by anchor order by distance, id) as r
          from ({past}))
        where r <= {5 if pre else 10} and past_date < event_date)
      where kept <= 5"""


CTES |= {
    "dated_flat": _analogs("dated", "dated_today"),
    "dated_flat_pre": _analogs("dated", "dated_today", pre=True),
    "topic_flat": _analogs("embedded", "topic_today"),
}


def _nested(flat: str) -> str:
    line = fill(fixed.ANALOG_LINE, past_date="past_date", snippet="snippet")
    return f"""
      select event_date, country, count(*) as n_analogs,
        string_agg({line}, {lit(fixed.ANALOG_SEPARATOR)}
          order by distance, past_date, snippet) as analogs_txt,
        list(distance order by distance, past_date, snippet) as distances
      from {flat} group by event_date, country"""


def _names(column: str, key: str) -> str:
    return (
        f"array_to_string(list_transform({column}, lambda e: e.{key}), "
        f"{lit(fixed.ENTITY_SEPARATOR)})"
    )


_FACTS = {
    "country": "country",
    "headline_count": "headline_count",
    "themes": "themes_nice",
    "people": "people_nice",
    "context": "ctx",
    "analogs": "analogs_txt",
}


def _cut(text: str, words: int) -> str:
    return f"array_to_string((string_split({text}, ' '))[1:{words}], ' ')"


CTES |= {
    "dated_nested": _nested("dated_flat"),
    "topic_nested": _nested("topic_flat"),
    "context": f"""
      select t.event_date, t.country, headline_count, {snippet('topic_doc', 700)} as ctx,
        coalesce(analogs_txt, {lit(fixed.NO_ANALOGS)}) as analogs_txt,
        {themes_nice(_names('top_themes', 'theme'))} as themes_nice,
        {people_nice(_names('top_people', 'person'))} as people_nice
      from top t left join entities using (event_date, country)
      left join topic_nested using (event_date, country)""",
    "briefings": f"""
      select event_date, country, {_cut(fill(BRIEFING, **_FACTS), 300)} as briefing_text
      from context where ctx is not null""",
    "scores": f"""
      select event_date, country, briefing_text, good, bad,
        case when good < bad then '-' else '' end || (h // 100) || '.' ||
          lpad(cast(h % 100 as varchar), 2, '0') as reply
      from (select *, cast(floor(abs(good - bad) * 100 / (good + bad + 1)) as bigint) as h from (
        select *, {count_words('words', GOOD_WORDS)} as good,
          {count_words('words', BAD_WORDS)} as bad
        from (select *, regexp_split_to_array(lower(briefing_text), '[^\\p{{L}}]+') as words
          from briefings where event_date = (select max(event_date) from briefings))))""",
    "mood": f"""
      select event_date, country, mood_score, top_themes, briefing_text,
        {_cut(fill(
            SUMMARY, country='country',
            mood="case when mood_score > 0.1 then 'positive' "
                 "when mood_score < -0.1 then 'negative' else 'neutral' end",
            themes=f"coalesce(nullif({themes_nice(_names('top_themes', 'theme'))}, ''), 'none')",
        ), 60)} as summary_ref
      from (select *, {blend(score('reply'), 'avg_tone')} as mood_score
        from scores left join topics using (event_date, country)
        left join entities using (event_date, country))
      where mood_score is not null""",
    "day_scores": """
      select event_date, country, count(*) as headline_count, avg(tone) / 10 as mood_score
      from raw where country is not null group by event_date, country""",
    "placed": "select s.*, region from day_scores s left join dim using (country)",
    "dim": """
      select n_name as country, 'N' || lpad(cast(n_nationkey as varchar), 2, '0') as iso3,
        n_name as country_name, r_name as region
      from nation join region on n_regionkey = r_regionkey""",
    "feed": f"""
      select event_date, country, iso3, country_name, region, mood_score,
        least(greatest(mood_score, -1.0::double), 1.0::double) as mood_clamped,
        -1.0::double as range_low, 1.0::double as range_high, 'RdYlGn' as color_scale,
        {pairs('top_themes', 'theme')}, briefing_text, summary_ref
      from mood left join dim using (country)
      where event_date = (select max(event_date) from mood)""",
}

NEEDS: dict[str, list[str]] = {
    "paged": ["raw", "spelled"],
    "graph": ["gkg_feed"],
    "recent": ["raw"],
    "marked": ["raw"],
    "enriched": ["recent", "graph"],
    "enriched_latest": ["recent", "graph"],
    "pairs": ["enriched"],
    "entities": ["pairs"],
    "plain_entities": ["enriched"],
    "country_day": ["raw"],
    "topics": ["country_day"],
    "top": ["topics"],
    "embedded": ["topics"],
    "dated_today": ["dated"],
    "topic_today": ["top", "embedded"],
    "dated_flat": ["dated", "dated_today"],
    "dated_flat_pre": ["dated", "dated_today"],
    "topic_flat": ["embedded", "topic_today"],
    "dated_nested": ["dated_flat"],
    "topic_nested": ["topic_flat"],
    "context": ["top", "entities", "topic_nested"],
    "briefings": ["context"],
    "scores": ["briefings"],
    "mood": ["scores", "topics", "entities"],
    "feed": ["mood", "dim"],
    "day_scores": ["raw"],
    "placed": ["day_scores", "dim"],
}


def with_tables(select: str, *names: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    body = ",\n".join(f"{name} as materialized ({CTES[name]})" for name in ordered)
    return f"with {body}\n{select}" if body else select


_EVENT = "event_date, country, admin1, lat, lon, EventCode, EventBaseCode, EventRootCode, url"
_TONES = (
    "round(avg_tone, 10) as avg_tone, round(min_tone, 10) as min_tone, "
    "round(max_tone, 10) as max_tone"
)
_TOPIC_ARRAYS = (
    "array_to_string(top_event_types, '|') as top_event_types, "
    "array_to_string(sample_urls, '|') as sample_urls"
)
_ARRAYS = (
    "array_to_string(themes, '|') as themes, array_to_string(persons, '|') as persons, "
    "array_to_string(orgs, '|') as orgs"
)
_ENTITY_PAIRS = (
    f"event_date, country, {pairs('top_themes', 'theme')}, {pairs('top_people', 'person')}"
)
_REPLY = """
  select event_id, value, case when event_id % 11 = 0 then null
    when event_id % 5 = 0 then cast(cast(trunc(value) as integer) as varchar)
    when event_id % 3 = 0 then 'Score: -' || value || ', or so.'
    else cast(value as varchar) end as reply
  from events"""


_BRIEFING_PROMPT = fill(
    fixed.BRIEFING_PROMPT,
    country="country",
    themes="themes_nice",
    people="people_nice",
    context="ctx",
    analogs="analogs_txt",
)


def _refused(text: str) -> str:
    return f"(case when left(md5({text}), 1) in ('0', '1', '2') then 'ValueError: refused' end)"


def _similar_to_day(pre: bool) -> str:
    other = f"event_date <> date '{SIMILAR_DAY}'"
    return with_tables(
        f"""
        select event_date, country, topic_doc, round(distance, 6) as distance, id from (
          select *, row_number() over (order by distance, id) as r from (
            select b.*, {distance('a.embedding', 'b.embedding')} as distance
            from dated b, (select embedding from dated where country = '{SIMILAR_COUNTRY}'
              and event_date = date '{SIMILAR_DAY}' order by id limit 1) a
            {'where ' + other if pre else ''}))
        where r <= 10 and {other}""",
        "dated",
    )


def _json(shape: str) -> str:
    """First scalar of the four response paths."""
    found = []
    for path in fixed.RESPONSE_PATHS:
        found.append(
            f"case when json_type({shape}, '{path}') not in ('OBJECT', 'ARRAY') "
            f"then json_extract_string({shape}, '{path}') end"
        )
    return ", ".join(found)


_RAW_REPLY = """case turn % 6
    when 1 then json_object('ml_generate_text_result', json_object('candidates',
      json_array(json_object('content', json_object('parts',
        json_array(json_object('text', text)))))))
    when 2 then json_object('ml_generate_text_result', json_object('candidates',
      json_array(json_object('content', json_array(json_object('text', text))))))
    when 3 then json_object('predictions', json_array(json_object('content', text)))
    when 4 then case when conv_id % 7 = 0
      then json_object('text', json_object('text', text)) else json_object('text', text) end
    end"""

def _hot(url: str, every: int) -> str:
    return f"case when cast(split_part({url}, '/', 5) as bigint) % {every} = 0 then '{HOT_URL}' else {url} end"


ORACLE: dict[str, str] = {
    "ingest_events": with_tables(f"select {_EVENT}, round(tone, 10) as tone from raw", "raw"),
    "enrich_gkg": with_tables(
        f"select {_EVENT}, round(tone, 10) as tone, {_ARRAYS} from enriched", "enriched"
    ),
    "enrich_gkg_latest": with_tables(
        f"select {_EVENT}, round(tone, 10) as tone, {_ARRAYS} from enriched_latest",
        "enriched_latest",
    ),
    "enrich_gkg_hot": with_tables(
        f"""
        select event_date, country, url = '{HOT_URL}' as hot, count(*) as n_rows,
          cast(sum(len(coalesce(themes, []))) as bigint) as n_themes,
          cast(sum(len(coalesce(persons, []))) as bigint) as n_persons,
          cast(sum(len(coalesce(orgs, []))) as bigint) as n_orgs
        from (select event_date, country, {_hot('url', 3)} as url from recent) r
        left join (select {_hot('url', 125)} as url, themes, persons, orgs from graph) g using (url)
        group by 1, 2, 3""",
        "recent", "graph",
    ),
    "gkg_fields": with_tables(
        f"select date, DocumentIdentifier, "
        f"array_to_string({entities('V2Themes', 50)}, '|') as themes, "
        f"array_to_string({entities('V2Persons', 30)}, '|') as persons, "
        f"array_to_string({entities('V2Organizations', 30)}, '|') as orgs from gkg_feed",
        "gkg_feed",
    ),
    "canonical_urls": f"select page_id, url, {url_key('url')} as url_key from pages",
    "page_openings": f"""select page_id, {opening('w', 300)} as snippet, md5(nullif(w, '')) as whole
      from (select page_id, {page_text('html')} as w from pages)""",
    "event_snippets": with_tables(
        "select event_date, country, p.url_key, snippet, count(*) as n "
        "from paged p left join page_snippets s on p.url_key = s.url_key group by all",
        "paged",
        "page_snippets",
    ),
    "country_snippets": with_tables(
        """select event_date, country, string_agg(snippet, ' | ' order by r) as snippets from (
          select *, row_number() over (partition by event_date, country order by n desc, snippet) as r from (
            select event_date, country, snippet, count(*) as n
            from paged join page_snippets using (url_key) group by all))
        where r <= 3 group by all""",
        "paged",
        "page_snippets",
    ),
    "gkg_fields_uncapped": with_tables(
        f"select date, DocumentIdentifier, "
        f"array_to_string({entities('V2Themes')}, '|') as themes, "
        f"array_to_string({entities('V2Persons')}, '|') as persons, "
        f"array_to_string({entities('V2Organizations')}, '|') as orgs from gkg_feed",
        "gkg_feed",
    ),
    "country_topics": with_tables(
        f"select event_date, country, headline_count, {_TONES}, {_TOPIC_ARRAYS}, topic_doc from topics",
        "topics",
    ),
    "country_topics_from_states": with_tables(
        f"select event_date, country, headline_count, {_TONES}, {_TOPIC_ARRAYS}, topic_doc from topics",
        "topics",
    ),
    "top_countries_latest": with_tables(
        f"select event_date, country, headline_count, {_TONES}, {_TOPIC_ARRAYS}, topic_doc from top",
        "top",
    ),
    "today_for_analogs": with_tables("select event_date, country from top", "top"),
    "news_embeddings": with_tables(
        "select event_date, country, topic_doc, array_to_string(list_transform(embedding, "
        "lambda x: cast(round(cast(x as double) * 1000000) as bigint)), ',') as embedding, id "
        "from embedded",
        "embedded",
    ),
    "news_embeddings_batched": with_tables(
        f"""select event_date, country, topic_doc, id, {_refused('topic_doc')} as error,
          case when topic_doc is not null and {_refused('topic_doc')} is null then array_to_string(list_transform(v, lambda x:
            cast(round(cast(cast(x / sqrt(list_dot_product(v, v)) as float) as double) * 1000000) as bigint)), ',')
          end as embedding
        from (select *, [length(d), length(d) - length(replace(d, 'e', '')), length(d) - length(replace(d, '7', '')),
            1]::double[] as v from (select *, coalesce(topic_doc, '') as d from embedded))""",
        "embedded",
    ),
    "top_entities": with_tables(f"select {_ENTITY_PAIRS} from entities", "entities"),
    "top_entities_from_feeds": with_tables(f"select {_ENTITY_PAIRS} from entities", "entities"),
    "top_entities_unweighted": with_tables(
        f"select {_ENTITY_PAIRS} from plain_entities", "plain_entities"
    ),
    "vector_topk": f"""
      with places as (
        select label, vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos
        from embeddings),
      means as (
        select label, list(x order by pos) as embedding from (
          select label, pos, avg(cast(x as double)) as x from places group by label, pos)
        group by label)
      select label, vec_id, round(distance, 6) as distance, cast(r as integer) as rank from (
        select *, row_number() over (partition by label order by distance, vec_id) as r from (
          select m.label, e.vec_id, {distance('m.embedding', 'e.embedding')} as distance
          from means m, embeddings e))
      where r <= 10""",
    "vector_topk_all": f"""
      select anchor_id, vec_id, round(distance, 6) as distance, cast(r as integer) as rank from (
        select *, row_number() over (partition by anchor_id order by distance, vec_id) as r from (
          select a.vec_id as anchor_id, e.vec_id, {distance('a.embedding', 'e.embedding')} as distance
          from embeddings a, embeddings e))
      where r <= 10""",
    "vector_topk_approx": """
      select label, count(*) as anchors, true as recall_reached, true as part_ranked
      from embeddings where vec_id % 100 = 0 group by label""",
    "similar_to_day_post": _similar_to_day(pre=False),
    "similar_to_day_pre": _similar_to_day(pre=True),
    "similar_to_text": with_tables(
        f"""
        select event_date, country, topic_doc, round(distance, 6) as distance, id from (
          select *, row_number() over (order by distance, id) as r from (
            select b.*, {distance('a.v', 'b.embedding')} as distance
            from embedded b, (select {vector('q')} as v from (select {lit(QUERY_TEXT)} as q)) a
            where b.embedding is not null))
        where r <= 10""",
        "embedded",
    ),
    "analogs_flat": with_tables(
        "select * replace (round(distance, 6) as distance) from dated_flat", "dated_flat"
    ),
    "analogs_flat_pre": with_tables(
        "select * replace (round(distance, 6) as distance) from dated_flat_pre", "dated_flat_pre"
    ),
    "analogs_nested": with_tables(
        "select event_date, country, cast(n_analogs as integer) as n_analogs, analogs_txt, "
        "array_to_string(list_transform(distances, "
        "lambda x: cast(round(x * 1000000) as bigint)), ',') as distances "
        "from dated_nested",
        "dated_nested",
    ),
    "topic_analogs": with_tables(
        "select event_date, country, past_date, snippet, round(distance, 6) as distance "
        "from topic_flat",
        "topic_flat",
    ),
    "theme_clean": with_tables(
        f"select date, DocumentIdentifier, {themes_nice('V2Themes')} as themes_nice from gkg_feed",
        "gkg_feed",
    ),
    "people_clean": with_tables(
        f"select date, DocumentIdentifier, {people_nice('V2Persons')} as people_nice from gkg_feed",
        "gkg_feed",
    ),
    "capitalised": f"select page_id, {capitalise('url')} as url_capitalised, "
    f"{capitalise('html')} as html_capitalised from pages",
    "url_free_text": "select page_id, "
    + snippet("('seen at ' || url || ' by page ' || page_id)", 400)
    + " as snippet, "
    + replace_all("html", fixed.URL_PATTERN, "")
    + " as url_free from pages",
    "number_text": f"select event_id, {number('value - 100')} as value_text from events",
    "briefing_context": with_tables("select * from context", "context"),
    "briefing_prompt": with_tables(
        f"select event_date, country, {_BRIEFING_PROMPT} as prompt from context", "context"
    ),
    "response_normalise": f"""
      select conv_id, turn, coalesce(case when turn % 6 = 0 then text end, {_json('raw')}) as reply
      from (select *, {_RAW_REPLY} as raw from conversations)""",
    "score_parse": f"select event_id, reply, {score('reply')} as score from ({_REPLY})",
    "score_parse_lenient": "select event_id, reply, "
    f"{score('reply', fixed.LENIENT_SCORE_PATTERN)} as score from ({_REPLY})",
    "mood_blend": f"select event_id, {blend(score('reply'), '((50 - value) / 10)')} as mood_score "
    f"from ({_REPLY})",
    "daily_briefings": with_tables("select * from briefings", "briefings"),
    "daily_briefings_batched": with_tables(
        f"""select event_date, country, 'briefing: ' || {_refused('prompt')} as error,
          case when {_refused('prompt')} is null then '300 ' || md5(prompt) end as briefing_text
        from (select *, {_BRIEFING_PROMPT} as prompt from context)""",
        "context",
    ),
    "sentiment_prompt": with_tables(
        "select event_date, country, "
        + fill(fixed.SENTIMENT_PROMPT, briefing="briefing_text")
        + " as prompt from briefings",
        "briefings",
    ),
    "summary_prompt": with_tables(
        "select event_date, country, "
        + fill(fixed.SUMMARY_PROMPT, country="country")
        + " as prompt from briefings",
        "briefings",
    ),
    "daily_mood": with_tables(
        "select event_date, country, mood_score, briefing_text, summary_ref, "
        f"{pairs('top_themes', 'theme')} from mood",
        "mood",
    ),
    "mood_map_feed": with_tables("select * from feed", "feed"),
    "mood_trend": with_tables(
        """select s.event_date, s.country, round(any_value(s.mood_score), 10) as mood_score,
          round(avg(t.mood_score), 10) as rolling, count(t.mood_score) as days_seen
        from day_scores s join day_scores t on s.country = t.country
          and t.event_date between s.event_date - 6 and s.event_date
        group by s.event_date, s.country""",
        "day_scores",
    ),
    "mood_shift": with_tables(
        """select event_date, country, round(x, 10) as mood_score, round(x - y, 10) as change,
          round(z, 8) as z_score, coalesce(abs(z) >= 2, false) as alert
        from (select *, case when sd > 1e-9 then (x - m) / sd end as z from (
          select s.event_date, s.country, any_value(s.mood_score) as x, avg(t.mood_score) as m,
            stddev_samp(t.mood_score) as sd,
            max(t.mood_score) filter (where t.event_date = s.event_date - 1) as y
          from day_scores s left join day_scores t on s.country = t.country
            and t.event_date between s.event_date - 7 and s.event_date - 1
          group by s.event_date, s.country))""",
        "day_scores",
    ),
    "region_rollup": with_tables(
        """select event_date, level, region, country,
          cast(sum(headline_count) as bigint) as headline_count,
          round(sum(mood_score * headline_count)
            / sum(headline_count) filter (where mood_score is not null), 10) as mood
        from (
          select event_date, 'country' as level, region, country, headline_count, mood_score from placed
          union all select event_date, 'region', region, null, headline_count, mood_score from placed
          union all select event_date, 'world', null, null, headline_count, mood_score from placed)
        group by event_date, level, region, country""",
        "placed",
    ),
    "full_run": with_tables("select * from feed", "feed"),
    "full_run_two_days": with_tables("select * from feed", "feed"),
    "full_run_resumed": with_tables("select * from feed", "feed"),
    "retention": with_tables(
        f"select {_EVENT}, round(tone, 10) as tone from raw "
        "where event_date >= date '2024-01-30' - 20",
        "raw",
    ),
    "stored_topics": with_tables(
        f"select event_date, country, headline_count, {_TONES}, {_TOPIC_ARRAYS}, topic_doc from topics",
        "topics",
    ),
    "expired_partitions": with_tables(
        "select event_date, count(*) as events from raw "
        "where event_date >= date '2024-01-30' - 20 group by event_date",
        "raw",
    ),
    "exported_topics": with_tables(
        f"select event_date, country, headline_count, {_TONES}, {_TOPIC_ARRAYS}, topic_doc from topics",
        "topics",
    ),
    "delimited_feed": with_tables(f"select {_EVENT}, round(tone, 10) as tone from raw", "raw"),
    "country_day_stream": with_tables(
        f"select event_date, country, headline_count, {_TONES} from ("
        "select event_date, country, count(*) as headline_count, avg(tone) as avg_tone, "
        "min(tone) as min_tone, max(tone) as max_tone from raw where country is not null "
        "group by event_date, country)",
        "raw",
    ),
    "country_day_stream_two_batches": with_tables(
        """
        select kind, event_date, country, count(*) as headline_count, round(avg(tone), 8) as avg_tone,
          round(min(tone), 10) as min_tone, round(max(tone), 10) as max_tone
        from (
          select case n when 3 then 'future' when 4 then 'late' else 'kept' end as kind, country, tone,
            cast(make_date(year(event_date) + case n when 3 then 100 when 4 then -100 else 0 end,
              month(event_date), day(event_date)) as date) as event_date
          from (select *, coalesce(cast(split_part(url, '/', 5) as bigint) % 50, 0) as n from raw))
        where kind <> 'kept' or country is not null
        group by kind, event_date, country""",
        "raw",
    ),
    "delimited_feed_dirty": with_tables(
        """
        select event_date, country, '' as reason, count(*) as n, round(avg(tone), 8) as avg_tone
        from marked where k not in (3, 4, 5) group by event_date, country
        union all
        select null, null, reason, count(*), null from (
          select case k when 3 then 'impossible day' when 4 then 'bad AvgTone' else 'bad line' end as reason
          from marked where k in (3, 4, 5)) group by reason""",
        "marked",
    ),
    "graph_feed_dirty": with_tables(
        """
        select date, '' as reason, count(*) as n, cast(sum(length(nullif(V2Themes, ''))) as bigint) as theme_chars
        from (select *, (doc % 50) as k from (
          select *, cast(split_part(DocumentIdentifier, '/', 5) as bigint) as doc from gkg_feed))
        where k not in (3, 4, 5) group by date
        union all
        select null, reason, count(*), null from (
          select case k when 3 then 'impossible day' when 4 then 'bad date' else 'bad line' end as reason
          from (select cast(split_part(DocumentIdentifier, '/', 5) as bigint) % 50 as k from gkg_feed)
          where k in (3, 4, 5)) group by reason""",
        "gkg_feed",
    ),
}
for _name in ("similar_to_day_post", "similar_to_day_pre", "similar_to_text"):
    ORACLE[f"sql_{_name}"] = ORACLE[_name]
ORACLE["regions_dated"] = with_tables(
    """
    select event_date, region, cast(sum(n) as bigint) as n,
      cast(sum(case when known then n else 0 end) as bigint) as known
    from (
      select event_date, country, n, max_by(region, valid_from) as region, count(code) > 0 as known
      from (select event_date, country, count(*) as n from raw group by event_date, country)
      left join (
        select n_name as code, r_name as region, date '2024-01-05' as valid_from, true as first
        from nation join region on n_regionkey = r_regionkey
        union all
        select n_name, 'NEW ' || r_name, date '2024-01-15', false
        from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0)
      on code = country and (first or valid_from <= event_date)
      group by event_date, country, n)
    group by event_date, region""",
    "raw",
)
