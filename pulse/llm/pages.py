"""Main text of web pages by differencing with the page of the nearest URL.

A page is cut into text blocks (its lines), each with what the markup says about it:

* in an article: inside ``article``, ``main`` or a main role, outside of parts that are marked
  as something else; it is kept, also where another page says the same;
* marked as something else: menus, headers and footers of the page, sidebars, adverts, forms,
  by element or role, or hidden; it goes;
* open: neither. A class or id that names a part as something else (a whole token, not of
  html, body, article, main or headings; a number at its end does not count) only proposes that it
  goes: a named part inside an article is open, but adverts, reader comments, sidebars and notices
  of the site go; one outside goes if the page has an article, else it is open.

Differencing settles the open lines. Pages of a host are put in order of the URL's path; the
lines of a page are aligned with those of the pages before and after it by the longest common
subsequence, and shared lines go. Then the lines of an article, which is marked as the text,
are restored.

Neighbours are the nearest pages before and after whose lists of lines differ, so that repeated
rows and mirrored pages do not delete each other; pages with no lines are nobody's neighbour.
Ties of the path go by the whole URL, then by hashes of id and lines.

Hosts with more than ``MANY`` pages are cut into ranges of that order, so that no host stays in
one task, and each range is told the pages at the borders of the ranges around it: neighbours
are the same for every cut. Only the cuts and border pages reach the driver. Pages are sorted
by Spark, forwards and backwards, and compared as they stream by. Null or empty html gives an empty
text, a null url counts as host and path "". Extra columns pass through; columns named as a
result column are replaced.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import slices, stored, without

MANY = 1000
FEW_PAIRS = 8  # pairs of equal lines per line up to which pages are aligned by them
HOT_SHARE = 5000  # a host with more than one page in so many, and MANY, is cut

# Elements and names of the parts of a page.
DROPPED_ELEMENTS = frozenset(
    "head nav footer aside form button select dialog menu noscript template svg iframe object audio video canvas".split()
)
RAW_ELEMENTS = frozenset("script style textarea title xmp".split())
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_ELEMENTS = frozenset("article main".split())
UNNAMED_ELEMENTS = ARTICLE_ELEMENTS | frozenset("html body h1 h2 h3 h4 h5 h6".split())
BLOCK_ELEMENTS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notification popup modal overlay sidebar aside widget nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead topbar footer copyright comment comments commentlist respond replies disqus share sharing social related "
    "recommended newsletter subscribe subscription signup login search pagination pager skip".split()
)

# Names of parts that are no article even inside one: adverts, reader comments, notices of the site, sidebars.
FOREIGN_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup "
    "modal sidebar comment comments commentlist respond replies disqus newsletter".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NUMBER = re.compile(r"[-_]?\d+$")  # comment-17 names a comment
DROP, KEEP, OPEN, NAMED = 0, 1, 2, 3


def _marked(attributes: str) -> tuple[bool, frozenset | set, bool]:
    """Whether the attributes mark something else, the names of something else, whether they mark the article."""
    if not attributes.strip(" /"):
        return False, frozenset(), False
    found = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    roles = found.get("role", "").split()
    names = {_NUMBER.sub("", x) for x in (found.get("class", "") + " " + found.get("id", "")).split()}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return hidden or bool(DROPPED_ROLES & set(roles)), names & DROPPED_NAMES, "main" in roles


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with DROP, KEEP or OPEN."""
    if not html:
        return []
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # element, inside a dropped part, the article, a named part
    opened: dict[str, int] = defaultdict(int)  # elements of a name on the stack
    dropped = article = named = 0
    at, any_article = 0, False

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                inside = (OPEN if named else KEEP) if article else NAMED if named else OPEN
                lines.append((text, DROP if dropped else inside))

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            if name in BLOCK_ELEMENTS:
                flush()
            if opened[name]:  # a closing tag without an opening one closes nothing
                inner, before = None, (dropped, article, named)
                while inner != name:
                    inner, *state = stack.pop()
                    opened[inner] -= 1
                if tuple(state) != before:
                    flush()
                dropped, article, named = state
            continue
        if name in RAW_ELEMENTS:  # no markup inside
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in BLOCK_ELEMENTS:
            flush()
        if name in VOID_ELEMENTS or attributes.rstrip().endswith("/"):
            continue
        away, other, is_main = _marked(attributes)
        if is_main or (name in UNNAMED_ELEMENTS and not (article and name == "article")):
            other = frozenset()  # an article inside an article may be a comment on it
        if article and other & FOREIGN_NAMES:
            away = True
        if name in DROPPED_ELEMENTS or (name == "header" and not article):
            away = True
        starts = (name in ARTICLE_ELEMENTS or is_main) and not away and not dropped and not named
        if (away and not dropped) or (starts and not article) or (other and not named):
            flush()
        stack.append((name, dropped, article, named))
        opened[name] += 1
        dropped, article, named = dropped or int(away), article or int(starts), named or int(bool(other))
        any_article = any_article or starts
    flush()
    return [(t, (DROP if any_article else OPEN) if kind == NAMED else kind) for t, kind in lines]


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences of ``a`` with the beginnings of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(step)
    return row


def _by_matches(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of ``x`` in a longest common subsequence with ``y``, from the pairs of equal lines (Hunt-Szymanski)."""
    where = defaultdict(list)
    for j in range(len(y) - 1, -1, -1):
        where[int(y[j])].append(j)
    ends: list[int] = []  # of the subsequences of each length, the least end in y
    last: list[int] = []
    place: list[int] = []
    link: list[int] = []
    for i, line in enumerate(x.tolist()):
        for j in where[line]:
            k = bisect_left(ends, j)
            place.append(i)
            link.append(last[k - 1] if k else -1)
            ends[k : k + 1], last[k : k + 1] = [j], [len(place) - 1]
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(place[at])
        at = link[at]
    return out[::-1]


def common_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of ``a`` that a longest common subsequence with ``b`` keeps.

    Pages whose lines seldom repeat are aligned by their pairs of equal lines, in time that hardly exceeds the
    number of lines; others by Hirschberg, in the product of the numbers of lines.
    """
    lo, ends = 0, (len(a), len(b))
    while lo < min(ends) and a[lo] == b[lo]:
        lo += 1
    out, tail = list(range(lo)), 0
    while tail < min(ends) - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    last = list(range(len(a) - tail, len(a)))
    a, b = a[lo : len(a) - tail], b[lo : len(b) - tail]
    ia, ib = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))  # others align with nothing
    x, y = a[ia], b[ib]
    lines, often = np.unique(y, return_counts=True)
    if len(y) and often[np.searchsorted(lines, x)].sum() <= FEW_PAIRS * (len(x) + len(y)):
        return out + [lo + int(ia[f]) for f in _by_matches(x, y)] + last
    todo = [(0, len(x), 0, len(y))]
    found: list[int] = []
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        if j - i == 1:
            if (y[k:m] == x[i]).any():
                found.append(i)
            continue
        mid = (i + j) // 2
        both = _row(x[i:mid], y[k:m]) + _row(x[mid:j][::-1], y[k:m][::-1])[::-1]
        cut = k + int(both.argmax())
        todo += [(i, mid, k, cut), (mid, j, cut, m)]
    return out + sorted(lo + int(ia[f]) for f in found) + last


_PARSED = [("__texts", pa.list_(pa.string())), ("__kinds", pa.binary()), ("__hashes", pa.binary())]


_ORDER = ["__path", "__url", "__tie"]
_PART = ["__host", "__bucket"]


def _cuts(pages: DataFrame, most: int) -> dict[str, list[tuple]]:
    """Places in the order at which hosts of more than ``most`` pages are cut."""
    hosts = pages.groupBy("__host").agg(F.count("*").alias("n__host"))
    hot = hosts.filter(F.col("n__host") > most)  # fewer than HOT_SHARE
    n = hot.agg(F.sum("n__host")).first()[0]
    cuts = defaultdict(list)
    if n:
        keys = pages.join(F.broadcast(hot), "__host").select("__host", *_ORDER)
        ranges = keys.repartitionByRange(-(-n // most), "__host", *_ORDER).withColumn("__range", F.spark_partition_id())
        firsts = ranges.groupBy("__range").agg(F.min(F.struct("__host", *_ORDER)).alias("k")).select("k.*").collect()
        for host, *key in sorted(map(tuple, firsts)):
            cuts[host].append(tuple(key))
        for r in hot.select("__host").collect():
            cuts.setdefault(r[0], [])
    return dict(cuts)


def _borders(parsed: DataFrame) -> tuple[dict, dict]:
    """For each range of a cut host: the lines of the page before it and of the nearest one
    before that with other lines; the same for the pages after it."""
    key = F.struct(*_ORDER, F.xxhash64("__hashes"))
    parsed = parsed.filter("length(__hashes) > 0").select(*_PART, "__hashes", key.alias("k"))
    ends = parsed.groupBy(*_PART).agg(F.min_by("__hashes", "k").alias("first"), F.max_by("__hashes", "k").alias("last"))
    other = lambda c: F.when(F.col("__hashes") != F.col(c), F.col("k"))
    rows = parsed.join(F.broadcast(ends), _PART).groupBy(*_PART).agg(
        F.first("first"), F.min_by("__hashes", other("first")), F.first("last"), F.max_by("__hashes", other("last"))
    )
    rows = sorted([(r[0], r[1]), *r[2:]] for r in rows.collect())
    before, after = {}, {}
    for told, ordered, at in ((before, rows, 3), (after, rows[::-1], 1)):
        host, state = None, (None, None)
        for row in ordered:
            if row[0][0] != host:
                host, state = row[0][0], (None, None)
            told[row[0]] = state
            near, far = row[at], row[at + 1]
            if far is None:  # all pages of the range have the same lines
                far = state[1] if state[0] == near else state[0]
            state = near, far
    return before, after


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """The rows without ``html``, with ``text`` and ``n_chars``."""
    pages = without(pages, "text", "n_chars", "__host", "__bucket", *_ORDER, "n__host", "__gone")
    kept = [c for c in pages.columns if c != html_col]
    url = F.coalesce(url_col, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    pages = pages.withColumns({"__host": host, "__path": path, "__url": url, "__tie": F.xxhash64(id_col)})
    cuts = _cuts(pages, max(MANY, pages.count() // HOT_SHARE))
    carried = [*kept, "__host", *_ORDER]

    def bucket(host, *key):
        return bisect_right(cuts[host], key) if host in cuts else -1

    def parses(batches):
        for whole in batches:
            for batch in slices(whole, html_col):
                texts, kinds, hashes = [], [], []
                for html in batch.column(html_col).to_pylist():
                    lines = page_lines(html)
                    texts.append([t for t, kind in lines if kind])
                    kinds.append(bytes(kind for _, kind in lines))
                    hashes.append(b"".join(blake2b(t.encode(), digest_size=8).digest() for t, _ in lines))
                order = zip(*(batch.column(c).to_pylist() for c in ("__host", *_ORDER)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in carried]
                    + [pa.array([bucket(*x) for x in order], pa.int32())]
                    + [pa.array(x, k) for x, (_, k) in zip((texts, kinds, hashes), _PARSED, strict=True)],
                    names=[*carried, "__bucket"] + [n for n, _ in _PARSED],
                )

    fields = {f.name: f for f in pages.schema.fields}
    kind = T.StructType(
        [fields[c] for c in carried]
        + [
            T.StructField("__bucket", T.IntegerType()),
            T.StructField("__texts", T.ArrayType(T.StringType())),
            T.StructField("__kinds", T.BinaryType()),
            T.StructField("__hashes", T.BinaryType()),
        ]
    )
    parse = lambda df: df.select(*[f"`{c}`" for c in carried], f"`{html_col}`").mapInArrow(parses, kind)
    parsed = parse(pages)
    before = after = {}
    if cuts:  # parsed twice, so that no text is stored
        cut = parse(pages.filter(F.col("__host").isin(list(cuts)))).select(*_PART, *_ORDER, "__hashes")
        before, after = _borders(stored(cut, "borders"))
    told = parsed.sparkSession.sparkContext.broadcast((before, after))

    def shared(batches, way):
        """Batches with, for each page, which lines it shares with its neighbour that way."""
        where, state, gone = None, (None, None), None
        for batch in batches:
            marks = []
            for host, part, kinds, hashes in zip(
                *(batch.column(c).to_pylist() for c in (*_PART, "__kinds", "__hashes")), strict=True
            ):
                if (host, part) != where:
                    where = host, part
                    state, gone = told.value[way].get(where, (None, None)), None
                if hashes and hashes != state[0]:
                    state, gone = (hashes, state[0]), None
                if OPEN not in kinds or state[1] is None:  # nothing to settle
                    marks.append(bytes(len(kinds)))
                    continue
                if gone is None:
                    mark = np.zeros(len(kinds), np.uint8)
                    mark[common_lines(*(np.frombuffer(x, np.uint64) for x in (hashes, state[1])))] = 1
                    gone = mark.tobytes()
                marks.append(gone)
            yield batch, marks

    def forwards(batches):
        for batch, marks in shared(batches, 0):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], names=[*batch.schema.names, "__gone"])

    def backwards(batches):
        for batch, marks in shared(batches, 1):
            done = []
            for texts, kinds, *both in zip(*(batch.column(c).to_pylist() for c in ("__texts", "__kinds", "__gone")), marks, strict=True):
                kinds, (one, two) = np.frombuffer(kinds, np.uint8), (np.frombuffer(x, np.uint8) for x in both)
                keep = ~((one | two).astype(bool) & (kinds == OPEN))[kinds > 0]
                done.append(" ".join(t for t, k in zip(texts, keep, strict=True) if k))
            yield _finished(batch, kept, done)

    order = [*_PART, *_ORDER, F.xxhash64("__hashes")]
    ordered = parsed.repartition(*_PART).sortWithinPartitions(*order)
    ordered = ordered.mapInArrow(forwards, T.StructType([*parsed.schema.fields, T.StructField("__gone", T.BinaryType())]))
    ordered = ordered.sortWithinPartitions(*order, ascending=False)
    schema = T.StructType(
        [fields[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )
    return ordered.mapInArrow(backwards, schema)


def _finished(batch: pa.RecordBatch, kept: list[str], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
        names=[*kept, "text", "n_chars"],
    )


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_pages(pages)
