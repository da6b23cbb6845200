"""Each operator against brute force or a defined result, and on awkward tables."""

import collections
import hashlib
import html
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.llm import (
    contamination,
    languages,
    maxent,
    mixing,
    neardup,
    pages,
    repeats,
    toolcalls,
    topk,
    toxicity,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, SCORE string, n_hit int, Class_id string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, f"Start here {PASSAGE} and end", "en", "a", 5, "x", 1, "y"),
        (2, f"Other words {PASSAGE} and more", "en", None, None, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "fr", "a", 0, "x", 1, "y"),
        (5, "é", None, "b", 1, "x", 1, "y"),
        (5, "é", None, "b", 1, "x", 1, "y"),
        (6, "123 %% 456", "de", "b", 3, "x", 1, "y"),
        (None, f"No id {PASSAGE}", "en", "b", 3, "x", 1, "y"),
        (None, None, None, None, None, None, None, None),
        (7, "word " * 60_000, "en", "b", 3, "x", 1, "y"),
        (8, "same text of five words or so", "en", "b", 3, "x", 1, "y"),
        (9, "Same text, of five words or so!", "en", "b", 3, "x", 1, "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect() if r[0] is not None}


def names_once(df):
    low = [c.lower() for c in df.columns]
    assert len(low) == len(set(low))


def test_languages_on_held_out_rows(documents):
    model = languages.learn_languages(documents)
    found = languages.identify_languages(documents, model)
    rows = found.filter("crc32(cast(doc_id as string)) % 4 = 2 and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 50, (3, languages.BUCKETS)) * (rng.random((3, languages.BUCKETS)) < 0.1)
    model = languages.MixtureModel(["a", "b", "c"], counts)
    draw = lambda k, n: rng.choice(languages.BUCKETS, n, p=counts[k] / counts[k].sum())
    mix, _ = model.infer(np.concatenate([draw(0, 3000), draw(1, 1000)]))
    assert [n for n, _ in mix] == ["a", "b"] and abs(mix[0][1] - 0.75) < 0.05
    assert [n for n, _ in model.infer(draw(2, 500))[0]] == ["c"]


def test_signs_and_null_ids(spark, monkeypatch):
    """Fractions and numerals are no letters; a null id is not held out."""
    model = languages.MixtureModel(["a"], np.ones((1, languages.BUCKETS)))
    texts = ["½ ² ①", "Ⅷ", "½ a", "一", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in languages.identify_languages(docs, model).collect()}
    assert found == {0: "und", 1: "und", 2: "a", 3: "a", 4: "und", 5: "und"}
    rows = spark.createDataFrame([(None, "word"), (1, "word")], "doc_id long, text string")
    for module, learn, query in ((languages, "learn_languages", "op1_language_id"), (toxicity, "learn_lexicon", "op10_toxicity")):
        fitted = model if module is languages else toxicity.Lexicon({}, (), (0.0, 0.0, 0.0))
        monkeypatch.setattr(module, learn, lambda *a, fitted=fitted, **k: fitted)

        class Session:
            class read:  # noqa: N801
                parquet = staticmethod(lambda path: rows)

        assert {r.held_out for r in getattr(module, query)(Session, "").collect()} <= {True, False}


def test_domain_sample_takes_an_id_once(spark):
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("some text").alias("text"))
    labels = spark.createDataFrame([(1, 1, 0)] * 50, "doc_id long, quality int, toxic int")
    sent = []
    whole, mixing._fit = mixing._fit, lambda features, y: sent.append(len(features)) or mixing.DomainModel()
    try:
        mixing.learn_domains(docs, labels)
    finally:
        mixing._fit = whole
    assert sent == [1]


def test_languages_on_awkward_rows(awkward):
    model = languages.learn_languages(awkward)
    found = languages.identify_languages(awkward, model)
    names_once(found)
    rows = by_id(found, "lang_pred", "score")
    assert found.count() == awkward.count()
    assert rows[3] == rows[4] == rows[6] == ("und", 0.0)
    assert languages.identify_languages(awkward.limit(0), model).count() == 0
    nothing = languages.learn_languages(awkward.limit(0))
    assert {r.lang_pred for r in languages.identify_languages(awkward, nothing).collect()} == {"und"}


def test_page_lines():
    text = (
        '<head><title>T</title></head><nav>A<li>B</nav><div class="cookie-notice">We <b>use</b></div><main>'
        "<h1>Hi &amp; you</h1><p>one<br>two t<b>hre</b>e&nbsp; x<script>var t='</p>'</script><div id=comments>bad</div>"
        "<form>f</form></main><aside>s</aside><footer>c"
    )
    assert [t for t, kind in pages.page_lines(text) if kind == pages.KEEP] == ["Hi & you", "one", "two three x"]
    assert pages.page_lines(None) == pages.page_lines("") == []


def test_common_lines_are_longest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 20)) for _ in range(2))
        kept = pages.common_lines(a, b)
        assert len(kept) == pages._row(a, b)[-1] and kept == sorted(set(kept))
        rest = iter(b.tolist())
        assert all(x in rest for x in a[kept].tolist())


def test_page_differencing(spark):
    page = lambda own: f"<div>Menu</div><div>All rights</div><p>{own}</p><div>Bye</div>"
    rows = [(k, f"http://h.example/a/{k}", page(f"own {k}"), "t") for k in range(4)]
    rows += [(9, "http://alone.example/", page("own 9"), "t"), (10, None, None, None), (11, "http://x", "", "t")]
    found = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string"))
    names_once(found)
    got = {r.page_id: (r.text, r.n_chars) for r in found.collect()}
    assert [got[k] for k in range(4)] == [(f"own {k}", 5) for k in range(4)]
    assert got[9][0] == "Menu All rights own 9 Bye" and got[10] == got[11] == ("", 0)
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_differencing_settles_lines_beside_an_article(spark):
    page = lambda own: f"<div>Menu</div><article><p>Menu</p><p>own</p></article><p>{own}</p><div>Bye</div>"
    rows = [(k, f"http://h.example/a/{k}", page(f"more {k}")) for k in range(3)]
    found = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()} == {k: f"Menu own more {k}" for k in range(3)}


def test_names_only_propose():
    kept = lambda x, kind: [t for t, k in pages.page_lines(x) if k == kind]
    for body in ("<body class='has-sidebar search'><article class='post comments comments-open'>", "<body><main class='page search'>"):
        found = body + "<h1 class='header entry-header'>Title</h1><p class='notice-period'>real</p><p class=notice>maybe</p>"
        assert kept(found, pages.KEEP) == ["Title", "real"] and kept(found, pages.OPEN) == ["maybe"]
    assert kept("<div class='search'><p>one</p></div>two", pages.OPEN) == ["one", "two"]
    assert kept("<div class=related><article>teaser</article></div><article>own</article>", pages.KEEP) == ["own"]
    assert kept("<div class=ad>buy</div><article>own</article>", pages.DROP) == ["buy"]


def test_comments_and_adverts_inside_an_article_go():
    found = pages.page_lines(
        "<article><p>text</p><div class=ad-3>buy</div><section class='comments'><p>Nice!</p><div class=ad>more</div></section>"
        "<div id='comment-1'>hey</div><article class='comment even'>you</article><p>end</p><aside>s</aside></article>after"
    )
    assert [t for t, kind in found if kind == pages.KEEP] == ["text", "end"]
    assert [t for t, kind in found if kind == pages.OPEN] == ["after"]


def test_long_and_broken_pages():
    broken = "<article>" + "<b>x</i>" * 60_000 + "</article>y" + "</p></b>" * 60_000 + "<div>" * 60_000 + "z"
    started = time.process_time()
    kinds = {t: kind for t, kind in pages.page_lines(broken)}
    assert kinds == {"x" * 60_000: pages.KEEP, "y": pages.OPEN, "z": pages.OPEN}
    a = np.arange(200_000)
    b = np.concatenate([a[1::2], a[::2]])  # no common end, every line in both
    assert len(pages.common_lines(a, b)) == 100_000
    assert time.process_time() - started < 20


@pytest.mark.parametrize("few", [0, 8])
def test_both_ways_of_aligning_are_longest(monkeypatch, few):
    monkeypatch.setattr(pages, "FEW_PAIRS", few)
    rng = np.random.default_rng(few)
    for _ in range(200):
        a, b = (rng.integers(0, 9, rng.integers(0, 40)) for _ in range(2))
        kept = pages.common_lines(a, b)
        assert len(kept) == pages._row(a, b)[-1] and kept == sorted(set(kept))
        rest = iter(b.tolist())
        assert all(x in rest for x in a[kept].tolist())


@pytest.mark.parametrize("many", [1, 3, 1000])
def test_neighbours_at_every_size(spark, monkeypatch, many):
    monkeypatch.setattr(pages, "MANY", many)
    page = lambda section, own: f"<div>Menu {section}</div><p>{own}</p><div>Bye</div>"
    rows = [(k, f"http://h.example/{k // 4:02}/{k}", page(k // 4, f"own {k}")) for k in range(40)]
    rows += [rows[5]] * 9 + [(100 + k, f"http://h.example/02/8?page={k}", page(2, "own 8")) for k in range(7)]
    rows += [(200, "http://h.example/02/8", ""), (300, "http://copies.example/a", page(0, "x"))] + [(300, "http://copies.example/a", page(0, "x"))] * 5
    found = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    want = {i: re.search("own [0-9]+", h)[0] if "own" in h else "" for i, _, h in rows} | {300: "Menu 0 x Bye"}
    assert {(r.page_id, r.text) for r in found} == set(want.items())


def test_marked_articles_are_whole(spark):
    def plain(text):
        inside = re.search(r"<article>(.*?)</article>", text or "", re.S)
        blocks = re.sub(r"</?(p|h1|br|div|li|ul)\b[^>]*>", " ", inside[1]) if inside else ""
        return " ".join(html.unescape(re.sub(r"<[^>]+>", "", blocks)).split())

    raw = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in pages.op2_html_extraction(spark, SF).collect()} == raw


def removed(rows, span=repeats.SPAN):
    seen, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        windows = [data[k : k + span] for k in range(len(data) - span + 1)]
        mark = bytearray(len(data))
        for k, w in enumerate(windows):
            if seen.get(w, i) < i:
                mark[k : k + span] = b"\1" * span
        for w in windows:
            seen[w] = min(i, seen.get(w, i))
        spans = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        out[i] = (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("wide", [1, 256])
def test_repeats_by_brute_force(documents, monkeypatch, wide):
    monkeypatch.setattr(repeats, "WIDE", wide)
    docs = documents.select("doc_id", "text")
    found = repeats.repeated_bytes(docs, batch_bytes=60_000)
    got = by_id(found, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed([tuple(r) for r in docs.collect()])


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(100):
        text = rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint8)
        order, _ = repeats.suffix_array(text)
        raw = text.tobytes()
        assert list(order) == sorted(range(len(raw)), key=lambda k: raw[k:])
        shared = repeats.common_prefixes(text, order, lane=7)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == same


def test_last_window_of_a_block_keeps_its_class(monkeypatch):
    def packed(texts):
        matrix = np.zeros((len(texts), repeats._WIDTH + 1), np.uint8)
        for row, text in zip(matrix, texts, strict=True):
            row[: len(text)], row[-1] = np.frombuffer(text, np.uint8), len(text)
        return matrix

    last = b"y" + b"x" * (repeats.SPAN - 2) + b"z"  # the suffix "z" sorts after every window
    texts, ids = [b"a" + last, b"b" + last, b"c" * 60, b"d" + last], np.array([5, 3, 4, 1])
    _, _, _, cls, keys, least = repeats._block_classes(packed(texts), ids)
    assert len(set(keys.tolist())) == len(keys) == cls[-1] + 1 and least[-1] == 1
    rng = np.random.default_rng(0)
    for per_block in (2, 4, 100):
        monkeypatch.setattr(repeats, "BLOCK_BYTES", per_block * repeats._WIDTH)
        pool = [bytes(rng.integers(97, 123, repeats.SPAN).astype(np.uint8)) for _ in range(4)]
        more = [bytes([97 + k]) + pool[k % 4] + bytes([122 - k])[: k % 2] for k in range(20)]
        for rows in (texts, more):
            own = rng.permutation(len(rows)).astype(np.int64)
            want = {}
            for i, t in zip(own.tolist(), rows, strict=True):
                for k in range(len(t) - repeats.SPAN + 1):
                    w = t[k : k + repeats.SPAN]
                    want[w] = min(i, want.get(w, i))
            got = repeats._settle(packed(rows), own)
            for r, t in enumerate(rows):
                assert all(got[r, k] == want[t[k : k + repeats.SPAN]] for k in range(len(t) - repeats.SPAN + 1))


def test_repeats_on_awkward_rows(awkward):
    found = repeats.repeated_bytes(awkward)
    names_once(found)
    got = by_id(found, "n_bytes", "n_removed")
    assert found.count() == awkward.count() and got[3] == got[4] == (0, 0) and got[7][1] == 0
    assert got[1][1] == 0 and got[2][1] >= len(PASSAGE)
    assert found.filter("doc_id is null and n_removed > 0").count() == 0
    assert repeats.repeated_bytes(awkward.limit(0)).count() == 0


def bag(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def classes(rows):
    bags = {i: bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in bags if bags[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if not bags[a].keys().isdisjoint(bags[b]):
                both = (bags[a] & bags[b]).total()
                if both >= neardup.SIMILARITY * (bags[a].total() + bags[b].total() - both):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in bags}


def test_near_duplicates_by_brute_force(documents):
    docs = documents.select("doc_id", "text")
    got = {i: c for i, (c,) in by_id(neardup.with_classes(docs), "class_id").items()}
    assert got == classes([tuple(r) for r in docs.collect()])


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = neardup.mixed(np.arange(1, 400, dtype=np.uint64))
    a = rng.integers(0, 6, len(h))
    b = np.clip(a + rng.integers(-1, 2, len(h)), 0, 9)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    seen = []
    for k in range(30):
        own = neardup.mixed(h + np.uint64(k * 1000))
        x, y = (neardup.bag_signatures(own[w > 0], np.zeros((w > 0).sum(), int), w[w > 0], 1) for w in (a, b))
        seen.append((x == y).mean())
    assert abs(np.mean(seen) - exact) < 0.025


def test_near_duplicates_on_awkward_rows(awkward):
    found = neardup.with_classes(awkward)
    names_once(found)
    got = by_id(found, "class_id", "n_links")
    assert found.count() == awkward.count()
    assert got[9] == (8, 0) and got[3] == (3, 0) and got[4] == (4, 0) and got[5] == (5, 0)
    assert found.filter("doc_id is null and class_id is not null").count() == 0
    assert neardup.with_classes(awkward.limit(0)).count() == 0


def test_merged_labels_equal_those_of_all_links(spark):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, p)) for p in rng.integers(0, 120, (90, 2)) if p[0] != p[1]]
    frame = [spark.createDataFrame(x, "a long, b long") for x in (links[:60], links[60:], links)]
    got, wanted = neardup.merged(neardup.components(frame[0]), frame[1]), neardup.components(frame[2])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    same = neardup.merged(wanted, frame[1].limit(0))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, wanted.collect()))


def test_long_texts_leave_no_long_tables_of_powers():
    from pulse.llm import common

    data = np.random.default_rng(0).integers(0, 256, (1 << 22) + 9, np.uint8)
    data[-9:] = data[:9]
    hashes = common.SpanHashes(data).spans(np.array([0, len(data) - 9]), np.array([9, len(data)]))
    assert hashes[0] == hashes[1]
    assert max(len(x) for x in common._powers.values()) <= 1 << 22


def test_near_duplicates_write_few_files(spark, documents, monkeypatch):
    """Tables of a few numbers have a file per core, not one per shuffle partition."""
    real, files = neardup.stored, collections.defaultdict(int)

    def counted(df, label):
        out = real(df, label)
        files[label] = max(files[label], len(out.inputFiles()))
        return out

    monkeypatch.setattr(neardup, "stored", counted)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = documents.select("doc_id", "text")
        got = {i: c for i, (c,) in by_id(neardup.with_classes(docs), "class_id").items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == classes([tuple(r) for r in docs.collect()])
    cores = spark.sparkContext.defaultParallelism
    assert all(files[x] <= cores for x in ("components", "members", "own", "apart", "rarity", "prefix", "named")), files


def test_mixing_reaches_targets(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = mixing.mix(documents, labels).collect()
    tokens = sum(r.n_tokens for r in rows)
    for k, d in enumerate(mixing.DOMAINS):
        share = sum(r.rate * r.n_tokens * r.posterior[k] for r in rows) / tokens
        assert abs(share - mixing.TARGETS[d]) < 0.01
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)


def test_mixing_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")
    found = mixing.mix(awkward, labels)
    names_once(found)
    assert found.count() == awkward.count()
    assert by_id(found, "n_tokens")[3] == (0,)
    assert mixing.mix(awkward.limit(0), labels).count() == 0
    assert {r.rate for r in mixing.mix(awkward, labels.limit(0), {d: 1 for d in mixing.DOMAINS}).collect()} == {1.0}


def test_search_block_is_exact():
    rng = np.random.default_rng(0)
    for t in range(24):
        n, d = int(rng.integers(1, 3000)), int(rng.integers(1, 20))
        base = rng.integers(-50, 50, (n, d))
        if t % 3 == 0:
            base = (base * rng.random((n, 1)) ** 4).astype(int)
        if t % 4 == 0:
            base = rng.integers(-900, 900, (5, d))[rng.integers(0, 5, n)] + base // 8
        ids = rng.permutation(n)
        row, found, score = topk.search_block(ids, base, ids[:20], base[:20])
        for j in range(min(n, 20)):
            dots = base @ base[j]
            best = sorted((-int(dots[x]), int(ids[x])) for x in range(n) if ids[x] != ids[j])[: topk.K]
            assert best == sorted((-int(score[x]), int(found[x])) for x in np.flatnonzero(row == j))


def test_search_block_keeps_ids_once():
    rng = np.random.default_rng(1)
    for n in (60, 3000):
        base, ids = rng.integers(-50, 50, (n, 4)), rng.integers(0, 40, n)
        base[ids == 7] = 60 + np.arange((ids == 7).sum())[:, None] % 20
        row, found, score = topk.search_block(ids, base, ids[:10], base[:10])
        for j in range(10):
            best = {}
            for i, dot in zip(ids.tolist(), (base @ base[j]).tolist(), strict=True):
                if i != ids[j]:
                    best[i] = max(dot, best.get(i, dot))
            want = sorted((-s, i) for i, s in best.items())[: topk.K]
            assert want == sorted((-int(score[x]), int(found[x])) for x in np.flatnonzero(row == j))


def test_search_with_a_hot_id(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [3.0, 1.0])] * 40 + [(1, [4.0, k / 8]) for k in range(25)]
    rows += [(k, [1.0 / k, 1.0]) for k in range(2, 16)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in topk.top_products(base, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(k, k) for k in range(1, 11)]


def test_search_leaves_unsound_vectors_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, None),
            (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (8, [0.0, 0.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_products(base, F.col("vec_id") % 100 == 0).collect()))
    one, half = 1024 * 1024, 1024 * 512
    assert got == [(0, 1, 1, one), (0, 2, 100, half), (0, 3, 8, 0), (100, 1, 0, half), (100, 2, 1, half), (100, 3, 8, 0)]
    assert topk.top_products(base.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_phrases_on_awkward_rows(spark, awkward):
    items = [(1, PASSAGE.upper()), (10, "five six"), (2, None), (None, PASSAGE), (3, "--"), (2, "Same TEXT"), (10, "five six")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.phrase_matches(awkward, benchmark)
    names_once(found)
    got = by_id(found, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1] == (18, 14, 2, sha("1,10"), True) and got[8] == (7, 2, 1, sha("2"), True)
    assert got[3] == got[4] == (0, 0, 0, sha(""), False) and got[7] == (60_000, 0, 0, sha(""), False)
    assert found.count() == awkward.count()
    assert contamination.phrase_matches(awkward.limit(0), benchmark).count() == 0
    assert contamination.phrase_matches(awkward, benchmark.limit(0)).filter("contaminated").count() == 0
    near = contamination.proximity_matches(awkward, benchmark, within=3)
    assert near.count() > 0


def test_phrases_run_without_python(spark):
    plan = contamination.op7_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tool_calls(spark):
    call = lambda id, needs=(), name="answer", arguments='{"question":"é","turn":1}': (
        f'{{"id":"{id}","name":"{name}","arguments":{arguments},"needs":[{",".join(chr(34) + n + chr(34) for n in needs)}]}}'
    )
    said = lambda *calls: f'{{"tool_calls":[{",".join(calls)}]}}'
    got = lambda id, x: f'{{"tool_call_id":"{id}","content":"{x}"}}'
    rows = [
        (1, 1, "assistant", said(call("a"), call("b", ["a"]), call("c", ["b", "a"]))),
        (1, 2, "tool", got("a", "ra")), (1, 3, "tool", got("a", "later")), (1, 4, "tool", got("x", "lost")),
        (1, 5, "assistant", said(call("d", ["e"]), call("e", ["d"]), call("f", ["zz"]), call("g", name="no"))),
        (1, 6, "assistant", said(call("h", arguments='{"turn":"1","more":2}'))),
        (1, 6, "assistant", said(call("h", arguments='{"turn":"1","more":2}'))),
        (2, 1, "assistant", "plain"), (2, 2, None, None), (None, 1, "assistant", said(call("n"))), (2, None, "tool", got("a", "r")),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.call_id: r for r in toolcalls.link_tool_calls(messages).collect()}
    assert {k: (r.status, r.level) for k, r in found.items()} == {
        "a": ("ok", 0), "b": ("open", 1), "c": ("open", 2), "d": ("cycle", -1), "e": ("cycle", -1),
        "f": ("invalid", 0), "g": ("invalid", 0), "h": ("invalid", 0), "x": ("orphan", None),
    }
    assert found["a"].n_results == 2
    assert found["a"].json == '{"call":{"arguments":{"question":"é","turn":1},"id":"a","name":"answer","needs":[]},"level":0,"result":"ra"}'
    assert found["h"].errors == ["missing question", "unexpected more", "turn is not integer"]
    assert toolcalls.link_tool_calls(messages.limit(0)).count() == 0


def test_tool_calls_of_all_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    assert toolcalls.op8_tool_calls(spark, SF).count() == rows.filter("role = 'assistant'").count()


def test_language_model_scores(documents):
    rows = maxent.score_texts(documents.select("doc_id", "text"), batch_bytes=100_000).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)) + [None] for r in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter(t for i in train for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens[r.doc_id]
        base = sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id not in set(train), len(own), n)
        assert r.n_known == sum(counts[t] > 0 for t in own) and abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_probabilities_sum_to_one():
    keys = (np.arange(1, 41, dtype=np.uint64) << np.uint64(8)) | (np.arange(40, dtype=np.uint64) % np.uint64(16))
    counts = np.arange(50, 10, -1)
    top, rest = keys[:30], keys[30:]
    mass, types = np.zeros(16, int), np.zeros(16, int)
    np.add.at(mass, (rest & np.uint64(15)).astype(int), counts[30:])
    np.add.at(types, (rest & np.uint64(15)).astype(int), 1)
    model = maxent.MaxEnt(top, counts[:30], mass, types, int(counts.sum()), 40)
    model.train(keys, np.array([0, 40]), [np.zeros(maxent.HASHED, np.float32), np.zeros(2 * maxent.IDS * maxent.CLASSES, np.float32)])
    unseen = (np.arange(99, 115, dtype=np.uint64) << np.uint64(8)) | np.arange(16, dtype=np.uint64)
    whole = np.concatenate([keys, unseen])
    known = np.concatenate([counts, np.zeros(16, int)])
    total = 0.0
    for k, c in zip(whole, known, strict=True):
        total += np.exp(model.log_probabilities(np.array([keys[3], k]), np.array([0, 2]), np.array([counts[3], c]))[1])
    assert total == pytest.approx(1, abs=1e-4)


def test_language_model_on_awkward_rows(awkward):
    found = maxent.score_texts(awkward)
    names_once(found)
    got = by_id(found, "n_tokens", "score")
    assert found.count() == awkward.count() and got[3] == got[4] and got[3][0] == 1 and got[7][0] == 60_001
    assert found.filter("doc_id is null and held_out").count() == 0
    assert maxent.score_texts(awkward.limit(0)).count() == 0


def test_toxicity_folds_and_spares():
    lexicon = toxicity.Lexicon({" scum": 5.0}, ["pond scum"], (-3.0, 2.0, 1.0))
    for text in ("You SCUM!", "sсum", "5cum", "$cum or sсum", "s​cum"):
        assert lexicon.hits(toxicity.folded(text)) or text.startswith("$"), text
    assert not lexicon.hits(toxicity.folded("the pond scum is green")) and not lexicon.hits(toxicity.folded("discum"))
    short, long = "scum here", "scum here " + "clean words " * 200
    assert lexicon.score(toxicity.folded(short)) > lexicon.score(toxicity.folded(long))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op10_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9


def test_toxicity_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (8, None), (9, 0)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(awkward, toxicity.learn_lexicon(awkward, labels))
    names_once(found)
    assert found.count() == awkward.count() and found.filter("not score between 0 and 1").count() == 0
    got = by_id(found, "score", "predicted")
    assert got[3] == got[4]
    assert toxicity.score_toxicity(awkward.limit(0), toxicity.learn_lexicon(awkward, labels.limit(0))).count() == 0


def test_levels_of_long_conversations(spark, monkeypatch):
    """A chain of 2000 calls, branches, cycles and far needs against a plain worklist, at bounded tables."""
    rng = np.random.default_rng(8)
    needs = {(1, f"c{i}"): (i, [f"c{i - 2}"] if i > 1 else []) for i in range(2000)}
    for i in range(600):
        near = [f"b{max(0, i - int(x))}" for x in rng.integers(1, 9, 2)] if i else []
        far = [f"b{int(rng.integers(0, i))}"] if i and i % 50 == 0 else []
        needs[2, f"b{i}"] = (i // 2, [*near, *far, "nobody"])
    needs |= {(3, f"d{i}"): (i * 7, [f"d{i + 1}"] if i < 99 else []) for i in range(100)}
    needs |= {(4, f"e{i}"): (i * 9, [f"e{(i + 1) % 60}"] if i < 60 else [f"e{i - 30}"] if i < 80 else []) for i in range(100)}
    needs |= {(5, "x"): (3, ["x"]), (5, "y"): (-40, ["x"]), (5, "z"): (10**12, [])}
    expected, left = {}, {k: {n for n in own if (k[0], n) in needs} for k, (_, own) in needs.items()}
    while True:
        ready = [k for k, own in left.items() if all((k[0], n) in expected for n in own)]
        if not ready:
            break
        for k in ready:
            expected[k] = max((expected[k[0], n] + 1 for n in left.pop(k)), default=0)
    expected |= dict.fromkeys(left, -1)
    rows = [(conv, call, turn, own) for (conv, call), (turn, own) in needs.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, needs array<string>").repartition(5)
    written = []
    whole = toolcalls.stored
    monkeypatch.setattr(toolcalls, "stored", lambda df, label: written.append(label) or whole(df, label))
    for width in (16, 1024):
        written.clear()
        found = {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(calls, width).collect()}
        assert found == expected and len(written) < 24
    monkeypatch.setattr(toolcalls, "CHUNK", 10)
    monkeypatch.setattr(toolcalls, "MOST_PARTS", 50)
    assert {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(calls, 16).collect()} == expected
