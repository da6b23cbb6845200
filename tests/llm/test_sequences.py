"""Packing, periodic runs and conversation repair against brute force, and on awkward tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm.tests_llm_rows import awkward_rows
from pulse.llm import packing, periodic, turns

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, N_RUNS long"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- packing -----------------------------------------------------------------------
def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_ids_equal_whole_encoding():
    tokenizer = Tokenizer.from_file(PATH)
    encoder = packing.WordIds(tokenizer.to_str())
    texts = [
        "", None, "H̱ İ Á K̊", "Don't, it's OK... a),b ),,x.'s 't.,'s", "x<|endoftext|>y <|ENDOFTEXT|>.",
        "　 a b\r\n\tc\x1cd\x85e", "ΑΣ Σ.", "123,4.5a.6", "a.b.c,,,d!?", "éa.B,C", "a\x00b.\x0bz", "\U0001f600a.b",
    ]
    rng = np.random.default_rng(0)
    letters = list("aAzZsStT.,!?;:'|<>&- \t09éÉ×÷́̈İΣ½٣\U0001f600")
    texts += ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3000)]
    ids, places = encoder(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[places[k] : places[k + 1]].tolist() == encoded(tokenizer, text)[:-1], repr(text)


def test_word_ids_without_some_letters():
    """A word whose last letter the vocabulary lacks moves no ids to the words beside it."""
    from tokenizers import models, pre_tokenizers

    vocabulary = {t: k for k, t in enumerate(["[U]", "\x01", "a", "b", "a</w>", "b</w>", "ab</w>"])}
    tokenizer = Tokenizer(models.BPE(vocabulary, [("a", "b</w>")], end_of_word_suffix="</w>"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    encoder = packing.WordIds(tokenizer.to_str())
    texts = ["ab axc b", "a cab é ba", "b"]
    ids, places = encoder(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[places[k] : places[k + 1]].tolist() == encoded(tokenizer, text)[:-1], text


def checked(rows, pieces, tokenizer):
    """Every id in one piece, checksums, gapless sequences, little padding; returns the padding."""
    texts = {}
    for id, text in rows:
        texts.setdefault(id, []).append(encoded(tokenizer, text))
    for id, found in itertools.groupby(sorted(pieces, key=lambda p: (str(p.doc_id), p.start)), key=lambda p: p.doc_id):
        own = texts.pop(id)
        assert len({tuple(x) for x in own}) == 1
        found = list(found)
        assert sum(p.length for p in found) == len(own) * len(own[0])
        covered = np.zeros(len(own[0]), int)
        for p in found:
            ids = np.array(own[0][p.start : p.start + p.length], "<u4")
            assert p.length == len(ids) > 0 and p.doc_tokens == len(own[0])
            assert p.ids_crc32 == zlib.crc32(ids.tobytes())
            covered[p.start : p.start + p.length] += 1
        assert (covered == len(own)).all()
    assert not texts
    sizes = []
    for _, found in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        place = 0
        for p in found:
            assert p.offset == place
            place += p.length
        assert place <= packing.WINDOW
        sizes.append(place)
    return sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in sizes)


def test_packed_pieces(spark, documents):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for size in (1 << 20, 5000):
        pieces = packing.pack(documents, PATH, shard_tokens=size).collect()
        assert checked(rows, pieces, tokenizer) == 0
        assert (len({p.sequence_id >> 32 for p in pieces}) > 3) == (size == 5000)


def test_packed_awkward_rows(spark):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(awkward_rows(), "doc_id long, text string, start string, OFFSET string, n_chars long")
    found = packing.pack(docs, PATH, with_ids=True)
    pieces = found.collect()
    assert checked([(r[0], r[1]) for r in awkward_rows()], pieces, tokenizer) == 0
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_neighbours_share_a_window(spark):
    """Texts of one subject are packed together, and by the scores of a plain BM25."""
    rng = np.random.default_rng(0)
    subjects = [[f"{a}{b}" for b in ("ing", "ed", "er", "ly")] for a in ("walk", "paint", "cook", "jump")]
    rows = [(k, " ".join(rng.choice(subjects[k % 4], 300))) for k in range(80)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    of = {}
    for p in pieces:
        of.setdefault(p.sequence_id, []).append(p.doc_id % 4)
    same = sum(max(x.count(s) for s in range(4)) for x in of.values()) / sum(len(x) for x in of.values())
    assert same > 0.9


def test_scores_equal_plain_bm25():
    rng = np.random.default_rng(1)
    units = [rng.integers(0, 50, rng.integers(1, 60)).astype("<u2") for _ in range(40)]
    df = np.zeros(50)
    for u in units:
        df[np.unique(u)] += 1
    stats = packing.Frequencies(df, len(units), sum(map(len, units)))
    shard = packing.Shard(units, stats)
    for q in (0, 7):
        for d, u in enumerate(units):
            want = 0.0
            for t in set(units[q].tolist()):
                tf = int((u == t).sum())
                idf = np.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5))
                want += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / stats.mean))
            assert abs(shard.scores(q)[d] - want) < 1e-4
    scores, unused = shard.scores(3), np.ones(40, bool)
    unused[[3, 5]] = False
    want = sorted((u for u in range(40) if unused[u]), key=lambda u: (-scores[u], u))
    assert list(packing.neighbours(scores, unused)) == want


# --- periodic runs -----------------------------------------------------------------
def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= 2 * q:
                found.setdefault((start, i + q - start), q)
    return sorted((s, m, q) for (s, m), q in found.items() if m >= least)


def plain_row(id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(id).encode()) if id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 6)):
            text = rng.integers(0, rng.integers(1, 4), rng.integers(0, 150))
            if len(text) > 40 and rng.random() < 0.5:
                a, p = rng.integers(0, len(text) - 30), rng.integers(1, 40)
                text[a:] = text[a + np.arange(len(text) - a) % p]
            texts.append(text)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = sorted(zip(*(x.tolist() for x in periodic.runs_of(np.concatenate(texts).astype(np.int64), starts)), strict=True))
        assert found == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t.tolist())]


def test_pairs_in_portions():
    sizes = np.array([0, 5, 1, 30, 2])
    whole = [np.concatenate(c).tolist() for c in zip(*periodic.grid_pairs(sizes, 7), strict=True)]
    want = [(t, i, p) for t, n in enumerate(sizes) for p in range(1, n // 2 + 1) for i in range(0, n - p, p)]
    assert list(zip(*whole, strict=True)) == want


def test_periodic_documents(spark, documents):
    found = periodic.op12_periodic_runs(spark, SF).collect()
    # brute force is slow: texts of up to 400 words, and all of which a part was made periodic
    small = [r for r in documents.collect() if len(r.text.split()) < 400 or zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and len(r.text) < 20_000]
    got = {r.doc_id: tuple(r) for r in found}
    assert len(found) == documents.count() and len(small) > 50
    for r in small:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text)


def test_periodic_awkward_rows(spark):
    rows = [(*r[:4], r[4]) for r in awkward_rows()] + [(10, "so " * 20 + "it is", "en", "a", 1), (11, " \t\n", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = periodic.periodic_runs(docs, rewrite=True)
    low = [c.lower() for c in found.columns]
    assert len(low) == len(set(low))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(str, (tuple(r[c] for c in names) for r in found.collect())))
    want = sorted(str(plain_row(r[0], r[1])) if r[0] != 7 else None for r in rows if r[0] != 7)
    assert [g for g in got if not g.startswith("(7,")] == want
    long = next(r for r in found.collect() if r.doc_id == 7)
    assert long.period <= 3 or zlib.crc32(b"7") % 10 == 0
    assert next(r for r in found.collect() if r.doc_id == 10).collapsed == "so it is"
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


# --- conversation repair -------------------------------------------------------------
def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(turns_):
    """All cheapest edits by a search forwards over every state, the least audit by comparing whole strings."""
    seen, rows = set(), []
    for turn, role, text in turns_:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((turn, role, text, fault))
    best = {"": (0, "", [])}  # state -> cost, audit, lines

    def put(table, state, item):
        if state not in table or item[:2] < table[state][:2]:
            table[state] = item

    def follows(state, role):
        if role == "s":
            return "s" if state == "" else None
        return {"u": "u", "a": "a" if state == "u" else None}[role] if role == "a" or state in ("", "s", "a") else None

    def inserts(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if to := follows(state, role[0]):
                        put(table, to, (cost + 3, audit + "I", [*lines, f"{role}:"]))
        return table

    for _, role, text, fault in rows:
        fresh = {}
        for state, (cost, audit, lines) in inserts(best).items():
            put(fresh, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] in ("s", "u", "a") and (to := follows(state, role[0])):
                put(fresh, to, (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for other in ("user", "assistant"):
                if to := follows(state, other[0]):
                    put(fresh, to, (cost + 3 + more, audit + "R", [*lines, f"{other}:{text}"]))
        best = fresh
    cost, audit, lines = min((inserts(best)[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults = [r[3] for r in rows]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (
        gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_conversations(rows, damaged=True):
    after = plain_damage(rows) if damaged else rows
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out[conv] = plain_repair(own)
    return out


def found_digests(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def random_turns(rng, convs, size, roles=("user", "assistant", "system", "tool", "")):
    texts = ["Yes.", "No", "", " ", "Why?", "Go on!", "x y", "Done. "]
    return [
        (c, int(t), str(rng.choice(roles)), str(rng.choice(texts)) + (f" {k}." if rng.random() < 0.5 else ""))
        for c in range(convs) for k, t in enumerate(rng.integers(0, 30, rng.integers(0, size)))
    ]


KIND = "conv_id long, turn long, role string, text string"


def test_given_conversations(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    assert found_digests(turns.op13_conversation_repair(spark, SF)) == plain_conversations(rows)


@pytest.mark.parametrize("bits", [12, 2])
def test_random_conversations(spark, bits, monkeypatch):
    """Also with blocks of four turns, where most conversations reach over several."""
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    rng = np.random.default_rng(bits)
    rows = random_turns(rng, 60, 14) + [(c + 100, t, r, x) for c, t, r, x in random_turns(rng, 12, 60, ("user", "assistant"))]
    rows += [(200, k, "user", f"{k}.") for k in range(41)] + [(201, k, "user", "same.") for k in range(30)]
    rows += [(202, k, "system", f"{k}") for k in range(17)] + [(203, 1, "user", "tie.")] * 20 + [(204, k, "ua"[k % 2], f"{k}!") for k in range(1, 40)]
    df = spark.createDataFrame(rows, KIND)
    ordered, edits = turns.repair(df)
    assert found_digests(turns.digests(df, ordered, edits)) == plain_conversations(rows, False)
    made = turns.repaired_turns(ordered, edits).orderBy("seq", "place").collect()
    lines = {}
    for r in made:
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = plain_conversations(rows, False)
    for conv, digest in want.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == digest[-1]


def test_awkward_conversations(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "user", "Hi."), (1, None, None, "x."),
        (1, 5, "assistant", None), (2, 1, "", "."), (3, 1, "Ärger", "a."), (3, 9, "system", "word " * 50_000), (4, 2, "assistant", "Ok."),
    ]
    rows += [(9, k, "user", None) for k in range(40)]
    for some in (rows, []):
        df = spark.createDataFrame([(*r, 1, "x") for r in some], KIND + ", seq int, AUDIT string")
        got = found_digests(turns.digests(df, *turns.repair(turns.damage(df))))
        assert got == plain_conversations(some)


def test_vectors_in_step():
    """A rerun gives what the search from the vector gives, also where it stops early."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        rows = [(str(rng.choice(list("suat"))), int(rng.integers(0, 4))) for _ in range(rng.integers(1, 12))]
        first = turns.backward(rows, turns.FINAL)
        after = turns.backward([("u", 3), ("a", 0), ("s", 0)][: rng.integers(0, 4)], turns.FINAL)[0]
        assert turns.rerun(rows, after, first) == turns.level(turns.backward(rows, after)[0])
