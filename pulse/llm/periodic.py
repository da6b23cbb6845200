"""Periodic runs of words, found from longest common extensions on a difference cover.

A run is a maximal stretch of words with smallest period ``q`` and at least two periods.
For every period ``p`` the places ``0, p, 2p, ...`` form a grid; a run with period ``p`` holds
two neighbours of its grid, so from the common extension of each pair of neighbours, forwards
and backwards, follow all runs (n ln n pairs for n words). Runs found with a multiple of
their period have the same ends, and the least period is kept.

Extensions come from a difference cover: of the suffixes only those at places whose remainder
modulo 31 is in a fixed set of six are sorted, first by blocks of 31 words, then by doubling
over the blocks of a remainder class. For two places there is a shift below 31 that takes both
to sampled places; the words before are compared one by one (nearly all pairs end there), the
rest is a range minimum over the common prefixes of neighbours in sorted order, from a sparse
table. Backwards the same is done on the reversed words.

Texts of a batch are sorted together, with a separator word of its own after each, so nothing
extends beyond a text. A text stays in one task; pairs are made in bounded portions.

Defined cases: a null, empty or blank text has no words and no runs. A null id rewrites no
words. Repeated rows give equal rows. Extra columns are kept, those whose names clash with a
result are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import SPACE, extended, slices, utf8, without, words

# a perfect difference set: every remainder modulo 31 is the difference of two of its numbers
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
MIN_WORDS = 12
PAIRS = 1 << 20

# for a difference d: a number h of the cover with h + d in the cover as well
_FIRST = np.zeros(MODULUS, np.int64)
for _h in COVER:
    for _k in COVER:
        _FIRST[(_k - _h) % MODULUS] = _h


class Extensions:
    """Longest common prefixes of the suffixes of ``text``, an array of word numbers.

    Words that occur once between others (separators) end every extension.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = np.concatenate([text, np.full(2 * MODULUS, -1, text.dtype)]).astype(np.int32)
        self.n = n
        # sampled places by class, a class's places one after another
        places = [np.arange(h, n, MODULUS) for h in COVER]
        self.places = np.concatenate(places)
        sizes = np.array([len(p) for p in places])
        ends = np.cumsum(sizes)
        # where the class of an element ends: the block after the last is the empty one
        self.class_end = np.repeat(ends, sizes)
        self.slot = np.full(MODULUS, -1)
        self.slot[COVER] = ends - sizes
        self._sort()
        self._table()

    def _sort(self) -> None:
        m = len(self.places)
        windows = np.lib.stride_tricks.sliding_window_view(self.text, MODULUS)
        blocks = np.ascontiguousarray(windows[self.places]).astype(">u4")
        keys = blocks.view(np.dtype((np.void, 4 * MODULUS))).ravel()
        _, rank = np.unique(keys, return_inverse=True) if m else (None, np.zeros(0, np.int64))
        rank = rank.ravel()
        self.levels = [rank]
        at = np.arange(m)
        step = 1
        while m and step < m:
            count = np.bincount(rank)
            if count.max() == 1:
                break
            ahead = at + step
            follows = np.where(ahead < self.class_end, rank[np.minimum(ahead, m - 1)] + 1, 0)
            # groups of one keep their place: only the others are refined
            open_ = np.flatnonzero(count[rank] > 1)
            base = np.cumsum(np.concatenate([[0], count[:-1]]))
            fresh = base[rank]
            order = open_[np.lexsort((follows[open_], rank[open_]))]
            a, b = rank[order], follows[order]
            new_group = np.concatenate([[True], a[1:] != a[:-1]])
            new = new_group | np.concatenate([[True], b[1:] != b[:-1]])
            number = np.arange(len(order))
            head = np.maximum.accumulate(np.where(new, number, 0))
            start = np.maximum.accumulate(np.where(new_group, number, 0))
            fresh[order] = base[a] + head - start
            # dense ranks again, in the same order
            rank = _dense(fresh)
            self.levels.append(rank)
            step *= 2
        self.rank = np.empty(m, np.int64)
        self.order = np.argsort(rank, kind="stable")
        self.rank[self.order] = np.arange(m)

    def _table(self) -> None:
        """Common prefixes of neighbours in sorted order, and their range minima."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        blocks = np.zeros(len(a), np.int64)
        # equal names never reach the last block of a class, which holds the last separator
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], 1 << k
            same = np.flatnonzero(rank[a] == rank[b])
            for moved in (blocks, a, b):
                moved[same] += step
        first, second = self.places[self.order[:-1]], self.places[self.order[1:]]
        self.lcp = blocks * MODULUS
        self.lcp += self._direct(first + self.lcp, second + self.lcp, np.full(len(first), MODULUS))
        self.minima = [self.lcp]
        width = 1
        while 2 * width <= len(self.lcp):
            below = self.minima[-1]
            self.minima.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from two places on, at most ``most``; one round for each word."""
        out = np.zeros(len(i), np.int64)
        i, j = np.minimum(i, self.n + MODULUS), np.minimum(j, self.n + MODULUS)
        left = np.arange(len(i))
        step = 0
        while len(left):
            left = left[most[left] > step]
            a, b = i[left] + step, j[left] + step
            left = left[(a < self.n) & (b < self.n)]
            left = left[self.text[i[left] + step] == self.text[j[left] + step]]
            out[left] += 1
            step += 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j (i < j, both inside)."""
        shift = (_FIRST[(j - i) % MODULUS] - i) % MODULUS
        out = self._direct(i, j, shift)
        far = np.flatnonzero(out == shift)
        far = far[(i[far] + shift[far] < self.n) & (j[far] + shift[far] < self.n)]
        if len(far):
            a, b = i[far] + shift[far], j[far] + shift[far]
            a = self.rank[self.slot[a % MODULUS] + a // MODULUS]
            b = self.rank[self.slot[b % MODULUS] + b // MODULUS]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.floor(np.log2(high - low)).astype(np.int64)
            found = np.zeros(len(far), np.int64)
            for k in np.unique(level).tolist():
                of = np.flatnonzero(level == k)
                table = self.minima[k]
                found[of] = np.minimum(table[low[of]], table[high[of] - (1 << k)])
            out[far] += found
        return out


def _dense(rank: np.ndarray) -> np.ndarray:
    """The same order with numbers from 0 without gaps."""
    seen = np.zeros(len(rank), np.int64)
    seen[rank] = 1
    return (np.cumsum(seen) - 1)[rank]


def grid_pairs(sizes: np.ndarray, portion: int = PAIRS):
    """Grid neighbours of all texts: arrays ``(text, place, period)`` of bounded length."""
    # one entry per (text, period), in order
    many = sizes // 2
    text = np.repeat(np.arange(len(sizes)), many)
    period = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + 1
    pairs = (sizes[text] - 1) // period
    done = np.cumsum(pairs)
    lo = 0
    while lo < len(text):
        before = done[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(done, before + portion, side="right")))
        some = slice(lo, hi)
        n = pairs[some]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[some], n)
        yield np.repeat(text[some], n), place * p, p
        lo = hi


def runs_of(numbers: np.ndarray, starts: np.ndarray, min_words: int = MIN_WORDS):
    """Runs ``(text, start, length, period)`` of several texts, by text, start and period.

    ``numbers`` are the words of all texts as non-negative numbers, ``starts`` where each text
    begins (n + 1).
    """
    sizes = np.diff(starts)
    n_texts = len(sizes)
    none = np.zeros(0, np.int64)
    if not len(numbers):
        return none, none, none, none
    # a separator before each text and after the last; every one is a word of its own
    top = int(numbers.max()) + 1
    joined = np.empty(len(numbers) + n_texts + 1, np.int64)
    begin = starts[:-1] + np.arange(n_texts) + 1
    text_of = np.repeat(np.arange(n_texts), sizes)
    joined[np.arange(len(numbers)) + text_of + 1] = numbers
    separators = np.concatenate([begin - 1, [len(joined) - 1]])
    joined[separators] = top + np.arange(n_texts + 1)
    last = len(joined) - 1
    forward = backward = None
    found = []
    for text, place, period in grid_pairs(sizes):
        at = begin[text] + place
        # most neighbours differ in both directions and end here
        near = (joined[at] == joined[at + period]) | (joined[at - 1] == joined[at + period - 1])
        at, period, text = at[near], period[near], text[near]
        if not len(at):
            continue
        if forward is None:
            forward, backward = Extensions(joined), Extensions(joined[::-1])
        ahead = forward(at, at + period)
        # backwards from the words before: mirrored places, the later one first
        behind = backward(last - (at + period - 1), last - (at - 1))
        good = ahead + behind + period >= np.maximum(2 * period, min_words)
        at, text, period, ahead, behind = (x[good] for x in (at, text, period, ahead, behind))
        found.append(_least(text, at - behind - begin[text], ahead + behind + period, period))
    if not found:
        return none, none, none, none
    return _least(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _least(text, start, length, period):
    """Of runs with equal ends the one with the least period, by text, start and period."""
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = (x[fresh] for x in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return tuple(x[order] for x in (text, start, length, period))


def rewritten(sizes: np.ndarray, ids: list) -> np.ndarray:
    """For every word of every text the number of the word that stands there.

    A tenth of the texts, by a checksum of the id, repeats a stretch from some word on.
    """
    out = []
    for n, id in zip(sizes.tolist(), ids, strict=True):
        places = np.arange(n)
        if n and id is not None:
            h = zlib.crc32(str(id).encode())
            if h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                places[a:] = a + (places[a:] - a) % p
        out.append(places)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


COLUMNS = {
    "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
}


def _batch_runs(texts: pa.Array, ids: list | None, min_words: int, with_text: bool):
    data, offsets = utf8(texts)
    begin, end, row = words(data, offsets, ~SPACE)
    n = len(offsets) - 1
    starts = np.searchsorted(row, np.arange(n + 1))
    sizes = np.diff(starts)
    # the words without the white space between them
    inside = ~SPACE[data]
    kept = np.ascontiguousarray(data[inside])
    at = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    numbers = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(kept)]).dictionary_encode()
    source = np.arange(len(begin))
    if ids is not None:
        source = np.repeat(starts[:-1], sizes) + rewritten(sizes, ids)
    numbers = numbers.indices.to_numpy().astype(np.int64)[source]
    text, start, length, period = runs_of(numbers, starts, min_words)
    # words after the first period of a run go
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, starts[text] + start + period, 1)
    np.add.at(change, starts[text] + start + length, -1)
    stays = np.cumsum(change[:-1]) == 0
    source, own = source[stays], np.repeat(np.arange(n), sizes)[stays]
    size = at[source + 1] - at[source]
    # the words that stay, each with one space after it
    ends = np.cumsum(size + 1)
    buffer = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
    word = np.repeat(np.arange(len(source)), size)
    step = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    buffer[(ends - size - 1)[word] + step] = kept[at[source][word] + step]
    places = np.concatenate([[0], ends])[np.searchsorted(own, np.arange(n + 1))]
    first = np.searchsorted(text, np.arange(n + 1))
    out: dict[str, list] = {c: [] for c in COLUMNS}
    collapsed, every = [], []
    raw = memoryview(buffer)
    for k in range(n):
        runs = list(zip(*(x[first[k] : first[k + 1]].tolist() for x in (start, length, period)), strict=True))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        out["n_runs"].append(len(runs))
        for name, value in zip(("start", "length", "period"), best, strict=True):
            out[name].append(value)
        out["exponent_milli"].append(1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
        whole = raw[places[k] : max(places[k], places[k + 1] - 1)]
        out["collapsed_sha256"].append(hashlib.sha256(whole).hexdigest())
        if with_text:
            collapsed.append(bytes(whole).decode())
            every.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
    arrays = {c: pa.array(v, COLUMNS[c]) for c, v in out.items()}
    if with_text:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        arrays |= {"runs": pa.array(every, kind), "collapsed": pa.array(collapsed, pa.string())}
    return arrays


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    rewrite: bool = False,
    with_text: bool = True,
) -> DataFrame:
    """Adds the runs of every text: their number, the longest, digests of all and of what stays.

    ``with_text`` adds ``runs`` (all of them) and ``collapsed``, the text without the words that
    only repeat. ``rewrite`` first makes a tenth of the texts periodic, by a checksum of the id.
    """
    added = [*COLUMNS, *(["runs", "collapsed"] if with_text else [])]
    docs = without(docs, *(c for c in added if c.lower() not in (id_col.lower(), text_col.lower())))
    names = docs.columns

    def find(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                ids = part.column(id_col).to_pylist() if rewrite else None
                yield extended(part, names, _batch_runs(part.column(text_col), ids, min_words, with_text))

    kinds = {pa.int64(): "long", pa.string(): "string"}
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    tail = ", ".join(f"{c} {kinds[t]}" for c, t in COLUMNS.items())
    if with_text:
        tail += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.mapInArrow(find, f"{head}, {tail}")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which is made periodic first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    return periodic_runs(docs, rewrite=True, with_text=False).drop("text")
