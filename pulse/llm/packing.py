"""Lexical retrieval packing of documents into windows of tokens.

Texts become token ids once and are stored. Whole windows of a long document are sequences of
their own; what is left of each document (less than a window) is a unit, and units are packed
with their BM25 neighbours. Terms are token ids, so the document frequencies, counted over
all units, are at most one number per entry of the vocabulary.

The inverted index is sharded. A unit is routed by its heaviest term (tf and idf as in BM25);
terms are laid one after another into shards of about ``shard_tokens`` tokens, and a term with
more tokens than that gets several shards, among which its units are dealt by a hash. A
shard is one task: it holds its postings, takes the longest unused unit as seed, scores all
unused units of the shard against it, and fills the seed's window in order of score. The unit
that does not fit is cut, and its rest is the seed of the next window. So every window of a
shard is full but the last, which is cut into lengths that are powers of two: nothing is padded.

Defined cases: a null or empty text is the end id alone. Units without a common term score 0
and follow in order of their rows; ties go by row as well. Repeated rows, equal ids and null
ids are documents of their own. Extra columns are ignored. An empty table has no pieces.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import SPACE, slices, stored, utf8

WINDOW = 2048
END = 1
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
#: Words whose ids a worker remembers; more only means that it starts again.
KEPT_WORDS = 1 << 19
#: Words that are encoded as one text.
JOINED = 256

_BEGIN, _LATIN, _OTHER, _CAPITAL, _INSIDE = 1, 2, 4, 8, 16


def _pair_flags() -> np.ndarray:
    """What a byte is after another one, by 256 * first + second.

    A word begins at it whatever comes before; it ends a letter of Latin-1; it is a sign or a
    digit; it makes a capital; it is no white space.
    """
    byte = np.arange(256)
    digit = (byte >= 48) & (byte <= 57)
    small = (byte >= 97) & (byte <= 122)
    capital = (byte >= 65) & (byte <= 90)
    sign = (byte > 32) & (byte < 127) & ~digit & ~small & ~capital
    first, second = np.divmod(np.arange(1 << 16), 256)
    # letters of two bytes, the first 0xC3: all but the signs of multiplication and division
    latin = (first == 0xC3) & (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    letter = small | capital
    begin = SPACE[first] | (letter[first] & (sign | digit)[second])
    begin |= (sign & (byte != 39))[first] & letter[second]
    begin |= (digit[first] & (second < 128)) | (digit[second] & (first < 128))
    flags = np.where(begin & ~SPACE[second], _BEGIN, 0) + np.where(latin, _LATIN, 0)
    flags += np.where((sign | digit)[second], _OTHER, 0) + np.where(~SPACE[second], _INSIDE, 0)
    flags += np.where(capital[second] | (latin & (second <= 0x9E)), _CAPITAL, 0)
    return flags.astype(np.uint8)


_FLAGS = _pair_flags()
# what follows a letter and cannot be a mark that joins it: ASCII, or a letter of Latin-1
_SAFE = np.where((np.arange(256) < 128) | (np.arange(256) == 0xC3), _CAPITAL, 0).astype(np.uint8)
# letters of ASCII, and the first byte of the letters of Latin-1
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), 0xC3])


class WordIds:
    """Token ids of texts, word by word; the ids of a word are asked once.

    No token reaches over white space, from a letter into a sign or a digit, from a sign other
    than the apostrophe into a letter, or over either end of a digit, so texts are cut there
    (in ASCII and the letters of Latin-1). Capitals of these become small ones unless what
    follows may be a mark that joins the letter. Words of letters only are encoded many at a
    time: the last token of each has the word end. Texts with the opening of a special token
    are encoded whole.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        # Spark runs a task per core: no threads inside
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.slots: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.slots.clear()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The slot of every word."""
        listed = _listed(words)
        slots = np.fromiter(map(self.slots.get, listed, repeat(-1)), np.int64, len(listed))
        fresh = np.flatnonzero(slots < 0)
        if len(self.slots) + len(fresh) > KEPT_WORDS:
            self._clear()
            fresh = np.arange(len(listed))
        if not len(fresh):
            return slots
        letters = _letters_only(words.take(pa.array(fresh)))
        plain, other = fresh[letters], fresh[~letters]
        ids, sizes = self._joined_ids(words.take(pa.array(plain)))
        if len(sizes) != len(plain):  # a vocabulary without some letter: word by word
            plain, other = plain[:0], fresh
            ids, sizes = ids[:0], sizes[:0]
        if len(other):
            found = self.tokenizer.encode_batch_fast([listed[k].decode() for k in other.tolist()], add_special_tokens=False)
            found = [x.ids for x in found]
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.uint32)])
            sizes = np.concatenate([sizes, np.fromiter(map(len, found), np.int64, len(found))])
        first = len(self.slots)
        start = int(self.ends[first])
        self.ends = _grown(self.ends, first + len(sizes) + 1)
        self.ends[first + 1 : first + len(sizes) + 1] = start + np.cumsum(sizes)
        self.ids = _grown(self.ids, start + len(ids))
        self.ids[start : start + len(ids)] = ids
        order = np.concatenate([plain, other])
        self.slots.update(zip(map(listed.__getitem__, order.tolist()), range(first, first + len(order)), strict=True))
        slots[order] = np.arange(first, first + len(order))
        return slots

    def _joined_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters in a row, and their number per word."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cuts = pa.array([*range(0, len(words), JOINED), len(words)], pa.int32())
        lists = pa.ListArray.from_arrays(cuts, words.cast(pa.large_string()))
        joined = pa.compute.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        ends = np.flatnonzero(self.is_end[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text starts (n + 1)."""
        data, starts = utf8(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        pairs = np.empty(len(data), np.uint16)
        pairs[0] = 32 << 8 | int(data[0])
        pairs[1:] = data[:-1]
        pairs[1:] <<= 8
        pairs[1:] |= data[1:]
        flags = _FLAGS[pairs]
        lower = flags & _CAPITAL
        lower[:-1] &= _SAFE[data[1:]]
        data = data + (lower << 2)
        begin = flags & _BEGIN
        begin[1:] |= (flags[:-1] >> 1) & (flags[1:] >> 2) & 1
        inside = (flags >> 4 & 1).view(bool)
        begin[starts[:-1][np.diff(starts) > 0]] = 1
        begin = np.flatnonzero(begin.view(bool) & inside)
        kept = data[inside]
        offsets = np.concatenate([np.cumsum(inside, dtype=np.int32)[begin] - 1, [len(kept)]]).astype(np.int64)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))]
        ).dictionary_encode()
        slots = self._learn(words.dictionary)[words.indices.to_numpy()]
        sizes = self.ends[slots + 1] - self.ends[slots]
        ids = self.ids[spread(self.ends[slots], sizes)]
        places = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begin, starts)]
        odd = [k for k, text in enumerate(pa.compute.match_substring(texts, "<|").to_pylist()) if text]
        if odd:
            parts = [ids[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
            for k in odd:
                parts[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            places = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, places


def _letters_only(words: pa.Array) -> np.ndarray:
    """Which words are nothing but letters of ASCII and those of Latin-1 from U+00C0 on."""
    data, starts = utf8(words)
    before = np.concatenate([[0], data[:-1]])
    second = (before == 0xC3) & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    strange = np.concatenate([[0], np.cumsum(~(_LETTER[data] | second))])
    return strange[starts[1:]] == strange[starts[:-1]]


def _listed(words: pa.Array) -> list[bytes]:
    """The words as bytes; much faster than ``to_pylist``."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if len(a) >= n:
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


_loaded: dict[int, WordIds] = {}


def _word_ids(model) -> WordIds:
    key = hash(model.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordIds(model.value)
    return _loaded[key]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_units(
    docs: DataFrame, model: str, window: int = WINDOW, id_col="doc_id", text_col="text", with_ids: bool = False
) -> DataFrame:
    """``doc_id, n, whole, tail``: tokens of a document, its whole windows' checksums, the rest's ids.

    ``with_ids`` adds ``ids``, the ids of the whole windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n", "whole", "tail", *(["ids"] if with_ids else [])]

    def encode(batches):
        encoder = _word_ids(shared)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = part.column("text")
                ids, places = encoder(texts)
                whole, tails, sizes, heads = [], [], [], []
                for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                    last = len(own) // window * window
                    whole.append([_crc(own[k : k + window]) for k in range(0, last, window)])
                    tails.append(own[last:].astype("<u2" if own.max() < 1 << 16 else "<u4").tobytes())
                    sizes.append(len(own))
                    heads.append(own[:last].tobytes())
                columns = [
                    part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(tails, pa.binary()),
                ]
                columns += [pa.array(heads, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(encode, f"doc_id {kind}, n long, whole array<long>, tail binary" + ", ids binary" * with_ids)


def _ids_of(tail: bytes, n: int, window: int) -> np.ndarray:
    size = n % window
    return np.frombuffer(tail, "<u2" if len(tail) == 2 * size else "<u4") if size else np.zeros(0, "<u2")


def _terms(units: list[np.ndarray], n_terms: int):
    """Distinct terms of every unit: unit, term and count, ordered by unit and term."""
    sizes = [len(u) for u in units]
    unit = np.repeat(np.arange(len(units)), sizes)
    every = np.concatenate(units).astype(np.int64) if units else np.zeros(0, np.int64)
    keys = unit * n_terms + every
    if len(units) * n_terms < 1 << 31:
        keys = keys.astype(np.int32)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate([first, [len(keys)]]))
    unit, term = np.divmod(keys[first], n_terms)
    return unit, term, tf, np.array(sizes, np.int64)


def _weights(unit, term, tf, sizes, idf, mean):
    return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[unit] / mean))


class Frequencies:
    """What BM25 needs of all units: idf of every term and the mean length."""

    def __init__(self, df: np.ndarray, units: int, tokens: int):
        self.idf = np.log1p((units - df + 0.5) / (df + 0.5))
        self.mean = tokens / max(1, units)


def _heaviest(units: list[np.ndarray], stats: Frequencies) -> np.ndarray:
    """The term of the greatest weight of every unit (ties: the least); -1 without terms."""
    unit, term, tf, sizes = _terms(units, len(stats.idf))
    weight = _weights(unit, term, tf, sizes, stats.idf, stats.mean)
    out = np.full(len(units), -1, np.int64)
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else []
    if len(first):
        top = np.maximum.reduceat(weight, first)
        best = np.flatnonzero(weight == np.repeat(top, np.diff(np.concatenate([first, [len(unit)]]))))
        out[unit[best[::-1]]] = term[best[::-1]]
    return out


class Shard:
    """The postings of one shard."""

    def __init__(self, units: list[np.ndarray], stats: Frequencies):
        unit, term, tf, self.sizes = _terms(units, len(stats.idf))
        self.terms, self.unit = term, unit
        self.own = np.searchsorted(unit, np.arange(len(units) + 1))
        weight = _weights(unit, term, tf, self.sizes, stats.idf, stats.mean)
        order = np.argsort(term, kind="stable")
        self.term, self.who, self.weight = term[order], unit[order].astype(np.int64), weight[order]
        self.n_terms = len(stats.idf)
        self._point()

    def _point(self) -> None:
        self.ptr = np.searchsorted(self.term, np.arange(self.n_terms + 1))

    def keep(self, unused: np.ndarray) -> None:
        """Forgets the postings of used units."""
        left = unused[self.who]
        self.term, self.who, self.weight = self.term[left], self.who[left], self.weight[left]
        self._point()

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every unit for the terms of ``seed``."""
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        at = spread(self.ptr[terms], self.ptr[terms + 1] - self.ptr[terms])
        return np.bincount(self.who[at], weights=self.weight[at], minlength=len(self.sizes))


def neighbours(scores: np.ndarray, unused: np.ndarray):
    """Unused units by falling score, ties by place; the order is made as far as it is asked for."""
    scores = np.where(unused, scores, -1.0)
    n = int(unused.sum())
    done, many = 0, 32
    while done < n:
        if many < n:
            limit = -np.partition(-scores, many - 1)[many - 1]
            some = np.flatnonzero(scores >= limit)
        else:
            some = np.flatnonzero(unused)
        some = some[np.lexsort((some, -scores[some]))]
        yield from some[done:].tolist()
        done, many = len(some), many * 16


def fill(units: list[np.ndarray], stats: Frequencies, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(unit, start, length, window number, place in the window)``."""
    n = len(units)
    shard = Shard(units, stats)
    unused = np.ones(n, bool)
    by_length = iter(np.lexsort((np.arange(n), -shard.sizes)).tolist())
    pieces: list[tuple[int, int, int, int, int]] = []
    number, left, indexed = 0, n, n
    rest: tuple[int, int] | None = None
    while left or rest:
        if rest is None:
            seed = next(u for u in by_length if unused[u])
            unused[seed] = False
            left -= 1
            rest = (seed, 0)
        seed, start = rest
        rest = None
        place = int(shard.sizes[seed]) - start
        pieces.append((seed, start, place, number, 0))
        if left and place < window:
            if 4 * left < 3 * indexed:
                shard.keep(unused)
                indexed = left
            for unit in neighbours(shard.scores(seed), unused.copy()):
                unused[unit] = False
                left -= 1
                size = int(shard.sizes[unit])
                taken = min(size, window - place)
                pieces.append((unit, 0, taken, number, place))
                place += taken
                if taken < size:
                    rest = (unit, taken)
                if place == window:
                    break
        number += 1
    return pieces


def in_powers(pieces: list[tuple[int, int, int, int, int]], window: int = WINDOW):
    """The same pieces, the last window cut into lengths that are powers of two."""
    if not pieces:
        return pieces
    number = pieces[-1][3]
    last = [p for p in pieces if p[3] == number]
    total = sum(p[2] for p in last)
    if total == window:
        return pieces
    out = [p for p in pieces if p[3] < number]
    lengths = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    room, place = lengths.pop(0), 0
    for unit, start, size, _, _ in last:
        while size:
            taken = min(size, room - place)
            out.append((unit, start, taken, number, place))
            start, size, place = start + taken, size - taken, place + taken
            if place == room:
                number, place = number + 1, 0
                room = lengths.pop(0) if lengths else 0
    return out


def _counted(units: DataFrame, n_terms: int, window: int) -> Frequencies:
    """Frequencies over all units: partial counts per task, one row per term at the driver."""

    def count(batches):
        df = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            own = [_ids_of(t, n, window) for t, n in zip(batch.column("tail").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            own = [u for u in own if len(u)]
            _, term, _, sizes = _terms(own, n_terms)
            df[:n_terms] += np.bincount(term, minlength=n_terms)
            df[n_terms] += len(own)
            df[n_terms + 1] += sizes.sum()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    rows = units.select("n", "tail").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(n_terms + 2, np.int64)
    for term, count_ in rows:
        df[term] = count_
    return Frequencies(df[:n_terms].astype(float), int(df[n_terms]), int(df[n_terms + 1]))


def _plan(mass: dict[int, int], n_terms: int, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of every route (last: units without a term)."""
    first, many = np.zeros(n_terms + 1, np.int64), np.ones(n_terms + 1, np.int64)
    shard, room = 0, shard_tokens
    for route in sorted(mass):
        if mass[route] > shard_tokens:
            many[route] = -(-mass[route] // shard_tokens)
            first[route] = shard + (room < shard_tokens)
            shard, room = first[route] + many[route], shard_tokens
        else:
            if mass[route] > room:
                shard, room = shard + 1, shard_tokens
            first[route] = shard
            room -= mass[route]
    return first, many


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their sequence; ``tokenizer`` is the path of a tokenizers file.

    ``with_ids`` adds the ids of the piece.
    """
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer)
    n_terms = max(loaded.get_vocab_size(with_added_tokens=True), END + 1)
    units = token_units(docs, loaded.to_str(), window, id_col, text_col, with_ids)
    units = stored(units.withColumn("row", F.monotonically_increasing_id()), "tokens")
    context = docs.sparkSession.sparkContext
    stats = context.broadcast(_counted(units, n_terms, window))

    def routes(batch) -> tuple[np.ndarray, list[np.ndarray]]:
        own = [_ids_of(t, n, window) for t, n in zip(batch.column("tail").to_pylist(), batch.column("n").to_pylist(), strict=True)]
        return _heaviest(own, stats.value) % (n_terms + 1), own

    def weigh(batches):
        mass = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            route, own = routes(batch)
            np.add.at(mass, route, [max(1, len(u)) for u in own])
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(mass[some])], names=["route", "mass"])

    mass = units.select("n", "tail").mapInArrow(weigh, "route int, mass long").groupBy("route").agg(F.sum("mass"))
    plan = context.broadcast(_plan({r: int(m) for r, m in mass.collect()}, n_terms, shard_tokens))
    names = units.columns

    def deal(batches):
        first, many = plan.value
        for batch in batches:
            route, _ = routes(batch)
            row = batch.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            shard = first[route] + ((row >> np.uint64(20)) % many[route].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(shard)], names=[*names, "shard"])

    kind = units.schema["doc_id"].dataType
    out = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if with_ids:
        out += ", ids array<long>"
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
    dealt = units.mapInArrow(deal, f"{kinds}, shard long")
    return dealt.groupBy("shard").applyInArrow(lambda table: _packed(table, stats, window, with_ids), out)


def _packed(table: pa.Table, stats, window: int, with_ids: bool) -> pa.Table:
    table = table.sort_by("row")
    base = table.column("shard")[0].as_py() << 32
    sizes, tails = table.column("n").to_pylist(), table.column("tail").to_pylist()
    rows = [k for k, n in enumerate(sizes) if n % window]
    units = [_ids_of(tails[k], sizes[k], window) for k in rows]
    pieces = in_powers(fill(units, stats.value, window), window)
    number = pieces[-1][3] + 1 if pieces else 0
    made = [(k, j * window, window, crc, number_, 0) for number_, (k, j, crc) in enumerate(
        ((k, j, crc) for k, crcs in enumerate(table.column("whole").to_pylist()) for j, crc in enumerate(crcs)), number
    )]
    cut = [units[u][a : a + size] for u, a, size, _, _ in pieces]
    made += [
        (rows[u], sizes[rows[u]] // window * window + a, size, _crc(ids), at, place)
        for (u, a, size, at, place), ids in zip(pieces, cut, strict=True)
    ]
    who, start, length, crc, number, place = (np.array(c, np.int64) for c in zip(*made, strict=True))
    columns = {
        "doc_id": table.column("doc_id").combine_chunks().take(pa.array(who)),
        "start": pa.array(start),
        "length": pa.array(length),
        "ids_crc32": pa.array(crc),
        "doc_tokens": pa.array(np.array(sizes, np.int64)[who]),
        "sequence_id": pa.array(base + number),
        "offset": pa.array(place),
    }
    if with_ids:
        heads = [np.frombuffer(x, "<u4").reshape(-1, window) for x in table.column("ids").to_pylist()]
        columns["ids"] = pa.array([x.tolist() for head in heads for x in head] + [c.tolist() for c in cut], pa.list_(pa.int64()))
    return pa.table(columns)


def op11_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed with their lexical neighbours."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
