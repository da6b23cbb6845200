"""Suffix-array removal of passages that stand in an earlier document as well.

A byte goes if a string of ``SPAN`` bytes covers it that also starts in a document with a
smaller id. The steps, each a Spark shuffle of packed arrays:

1. Documents are dealt into batches. Of every SPAN-byte window the smallest hash of its
   GRAM-byte substrings is its anchor (equal windows have equal anchors), so windows that
   are equal meet under one anchor. A batch sends each anchor once.
2. Anchors are counted by hash bucket; those of two documents or more go back to the batches.
3. A batch sends the texts around its shared anchors to shards, equal texts once, with the
   smallest id. Anchors that stand in very many batches would gather many contexts in one
   shard; their windows are dealt by a second anchor of FINE_GRAM bytes, which leaves
   hardly any context.
4. A shard builds suffix arrays of blocks of bounded size by Larsson-Sadakane refinement and
   common prefixes by Kasai's rule; suffixes that share SPAN bytes are a class. The sorted
   classes of the blocks are merged by binary search, and the least id of each class is
   known. Hashes only route: equality is decided on bytes here.
5. The batches mark the removed windows.

Null and empty texts have no bytes and lose none. Rows with a null id neither lose bytes nor
serve as an earlier document. Rows with equal ids do not remove bytes from each other.
Extra columns pass through; those named as a result column are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulse.llm.common import BATCH, SpanHashes, bounds, in_batches, runs, text_bytes, utf8, without

SPAN = 50
GRAM = 24
#: Of the second anchor, for windows whose first anchor stands in more than WIDE batches.
FINE_GRAM = 44
BATCH_BYTES = 2 << 20
BLOCK_BYTES = 1 << 18
WIDE = 256
_WIDTH = 2 * SPAN - GRAM  # the longest text around one anchor


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    have, out = 1, h
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(h) - w + 1], out[w - have :]) if w > have else out


class _Anchors:
    """Windows of a batch grouped by anchor: anchor hash, first and last window start."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str):
        self.data, self.starts = utf8(table.column(text_col))
        ids = table.column(id_col).combine_chunks()
        self.known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.hash = np.zeros(0, np.uint64)
        self.first = self.last = self.row = np.zeros(0, np.int64)
        lengths = np.diff(self.starts)
        n = len(self.data)
        if n >= SPAN:
            whole = np.repeat(self.starts[1:], lengths) - np.arange(n) >= SPAN
            windows = np.flatnonzero(whole & np.repeat(self.known, lengths))
            self.hash, self.first, self.last = self.grouped(windows, GRAM)
            self.row = np.searchsorted(self.starts, self.first, side="right") - 1

    def grouped(self, windows: np.ndarray, gram: int, apart: np.ndarray | None = None):
        """Runs of windows with one anchor of ``gram`` bytes: hash, first and last start.

        The place in the row breaks ties between equal grams, whatever the order of rows.
        """
        if not len(windows):
            return self.hash[:0], windows, windows
        grams = SpanHashes(self.data).grams(gram)
        place = np.arange(len(self.data)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        grams = (grams & ~np.uint64(63)) | (place[: len(grams)].astype(np.uint64) & np.uint64(63))
        least = _sliding_min(grams, SPAN - gram + 1)[windows]
        at = windows + (((least & np.uint64(63)).astype(np.int64) - place[windows]) & 63)
        new = np.ones(len(windows), bool)
        new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
        if apart is not None:
            new[1:] |= apart[1:] != apart[:-1]
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(windows)]]) - 1
        return least[begin] >> np.uint64(6), windows[begin], windows[end]

    def cut(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), _WIDTH + 1), np.uint8)
        length = end - start
        padded = np.concatenate([self.data, np.zeros(_WIDTH, np.uint8)])
        for k in range(int(length.max()) if len(length) else 0):
            column = padded[start + k]
            out[:, k] = np.where(k < length, column, 0)
        out[:, _WIDTH] = length
        return out


def _place(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a 58-bit hash and the 32 bits that tell it from others there."""
    low = (hashes & np.uint64((1 << 26) - 1)).astype(np.int64)
    return low % buckets, (hashes >> np.uint64(26)).astype(np.uint32)


def _distinct(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct row in sorted order, and the number of each row's class."""
    view = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1]))).ravel()
    _, first, inverse = np.unique(view, return_index=True, return_inverse=True)
    return first, inverse.ravel()


_NOTES = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("a", T.BinaryType()),
        T.StructField("b", T.BinaryType()),
    ]
)
_ARROW_NOTES = pa.schema(
    [("part", pa.int64()), ("batch", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]
)


def _notes(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table(
        [pa.array(c, f.type) for c, f in zip(columns, _ARROW_NOTES, strict=True)],
        schema=_ARROW_NOTES,
    )


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks. Sorts by eight bytes, then doubles the depth, each time only
    within groups that are still tied (Larsson-Sadakane)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= padded[k : n + k] << np.uint64(56 - 8 * k)
    order = np.argsort(key, kind="stable")
    # a suffix that ends is less than one that goes on with zeros
    ends = np.minimum(n - order, 8)
    tie = np.lexsort((ends, key[order])) if (text == 0).any() else np.arange(n)
    order, ends = order[tie], ends[tie]
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (ends[1:] != ends[:-1])
    rank = np.zeros(n + 1, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group + 1
    depth = 8
    while True:
        tied = ~new | ~np.concatenate([new[1:], [True]])
        at = np.flatnonzero(tied)
        if not len(at):
            return order, rank[:n] - 1
        who = order[at]
        own = rank[who]
        then = rank[np.minimum(who + depth, n)]
        pair = (own << 32) | then
        sort = np.argsort(pair, kind="stable")
        who, pair, own = who[sort], pair[sort], own[sort]
        order[at] = who
        fresh = np.ones(len(at), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[at] = fresh
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[who] = start + 1
        depth *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, lane: int = 128) -> np.ndarray:
    """Bytes that each suffix in sorted order shares with the one before it (Kasai).

    The text is cut into lanes that advance together, one comparison a round; the prefix of
    the next suffix is at least that of the last one less one.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(1, np.uint8)])
    out = np.zeros(n, np.int32)
    i = np.arange(0, n, lane)
    end = np.minimum(i + lane, n)
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        a, b = i + h, j + h
        same = (j >= 0) & (a < n) & (b < n)
        same &= padded[np.minimum(a, n)] == padded[np.clip(b, 0, n)]
        out[i] = h
        i = i + ~same
        h = np.where(same, h + 1, np.maximum(h - 1, 0))
        live = i < end
        if not live.all():
            i, end, h = i[live], end[live], h[live]
    return out[order]


def _block_classes(matrix: np.ndarray, ids: np.ndarray):
    """Windows of a block: class of each, one window of each class in order, least id."""
    length = matrix[:, _WIDTH].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(length)])
    text = matrix[:, :_WIDTH][np.arange(_WIDTH) < length[:, None]]
    order, _ = suffix_array(text)
    shared = common_prefixes(text, order)
    owner = np.repeat(np.arange(len(matrix)), length)
    is_window = starts[1:][owner] - np.arange(len(text)) >= SPAN
    kept = np.flatnonzero(is_window[order])
    windows = order[kept]
    # the common prefix of neighbours with others between them is the least on the way
    # (shorter suffixes after the last window are on no way)
    least = np.minimum.reduceat(shared[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1])) if len(kept) else shared[:0]
    first = least < SPAN
    if len(first):
        first[0] = True
    cls = np.cumsum(first) - 1
    starts_of = np.flatnonzero(first)
    least_id = np.minimum.reduceat(ids[owner[windows]], starts_of) if len(windows) else ids[:0]
    head = windows[starts_of]
    keys = text[head[:, None] + np.arange(SPAN)].view(f"S{SPAN}").ravel() if len(head) else np.zeros(0, f"S{SPAN}")
    return windows, owner, starts, cls, keys, least_id


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
    """Two sorted tables of classes as one, places found by binary search."""
    (ka, da), (kb, db) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    if not len(kb):
        return ka, da
    at = np.searchsorted(ka, kb)
    same = ka[np.minimum(at, len(ka) - 1)] == kb
    da = da.copy()
    np.minimum.at(da, at[same], db[same])
    rest = ~same
    return np.insert(ka, at[rest], kb[rest]), np.insert(da, at[rest], db[rest])


def _settle(matrix: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of every window of every text of a shard, in a matrix of texts x places."""
    out = np.full((len(matrix), _WIDTH - SPAN + 1), np.iinfo(np.int64).max)
    per_block = max(1, BLOCK_BYTES // _WIDTH)
    blocks = [
        _block_classes(matrix[k : k + per_block], ids[k : k + per_block])
        for k in range(0, len(matrix), per_block)
    ]
    tables = [(b[4], b[5]) for b in blocks]
    while len(tables) > 1:
        tables = [
            _merge(tables[k], tables[k + 1]) if k + 1 < len(tables) else tables[k]
            for k in range(0, len(tables), 2)
        ]
    for k, (windows, owner, starts, cls, keys, least) in enumerate(blocks):
        if len(blocks) > 1:
            least = tables[0][1][np.searchsorted(tables[0][0], keys)]
        of = owner[windows]
        out[k * per_block + of, windows - starts[of]] = least[cls]
    return out


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """The rows of ``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256, kept_text``.

    ``kept_text`` is the text without the removed bytes; bytes of a character that was cut
    apart are left out of it (``kept_sha256`` is taken over all remaining bytes).
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    docs = without(docs, *added, BATCH)
    total = text_bytes(docs, text_col)
    keyed = in_batches(docs, batch_bytes, id_col, text_col)
    buckets = max(1, total // (27 << 20))
    shards = max(1, -(-total // (3 * batch_bytes)))

    def sends_anchors(key, table):
        own = _Anchors(table, id_col, text_col)
        order = np.argsort(own.hash, kind="stable")
        hashes, rows = own.hash[order], own.row[order]
        start = runs(hashes)
        if not len(start):
            return _notes([])
        several = np.minimum.reduceat(rows, start) != np.maximum.reduceat(rows, start)
        bucket, bits = _place(hashes[start], buckets)
        return _notes(
            [
                (b, key[0].as_py(), _bytes(bits[own_b]), _bytes(several[own_b]))
                for b in range(buckets)
                if len(own_b := np.flatnonzero(bucket == b))
            ]
        )

    def finds_shared(key, table):
        parts = [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
        several = np.concatenate([np.frombuffer(x, bool) for x in table.column("b").to_pylist()])
        batches = np.repeat(np.asarray(table.column("batch")), [len(p) for p in parts])
        bits = np.concatenate(parts)
        order = np.argsort(bits, kind="stable")
        start = runs(bits[order])
        size = np.diff(np.concatenate([start, [len(bits)]]))
        shared = (size > 1) | np.logical_or.reduceat(several[order], start)
        shared, wide = np.repeat(shared, size), np.repeat(size > WIDE, size)
        order, wide = order[shared], wide[shared]
        by = np.argsort(batches[order], kind="stable")
        order, wide = order[by], wide[by]
        return _notes(
            [
                (key[0].as_py(), int(batches[order[lo]]), _bytes(bits[order[lo:hi]]), _bytes(wide[lo:hi]))
                for lo, hi in zip(*bounds(batches[order]), strict=True)
            ]
        )

    def flagged(own: _Anchors, notes: pa.Table):
        """Texts of shared anchors: shard, row of a matrix, document row, first window start."""
        known, wide = [], []
        for part, a, b in zip(*(notes.column(c).to_pylist() for c in ("part", "a", "b")), strict=True):
            known.append(np.frombuffer(a, np.uint32).astype(np.int64) | (part << 32))
            wide.append(np.frombuffer(b, bool))
        if not known or not len(own.hash):
            return None
        known, wide = np.concatenate(known), np.concatenate(wide)
        order = np.argsort(known)
        known, wide = known[order], wide[order]
        bucket, bits = _place(own.hash, buckets)
        key = bits.astype(np.int64) | (bucket << 32)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
        plain, spread = np.flatnonzero(hit & ~wide[at]), np.flatnonzero(hit & wide[at])
        n = own.last[spread] - own.first[spread] + 1
        one = np.repeat(own.first[spread], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        fine, begin, end = own.grouped(one, FINE_GRAM, np.repeat(spread, n))
        hashed = np.concatenate([own.hash[plain], fine]).astype(np.int64)
        first = np.concatenate([own.first[plain], begin])
        last = np.concatenate([own.last[plain], end])
        rows = np.searchsorted(own.starts, first, side="right") - 1
        return hashed % shards, own.cut(first, last + SPAN), rows, first

    def by_shard(own: _Anchors, notes: pa.Table):
        """For each shard: the distinct texts, the class of each text, least id, texts."""
        found = flagged(own, notes)
        if found is None:
            return
        shard, matrix, rows, first = found
        order = np.argsort(shard, kind="stable")
        for lo, hi in zip(*bounds(shard[order]), strict=True):
            which = order[lo:hi]
            head, cls = _distinct(matrix[which])
            least = np.full(len(head), np.iinfo(np.int64).max)
            np.minimum.at(least, cls, own.ids[rows[which]])
            yield int(shard[which[0]]), which, head, cls, least, matrix, rows, first

    def in_order(table: pa.Table) -> pa.Table:
        """The rows of a batch in an order that does not depend on how they came."""
        return table.sort_by([(id_col, "ascending"), (text_col, "ascending")])

    def sends_texts(key, table, notes):
        if not table.num_rows or not notes.num_rows:
            return _notes([])
        batch = table.column(BATCH)[0].as_py()
        own = _Anchors(in_order(table), id_col, text_col)
        pack = zstandard.ZstdCompressor(level=1)
        out = []
        for shard, which, head, cls, least, matrix, rows, first in by_shard(own, notes):
            out.append((shard, batch, pack.compress(_bytes(matrix[which[head]])), _bytes(least)))
            # where the answers go comes back to this batch with them, so that no window is sought twice
            # (an Arrow string column holds less than 2**31 bytes)
            windows = matrix[which, _WIDTH] - np.uint8(SPAN - 1)
            later = own.ids[rows[which]] > least[cls]
            places = [x.tobytes() for x in (first[which].astype(np.uint32), cls.astype(np.uint32), windows, later)]
            out.append((-1 - batch, batch, pack.compress(b"".join(places)), shard.to_bytes(8, "little")))
        return _notes(out)

    def settles(key, table):
        if key[0].as_py() < 0:
            return table.select(_ARROW_NOTES.names).cast(_ARROW_NOTES)
        unpack = zstandard.ZstdDecompressor()
        parts = [
            np.frombuffer(unpack.decompress(x), np.uint8).reshape(-1, _WIDTH + 1)
            for x in table.column("a").to_pylist()
        ]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("b").to_pylist()])
        matrix = np.concatenate(parts)
        head, cls = _distinct(matrix)
        matrix = matrix[head]
        least = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(least, cls, ids)
        settled = _settle(matrix, least)
        masks = np.zeros(len(ids), np.uint32)
        for k in range(settled.shape[1]):
            masks |= (settled[cls, k] < ids).astype(np.uint32) << np.uint32(k)
        ends = np.cumsum([len(p) for p in parts])
        return _notes(
            [
                (key[0].as_py(), b, _bytes(masks[e - len(p) : e]), b"")
                for b, p, e in zip(table.column("batch").to_pylist(), parts, ends, strict=True)
            ]
        )

    columns = docs.columns

    def removes(key, table, notes):
        table = in_order(table)
        data, starts = utf8(table.column(text_col))
        change = np.zeros(len(data) + 1, np.int32)
        unpack = zstandard.ZstdDecompressor()
        answers, sent = {}, []
        for part, a, b in zip(*(notes.column(c).to_pylist() for c in ("part", "a", "b")), strict=True):
            if part >= 0:
                answers[part] = np.frombuffer(a, np.uint32)
            else:
                sent.append((int.from_bytes(b, "little"), unpack.decompress(a)))
        for shard, places in sent:
            count = len(places) // 10
            first, cls = np.frombuffer(places, np.uint32, 2 * count).reshape(2, count).astype(np.int64)
            n, later = np.frombuffer(places, np.uint8, offset=8 * count).reshape(2, count)
            masks = np.where(later, np.uint32(0xFFFFFFFF), answers[shard][cls])
            for k in range(int(n.max())):
                hit = (k < n) & ((masks >> np.uint32(k)) & 1).astype(bool)
                s = first[hit] + k
                np.add.at(change, s, 1)
                np.add.at(change, s + SPAN, -1)
        gone = np.cumsum(change[:-1]) > 0
        size, removed, spans, sha, kept = [], [], [], [], []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            mark = gone[lo:hi]
            size.append(int(hi - lo))
            removed.append(int(mark.sum()))
            rest = data[lo:hi]
            if removed[-1]:
                spans.append(int(mark[0]) + int((mark[1:] & ~mark[:-1]).sum()))
                rest = rest[~mark]
            else:
                spans.append(0)
            rest = rest.tobytes()
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore"))
        out = table.select(columns)
        for name, values, kind in zip(
            added, (size, removed, spans, sha, kept), (pa.int64(),) * 3 + (pa.string(),) * 2, strict=True
        ):
            out = out.append_column(name, pa.array(values, kind))
        return out

    schema = T.StructType(
        docs.schema.fields
        + [T.StructField(n, T.LongType()) for n in added[:3]]
        + [T.StructField(n, T.StringType()) for n in added[3:]]
    )
    shared = keyed.groupBy(BATCH).applyInArrow(sends_anchors, _NOTES)
    shared = shared.groupBy("part").applyInArrow(finds_shared, _NOTES)
    texts = keyed.groupBy(BATCH).cogroup(shared.groupBy("batch")).applyInArrow(sends_texts, _NOTES)
    answers = texts.groupBy("part").applyInArrow(settles, _NOTES)
    return keyed.groupBy(BATCH).cogroup(answers.groupBy("batch")).applyInArrow(removes, schema)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeat an earlier one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

