"""Helpers that several operators share: batches of texts, packed arrays, stored tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.sinks.scratch import scratch_folder

BATCH = "__batch"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts together, nulls as empty."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns whose names clash (in any case) with those an operator adds."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def in_batches(docs: DataFrame, batch_bytes: int, id_col="doc_id", text_col="text") -> DataFrame:
    """Adds ``__batch``: rows dealt by a hash of id and text, about ``batch_bytes`` each.

    A hot source, a hot id or null ids do not gather in one batch, because the text is
    hashed too; only copies with equal ids do.
    """
    n = max(1, -(-text_bytes(docs, text_col) // batch_bytes))
    return docs.withColumn(BATCH, F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int"))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the offsets of the rows (n + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    if starts[-1] == offsets[-1] - offsets[0]:
        return raw[offsets[0] : offsets[-1]], starts
    whole = b"".join(x for x in column.to_pylist() if x is not None)
    return np.frombuffer(whole, np.uint8), starts


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps; longer tables would stay in its memory through all later stages.
_KEPT_POWERS = 1 << 22


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, the first of them kept for the next call in this process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 21), base, np.uint64)
        factors[0] = 1
        have = np.cumprod(factors, dtype=np.uint64)
        _powers[base] = have if len(have) <= _KEPT_POWERS else have[:_KEPT_POWERS].copy()
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class SpanHashes:
    """Hashes of any spans of a byte array from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same bytes give the same hash wherever they stand."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes from every place on."""
        if len(self.sums) <= k:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LETTERED = np.zeros(256, bool)
LETTERED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray):
    """Start, end and row of every maximal run of word bytes inside a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[starts] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    begin = np.flatnonzero(inside & (~before | fresh[:-1]))
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def slices(table: pa.Table | pa.RecordBatch, text_col: str, limit: int = 2 << 20):
    """Consecutive slices of a table whose texts hold about ``limit`` bytes at most."""
    sizes = np.asarray(
        pa.compute.fill_null(pa.compute.binary_length(table.column(text_col)), 0)
    ).astype(np.int64)
    piece = np.cumsum(sizes) // limit
    for lo, hi in zip(*bounds(piece), strict=True):
        yield table.slice(lo, hi - lo)


def bounds(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    start = runs(sorted_keys)
    return start, np.concatenate([start[1:], [len(sorted_keys)]]).astype(np.int64)[: len(start)]


def extended(batch: pa.RecordBatch, columns: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch followed by new ones."""
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in columns] + list(added.values()), names=columns + list(added)
    )
