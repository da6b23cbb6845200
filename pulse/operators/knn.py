"""Exact cosine top-k of many anchors over a large base.

Spark has no vector distance, so distances come from Arrow batches multiplied
as matrices; Spark partitions, shuffles and ranks. No pair of vectors becomes a
row: each task keeps k neighbours per anchor, and only those are shuffled.

Three plans give the same rows:

* few anchors (checked): they travel to every task, the base is scanned where
  it lies and is never shuffled;
* many anchors over a small base (checked): the base travels, the anchors are
  scanned where they lie;
* else the base is dealt once into blocks that fit a task, and the anchors stream
  past each block in the sorted order of one shuffle. A task holds one block and one
  batch of anchors, whatever their number. Only anchors beyond a million make a
  second lane, for which the base is dealt again.

Distances are rounded to 9 places before ranking and ties go by neighbour id:
the order does not depend on how rows fell into batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.operators.ranking import first_n_per_group

# executors need numpy and pyarrow, not this package: its task code travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BROADCAST_ANCHORS = 2048
MAX_BROADCAST_BYTES = 64 << 20
# bytes of base vectors that a task holds, and anchors that pass one copy of the base
BLOCK_BYTES = 64 << 20
LANE_ANCHORS = 1 << 20
BLOCK_ROWS = 4096
PLACES = 9


def topk_cosine(
    base: DataFrame,
    anchors: DataFrame,
    k: int,
    *,
    id: str = "id",
    vector: str = "embedding",
    anchor_id: str = "anchor_id",
    anchor_vector: str = "embedding",
    base_day: str | None = None,
    anchor_day: str | None = None,
    payload: list[str] | None = None,
    max_broadcast_anchors: int = MAX_BROADCAST_ANCHORS,
    max_base_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(anchor_id, ``id``, distance, rank, *payload): the k nearest per anchor.

    Ids are unique on their side. NULL, empty, zero and non-finite vectors have no
    cosine and take no part. With ``base_day`` and ``anchor_day`` only base rows of an
    earlier day are candidates.
    """
    left = _prepared(base, id, vector, base_day)
    right = _prepared(anchors, anchor_id, anchor_vector, anchor_day)
    id_type, anchor_type = left.schema["id"].dataType, right.schema["id"].dataType
    out = T.StructType(
        [
            T.StructField("anchor_id", anchor_type),
            T.StructField("id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    head = right.limit(max_broadcast_anchors + 1).toArrow()
    few = head.num_rows <= max_broadcast_anchors and head.nbytes <= MAX_BROADCAST_BYTES
    if few:
        shared = base.sparkSession.sparkContext.broadcast(_unpack(head))
        found = left.mapInArrow(partial(_scan, shared=shared, k=k, schema=_arrow(out)), out)
    else:
        found = _many(left, right, k, out, max_base_bytes)

    best = first_n_per_group(found, ["anchor_id"], [F.col("distance"), F.col("id")], k)
    best = best.withColumnRenamed("id", id)
    if payload:
        kept = base.select(id, *payload)
        # few anchors: at most anchors x k rows, both bounded above
        best = kept.join(F.broadcast(best) if few else best, id)
    return best.select("anchor_id", id, "distance", "rank", *(payload or []))


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two array columns as a column expression."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _prepared(df: DataFrame, id: str, vector: str, day: str | None) -> DataFrame:
    columns = [F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")]
    if day:
        columns.append(F.unix_date(day).alias("day"))
    return df.select(columns).where(F.size("vector") > 0)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _unpack(table: pa.Table | pa.RecordBatch):
    """Arrow rows -> (ids, unit vectors as a matrix, days or None); vectors without a cosine go."""
    ids = np.asarray(table.column("id").to_pylist())
    lists = table.column("vector")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    days = None
    if "day" in table.schema.names:
        days = table.column("day").to_numpy(zero_copy_only=False)
    if not len(ids):
        return ids, np.zeros((0, 0)), days
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # a null element becomes NaN
    starts = np.cumsum(sizes) - sizes
    usable = np.logical_and.reduceat(np.isfinite(flat), starts) & np.logical_or.reduceat(flat != 0, starts)
    if not usable.all():
        flat = flat[np.repeat(usable, sizes)]
        ids, sizes = ids[usable], sizes[usable]
        days = days if days is None else days[usable]
    if len(sizes) and (sizes != sizes[0]).any():
        odd = ids[int(np.argmax(sizes != sizes[0]))]
        raise ValueError(f"vectors of unequal length: {odd}")
    matrix = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    return ids, matrix / np.linalg.norm(matrix, axis=1, keepdims=True), days


class _Nearest:
    """The k nearest per anchor seen so far, by (distance, id)."""

    def __init__(self, anchors, k: int):
        self.ids, self.unit, self.days = anchors
        self.k = k
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.ids)

    def add(self, batch) -> None:
        ids, unit, days = batch
        if not len(ids) or not len(self.ids):
            return
        if unit.shape[1] != self.unit.shape[1]:
            raise ValueError(f"vector of {ids[0]} and the anchors differ in length")
        # anchors in slices, so that the distance matrix stays small
        step = max(1, (4 << 20) // len(ids))
        for start in range(0, len(self.ids), step):
            rows = np.round(1.0 - self.unit[start : start + step] @ unit.T, PLACES)
            for offset, distances in enumerate(rows):
                at = start + offset
                if self.days is None:
                    self._merge(at, distances, ids)
                else:
                    earlier = days < self.days[at]
                    self._merge(at, distances[earlier], ids[earlier])

    def _merge(self, at: int, distances: np.ndarray, ids: np.ndarray) -> None:
        if len(distances) > self.k:
            limit = np.partition(distances, self.k - 1)[self.k - 1]
            near = distances <= limit
            distances, ids = distances[near], ids[near]
        if self.best[at] is not None:
            distances = np.concatenate([self.best[at][0], distances])
            ids = np.concatenate([self.best[at][1], ids])
        order = np.lexsort((ids, distances))[: self.k]
        self.best[at] = distances[order], ids[order]

    def rows(self, schema: pa.Schema) -> pa.Table:
        anchor_ids, ids, distances = [], [], []
        for anchor, found in zip(self.ids.tolist(), self.best, strict=True):
            if found is not None:
                distances += found[0].tolist()
                ids += found[1].tolist()
                anchor_ids += [anchor] * len(found[0])
        columns = [
            pa.array(values, field.type)
            for values, field in zip((anchor_ids, ids, distances), schema, strict=True)
        ]
        return pa.Table.from_arrays(columns, schema=schema)


def _scan(
    batches: Iterator[pa.RecordBatch], shared, k: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    nearest = _Nearest(shared.value, k)
    for batch in batches:
        nearest.add(_unpack(batch))
    yield from nearest.rows(schema).to_batches()


def _many(base: DataFrame, anchors: DataFrame, k: int, out: T.StructType, max_base_bytes: int) -> DataFrame:
    """Neighbours of more anchors than travel to every task."""
    count, elements = base.agg(F.count("*"), F.sum(F.size("vector"))).first()
    base_bytes = 8 * (elements or 0)
    if base_bytes <= max_base_bytes:
        shared = base.sparkSession.sparkContext.broadcast(_unpack(base.toArrow()))
        return anchors.mapInArrow(partial(_past, shared=shared, k=k, schema=_arrow(out)), out)
    # a block a core at least, unless blocks get so small that only copies of anchors are added
    cores = base.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-base_bytes // BLOCK_BYTES), min(cores, -(-count // BLOCK_ROWS)), 1)
    return _streamed(base, anchors, k, out, blocks)


def _past(batches: Iterator[pa.RecordBatch], shared, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nearest = _Nearest(_unpack(batch), k)
        nearest.add(shared.value)
        yield from nearest.rows(schema).to_batches()


def _streamed(base: DataFrame, anchors: DataFrame, k: int, out: T.StructType, blocks: int) -> DataFrame:
    """Anchors past blocks of the base; ids are unique, so blocks and lanes are even."""
    lanes = max(1, -(-anchors.count() // LANE_ANCHORS))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def dealt(df: DataFrame, block, lane) -> DataFrame:
        placed = df.withColumn("block", block).withColumn("lane", lane)
        cell = (F.col("block") * lanes + F.col("lane")).cast("int")
        return placed.withColumn("cell", cell).drop("block", "lane")

    held = dealt(base, own(blocks), every(lanes))
    return met(held, dealt(anchors, every(blocks), own(lanes)), blocks * lanes, k, out)


def met(base: DataFrame, anchors: DataFrame, cells: int, k: int, out: T.StructType) -> DataFrame:
    """The k nearest per anchor and cell: anchors stream past the base rows of their cell.

    Both sides have ``id, vector``, perhaps ``day``, and ``cell``, a number below ``cells``.
    """

    def side(df: DataFrame, kind: int) -> DataFrame:
        # both ids have a place, as they may differ in type
        names = [F.col("id") if i == kind else F.lit(None).cast(out[1 - i].dataType) for i in range(2)]
        return df.select(
            "cell", F.lit(kind).alias("kind"),
            *(n.alias(name) for n, name in zip(names, ("base_id", "anchor_id"), strict=True)),
            *(c for c in df.columns if c not in ("id", "cell")),
        )

    rows = side(base, 0).unionByName(side(anchors, 1))
    dealt = rows.repartitionById(cells, "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(partial(_stream, k=k, schema=_arrow(out)), out)


def _stream(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of every cell first the base, which is held, then the anchors, batch by batch."""
    cell, parts, held = None, [], None
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        kinds = batch.column("kind").to_numpy()
        change = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for start, end in zip([0, *change.tolist()], [*change.tolist(), len(cells)], strict=True):
            if start == end:
                continue
            if cells[start] != cell:
                cell, parts, held = cells[start], [], None
            part = batch.slice(start, end - start)
            name = "anchor_id" if kinds[start] else "base_id"
            names = ["id", *(c for c in batch.schema.names if c in ("vector", "day"))]
            part = pa.RecordBatch.from_arrays([part.column(name), *(part.column(c) for c in names[1:])], names=names)
            if not kinds[start]:
                parts.append(_unpack(part))
                continue
            if held is None:
                full = [p for p in parts if len(p[0])]
                if len({p[1].shape[1] for p in full}) > 1:
                    raise ValueError(f"vectors of unequal length: {full[-1][0][0]}")
                held = tuple(None if c[0] is None else np.concatenate(c) for c in zip(*full, strict=True)) if full else ()
                parts = []
            if held:
                nearest = _Nearest(_unpack(part), k)
                nearest.add(held)
                yield from nearest.rows(schema).to_batches()
