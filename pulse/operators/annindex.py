"""Approximate cosine top-k from a stored index of nearest centroids.

The centroids come from k-means on a bounded sample; every row of the base is assigned to the
nearest one and stored, partitioned by cell. A search looks into the ``probes``
cells nearest to each anchor and ranks what lies there by exact distance, so distances are
exact and only neighbours in other cells can be missed. Cells that hold more than a task
should are cut into parts; each anchor of the cell meets all of them.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.operators import knn
from pulse.operators.ranking import first_n_per_group

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# rows that k-means is fitted on, at most; all rows are indexed
SAMPLE_ROWS = 50_000
MAX_CELLS = 4096
ROUNDS = 12
# rows of a cell that one task holds
PART_ROWS = 100_000


@dataclass(frozen=True)
class CellIndex:
    """A stored index: ``id, vector, cell`` by cell, the centroids, and the rows of every cell."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    sizes: np.ndarray

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")


def build_index(
    base: DataFrame, path: str, *, id: str = "id", vector: str = "embedding", cells: int | None = None
) -> CellIndex:
    """Index all rows of ``base`` whose vector has a cosine; ids are unique.

    ``cells`` defaults to the square root of the number of rows, at most ``MAX_CELLS``.
    """
    spark = base.sparkSession
    rows = knn._prepared(base, id, vector, None)
    n = rows.count()
    cells = max(1, min(cells or round(n**0.5), MAX_CELLS))
    # the sample with the least hashes: the same rows on every run
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    centroids = _centroids(knn._unpack(sample)[1], cells)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    assigned = rows.mapInArrow(partial(_assign, centroids=centroids, probes=1), schema)
    assigned.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    return open_index(spark, path, centroids)


def open_index(spark: SparkSession, path: str, centroids: np.ndarray | None = None) -> CellIndex:
    """A stored index; ``centroids`` are stored beside the rows when they are given."""
    if centroids is not None:
        stored = [(i, c.tolist()) for i, c in enumerate(centroids)]
        spark.createDataFrame(stored, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    # at most MAX_CELLS rows
    found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    sizes = np.zeros(len(found), np.int64)
    try:
        counted = spark.read.parquet(f"{path}/rows").groupBy("cell").count().collect()
    except Exception as e:  # an empty base writes no file
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        counted = []
    for cell, count in counted:
        sizes[cell] = count
    return CellIndex(spark, path, np.array([r.centroid for r in found]), sizes)


def search_index(
    index: CellIndex,
    anchors: DataFrame,
    k: int,
    *,
    probes: int = 8,
    id: str = "id",
    anchor_id: str = "anchor_id",
    anchor_vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, ``id``, distance, rank): the k nearest in the cells probed per anchor."""
    right = knn._prepared(anchors, anchor_id, anchor_vector, None)
    anchor_type = right.schema["id"].dataType
    schema = T.StructType([*right.schema.fields, T.StructField("cell", T.IntegerType())])
    probed = right.mapInArrow(partial(_assign, centroids=index.centroids, probes=probes), schema)
    if not index.sizes.sum():
        empty = T.StructType([
            T.StructField("anchor_id", anchor_type), T.StructField(id, T.StringType()),
            T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType()),
        ])
        return index.spark.createDataFrame([], empty)
    # parts of cells are numbered through; a cell's anchors are copied to all of its parts
    parts = np.maximum(1, -(-index.sizes // PART_ROWS))
    first = np.cumsum(parts) - parts
    numbers = F.array(*(F.lit(int(x)) for x in first))
    many = F.array(*(F.lit(int(x)) for x in parts))
    at = lambda array: F.element_at(array, F.col("cell") + 1)
    # at most MAX_CELLS numbers: only the cells that are probed are read
    needed = [r.cell for r in probed.select("cell").distinct().collect()]
    rows = index.rows().where(F.col("cell").isin(needed))
    held = rows.select("id", "vector", (at(numbers) + F.pmod(F.xxhash64("id"), at(many)).cast("int")).alias("cell"))
    passing = probed.select(
        "id", "vector", F.explode(F.sequence(at(numbers), at(numbers) + at(many) - 1)).alias("cell")
    )
    out = T.StructType([
        T.StructField("anchor_id", anchor_type), T.StructField("id", rows.schema["id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
    found = knn.met(held, passing, int(parts.sum()), k, out)
    best = first_n_per_group(found, ["anchor_id"], [F.col("distance"), F.col("id")], k)
    return best.withColumnRenamed("id", id)


def scored_rows(index: CellIndex, anchors: DataFrame, probes: int, anchor_id: str = "anchor_id", anchor_vector: str = "embedding") -> DataFrame:
    """(anchor_id, rows): how many rows a search ranks for each anchor."""
    right = knn._prepared(anchors, anchor_id, anchor_vector, None)
    schema = T.StructType([*right.schema.fields, T.StructField("cell", T.IntegerType())])
    probed = right.mapInArrow(partial(_assign, centroids=index.centroids, probes=probes), schema)
    sizes = F.array(*(F.lit(int(x)) for x in index.sizes))
    return probed.groupBy(F.col("id").alias("anchor_id")).agg(F.sum(F.element_at(sizes, F.col("cell") + 1)).alias("rows"))


def _centroids(unit: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means, started from rows spread over the sample."""
    if not len(unit):
        return np.zeros((1, 1))
    cells = min(cells, len(unit))
    centroids = unit[np.linspace(0, len(unit) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(unit, -(-len(unit) // 4096))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        # a centroid without rows stays where it is
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def _assign(batches, centroids: np.ndarray, probes: int):
    """Every row once for each of its nearest cells (ties: the lesser number)."""
    for batch in batches:
        ids, unit, _ = knn._unpack(batch)
        if not len(ids):
            continue
        if unit.shape[1] != centroids.shape[1]:
            raise ValueError(f"vector of {ids[0]} and the centroids differ in length")
        order = np.argsort(-np.round(unit @ centroids.T, 9), axis=1, kind="stable")[:, :probes]
        n = order.shape[1]
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(unit, n, axis=0).ravel()), unit.shape[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(ids, n).tolist(), batch.schema.field("id").type),
                vectors.cast(pa.list_(pa.float64())),
                pa.array(order.ravel().astype(np.int32)),
            ],
            names=["id", "vector", "cell"],
        )
