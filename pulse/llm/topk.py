"""Exact inner-product search with buckets of vectors of similar length.

Vectors become integers, floor(1024 x), and rows with equal ids and integers are one row. Base
rows are dealt by a hash of id and integers into blocks, so that no id gathers in one; inside a block they are sorted by length and cut into buckets. The queries, in blocks, meet
every base block once. A query walks a block's buckets from the longest vectors on and keeps
its best ``k`` ids, each with its best row; the k-th score so far over (length of the query x longest length of the
bucket) is the cosine a vector there must reach:

* over 1, the rest of the block is skipped;
* from ``COORDINATE`` on, the query's largest coordinate bounds that coordinate of any
  vector within the cosine; candidates are found in the bucket's sorted coordinate;
* below, only vectors shorter than score over query length are skipped.

Candidates are verified by integer products, so the result is exact. A query's best of all
blocks are ranked at the end.

Null vectors, vectors with a null or non-finite component and rows with a null id take no
part. Vectors are compared with those of the same dimension only. Rows with equal ids are one
candidate with the best of their scores, and never a candidate of the query with that id.
Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import stored

K = 10
BLOCK_ROWS = 32_768
QUERY_ROWS = 1024
BUCKET_ROWS = 1024
LEAST_BLOCKS = 12
COORDINATE = 0.6
_PACKED = "block int, dim int, ids binary, vectors binary"


def _pack(key, table):
    ids = np.asarray(table.column("id").combine_chunks()).astype(np.int64)
    vectors = np.asarray(table.column("v").combine_chunks().flatten()).astype(np.int64)
    return pa.table(
        {
            "block": pa.array([key[0].as_py()], pa.int32()),
            "dim": pa.array([key[1].as_py()], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
        }
    )


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    block = F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias("block")
    return rows.select(block, F.size("v").alias("dim"), "id", "v").groupBy("block", "dim").applyInArrow(_pack, _PACKED)


def search_block(base_ids, base, query_ids, queries, k: int = K):
    """Best k ids of a base block for every query: (query row, id, score) arrays."""
    length = np.sqrt((base.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((base_ids, -length))
    base_ids, base, length = base_ids[order], base[order].astype(np.float64), length[order]
    wide = len(base) and len(queries) and np.abs(base).max() * np.abs(queries).max() * base.shape[1] >= 2**53
    whole = base.astype(np.int64) if wide else base  # products stay exact
    own = queries.astype(np.int64 if wide else np.float64)
    size = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    best = [(np.zeros(0, np.int64), np.zeros(0, own.dtype)) for _ in queries]
    bound = np.full(len(queries), -np.inf)
    repeated = len(np.unique(base_ids)) < len(base_ids)

    def offer(q, rows, scores):
        keep = (base_ids[rows] != query_ids[q]) & (scores >= bound[q])
        ids, values = np.concatenate([best[q][0], base_ids[rows[keep]]]), np.concatenate([best[q][1], scores[keep]])
        top = np.lexsort((ids, -values))
        if repeated:  # the first of an id is its best row
            top = top[np.sort(np.unique(ids[top], return_index=True)[1])]
        top = top[:k]
        best[q] = ids[top], values[top]
        if len(top) == k:
            bound[q] = values[top[-1]]

    live = np.arange(len(queries))
    for lo in range(0, len(base), BUCKET_ROWS):
        hi = min(lo + BUCKET_ROWS, len(base))
        longest = length[lo]
        reach = size[live] * longest
        live = live[reach * (1 + 1e-9) + 1e-6 >= bound[live]]
        if not len(live):
            break
        reach = size[live] * longest
        cosine = np.where((reach > 0) & np.isfinite(bound[live]), bound[live] / np.maximum(reach, 1e-30), -1.0) - 1e-9
        by_coordinate = cosine >= COORDINATE
        for q, c in zip(live[by_coordinate], cosine[by_coordinate], strict=True):
            f = int(np.abs(queries[q]).argmax())
            # where vectors of the bucket can lie along f (turned so that the query's is positive)
            sign = 1.0 if queries[q, f] >= 0 else -1.0
            along = sign * base[lo:hi, f] / np.maximum(length[lo:hi], 1e-30)
            rank = np.argsort(along)
            at = abs(queries[q, f]) / size[q]
            spread = np.sqrt(max(0.0, (1 - c * c) * (1 - at * at))) + 1e-9
            highest = at * c + spread if c > at else 1.0
            low, high = np.searchsorted(along[rank], [at * c - spread, highest + 1e-9])
            rows = lo + rank[low:high]
            if len(rows):
                offer(q, rows, whole[rows] @ own[q])
        rest = live[~by_coordinate]
        if len(rest):
            scores = whole[lo:hi] @ own[rest].T
            for j, q in enumerate(rest):
                cut = hi - lo
                if np.isfinite(bound[q]) and bound[q] > 0 and size[q] > 0:  # shorter ones cannot reach it
                    need = bound[q] / size[q] * (1 - 1e-9)
                    cut = int(np.searchsorted(-length[lo:hi], -need, side="right"))
                rows = np.flatnonzero(scores[:cut, j] >= bound[q])
                if len(rows):
                    offer(q, lo + rows, scores[rows, j])
    counts = [len(b[0]) for b in best]
    return np.repeat(np.arange(len(queries)), counts), *(
        (np.concatenate([b[i] for b in best]) if best else np.zeros(0)) for i in (0, 1)
    )


def _search(key, table):
    out = [[], [], []]
    read = lambda x, dim: np.frombuffer(x, np.int64).reshape(-1, dim)
    for dim, qi, qv, bi, bv in zip(*(table.column(c).to_pylist() for c in ("dim", "qi", "qv", "ids", "vectors")), strict=True):
        query_ids = np.frombuffer(qi, np.int64)
        row, ids, scores = search_block(np.frombuffer(bi, np.int64), read(bv, dim), query_ids, read(qv, dim))
        for part, values in zip(out, (query_ids[row], ids, scores.astype(np.int64)), strict=True):
            part.append(values)
    whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), whole, strict=True)})


def top_products(
    base: DataFrame, is_query: Column, id_col="vec_id", vector_col="embedding", k: int = K
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of ``base`` for its query rows."""
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = sound & F.forall(vector_col, value)
    rows = base.filter(sound)
    whole = F.transform(vector_col, lambda x: F.floor(1024 * x.cast("double")).cast("long"))
    plain = lambda df: df.select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).distinct()
    n = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks = max(1, -(-n.n // BLOCK_ROWS), min(-(-n.n // BUCKET_ROWS), LEAST_BLOCKS))
    packed = stored(_blocks(plain(rows), blocks), "blocks")
    asked = _blocks(plain(rows.filter(is_query)), max(1, -(-n.q // QUERY_ROWS))).select(
        F.col("block").alias("qb"), "dim", F.col("ids").alias("qi"), F.col("vectors").alias("qv"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    met = asked.join(packed.hint("merge"), ["block", "dim"]).groupBy("block", "dim", "qb")
    found = met.applyInArrow(_search, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth one."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum(list_transform(list_zip(q.e, p.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q, v p WHERE q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
