"""Joins that spread heavy keys over several tasks.

AQE splits a join partition by its bytes. A key can be small in bytes on both sides
and still make one task produce billions of rows; such keys are split here, by key.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.sinks.scratch import scratch_folder

# rows of a left join that one key may make in one task
PAIRS_PER_TASK = 1_000_000


def heavy_keys(df: DataFrame, key: str, counted: str, rows_per_bucket: int) -> DataFrame:
    """(key, buckets) of the keys with more than ``rows_per_bucket`` rows.

    Every such key is split, however many there are: Spark picks the join by their size.
    ``counted`` is a column that the caller reads as well: the count then shares its
    shuffle.
    """
    sizes = df.groupBy(key).agg(F.count(counted).alias("rows"))
    heavy = sizes.where(F.col("rows") > rows_per_bucket)
    return heavy.select(key, F.ceil(F.col("rows") / rows_per_bucket).alias("buckets"))


def spread_join(
    small: DataFrame, large: DataFrame, key: str, spread_by: str, heavy: DataFrame
) -> DataFrame:
    """``small`` JOIN ``large`` on ``key``.

    Rows of ``large`` with a heavy key go to a bucket by the hash of ``spread_by``;
    the rows of ``small`` with that key are copied to every bucket. The bucket depends
    on values only, so a retried task makes the same ones.
    """
    buckets = F.coalesce("buckets", F.lit(1).cast("bigint"))
    placed = large.join(heavy, key, "left").withColumn(
        "bucket", F.pmod(F.xxhash64(spread_by), buckets)
    )
    copied = small.join(heavy, key, "left").withColumn(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1))
    )
    joined = copied.drop("buckets").join(placed.drop("buckets"), [key, "bucket"])
    return joined.drop("bucket")


def key_grid(
    left_sizes: DataFrame, right_sizes: DataFrame, key: str, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """(key, right_rows, left_buckets, right_buckets) of the keys that one task should not join.

    The sizes are (key, n). A key counts by the product of its rows on both sides. Its grid
    has about ``pairs_per_task`` pairs a cell, and cells as square as the sizes allow, so
    that few copies are made.
    """
    side = isqrt(pairs_per_task)
    left = left_sizes.select(key, F.col("n").alias("left_rows"))
    right = right_sizes.select(key, F.col("n").alias("right_rows"))
    rows = left.join(right, key, "full_outer").na.fill(0, ["left_rows", "right_rows"])
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    rows = rows.where(one("left_rows") * one("right_rows") > pairs_per_task)

    def buckets(own: str, other: str):
        cells = F.ceil(F.col(own) * F.least(one(other), F.lit(side)) / pairs_per_task)
        return F.greatest(cells, F.lit(1)).cast("bigint")

    return rows.select(
        key,
        "right_rows",
        buckets("left_rows", "right_rows").alias("left_buckets"),
        buckets("right_rows", "left_rows").alias("right_buckets"),
    )


def spread_left_join(left: DataFrame, right: DataFrame, key: str, grid: DataFrame) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``key``, the keys of ``grid`` dealt over its cells.

    A left row of such a key has one left bucket and is copied to the key's right buckets;
    a right row the other way round, so each pair meets in one cell. A copy without
    partner is dropped if the key has right rows: the row has partners in another cell.
    Buckets are hashes of the values, so a retried task makes the same ones. The grid is
    written once; its size on disk lets Spark choose how to join it.
    """
    folder = scratch_folder(left.sparkSession, "grid")
    grid.write.parquet(folder)
    grid = left.sparkSession.read.schema(grid.schema).parquet(folder)
    if grid.isEmpty():
        return left.join(right, key, "left")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in df.columns]
        buckets, copies = F.col(f"{own}_buckets"), F.coalesce(f"{other}_buckets", F.lit(1).cast("bigint"))
        bucket = F.when(buckets > 1, F.pmod(F.xxhash64(*columns), buckets)).otherwise(0)
        return (
            df.join(grid, key, "left")
            .withColumn(own, bucket)
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
            .drop("left_buckets", "right_buckets")
        )

    first = dealt(left, "left", "right")
    second = dealt(right, "right", "left").drop("right_rows").withColumn("partner", F.lit(True))
    joined = first.join(second, [key, "left", "right"], "left")
    kept = joined.where(F.col("partner") | (F.coalesce("right_rows", F.lit(0)) == 0))
    return kept.select(*left.columns, *(c for c in right.columns if c != key))
