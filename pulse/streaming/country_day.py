"""The events feed as a stream: raw events and country-day tone, kept up to date.

The same operators as in batch, run incrementally. State is one row of counts per
country-day and is dropped once the day leaves the raw window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulse.config import DEFAULTS, PulseConfig
from pulse.functions.dates import AsOf, as_of_day, first_day, resolved_day
from pulse.operators.ingest import event_rows, ingest_events
from pulse.operators.topics import DAY_COUNTRY
from pulse.sinks.tables import TableStore

DAY_TIME = "event_time"
PART = "batch"
RAW, REJECTED, SUMS = "events_raw", "events_rejected", "country_day_sums"


def stream_raw_events(
    feed: DataFrame, path: str, checkpoint: str, as_of: AsOf = None, cfg: PulseConfig = DEFAULTS
) -> StreamingQuery:
    """Append new feed files to the raw table, partitioned by day; exactly once."""
    return (
        ingest_events(feed, as_of, cfg)
        .writeStream.format("parquet")
        .partitionBy("event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_future_events(
    feed: DataFrame, path: str, checkpoint: str, as_of: AsOf = None, cfg: PulseConfig = DEFAULTS
) -> StreamingQuery:
    """Append events dated after ``as_of``, which the statistics leave out; exactly once."""
    return (
        ingest_events(feed, as_of, cfg)
        .where(F.col("event_date") > as_of_day(as_of))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_country_day(
    feed: DataFrame, path: str, checkpoint: str, as_of: AsOf = None, cfg: PulseConfig = DEFAULTS
) -> StreamingQuery:
    """Keep tone statistics per country-day in ``path``.

    Every micro-batch writes the groups it changed to its own folder. A batch that
    is run again after a failure replaces its folder, so nothing counts twice. The
    watermark is the raw window. Days after ``as_of`` are left out before it, so that a wrong
    date cannot close the days that are still to come; ``stream_future_events`` keeps them.
    """
    located = ingest_events(feed, as_of, cfg).where(
        F.col("country").isNotNull() & (F.col("event_date") <= as_of_day(as_of))
    )
    timed = located.withColumn(DAY_TIME, F.col("event_date").cast("timestamp")).withWatermark(
        DAY_TIME, f"{cfg.raw_days} days"
    )
    changed = timed.groupBy(DAY_TIME, "country").agg(
        F.count("*").alias("headline_count"),
        F.avg("tone").alias("avg_tone"),
        F.min("tone").alias("min_tone"),
        F.max("tone").alias("max_tone"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{PART}={batch_id}")

    return (
        changed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def read_country_day(spark, path: str) -> DataFrame:
    """Current statistics: of each country-day the row of its last batch."""
    row = F.struct("headline_count", "avg_tone", "min_tone", "max_tone")
    return (
        spark.read.parquet(path)
        .withColumn("event_date", F.to_date(DAY_TIME))
        .groupBy(*DAY_COUNTRY)
        .agg(F.max_by(row, PART).alias("last"))
        .select(*DAY_COUNTRY, "last.*")
    )


def country_day_sums(events: DataFrame) -> DataFrame:
    """Sums of events per country-day that can be added to those of other events."""
    return events.where(F.col("country").isNotNull()).groupBy(*DAY_COUNTRY).agg(
        F.count("*").alias("headline_count"),
        F.count("tone").alias("tone_count"),
        F.sum("tone").alias("tone_sum"),
        F.min("tone").alias("min_tone"),
        F.max("tone").alias("max_tone"),
    )


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sums of two sets of events from the sums of each."""
    total = [F.sum(c).alias(c) for c in ("headline_count", "tone_count", "tone_sum")]
    ends = [F.min("min_tone").alias("min_tone"), F.max("max_tone").alias("max_tone")]
    return old.unionByName(new).groupBy(*DAY_COUNTRY).agg(*total, *ends)


def stream_to_tables(
    feed: DataFrame,
    store: TableStore,
    checkpoint: str,
    as_of: AsOf = None,
    cfg: PulseConfig = DEFAULTS,
    stream: str = "events",
    compact_every: int = 16,
    keep_versions: int = 4,
) -> StreamingQuery:
    """The feed as tables of the store: raw events, rejected ones, and sums per country-day.

    One pass over the feed. Events after ``as_of`` and before the raw window are rejected with
    their reason, so a wrong day neither closes nor reopens another. Sums are merged into the
    days that a batch has events of, late ones included. Every table takes a batch
    once, by its number: a batch that is run again after a failure adds nothing. Days that
    left the raw window are dropped; raw days are rewritten as one folder every
    ``compact_every`` batches, and files of older versions are deleted.
    """
    day = resolved_day(store.spark, as_of)
    date = F.col("event_date")
    reason = (
        F.when(date.isNull(), "no day").when(date > F.lit(day), "future").when(date < first_day(day, cfg.raw_days), "late")
    )

    def write(batch: DataFrame, number: int) -> None:
        events = batch.persist()
        try:
            good = events.where(F.col("reason").isNull())
            store.append(REJECTED, events.where(F.col("reason").isNotNull()), stream, number)
            store.append(RAW, good, stream, number)
            store.merge(SUMS, country_day_sums(good), stream, number, added)
        finally:
            events.unpersist()
        for name in (RAW, SUMS):
            store.expire(name, day, cfg.raw_days)
        if number % compact_every == compact_every - 1:
            store.compact(RAW)
            store.compact(REJECTED)
        for name in (RAW, REJECTED, SUMS):
            store.vacuum(name, keep_versions)

    return (
        event_rows(feed).withColumn("reason", reason)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def country_day_statistics(store: TableStore) -> DataFrame:
    """Tone per country-day from the sums."""
    sums = store.read(SUMS)
    mean = F.when(F.col("tone_count") > 0, F.col("tone_sum") / F.col("tone_count"))
    return sums.select(*DAY_COUNTRY, "headline_count", mean.alias("avg_tone"), "min_tone", "max_tone")
