"""Table store: overwrite, replace days, append, read, expire and export.

Tables are catalog tables of a database, or folders under a root. A folder has its data under
``data/version=.../`` and a log of manifests. A manifest names, day by day, the
folders that make up the table. Every change writes its files to a folder of its own and
becomes visible when its manifest is renamed into the log; a job that dies before that
changes nothing, and a reader keeps the version it began with. Files that no kept version
names are deleted by ``vacuum`` alone.

There is one writer per table at a time; a second one that commits in between makes the
first raise.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.dates import AsOf, first_day, resolved_day
from pulse.schemas import STREAM_TABLES, TABLES, conform

DAY = "event_date"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
SCHEMAS = {**TABLES, **STREAM_TABLES}
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"

# partition by day; sort by country inside a file, or leave it
PARTITIONED_SORTED = {
    "events_raw", "events_enriched", "daily_country_topics", "daily_top_entities", "daily_analogs",
    "country_day_sums",
}
PARTITIONED = {"daily_briefings", "daily_mood", "events_rejected"}


def laid_out(df: DataFrame, sort_by: list[str] | None) -> DataFrame:
    """Rows of one day together in right-sized, sorted partitions.

    REBALANCE lets AQE split a day that holds more than its share and merge small
    ones; a plain repartition by day would give the heaviest day to one task.
    """
    df = df.hint("rebalance", DAY)
    return df.sortWithinPartitions(DAY, *sort_by) if sort_by else df


class ConcurrentWrite(RuntimeError):
    """Another writer committed a version of the table first."""


@dataclass
class Manifest:
    """One version of a table: its folders by day ('' for tables without days), and the
    last batch of every stream that appends to it."""

    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def paths(self) -> list[str]:
        return [
            f"{folder}/{DAY}={day}" if day else folder
            for day, folders in sorted(self.folders.items()) for folder in folders
        ]


@dataclass(frozen=True)
class TableStore:
    spark: SparkSession
    root: str | None = None
    database: str | None = None

    def __post_init__(self):
        if bool(self.root) == bool(self.database):
            raise ValueError("give either root or database")

    def create(self) -> None:
        """Create the namespace if it is not there."""
        if self.database:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(self.database)}")

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    # --- writing -----------------------------------------------------------------
    def overwrite(self, name: str, df: DataFrame) -> DataFrame:
        """Replace the table and return it as read back.

        Reading it back cuts the lineage: later steps start from files that
        outlive any executor.
        """
        df = self._laid_out(name, df)
        if self.database:
            writer = df.write.format("parquet").mode("overwrite")
            if _by_day(name):
                writer = writer.partitionBy(DAY)
            writer.saveAsTable(self._table(name))
            return self.read(name)
        last = self.manifest(name)
        folder = self._staged(name, df)
        return self._switched(name, last, {day: [folder] for day in self._days_in(name, folder)})

    def replace_days(self, name: str, df: DataFrame, days: Iterable[dt.date] = ()) -> DataFrame:
        """Replace the days that ``df`` has rows of, and ``days``; all others stay as they are."""
        if not _by_day(name):
            raise ValueError(f"{name} has no days")
        emptied = {day.isoformat() for day in days}
        if self.database:
            return self._replace_partitions(name, df, emptied)
        last = self.manifest(name)
        folder = self._staged(name, self._laid_out(name, df))
        fresh = {day: [folder] for day in self._days_in(name, folder)}
        kept = {day: f for day, f in last.folders.items() if day not in emptied}
        return self._switched(name, last, {**kept, **fresh})

    def append(self, name: str, df: DataFrame, stream: str, batch: int) -> None:
        """Add the rows of a stream's batch; a batch that is in the table already changes nothing."""
        last = self._appendable(name, stream, batch)
        if last is None:
            return
        folder = self._staged(name, self._laid_out(name, df), f"{stream}-{batch}")
        folders = {day: list(f) for day, f in last.folders.items()}
        for day in self._days_in(name, folder):
            folders.setdefault(day, []).append(folder)
        self._commit(name, last, folders, {**last.batches, stream: batch})

    def merge(self, name: str, df: DataFrame, stream: str, batch: int, combined) -> None:
        """Combine a batch with the rows of the same days; once per batch, like ``append``.

        ``combined`` makes the new rows of these days from the old ones and the batch's.
        Only days of the batch are read and written, so the table has one folder a day.
        """
        last = self._appendable(name, stream, batch)
        if last is None:
            return
        staged = self._staged(name, df, f"{stream}-{batch}-in")
        days = self._days_in(name, staged)
        old = self._read(name, Manifest(0, {d: last.folders[d] for d in days if d in last.folders}))
        new = self._read(name, Manifest(0, {d: [staged] for d in days}))
        folder = self._staged(name, self._laid_out(name, combined(old, new)), f"{stream}-{batch}")
        folders = {**last.folders, **{d: [folder] for d in self._days_in(name, folder)}}
        self._commit(name, last, folders, {**last.batches, stream: batch})

    def compact(self, name: str) -> list[str]:
        """Rewrite the days that lie in several folders as one; returns them."""
        many = [d for d, f in self.manifest(name).folders.items() if len(f) > 1 and d != NO_DAY]
        if many:
            days = [dt.date.fromisoformat(d) for d in many]
            self.replace_days(name, self.read(name).where(F.col(DAY).isin(days)))
        return sorted(many)

    def expire(self, name: str, as_of: AsOf = None, days: int = 60) -> list[str]:
        """Drop the days older than ``days``; data files are not rewritten.

        A metadata operation on the list of days. Returns the dropped days. ``as_of`` defaults
        to the session's current day.
        """
        oldest = resolved_day(self.spark, as_of) - dt.timedelta(days=days)
        if self.database:
            old = [d for d in self._partitions(name) if d < oldest]
            self._drop_partitions(name, old)
            return sorted(d.isoformat() for d in old)
        last = self.manifest(name)
        old = [d for d in last.folders if d and d != NO_DAY and dt.date.fromisoformat(d) < oldest]
        if old:
            self._commit(name, last, {d: f for d, f in last.folders.items() if d not in old}, last.batches)
        return sorted(old)

    def vacuum(self, name: str, keep: int = 1) -> list[str]:
        """Delete the files and manifests that only versions before the last ``keep`` name.

        Staged folders of jobs that died go as well, so no write may be under way.
        """
        numbers = self.versions(name)
        kept = [self.manifest(name, n) for n in numbers[-keep:]]
        named = {folder.split("/")[0] for m in kept for folders in m.folders.values() for folder in folders}
        fs, log = self._folder(name, "_log")
        for n in numbers[:-keep]:
            fs.delete(self._path(f"{log}/{n:020d}.json"), False)
        fs, data = self._folder(name, "data")
        gone = [f for f in self._names(name, "data") if f not in named]
        for folder in gone:
            fs.delete(self._path(f"{data}/{folder}"), True)
        return sorted(gone)

    # --- reading -----------------------------------------------------------------
    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as it is now, or as a version was."""
        if self.database:
            return self.spark.table(self._table(name)).select(SCHEMAS[name].fieldNames())
        found = self.manifest(name, version)
        if not found.number:
            raise FileNotFoundError(f"no table {name} under {self.root}")
        return self._read(name, found)

    def exists(self, name: str) -> bool:
        if self.database:
            return self.spark.catalog.tableExists(f"{self.database}.{name}")
        return bool(self.versions(name))

    def versions(self, name: str) -> list[int]:
        """Numbers of the versions that are still there."""
        return sorted(int(f[:-5]) for f in self._names(name, "_log") if f.endswith(".json"))

    def manifest(self, name: str, version: int | None = None) -> Manifest:
        """The last version, or a given one; number 0 if there is none."""
        if version is None:
            version = max(self.versions(name), default=0)
        if not version:
            return Manifest()
        fs, log = self._folder(name, "_log")
        stream = fs.open(self._path(f"{log}/{version:020d}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Manifest(version, found["folders"], found["batches"])

    def _read(self, name: str, manifest: Manifest) -> DataFrame:
        schema = SCHEMAS[name]
        data = f"{self.path(name)}/data"
        paths = [f"{data}/{p}" for p in manifest.paths()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.option("basePath", data).schema(schema).parquet(*paths)
        return found.select(schema.fieldNames())

    # --- folders and manifests ---------------------------------------------------------
    def _laid_out(self, name: str, df: DataFrame) -> DataFrame:
        df = conform(df, SCHEMAS[name])
        if not _by_day(name):
            return df
        return laid_out(df, ["country"] if name in PARTITIONED_SORTED else None)

    def _staged(self, name: str, df: DataFrame, token: str | None = None) -> str:
        """Write the rows to a folder that no version names yet."""
        folder = f"version={token or uuid.uuid4().hex}"
        writer = conform(df, SCHEMAS[name]).write.mode("overwrite")
        if _by_day(name):
            writer = writer.partitionBy(DAY)
        writer.parquet(f"{self.path(name)}/data/{folder}")
        return folder

    def _days_in(self, name: str, folder: str) -> list[str]:
        if not _by_day(name):
            return [""]
        names = self._names(name, f"data/{folder}")
        return [n.partition("=")[2] for n in names if n.startswith(f"{DAY}=")]

    def _appendable(self, name: str, stream: str, batch: int) -> Manifest | None:
        """The version to add a batch to; none if it has it."""
        if self.database or not _by_day(name):
            raise ValueError("streams append to tables by day under a root")
        last = self.manifest(name)
        return None if last.batches.get(stream, -1) >= batch else last

    def _switched(self, name: str, last: Manifest, folders: dict[str, list[str]]) -> DataFrame:
        self._commit(name, last, folders, last.batches)
        return self.read(name)

    def _commit(self, name: str, last: Manifest, folders: dict[str, list[str]], batches: dict[str, int]) -> None:
        """Make a version visible: its manifest is written aside and renamed."""
        fs, log = self._folder(name, "_log")
        fs.mkdirs(self._path(log))
        final, aside = self._path(f"{log}/{last.number + 1:020d}.json"), self._path(f"{log}/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps({"folders": folders, "batches": batches}).encode()))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise ConcurrentWrite(f"{name} has a version {last.number + 1} already")

    def _names(self, name: str, inner: str) -> list[str]:
        fs, path = self._folder(name, inner)
        path = self._path(path)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _folder(self, name: str, inner: str):
        path = f"{self.path(name)}/{inner}"
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    # --- catalog tables ----------------------------------------------------------------
    def _table(self, name: str) -> str:
        return f"{_quoted(self.database)}.{_quoted(name)}"

    def _replace_partitions(self, name: str, df: DataFrame, emptied: set[str]) -> DataFrame:
        df = self._laid_out(name, df)
        if not self.exists(name):
            return self.overwrite(name, df)
        self._drop_partitions(name, [dt.date.fromisoformat(d) for d in emptied])
        columns = [c for c in df.columns if c != DAY]
        # insertInto takes the mode from the session alone
        before = self.spark.conf.get(OVERWRITE_MODE)
        self.spark.conf.set(OVERWRITE_MODE, "dynamic")
        try:
            df.select(*columns, DAY).write.mode("overwrite").insertInto(self._table(name))
        finally:
            self.spark.conf.set(OVERWRITE_MODE, before)
        return self.read(name)

    def _partitions(self, name: str) -> list[dt.date]:
        rows = self.spark.sql(f"SHOW PARTITIONS {self._table(name)}").toLocalIterator()
        days = (row[0].partition("=")[2] for row in rows)
        return [dt.date.fromisoformat(d) for d in days if d != NO_DAY]

    def _drop_partitions(self, name: str, days: Iterable[dt.date]) -> None:
        for day in days:
            self.spark.sql(f"ALTER TABLE {self._table(name)} DROP IF EXISTS PARTITION ({DAY} = DATE '{day.isoformat()}')")


def _by_day(name: str) -> bool:
    return name in PARTITIONED_SORTED or name in PARTITIONED


def unexpired(df: DataFrame, as_of: AsOf = None, days: int = 60) -> DataFrame:
    """Rows young enough to be kept, for stores without partitions."""
    return df.where(F.col(DAY) >= first_day(as_of, days))


def export(df: DataFrame, path: str, format: str = "json") -> None:
    """Write a feed for a client (JSON lines, CSV or Parquet); nothing is collected."""
    df.write.format(format).mode("overwrite").save(path)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
