"""What a run has finished: a step whose inputs did not change is not run again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from pulse.sinks.tables import TableStore

TABLE = "_steps"


def fingerprint(*parts: object) -> str:
    """A digest of values that print the same when they are equal."""
    return hashlib.sha256(json.dumps([repr(p) for p in parts]).encode()).hexdigest()


def files_of(feed: DataFrame) -> str:
    """A digest of the files a feed is read from. Feeds without files need a version of their own."""
    return fingerprint(sorted(feed.inputFiles()))


class Ledger:
    """Finished steps of a store under a root, one small file each.

    A step is known by its table and has a fingerprint of all it was made of: parameters,
    feeds, and the versions of the tables it read. The file is written after the table's
    version, so a run that dies between the two makes the step once more and no reader
    sees half a table.
    """

    def __init__(self, store: TableStore):
        if not store.root:
            raise ValueError("a ledger needs a store under a root: catalog tables have no versions")
        self.store = store
        self.ran: list[str] = []

    def version(self, name: str) -> int:
        return self.store.manifest(name).number

    def step(self, name: str, made_of: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table as it stands if it was made of the same, else ``make`` runs and its table is returned."""
        done = self._read(name)
        if done and done["made_of"] == made_of and done["version"] == self.version(name):
            return self.store.read(name, done["version"])
        table = make()
        self.ran.append(name)
        self._write(name, {"made_of": made_of, "version": self.version(name)})
        return table

    def _file(self, name: str):
        path = f"{self.store.root.rstrip('/')}/{TABLE}/{name}.json"
        jvm = self.store.spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(path)
        return path.getFileSystem(self.store.spark._jsc.hadoopConfiguration()), path

    def _read(self, name: str) -> dict | None:
        fs, path = self._file(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError:  # a run died while it wrote: the step is made again
            return None
        finally:
            stream.close()

    def _write(self, name: str, done: dict) -> None:
        fs, path = self._file(name)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(json.dumps(done).encode()))
        finally:
            stream.close()
