"""A stream source for files that are written again and again, such as a run's checkpoint.

Spark's file source remembers paths, so a rewritten file is never seen again.  This one tells versions
apart by (path, time of change, size).  Each look copies the versions that are new into a spool folder
under running numbers, and an offset is the last number; a batch is read from the spool, so it can be
replayed after a restart although the file has been rewritten since.  What Spark has committed leaves
the spool.  The spool must lie in a folder that the executors share.

Bounds: the ledger holds a line a watched file, and a version is one row; both are meant for files like
checkpoints, of which there is one a run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from factloom.sources import files

SCHEMA = "version long, path string, modified_ns long, size long, value string"
#: Versions that one task reads.
_TASK = 64


@dataclass
class _Versions(InputPartition):
    first: int
    last: int


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, names: str, spool: str):
        self.folder, self.names, self.spool = folder, names, spool

    def _ledger(self) -> dict:
        held = files.read(files.join(self.spool, "ledger.json"))
        return json.loads(held) if held else {"last": 0, "files": {}}

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        ledger = self._ledger()
        before = ledger["last"]
        for name, (modified, size) in sorted(files.listed(self.folder, self.names).items(), key=lambda f: (f[1], f[0])):
            if ledger["files"].get(name) == [modified, size]:
                continue
            path = files.join(self.folder, name)
            value = files.read(path)
            if value is None or files.listed(self.folder, name).get(name) != (modified, size):
                continue  # it is being rewritten: the next look takes it
            ledger["last"] += 1
            row = {"version": ledger["last"], "path": path, "modified_ns": modified, "size": size, "value": value.decode("utf-8", "replace")}
            files.write(files.join(self.spool, f"{ledger['last']:012d}.json"), json.dumps(row).encode())
            ledger["files"][name] = [modified, size]
        if ledger["last"] > before:
            # The copies are there before the number that stands for them.
            files.write(files.join(self.spool, "ledger.json"), json.dumps(ledger).encode())
        return {"version": ledger["last"]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = start["version"] + 1, end["version"]
        return [_Versions(at, min(at + _TASK - 1, last)) for at in range(first, last + 1, _TASK)]

    def read(self, partition: _Versions) -> Iterator[tuple]:
        for version in range(partition.first, partition.last + 1):
            row = json.loads(files.read(files.join(self.spool, f"{version:012d}.json")))
            yield tuple(row[c] for c in ("version", "path", "modified_ns", "size", "value"))

    def commit(self, end: dict) -> None:
        for name in files.listed(self.spool, "[0-9]*.json"):
            if int(name.split(".")[0]) <= end["version"]:
                files.delete(files.join(self.spool, name))


class RewrittenFiles(DataSource):
    """``spark.readStream.format("rewritten_files")`` with the options path, names and spool."""

    @classmethod
    def name(cls) -> str:
        return "rewritten_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("names", "*"), self.options["spool"])


def watch(spark: SparkSession, folder: str, spool: str, names: str = "*.json") -> DataFrame:
    """(version, path, modified_ns, size, value): a row for each version of each matching file that a look has seen."""
    spark.dataSource.register(RewrittenFiles)
    return spark.readStream.format("rewritten_files").option("path", folder).option("names", names).option("spool", spool).load()
