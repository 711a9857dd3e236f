"""A stream of what changes in a directory tree: each batch scans it anew and emits entries added, changed and removed since the one before."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from larkspur.sources.file_tree import TreePartition, entries, hidden, listed

SCHEMA = "scan long, change string, dir string, name string, is_dir boolean, size long, mtime double"

Entry = tuple[bool, int | None, float]


class ChangePartition(InputPartition):
    """One subtree and the two scans that are compared."""

    def __init__(self, folder: str, deep: bool, before: int, after: int):
        self.folder, self.deep, self.before, self.after = folder, deep, before, after


class TreeChangesReader(DataSourceStreamReader):
    """Offsets are scans by number. A scan is one file of entries for each subtree under option `state`, a folder that all executors share.

    A subtree is walked once for each scan, by the task that needs it; a task that runs again, or a batch that does so
    after a failure, finds the scan written and gives the same rows. Before the first scan there was nothing.
    """

    def __init__(self, options: dict):
        self.top, self.state = (options[k].removeprefix("file://") for k in ("path", "state"))
        self.force = options.get("force", "false").lower() == "true"
        os.makedirs(self.state, exist_ok=True)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"scan": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The scan after the last one that a batch has been planned for."""
        done = [int(n.split(".")[1]) for n in os.listdir(self.state) if n.startswith("planned.")]
        return {"scan": max(done, default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The top folder by itself, and each folder in it with all below, those of the scan before too."""
        before, after = start["scan"], end["scan"]
        there = _read(self._path("planned", after))
        if there is None:
            there = sorted(e.name for e in entries(self.top) if e.is_dir(follow_symlinks=False) and not hidden(e.name))
            _write(self._path("planned", after), there)
        was = _read(self._path("planned", before)) or []
        return [ChangePartition("", False, before, after), *(ChangePartition(f, True, before, after) for f in sorted({*there, *was}))]

    def read(self, partition: ChangePartition) -> Iterator[tuple]:
        new = self._entries(partition, partition.after)
        old = {} if self.force else _read(self._path("scan", partition.before, partition.folder)) or {}
        for where in sorted({*old, *new}):
            a, b = old.get(where), new.get(where)
            change = "added" if a is None else "removed" if b is None else "changed" if a != b else None
            if change:
                folder, name = json.loads(where)
                yield partition.after, change, folder, name, *(b or a)

    def commit(self, end: dict) -> None:
        """Scans before the last one are not needed any more."""
        for n in os.listdir(self.state):
            if n.split(".")[1].isdigit() and int(n.split(".")[1]) < end["scan"]:
                os.remove(os.path.join(self.state, n))

    def _entries(self, partition: ChangePartition, scan: int) -> dict[str, list]:
        at = self._path("scan", scan, partition.folder)
        found = _read(at)
        if found is None:
            rows = listed(self.top, TreePartition(partition.folder, partition.deep))
            found = {json.dumps([folder, name]): [is_dir, size, mtime] for name, folder, is_dir, size, _, mtime in rows if not hidden(f"{folder}/{name}" if folder else name)}
            _write(at, found)
        return found

    def _path(self, kind: str, scan: int, folder: str = "") -> str:
        return os.path.join(self.state, f"{kind}.{scan}.{quote(folder, safe='')[:150]}")


def _read(path: str):
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def _write(path: str, value) -> None:
    """Whole or not at all: written beside its place, then moved there."""
    own = os.path.join(os.path.dirname(path), f"part.x.{os.getpid()}.{abs(hash(path))}")
    with open(own, "w", encoding="utf-8") as f:
        json.dump(value, f)
    os.replace(own, path)


class TreeChanges(DataSource):
    """spark.readStream.format("tree_changes").option("path", ...).option("state", ...).load(); option force: every entry is new in each scan."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TreeChangesReader:  # noqa: N802
        return TreeChangesReader(self.options)


def changes(spark: SparkSession, path: str, state: str, force: bool = False) -> DataFrame:
    """A stream of scan, change (added, changed, removed), dir, name, is_dir, size, mtime below `path`, by the ignore rules of a scan.

    Run it with a processing-time trigger for a scan every so often, or once by availableNow; with its checkpoint it goes
    on after the last scan that was delivered. force: all entries are emitted as added, whatever was seen before.
    `state` belongs to one such stream. A changed entry is one of another size, time or kind.
    """
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("path", path).option("state", state).option("force", str(force)).load()
