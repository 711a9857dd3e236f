"""A Spark data source that lists a directory tree: one row for each file and each folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf

from larkspur.operators.catalog import IGNORED_NAMES, IGNORED_PATHS, ignored_name, ignored_path, safe_path

SCHEMA = "name string, dir string, is_dir boolean, size long, ctime double, mtime double"


def hidden(folder: str) -> bool:
    """Whether an ignore rule drops a folder with all below it; such folders aren't entered."""
    return folder.startswith(IGNORED_PATHS) or "__pycache__" in folder or folder.rpartition("/")[2].startswith(IGNORED_NAMES)


class TreePartition(InputPartition):
    """The entries of one folder, with or without what lies below it."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class FileTreeReader(DataSourceReader):
    """Lists the folder of option `path` (seen by all executors); the folders of the first levels (option `depth`) are partitions of their own."""

    def __init__(self, options: dict):
        self.top, self.depth = options["path"].removeprefix("file://"), int(options.get("depth", 2))

    def partitions(self) -> list[TreePartition]:
        """The folders of the first levels one by one, and those of level `depth` (2) with all below them."""
        found, level = [TreePartition("", False)], [""]
        for d in range(self.depth):
            below = [f"{f}/{e.name}" if f else e.name for f in level for e in entries(os.path.join(self.top, f)) if e.is_dir(follow_symlinks=False)]
            level = sorted(f for f in below if not hidden(f))
            found += [TreePartition(f, d == self.depth - 1) for f in level]
        return found

    def read(self, partition: TreePartition) -> Iterator[tuple]:
        return listed(self.top, partition)


def listed(top: str, partition: TreePartition) -> Iterator[tuple]:
    """name, dir, is_dir, size, ctime and mtime of the entries of a partition."""
    waiting = [partition.folder]
    while waiting:
        folder = waiting.pop()
        for e in entries(os.path.join(top, folder)):
            try:
                at, is_dir = e.stat(follow_symlinks=False), e.is_dir(follow_symlinks=False)
            except OSError:
                continue
            yield e.name, folder, is_dir, None if is_dir else at.st_size, getattr(at, "st_birthtime", at.st_ctime), at.st_mtime
            if is_dir and partition.deep and not hidden(f"{folder}/{e.name}"):
                waiting.append(f"{folder}/{e.name}")


def entries(folder: str) -> list[os.DirEntry]:
    """Entries of a folder; none of one that can't be read."""
    try:
        with os.scandir(folder) as found:
            return list(found)
    except OSError:
        return []


class FileTree(DataSource):
    """spark.read.format("file_tree").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(self.options)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files and folders below `path` that no ignore rule drops: name, dir, is_dir, size, ctime and mtime (whole seconds).

    Links are not followed, what can't be read is left out, and empty folders are listed as any other. A folder is
    dropped with all below it.
    """
    spark.dataSource.register(FileTree)
    rows = spark.read.format("file_tree").load(path)
    folder = F.when(F.col("is_dir"), F.concat_ws("/", F.nullif("dir", F.lit("")), "name")).otherwise(F.col("dir"))
    hidden = F.exists(F.split("dir", "/"), ignored_name) | ignored_name(F.col("name"))
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    kept = rows.where(~hidden & ~F.exists(above, ignored_path))
    return kept.select("name", "dir", "is_dir", "size", F.col("ctime").cast("long").alias("ctime"), F.col("mtime").cast("long").alias("mtime"))


def served(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """`requests` (path) with status and size: what a server of the folder `path` would answer.

    "missing": an empty or reserved path, or one with two dots in a row, or no file; "denied": the path, links followed,
    leads out of the folder; "found": a file, with its size. Null paths are missing. Executors see the folder.
    """
    top = os.path.realpath(path.removeprefix("file://"))

    @pandas_udf("status string, size long")
    def look(paths: pd.Series) -> pd.DataFrame:
        def one(p: str | None) -> tuple[str, int | None]:
            if not p or "\0" in p:
                return "missing", None
            real = os.path.realpath(os.path.join(top, p))
            if real != top and not real.startswith(top.rstrip(os.sep) + os.sep):
                return "denied", None
            return ("found", os.path.getsize(real)) if os.path.isfile(real) else ("missing", None)

        return pd.DataFrame([one(p) for p in paths], columns=["status", "size"]).astype({"size": "Int64"})

    seen = requests.withColumn("__seen", look(F.when(safe_path(F.col("path")), F.col("path"))))
    return seen.withColumns({"status": F.col("__seen.status"), "size": F.col("__seen.size")}).drop("__seen")
