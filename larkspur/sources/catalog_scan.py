"""A directory scan as one job: files with their types, folders rolled up, totals, and the nested document, written as JSON.

    python -m larkspur.sources.catalog_scan FOLDER OUT [--force]
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.formatting import format_size
from larkspur.operators import catalog
from larkspur.sources import file_tree


def joined_path(folder: Column, name: Column) -> Column:
    """Folder and name with one slash between, none where a side is empty, and slashes for backslashes."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\\/]+", "/")
    return F.concat_ws("/", *(F.nullif(c, F.lit("")) for c in (F.rtrim(clean(folder), F.lit("/")), F.ltrim(clean(name), F.lit("/")))))


def _local(seconds: str) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The file records below a folder: name, ext, file_type, dir, path, size, size_str, ctime, mtime, their texts and days."""
    rows = catalog.with_file_type(file_tree.scan(spark, folder).where("not is_dir"))
    times = {f"{t}_str": _local(t) for t in ("ctime", "mtime")} | {f"{t}_date_str": F.substring(_local(t), 1, 10) for t in ("ctime", "mtime")}
    return rows.withColumns({"path": joined_path(F.col("dir"), F.col("name")), "size_str": format_size(F.col("size")), **times})


def folders(spark: SparkSession, folder: str) -> DataFrame:
    """dir of every folder that no rule drops, empty ones too."""
    return file_tree.scan(spark, folder).where("is_dir").select(joined_path(F.col("dir"), F.col("name")).alias("dir"))


def ignored(spark: SparkSession, folder: str) -> DataFrame:
    """One row: n_ignored, the entries that a rule drops where they are found (what lies below a dropped folder isn't looked at)."""
    spark.dataSource.register(file_tree.FileTree)
    every = spark.read.format("file_tree").load(folder).count()
    kept = file_tree.scan(spark, folder).count()
    return spark.createDataFrame([(every - kept,)], "n_ignored long")


def _kept(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame] | None:
    """path, size, mtime of the files and dir of the folders that an earlier scan has written, if all of it is there."""
    try:
        spark.read.text(f"{out}/trees")  # the last part to be written
        files, folders = (spark.read.schema(s).json(f"{out}/{n}") for n, s in (("files", "path string, size long, mtime long"), ("folders", "dir string")))
    except AnalysisException:
        return None
    return files, folders


def write(spark: SparkSession, folder: str, out: str, force: bool = False) -> int | None:
    """The scan as JSON lines under `out`: files, folders (tree nodes), totals and trees (one document a first-level folder).

    If an earlier scan is there and its files (by path, size and time) and folders are the same, it is left as it is, but
    with `force`. Returns how many files and folders differ from the earlier scan; None without one. The records are
    materialised for all four results; folders are listed by a walk of their own, so that empty ones count.
    """
    scanned = files(spark, folder).persist()
    nodes = catalog.folder_nodes(scanned, folders(spark, folder)).persist()
    kept, changed = _kept(spark, out), None
    if kept:
        diff = catalog.snapshot_diff(kept[0], scanned, "path", "size", "mtime").select("status").unionByName(catalog.snapshot_diff(kept[1].withColumn("is", F.lit(1)), nodes.select("dir").withColumn("is", F.lit(1)), "dir", "is").select("status"))
        changed = diff.where("status <> 'same'").count()
    if force or changed != 0:
        for name, rows in (("files", scanned), ("folders", nodes), ("totals", catalog.scan_totals(scanned)), ("trees", catalog.nested_trees(nodes))):
            rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/{name}")
    nodes.unpersist()
    scanned.unpersist()
    return changed


if __name__ == "__main__":
    args = argparse.ArgumentParser(description="Scan a folder and write what it holds as JSON.")
    args.add_argument("folder")
    args.add_argument("out")
    args.add_argument("-f", "--force", action="store_true", help="write the result though nothing has changed")
    given = args.parse_args()
    write(SparkSession.builder.getOrCreate(), given.folder, given.out, given.force)
