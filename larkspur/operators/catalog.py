"""File catalogs: classification, pruning, rollup of sizes up the directory tree, and the nested document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions.formatting import extension, format_size
from larkspur.session import checkpointed

# Category of each file extension, and the category of all others.
CATEGORIES = {
    "前端": "html htm xhtml css scss sass less styl pcss postcss js jsx ts tsx mjs cjs jsm tsm mts cts vue svelte astro swift kt",
    "后端": "py pyw java kotlin scala groovy c cpp h hpp cs go rs rlib rmeta rb php dockerfile gradle makefile cmake proto thrift idl wasm asm",
    "脚本": "sh bash zsh bat cmd ps1",
    "数据库": "sql mysql pgsql sqlite db db3 sqlite3 mdf ldf sqlitedb",
    "文档": "md markdown rst tex docx doc pdf ppt odt rtf epub xlsx xls csv tsv ods json jsonc xml yaml yml toml ini conf env properties txt text log bak tmp cache lock map gitignore",
    "媒体": "png jpg jpeg gif bmp svg webp ico tiff tif raw psd ai eps fig mp4 mov avi flv wmv mkv webm m4v mpg mpeg 3gp mp3 wav flac aac ogg wma m4a opus obj fbx dae stl 3ds blend",
    "压缩文件": "zip rar 7z tar gz bz2 xz dmg",
    "图表": "drawio excalidraw sketch xd afdesign puml plantuml mmd",
    "字体": "ttf otf woff woff2 eot glyphs glyphs2",
}
OTHER = "其他"
# Beginnings of names and of paths (from the root) that a scan leaves out.
IGNORED_NAMES = (".", "$")
IGNORED_PATHS = (".", "$", "assets", "node_modules", "vendor", "dist", "build", "out", "target", "__pycache__")
# Beginnings of request paths that other routes serve.
RESERVED = ("/css_js", "/graphql", "/api/")


def extension_table() -> list[tuple[str, str]]:
    return [(e, c) for c, es in CATEGORIES.items() for e in es.split()]


def with_file_type(files: DataFrame, name: str = "name") -> DataFrame:
    """`files` with ext and file_type, from a broadcast table of fixed size."""
    dim = files.sparkSession.createDataFrame(extension_table(), "ext string, file_type string")
    out = files.withColumn("ext", extension(F.col(name)))
    return out.join(F.broadcast(dim), "ext", "left").withColumn("file_type", F.coalesce("file_type", F.lit(OTHER)))


def ignored_name(name: Column) -> Column:
    return name.startswith(IGNORED_NAMES[0]) | name.startswith(IGNORED_NAMES[1])


def ignored_path(path: Column) -> Column:
    """A directory path from the root that begins with an ignored one, or holds __pycache__ anywhere."""
    path = F.translate(path, "\\", "/")
    out = path.contains("__pycache__")
    for p in IGNORED_PATHS:
        out = out | path.startswith(p)
    return out


def safe_path(path: Column) -> Column:
    """A request path (without its leading slash) that is not empty, holds no two dots in a row, and begins none of the reserved ones."""
    out = (path != "") & ~path.contains("..")
    for p in RESERVED:
        out = out & ~F.concat(F.lit("/"), path).startswith(p)
    return F.coalesce(out, F.lit(False))


def parent_dir(path: Column) -> Column:
    """Path without its last part; empty at the first level."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def ancestors(path: Column) -> Column:
    """The path and every directory above it, the root (empty) first."""
    parts = F.split(path, "/")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), inner))


def folder_rollup(files: DataFrame) -> DataFrame:
    """dir, size, n_files, mtime (latest) and ctime_min of every directory with all that lies below it.

    Files are summed by directory before their sums go up to the ancestors, so what is exploded has a row for each
    directory and task, not for each file.
    """
    by_dir = files.groupBy("dir").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("mtime").alias("mtime"), F.min("ctime").alias("ctime"))
    up = by_dir.select(F.explode(ancestors(F.col("dir"))).alias("dir"), "size", "n", "mtime", "ctime")
    return up.groupBy("dir").agg(F.sum("size").alias("size"), F.sum("n").alias("n_files"), F.max("mtime").alias("mtime"), F.min("ctime").alias("ctime_min"))


def folder_nodes(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Tree nodes below the root: dir, parent, name, depth, file_num, size, size_str, mtime, value, position among siblings.

    file_num counts direct subdirectories and direct files; value is the size where there are no subdirectories.
    `folders` (dir) adds directories without files, of size 0.
    """
    rolled = folder_rollup(files).where("dir <> ''")
    if folders is not None:
        above = folders.select(F.explode(ancestors(F.col("dir"))).alias("dir")).where("dir <> ''").distinct()
        rolled = above.join(rolled, "dir", "full_outer").na.fill({"size": 0, "n_files": 0, "mtime": 0})
    nodes = rolled.withColumn("parent", parent_dir(F.col("dir")))
    subs = nodes.groupBy(F.col("parent").alias("dir")).agg(F.count("*").alias("n_dirs"))
    direct = files.groupBy("dir").agg(F.count("*").alias("n_direct"))
    out = nodes.join(subs, "dir", "left").join(direct, "dir", "left").na.fill(0, ["n_dirs", "n_direct"])
    name = base_name(F.col("dir"))
    out = out.select(
        "dir", "parent", name.alias("name"), F.size(F.split("dir", "/")).cast("long").alias("depth"), (F.col("n_dirs") + F.col("n_direct")).alias("file_num"), "size",
        format_size(F.col("size")).alias("size_str"), "mtime", F.when(F.col("n_dirs") == 0, F.col("size")).alias("value"),
    )
    return out.withColumn("position", F.row_number().over(Window.partitionBy("parent").orderBy("name")).cast("long"))


def scan_totals(files: DataFrame) -> DataFrame:
    """One row: total_files, total_folders, total_size_bytes, total_size_str, root_children (directories of the first level)."""
    dirs = files.select("dir").distinct().select(F.explode(ancestors(F.col("dir"))).alias("dir")).where("dir <> ''").distinct()
    folders = dirs.agg(F.count("*").alias("total_folders"), F.count(F.when(~F.col("dir").contains("/"), 1)).alias("root_children"))
    totals = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size_bytes"))
    return totals.crossJoin(folders).select("total_files", "total_folders", "total_size_bytes", format_size(F.col("total_size_bytes")).alias("total_size_str"), "root_children")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, *state: str) -> DataFrame:
    """key and status (added, removed, changed, same) between two snapshots, by one full outer join on the key."""
    a = old.select(F.col(key).alias("key"), F.struct(*state).alias("was"))
    b = new.select(F.col(key).alias("key"), F.struct(*state).alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return a.join(b, "key", "full_outer").select(F.col("key").alias(key), status.alias("status"))


def nested_trees(nodes: DataFrame) -> DataFrame:
    """name, tree: each directory of the first level with all below it as one nested JSON document, children in order of name.

    Built from the deepest level upwards, one grouped join a level, however many, so that a document is gathered only under its own root.
    """
    # JSON of a node up to its children.
    numbers = F.to_json(F.struct("name", "file_num", "size", "size_str", "value"))
    rows = checkpointed(nodes.select("dir", "parent", "name", "depth", numbers.alias("own")))
    depth = rows.agg(F.max("depth")).first()[0] or 0
    below = None
    for d in range(depth, 0, -1):
        level = rows.where(F.col("depth") == d)
        if below is None:
            level = level.withColumn("tree", F.col("own"))
        else:
            inner = F.concat(F.lit(',"children":['), F.array_join("children", ","), F.lit("]}"))
            level = level.join(below, level.dir == below.up, "left").withColumn("tree", F.when(F.col("children").isNotNull(), F.concat(F.expr("left(own, length(own) - 1)"), inner)).otherwise(F.col("own")))
        if d == 1:
            return level.select("name", "tree")
        sorted_trees = F.transform(F.array_sort(F.collect_list(F.struct("name", "tree"))), lambda c: c["tree"])
        below = checkpointed(level.groupBy(F.col("parent").alias("up")).agg(sorted_trees.alias("children")))
    return rows.select("name", F.col("own").alias("tree")).limit(0)
