"""Queries over a file catalog made from orders: each order is a file in priority/status/year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions.formatting import extension, format_size, percent
from larkspur.operators import catalog as c
from larkspur.operators import stats, telemetry
from larkspur.plans.registry import query
from larkspur.session import table
from larkspur.sources import catalog_scan

EXTENSIONS = ("md", "py", "PNG", "sql", "sh", "zip", "drawio", "ttf", "html", "xyz")


def virtual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, dir, path, size, ctime, mtime (epoch seconds) and mtime_str of the catalog."""
    o = table(spark, sf_dir, "orders")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("o_orderkey") % len(EXTENSIONS) + 1).cast("int"))
    mtime = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit("."), ext)
    folder = F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("string"))
    rows = o.select(name.alias("name"), folder.alias("dir"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), mtime.alias("mtime"), (mtime - F.col("o_custkey") * 60).alias("ctime"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("mtime_str"))
    return rows.withColumn("path", F.concat_ws("/", "dir", "name"))


_LIST = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
FILES = f"""files AS (SELECT *, dir || '/' || name AS path FROM (SELECT o_orderkey || '.' || ({_LIST})[o_orderkey % {len(EXTENSIONS)} + 1] AS name,
  o_orderpriority || '/' || o_orderstatus || '/' || year(o_orderdate) AS dir, CAST(round(o_totalprice * 100) AS BIGINT) AS size,
  CAST(epoch(o_orderdate) AS BIGINT) AS mtime, CAST(epoch(o_orderdate) AS BIGINT) - o_custkey * 60 AS ctime, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS mtime_str FROM orders))"""
ROLLED = """ups AS (SELECT *, unnest(['', split_part(dir, '/', 1), split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2), dir]) AS up FROM files),
rolled AS (SELECT up AS dir, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files, max(mtime) AS mtime, min(ctime) AS ctime_min FROM ups GROUP BY up)"""


def size_sql(x: str) -> str:
    """DuckDB's text for a size in bytes."""
    steps = " ".join(f"WHEN {x} < {1024**k} THEN printf('%.2f {u}', round_even({x} / {float(1024 ** (k - 1))}, 2))" for k, u in enumerate(("B", "KB", "MB", "GB"), 1))
    return f"CASE WHEN {x} <= 0 THEN '0 B' {steps} ELSE printf('%.2f TB', round_even({x} / {float(1024**4)}, 2)) END"


@query(f"WITH {FILES}, {ROLLED} SELECT dir, size, n_files, mtime, ctime_min, least(ctime_min, 0) AS ctime_asis, {size_sql('size')} AS size_str FROM rolled")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = c.folder_rollup(virtual_files(spark, sf_dir))
    return rolled.select("dir", "size", "n_files", "mtime", "ctime_min", F.least("ctime_min", F.lit(0).cast("long")).alias("ctime_asis"), format_size(F.col("size")).alias("size_str"))


@query(f"""WITH {FILES}, {ROLLED}, nodes AS (SELECT *, regexp_extract(dir, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(dir, '([^/]*)$', 1) AS name FROM rolled WHERE dir <> ''),
subs AS (SELECT parent AS dir, count(*) AS n_dirs FROM nodes GROUP BY parent), direct AS (SELECT dir, count(*) AS n_direct FROM files GROUP BY dir)
SELECT dir, parent, name, CAST(len(string_split(dir, '/')) AS BIGINT) AS depth, coalesce(n_dirs, 0) + coalesce(n_direct, 0) AS file_num, size, {size_sql('size')} AS size_str, mtime,
CASE WHEN coalesce(n_dirs, 0) = 0 THEN size END AS value, row_number() OVER (PARTITION BY parent ORDER BY name) AS position
FROM nodes LEFT JOIN subs USING (dir) LEFT JOIN direct USING (dir)""")
def folder_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.folder_nodes(virtual_files(spark, sf_dir))


@query(f"""WITH {FILES}, {ROLLED} SELECT (SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM rolled WHERE dir <> '') AS total_folders,
(SELECT CAST(sum(size) AS BIGINT) FROM files) AS total_size_bytes, (SELECT {size_sql('s')} FROM (SELECT sum(size) AS s FROM files)) AS total_size_str, (SELECT count(*) FROM rolled WHERE dir <> '' AND dir NOT LIKE '%/%') AS root_children""")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.scan_totals(virtual_files(spark, sf_dir))


_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{t}')" for e, t in c.extension_table()) + ") AS v(ext, file_type))"


@query(f"""WITH {FILES}, {_DIM}, typed AS (SELECT lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext, size FROM files)
SELECT coalesce(file_type, '{c.OTHER}') AS file_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, count(DISTINCT ext) AS n_ext FROM typed LEFT JOIN dim USING (ext) GROUP BY 1""")
def file_type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.with_file_type(virtual_files(spark, sf_dir)).groupBy("file_type").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.countDistinct("ext").alias("n_ext"))


@query(f"WITH {FILES} SELECT split_part(dir, '/', 1) AS name, CAST(sum(size) AS BIGINT) AS size, count(DISTINCT dir) AS leaves FROM files GROUP BY 1")
def folder_tree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each first-level folder as one nested document, from which its size and its folders without others are read back."""
    trees = c.nested_trees(c.folder_nodes(virtual_files(spark, sf_dir)))
    return trees.select("name", F.get_json_object("tree", "$.size").cast("long").alias("size"), F.regexp_count("tree", F.lit('"value":')).cast("long").alias("leaves"))


@query()
def scan_dir_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of the tables itself as a catalog: name, dir, size, size_str and file_type of every file."""
    return catalog_scan.files(spark, sf_dir).select("name", "dir", "size", "size_str", "file_type")


@query(f"WITH {FILES} SELECT dir, count(*) AS n, string_agg(name || ':' || size, ',' ORDER BY name) AS files FROM files GROUP BY dir")
def files_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("name", "size")))
    text = F.array_join(F.transform(entries, lambda f: F.concat_ws(":", f["name"], f["size"].cast("string"))), ",")
    return virtual_files(spark, sf_dir).groupBy("dir").agg(F.count("*").alias("n"), text.alias("files"))


@query(f"WITH {FILES} SELECT dir, name, size, row_number() OVER (PARTITION BY dir ORDER BY name, size) AS position FROM files")
def files_in_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with its place in its folder: rows instead of one array a folder, and no task that holds a folder."""
    return stats.numbered_within(virtual_files(spark, sf_dir).select("dir", "name", "size"), ["dir"], "name", "size")


@query(f"WITH s AS (SELECT o_orderkey, CAST(round(o_totalprice * pow(1024, o_orderkey % 5 - 1)) AS BIGINT) - 2000 AS size FROM orders) SELECT o_orderkey, size, {size_sql('size')} AS size_str FROM s")
def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    size = F.round(F.col("o_totalprice") * F.pow(F.lit(1024.0), F.col("o_orderkey") % 5 - 1)).cast("long") - 2000
    return o.select("o_orderkey", size.alias("size")).withColumn("size_str", format_size(F.col("size")))


_PREFIXES = "(['', '.', '$', 'build', 'builder', 'src/node_modules', 'a/__pycache__', 'out', 'docs', '_x', 'assets'])[o_orderkey % 11 + 1]"


@query(f"""WITH p AS (SELECT o_orderkey, {_PREFIXES} || '/x' || o_orderkey AS path FROM orders), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM p)
SELECT o_orderkey, path, starts_with(name, '.') OR starts_with(name, '$') AS name_ignored,
regexp_matches(path, '^(\\.|\\$|assets|node_modules|vendor|dist|build|out|target|__pycache__)') OR contains(path, '__pycache__') AS path_ignored FROM n""")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = ["", ".", "$", "build", "builder", "src/node_modules", "a/__pycache__", "out", "docs", "_x", "assets"]
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.element_at(F.array(*map(F.lit, prefixes)), (F.col("o_orderkey") % 11 + 1).cast("int")), F.lit("/x"), F.col("o_orderkey").cast("string"))
    p = o.select("o_orderkey", path.alias("path"))
    return p.select("o_orderkey", "path", c.ignored_name(c.base_name(F.col("path"))).alias("name_ignored"), c.ignored_path(F.col("path")).alias("path_ignored"))


@query(f"WITH {FILES} SELECT substr(mtime_str, 1, 10) AS day, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM files GROUP BY 1")
def mtime_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_files(spark, sf_dir).groupBy(F.substring("mtime_str", 1, 10).alias("day")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 9 = 8 THEN '' ELSE (['api/', 'graphql', '../', 'docs/../', 'css_js', 'apix/', '', 'a..b/'])[page_id % 9 + 1] || regexp_replace(url, '^[a-z]+://', '') END AS path FROM pages)
SELECT page_id, path, path <> '' AND position('..' IN path) = 0 AND left(path, 6) <> 'css_js' AND left(path, 7) <> 'graphql' AND left(path, 4) <> 'api/' AS safe FROM p""")
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = ["api/", "graphql", "../", "docs/../", "css_js", "apix/", "", "a..b/"]
    path = F.concat(F.get(F.array(*map(F.lit, prefixes)), (F.col("page_id") % 9).cast("int")), F.regexp_replace("url", "^[a-z]+://", ""))
    path = F.when(F.col("page_id") % 9 == 8, "").otherwise(path)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("safe", c.safe_path(F.col("path")))


@query(f"""WITH {FILES}, a AS (SELECT path, size, mtime FROM files WHERE CAST(split_part(name, '.', 1) AS BIGINT) % 7 <> 0),
b AS (SELECT path, CASE WHEN CAST(split_part(name, '.', 1) AS BIGINT) % 5 = 0 THEN size + 1 ELSE size END AS size, mtime FROM files WHERE CAST(split_part(name, '.', 1) AS BIGINT) % 11 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = virtual_files(spark, sf_dir)
    key = F.split("name", r"\.")[0].cast("long")
    new = files.where(key % 11 != 0).withColumn("size", F.when(key % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return c.snapshot_diff(files.where(key % 7 != 0), new, "path", "size", "mtime")


@query("""WITH d AS (SELECT *, '/dev/' || CASE WHEN s_nationkey % 3 = 0 THEN 'nvme' || s_nationkey || 'n1p' || s_suppkey % 2 WHEN s_nationkey % 3 = 1 THEN 'disk' || s_nationkey || 's1' ELSE 'sda' || s_nationkey END AS device,
abs(s_acctbal) AS used, CAST(10000 + s_suppkey % 3 AS DOUBLE) AS total FROM supplier), p AS (SELECT *, round_even(100 * used / total, 1) AS percent, CASE WHEN s_nationkey % 3 = 2 THEN device ELSE substr(device, 6) END AS physical_id FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY physical_id ORDER BY percent DESC, s_suppkey) AS r FROM p) SELECT physical_id, device, s_suppkey, used, total, percent FROM r WHERE r = 1""")
def disk_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.busiest_partition(_disks(spark, sf_dir), "s_suppkey").select("physical_id", "device", "s_suppkey", "used", "total", "percent")


@query("""WITH d AS (SELECT *, CASE WHEN s_nationkey % 3 = 0 THEN 'nvme' || s_nationkey || 'n1p' || s_suppkey % 2 WHEN s_nationkey % 3 = 1 THEN 'disk' || s_nationkey || 's1' ELSE 'sda' || s_nationkey END AS device,
abs(s_acctbal) AS used, CAST(10000 + s_suppkey % 3 AS DOUBLE) AS total FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY round_even(100 * used / total, 1) DESC, s_suppkey) AS r FROM d)
SELECT sum(total) AS total, round(sum(used), 2) AS used, round_even(100 * sum(used) / sum(total), 1) AS percent FROM r WHERE r = 1""")
def disk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.disk_totals(_disks(spark, sf_dir), "s_suppkey").withColumn("used", F.round("used", 2))


@query("SELECT user_id, event_type, CAST(trunc((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS uptime FROM events GROUP BY ALL")
def uptime_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last event of each kind of every user."""
    ends = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("user_id", "event_type", telemetry.uptime(F.col("b"), F.col("a")).alias("uptime"))


def _disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    device = F.when(n % 3 == 0, F.concat(F.lit("nvme"), n, F.lit("n1p"), F.col("s_suppkey") % 2)).when(n % 3 == 1, F.concat(F.lit("disk"), n, F.lit("s1"))).otherwise(F.concat(F.lit("sda"), n))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("/dev/"), device).alias("device"), F.abs("s_acctbal").alias("used"), (F.lit(10000.0) + F.col("s_suppkey") % 3).alias("total"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE round_even(100 * abs(c_acctbal) / (c_custkey % 10 * 1000.0), 1) END AS percent FROM customer")
def percent_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", percent(F.abs("c_acctbal"), F.col("c_custkey") % 10 * 1000.0).alias("percent"))


@query("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events),
p AS (SELECT *, lag(total) OVER w AS was, lag(t) OVER w AS t0 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, CASE WHEN was IS NULL OR t - t0 <= 0 THEN 0.0 ELSE round((total - was) / (t - t0), 4) END AS rate FROM p""")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    samples = e.select("user_id", "event_id", t.alias("t"), F.sum("value").over(w).alias("total"))
    return telemetry.counter_rate(samples, "user_id", "t", "total", "event_id").select("user_id", "event_id", F.round("rate", 4).alias("rate"))
