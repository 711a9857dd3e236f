"""Queries for scales, calendars, hierarchies, flows and plane geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import formatting, numbers, scales, timeops
from larkspur.operators import geometry, hierarchy, quadtree, siblings, stats, trees
from larkspur.plans.registry import query
from larkspur.plans.statistics import step_sql
from larkspur.session import checkpointed, table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, x and the extent of x on each row, from one row of aggregates."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"))
    return p.crossJoin(F.broadcast(p.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))))


_E = "p AS (SELECT p_partkey, p_retailprice AS x, min(p_retailprice) OVER () AS lo, max(p_retailprice) OVER () AS hi FROM part)"


@query(f"WITH {_E} SELECT p_partkey, round((x - lo) / (hi - lo), 6) AS t, round(100 - 100 * (x - lo) / (hi - lo), 6) AS down FROM p")
def scale_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("lo"), F.col("hi"))
    return _part(spark, sf_dir).select("p_partkey", F.round(scales.linear(F.col("x"), d), 6).alias("t"), F.round(scales.linear(F.col("x"), d, (100, 0)), 6).alias("down"))


@query(f"WITH {_E} SELECT p_partkey, round((ln(x) - ln(lo)) / (ln(hi) - ln(lo)), 6) AS t FROM p")
def scale_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", F.round(scales.log(F.col("x"), (F.col("lo"), F.col("hi"))), 6).alias("t"))


@query("SELECT c_custkey, round((sign(c_acctbal) * ln(1 + abs(c_acctbal)) + ln(1001)) / (ln(10001) + ln(1001)), 6) AS t, round((sign(c_acctbal) * sqrt(abs(c_acctbal)) + sqrt(1000)) / (100 + sqrt(1000)), 6) AS root FROM customer")
def scale_symlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, d = F.col("c_acctbal"), (-1000, 10000)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scales.symlog(x, d), 6).alias("t"), F.round(scales.power(x, d, 0.5), 6).alias("root"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN (c_acctbal + 1000) / 1000 * 0.5 ELSE 0.5 + c_acctbal / 10000 * 0.5 END AS t FROM customer")
def scale_diverging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scales.diverging(F.col("c_acctbal"), -1000, 0, 10000).alias("t"))


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT p_partkey, CAST((p_retailprice >= a) AS INT) + CAST((p_retailprice >= b) AS INT) + CAST((p_retailprice >= c) AS INT) AS bucket FROM part, q")
def scale_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    # One row of cuts.
    cuts = stats.grouped_quantiles(p.withColumn("all", F.lit(1)), ["all"], "p_retailprice", {"a": 0.25, "b": 0.5, "c": 0.75})
    return p.crossJoin(F.broadcast(cuts)).select("p_partkey", scales.threshold(F.col("p_retailprice"), [F.col(c) for c in "abc"]).alias("bucket"))


@query(f"WITH {_E} SELECT p_partkey, CAST(least(greatest(floor((x - lo) / (hi - lo) * 7), 0), 6) AS INT) AS bucket FROM p")
def scale_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", scales.quantize(F.col("x"), (F.col("lo"), F.col("hi")), 7).alias("bucket"))


@query("SELECT p_partkey, CAST(p_size >= 10 AS INT) + CAST(p_size >= 20 AS INT) + CAST(p_size >= 40 AS INT) AS bucket FROM part")
def scale_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scales.threshold(F.col("p_size").cast("double"), [10, 20, 40]).alias("bucket"))


@query("""WITH d AS (SELECT event_type, min(event_id) AS f FROM events GROUP BY 1), i AS (SELECT event_type, row_number() OVER (ORDER BY f) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT event_type, i AS position, (['red', 'green', 'blue'])[i % 3 + 1] AS color, round((1 - 1.0 / (n + 0.2) * (n - 0.2)) / 2 + i / (n + 0.2), 6) AS start FROM i""")
def scale_ordinal_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("f"))
    i = d.select("event_type", (F.row_number().over(Window.orderBy("f")) - 1).cast("long").alias("position"), F.count("*").over(Window.partitionBy()).alias("n"))
    color = F.element_at(F.array(*map(F.lit, ("red", "green", "blue"))), (F.col("position") % 3 + 1).cast("int"))
    return i.select("event_type", "position", color.alias("color"), F.round(scales.band(F.col("position"), F.col("n"), padding=0.2), 6).alias("start"))


@query(f"WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), s AS (SELECT lo, hi, {step_sql('lo', 'hi', '10.0')} AS step FROM e) SELECT unnest(range(CAST(ceil(lo / step) AS BIGINT), CAST(floor(hi / step) AS BIGINT) + 1)) * step AS tick, floor(lo / step) * step AS nice_lo, ceil(hi / step) * step AS nice_hi FROM s")
def nice_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    s = e.withColumn("step", stats.tick_step(F.col("lo"), F.col("hi"), F.lit(10.0)))
    lo, hi = F.col("lo") / F.col("step"), F.col("hi") / F.col("step")
    k = s.select("*", F.explode(F.sequence(F.ceil(lo).cast("long"), F.floor(hi).cast("long"))).alias("k"))
    return k.select((F.col("k") * F.col("step")).alias("tick"), (F.floor(lo) * F.col("step")).alias("nice_lo"), (F.ceil(hi) * F.col("step")).alias("nice_hi"))


@query("SELECT event_id, " + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS {u}" for u in timeops.UNITS) + " FROM events")
def time_floor_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *(timeops.floor(F.col("ts"), u).cast("timestamp_ntz").alias(u) for u in timeops.UNITS))


@query("SELECT CAST(ts AS DATE) - CAST(dayofweek(ts) AS INT) AS week, count(*) AS n FROM events GROUP BY 1")
def time_week_sunday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(timeops.week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, ['一', '二', '三', '四', '五', '六', '七', '八', '九', '十', '十一', '十二'][month(o_orderdate)] || '月' AS month,
strftime(o_orderdate, '%Y年%-m月%-d日') || '星期' || substr('日一二三四五六', dayofweek(o_orderdate) + 1, 1) AS day FROM orders""")
def time_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", timeops.chinese_month(F.col("o_orderdate")).alias("month"), timeops.chinese_date(F.col("o_orderdate")).alias("day"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE (day(ts) - 1) % 3 = 0 GROUP BY 1")
def time_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").where(timeops.every(day, 3)).groupBy(day.alias("day")).agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), e AS (SELECT min(hour) AS a, max(hour) AS b FROM h), r AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM e) SELECT CAST(r.hour AS TIMESTAMP) AS hour, coalesce(n, 0) AS n FROM r LEFT JOIN h USING (hour)")
def time_range_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    ends = h.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour")).join(h, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


_PATTERN = "%Y-%m-%dT%H:%M:%S|%j|%U|%W|%V|%u|%w|%b|%B|%a|%A|%y|%I %p"


@query(f"SELECT o_orderkey, strftime(o_orderdate, '{_PATTERN}') AS text FROM orders")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", timeops.strftime(F.col("o_orderdate"), _PATTERN).alias("text"))


@query("SELECT CASE WHEN h < 600 THEN '凌晨' WHEN h < 900 THEN '早上' WHEN h < 1130 THEN '上午' WHEN h < 1230 THEN '中午' WHEN h < 1800 THEN '下午' ELSE '晚上' END AS part, count(*) AS n FROM (SELECT hour(ts) * 100 + minute(ts) AS h FROM events) GROUP BY 1")
def day_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(timeops.day_part(F.col("ts")).alias("part")).agg(F.count("*").alias("n"))


_VALUES = "(['', ' ', 'true', 'NaN', '12.5', '-3e4', '0x1F', '2024-01-05', '2024-01-05T10:20:30Z', 'abc', '1,000', 'Infinity', '.5', '5.', 'false ', '2024-1-5'])[event_id % 16 + 1]"


@query(f"""WITH v AS (SELECT event_id, {_VALUES} AS s FROM events), t AS (SELECT *, trim(s) AS t FROM v) SELECT event_id, s, CASE WHEN t = '' THEN 'null' WHEN t IN ('true', 'false') THEN 'boolean' WHEN t = 'NaN' THEN 'nan'
WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') OR regexp_full_match(t, '0[xX][0-9a-fA-F]+') OR t IN ('Infinity', '-Infinity', '+Infinity') THEN 'number'
WHEN coalesce(try_strptime(t, ['%Y-%m-%d', '%Y-%m', '%Y', '%Y-%m-%dT%H:%MZ', '%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%dT%H:%M:%S.%gZ'])) IS NOT NULL AND NOT regexp_matches(t, '-[0-9](-|$)') THEN 'date' ELSE 'string' END AS kind FROM t""")
def autotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["", " ", "true", "NaN", "12.5", "-3e4", "0x1F", "2024-01-05", "2024-01-05T10:20:30Z", "abc", "1,000", "Infinity", ".5", "5.", "false ", "2024-1-5"]
    s = F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % 16 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).withColumn("kind", formatting.auto_type(F.col("s")))


@query("""WITH v AS (SELECT o_orderkey, o_totalprice, o_totalprice / 1000 AS k FROM orders) SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS grouped,
CASE WHEN round_even(k, 2) < 10 THEN printf('%.2f', round_even(k, 2)) WHEN round_even(k, 1) < 100 THEN printf('%.1f', round_even(k, 1)) ELSE printf('%.0f', round_even(k, 0)) END || 'k' AS thousands FROM v""")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", formatting.grouped_number(x).alias("grouped"), formatting.si_number(x).alias("thousands"))


@query("""WITH v AS (SELECT o_orderkey, o_custkey, o_totalprice AS x, o_totalprice / 1000 AS k, o_totalprice * (1 + 1e-13) AS y, CAST(floor(log10(o_totalprice)) AS INT) AS e FROM orders)
SELECT o_orderkey, regexp_replace(printf('%.2f', x), '[.]?0+$', '') AS plain, regexp_replace(format('{:,.2f}', x), '[.]00$|0$', '') AS thousands,
CAST(CAST(round(y / power(10, e - 2)) AS BIGINT) * CAST(power(10, e - 2) AS BIGINT) AS VARCHAR) AS rounded, CASE WHEN round(y) < 10000 THEN printf('%.' || (3 - e) || 'f', y) ELSE regexp_replace(printf('%.3e', y), 'e[+]0*', 'e+') END AS general,
right(format('{:,}', 1000000000000000000 + o_custkey), 15) AS zeros, format('{:,.1f}', CASE WHEN x * 4 = floor(x * 4) AND x * 2 <> floor(x * 2) THEN x + 0.001 ELSE x END) AS tick,
printf('%.2f', CASE WHEN k * 8 = floor(k * 8) AND k * 4 <> floor(k * 4) THEN k + 0.0001 ELSE k END) || 'k' AS in_thousands FROM v""")
def number_format_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's price without a type, rounded to digits, in general form, and as ticks; its customer after zeros."""
    x, f = F.col("o_totalprice"), numbers.format_number
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", f(x, "").alias("plain"), f(x, ",").alias("thousands"), f(x, ".3r").alias("rounded"), f(x, ".4g").alias("general"), f(F.col("o_custkey"), "015,d").alias("zeros"),
        numbers.tick_format(x, 0.5, 1000).alias("tick"), numbers.format_prefix(x, ".2", 5000.0).alias("in_thousands"),
    )


_NODES = """nodes AS (SELECT 'all' AS id, NULL AS parent, 0.0::DOUBLE AS v UNION ALL SELECT 'r' || r_regionkey, 'all', 0.0 FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.0 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer)"""
_UP = "up(id, ancestor, distance) AS (SELECT id, id, CAST(0 AS BIGINT) FROM nodes UNION ALL SELECT up.id, n.parent, up.distance + 1 FROM up JOIN nodes n ON n.id = up.ancestor WHERE n.parent IS NOT NULL)"


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent, v: a tree of all, regions, nations and customers."""
    s = lambda c: F.col(c).cast("string")
    root = spark.createDataFrame([("all", None, 0.0)], "id string, parent string, v double")
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), s("r_regionkey")).alias("id"), F.lit("all").alias("parent"), F.lit(0.0).alias("v"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), s("n_nationkey")).alias("id"), F.concat(F.lit("r"), s("n_regionkey")).alias("parent"), F.lit(0.0).alias("v"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), s("c_custkey")).alias("id"), F.concat(F.lit("n"), s("c_nationkey")).alias("parent"), F.col("c_acctbal").alias("v"))
    return root.unionByName(r).unionByName(n).unionByName(c)


@query(f"WITH RECURSIVE {_NODES}, {_UP} SELECT id, ancestor, distance FROM up")
def hier_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.closure(tree_nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {_NODES}, {_UP} SELECT id, string_agg(ancestor, '/' ORDER BY distance DESC) AS path FROM up GROUP BY id")
def hier_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = hierarchy.closure(tree_nodes(spark, sf_dir)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("p"))
    return up.select("id", F.array_join("p.ancestor", "/").alias("path"))


@query(f"WITH {_NODES} SELECT id FROM nodes WHERE id NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)")
def hier_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.leaves(tree_nodes(spark, sf_dir)).select("id")


@query(f"WITH RECURSIVE {_NODES}, {_UP} SELECT ancestor AS id, round(sum(v), 2) AS total, count(*) FILTER (up.id NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)) AS n_leaves FROM up JOIN nodes ON nodes.id = up.id GROUP BY 1")
def hier_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = hierarchy.totals(hierarchy.by_level(tree_nodes(spark, sf_dir)), "v")
    return reduce(DataFrame.unionByName, levels).select("id", F.round("total", 2).alias("total"), "n_leaves")


@query(f"""WITH RECURSIVE {_NODES}, {_UP}, p AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey + 1) AS b FROM customer),
m AS (SELECT p.a, p.b, x.ancestor, x.distance AS da, x.distance + y.distance AS d FROM p JOIN up x ON x.id = p.a JOIN up y ON y.id = p.b AND y.ancestor = x.ancestor) SELECT a, b, arg_min(ancestor, da) AS lca, min(d) AS distance FROM m GROUP BY a, b""")
def hier_path_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("a"), F.concat(F.lit("c"), (k + 1).cast("string")).alias("b"))
    return hierarchy.lowest_common_ancestor(hierarchy.closure(tree_nodes(spark, sf_dir)), pairs)


@query(f"""WITH RECURSIVE {_NODES}, {_UP}, p AS (SELECT 'c' || c_custkey AS a, 'n' || n_nationkey AS b FROM customer, nation),
m AS (SELECT p.a, p.b, x.ancestor, x.distance AS da, x.distance + y.distance AS d FROM p JOIN up x ON x.id = p.a JOIN up y ON y.id = p.b AND y.ancestor = x.ancestor) SELECT a, b, arg_min(ancestor, da) AS lca, min(d) AS distance FROM m GROUP BY a, b""")
def hier_path_lca_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with each of the 25 nations."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    pairs = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("a")).crossJoin(F.broadcast(table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("b"))))
    return hierarchy.lowest_common_ancestor(hierarchy.closure(tree_nodes(spark, sf_dir)), pairs)


_FAULTS = """b AS (SELECT id, CASE WHEN id LIKE 'c%7' THEN 'gone' || id WHEN id LIKE 'c%31' THEN NULL ELSE parent END AS parent FROM nodes UNION ALL SELECT id, parent FROM nodes WHERE id LIKE 'c%9')"""


@query(f"WITH {_NODES}, {_FAULTS} SELECT 'missing' AS problem, id FROM b WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM b) UNION ALL SELECT 'ambiguous', id FROM b GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'multiple roots', id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM b WHERE parent IS NULL) WHERE r > 1")
def stratify_checks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer tree with lost parents, further roots and repeated ids."""
    nodes = tree_nodes(spark, sf_dir).select("id", "parent")
    id = F.col("id")
    parent = F.when(id.like("c%7"), F.concat(F.lit("gone"), id)).when(id.like("c%31"), F.lit(None)).otherwise(F.col("parent"))
    return hierarchy.problems(nodes.select("id", parent.alias("parent")).unionByName(nodes.where(id.like("c%9"))))


_BAD = """b AS (SELECT id, CASE WHEN id LIKE 'c%3' THEN 'c' || (CAST(substr(id, 2) AS BIGINT) + 1) WHEN id LIKE 'c%4' OR id LIKE 'c%5' THEN 'c' || (CAST(substr(id, 2) AS BIGINT) - 1) ELSE parent END AS parent FROM nodes)"""


@query(f"WITH RECURSIVE {_NODES}, {_BAD}, ends(id) AS (SELECT id FROM b WHERE parent IS NULL OR parent NOT IN (SELECT id FROM b) UNION SELECT b.id FROM b JOIN ends ON b.parent = ends.id) SELECT 'cycle' AS problem, id FROM b WHERE id NOT IN (SELECT id FROM ends) UNION ALL SELECT 'missing', id FROM b WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM b)")
def stratify_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer tree, in which customers are one another's parents two by two, and a third hangs below each pair."""
    id = F.col("id")
    other = lambda n: F.concat(F.lit("c"), (F.substring(id, F.lit(2), F.length(id)).cast("long") + n).cast("string"))
    parent = F.when(id.like("c%3"), other(1)).when(id.like("c%4") | id.like("c%5"), other(-1)).otherwise(F.col("parent"))
    return hierarchy.problems(tree_nodes(spark, sf_dir).select("id", parent.alias("parent")))


@query("""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/$', '') AS path FROM pages), c AS (SELECT path AS id, count(*) AS n FROM p GROUP BY 1), s AS (SELECT id, string_split(id, '/') AS parts FROM c),
e AS (SELECT DISTINCT unnest(list_transform(range(0, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS id FROM s)
SELECT id, CASE WHEN id <> '' THEN regexp_extract(id, '^(.*)/[^/]*$', 1) END AS parent, CAST(CASE WHEN id = '' THEN 0 ELSE len(string_split(id, '/')) END AS BIGINT) AS depth, n IS NULL AS imputed, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (id)""")
def stratify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.from_paths(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


@query("WITH n AS (SELECT n_regionkey AS parent, n_nationkey AS id, count(*) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), w AS (SELECT *, sum(v) OVER (PARTITION BY parent ORDER BY id ROWS UNBOUNDED PRECEDING) AS e, sum(v) OVER (PARTITION BY parent) AS t FROM n) SELECT parent, id, round((e - v) / t, 6) AS x0, round(e / t, 6) AS x1 FROM w")
def partition_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    v = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("id")).agg(F.count("*").alias("v"))
    return hierarchy.slices(v, "v").select("parent", "id", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    f = l.join(s, l.l_suppkey == s.s_suppkey).join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return f.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.sum("l_extendedprice").alias("value"))


@query("""WITH f AS (SELECT s_nationkey AS source, c_nationkey AS target, sum(l_extendedprice) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
b AS (SELECT source AS node, value AS s, 0 AS r, CASE WHEN source = target THEN value ELSE 0 END AS o FROM f UNION ALL SELECT target, 0, value, 0 FROM f) SELECT node, round(sum(s), 2) AS sent, round(sum(r), 2) AS received, round(sum(o), 2) AS own FROM b GROUP BY 1""")
def chord_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.flows(_trade(spark, sf_dir)).select("node", *(F.round(x, 2).alias(x) for x in ("sent", "received", "own")))


@query("""WITH f AS (SELECT s_nationkey AS source, c_nationkey AS target, sum(l_extendedprice) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT DISTINCT unnest([source, target]) AS node FROM f), g AS (SELECT node, coalesce((SELECT sum(value) FROM f WHERE source = node), 0) AS sent FROM n),
k AS (SELECT node, sent, (2 * pi() - 0.02 * count(*) OVER ()) / sum(sent) OVER () AS k, sum(sent) OVER (ORDER BY node) - sent AS before, 0.02 * (row_number() OVER (ORDER BY node) - 1) AS gaps FROM g)
SELECT source, target, round(value, 2) AS value, round(before * k + gaps, 6) AS group_start, round((before + sent) * k + gaps, 6) AS group_end,
round((before + sum(value) OVER w - value) * k + gaps, 6) AS start_angle, round((before + sum(value) OVER w) * k + gaps, 6) AS end_angle FROM f JOIN k ON source = node WINDOW w AS (PARTITION BY source ORDER BY target)""")
def chord_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = hierarchy.arcs(_trade(spark, sf_dir), 0.02)
    return angles.select("source", "target", F.round("value", 2).alias("value"), *(F.round(c, 6).alias(c) for c in ("group_start", "group_end", "start_angle", "end_angle")))


_FLOWS = "f AS (SELECT s_nationkey AS source, c_nationkey AS target, sum(l_extendedprice) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
_ARCS = """n AS (SELECT DISTINCT unnest([source, target]) AS node FROM f), g AS (SELECT node, coalesce((SELECT sum(value) FROM parts WHERE parts.node = n.node), 0) AS own FROM n),
k AS (SELECT node, (2 * pi() - 0.01 * count(*) OVER ()) / sum(own) OVER () AS k, sum(own) OVER (ORDER BY node) - own AS before, 0.01 * (row_number() OVER (ORDER BY node) - 1) AS gaps FROM g),
a AS (SELECT node, other, way, value, before * k + gaps + k * (sum(value) OVER w - value) AS s, before * k + gaps + k * sum(value) OVER w AS e FROM parts JOIN k USING (node) WINDOW w AS (PARTITION BY node ORDER BY way, CASE WHEN way = 0 THEN -other END, other))"""


def _ribbons(rows: DataFrame) -> DataFrame:
    angles = (F.round(f"{end}_{side}", 6).alias(f"{end}_{side}") for end in ("source", "target") for side in ("start", "end"))
    return rows.select("source", "target", F.round("value", 2).alias("value"), F.round("back", 2).alias("back"), *angles)


@query(f"""WITH {_FLOWS}, parts AS (SELECT node, other, 1 AS way, sum(value) AS value FROM (SELECT source AS node, target AS other, value FROM f UNION ALL SELECT target, source, 0 FROM f) GROUP BY ALL), {_ARCS},
m AS (SELECT x.*, y.value AS back, y.s AS s2, y.e AS e2 FROM a x JOIN a y ON y.node = x.other AND y.other = x.node WHERE x.value > y.value OR (x.value = y.value AND x.node <= y.node))
SELECT node AS source, other AS target, round(value, 2) AS value, round(back, 2) AS back, round(s, 6) AS source_start, round(e, 6) AS source_end, round(s2, 6) AS target_start, round(e2, 6) AS target_end FROM m""")
def chord_ribbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ribbons(hierarchy.chords(_trade(spark, sf_dir), 0.01))


@query(f"""WITH raw AS (WITH {_FLOWS} SELECT * FROM f), f AS (SELECT target AS source, source AS target, value FROM raw), parts AS (SELECT source AS node, target AS other, 1 AS way, value FROM f UNION ALL SELECT target, source, 0, value FROM f), {_ARCS}
SELECT x.node AS source, x.other AS target, round(x.value, 2) AS value, CAST(NULL AS DOUBLE) AS back, round(x.s, 6) AS source_start, round(x.e, 6) AS source_end, round(y.s, 6) AS target_start, round(y.e, 6) AS target_end
FROM a x JOIN a y ON y.node = x.other AND y.other = x.node WHERE x.way = 1 AND y.way = 0""")
def chord_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows turned over, each a ribbon of its own."""
    return _ribbons(hierarchy.chords(_trade(spark, sf_dir), 0.01, directed=True, transposed=True))


@query(f"WITH RECURSIVE {_NODES}, {_UP} SELECT ancestor AS top, id, CASE WHEN distance > 0 THEN parent END AS parent, distance AS depth, v FROM up JOIN nodes USING (id) WHERE ancestor LIKE 'r%'")
def hier_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region with all below it as a tree of its own."""
    t = tree_nodes(spark, sf_dir)
    return hierarchy.subtrees(t, hierarchy.closure(t), t.where(F.col("id").startswith("r")))


@query("""WITH p AS (SELECT 'web/pages/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/$', '') AS path FROM pages), c AS (SELECT path AS id, count(*) AS n FROM p GROUP BY 1), s AS (SELECT id, string_split(id, '/') AS parts FROM c),
e AS (SELECT DISTINCT unnest(list_transform(range(0, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS id FROM s),
t AS (SELECT id, CASE WHEN id <> '' THEN regexp_extract(id, '^(.*)/[^/]*$', 1) END AS parent, CAST(CASE WHEN id = '' THEN 0 ELSE len(string_split(id, '/')) END AS BIGINT) AS depth, n IS NULL AS imputed, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (id)),
k AS (SELECT parent AS id, count(*) AS k FROM t GROUP BY 1), d AS (SELECT min(depth) AS top FROM t LEFT JOIN k USING (id) WHERE NOT (imputed AND coalesce(k, 0) = 1))
SELECT id, CASE WHEN depth > top THEN parent END AS parent, depth - top AS depth, imputed, n FROM t, d WHERE depth >= top""")
def stratify_path_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages below two folders that hold nothing else: the first folder that branches is the root."""
    paths = table(spark, sf_dir, "pages").select(F.concat(F.lit("web/pages/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))
    return hierarchy.without_imputed_top(hierarchy.from_paths(paths))


@query(f"""WITH RECURSIVE {_NODES}, e AS (SELECT *, id = 'all' OR id LIKE 'r%' OR id IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 1) AS expanded FROM nodes),
t AS (SELECT * FROM e WHERE parent IS NULL UNION ALL SELECT e.* FROM e JOIN t ON e.parent = t.id WHERE t.expanded) SELECT id, parent, expanded FROM t""")
def hier_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer tree with every other nation closed."""
    id = F.col("id")
    odd = F.substring(id, F.lit(2), F.length(id)).cast("long") % 2 == 1
    expanded = (id == "all") | id.startswith("r") | F.when(id.startswith("n"), odd).otherwise(False)
    return hierarchy.shown(tree_nodes(spark, sf_dir).select("id", "parent", expanded.alias("expanded")))


@query(f"""WITH {_NODES}, moved AS (SELECT id, CASE WHEN id IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 4 = 0) THEN 'n' || (CAST(substr(parent, 2) AS INT) + 1) % 25 ELSE parent END AS parent FROM nodes)
SELECT id, parent FROM moved WHERE id NOT IN ('n3', 'n7') AND coalesce(parent, '') NOT IN ('n3', 'n7')""")
def tree_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth customer goes to the next nation; nations, asked to go below one of their own, stay; two nations are removed with all they then have."""
    c, nodes = table(spark, sf_dir, "customer"), tree_nodes(spark, sf_dir).select("id", "parent")
    name = lambda letter, k: F.concat(F.lit(letter), k.cast("string"))
    moves = c.where("c_custkey % 4 = 0").select(name("c", F.col("c_custkey")).alias("id"), name("n", (F.col("c_nationkey") + 1) % 25).alias("to"))
    within = c.groupBy(name("n", F.col("c_nationkey")).alias("id")).agg(F.min(name("c", F.col("c_custkey"))).alias("to"))
    moved = checkpointed(trees.move(nodes, hierarchy.closure(nodes), moves.unionByName(within)))
    gone = table(spark, sf_dir, "nation").where("n_nationkey in (3, 7)").select(name("n", F.col("n_nationkey")).alias("id"))
    return trees.remove(moved, hierarchy.closure(moved), gone)


@query("SELECT 'n' || c_nationkey AS parent, CASE WHEN count(*) > 1 AND count(*) FILTER (c_acctbal < 4500) * 2 < count(*) THEN 'left' ELSE 'right' END AS side FROM customer GROUP BY 1")
def next_child_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose poorer customers stand on the left."""
    c = table(spark, sf_dir, "customer")
    return hierarchy.next_side(c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.when(F.col("c_acctbal") < 4500, "left").alias("side")))


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_POLY = """p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
e AS (SELECT label, x, y, coalesce(lead(x) OVER w, first(x) OVER a) AS x2, coalesce(lead(y) OVER w, first(y) OVER a) AS y2 FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id), a AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {_POLY} SELECT label, round(sum(x * y2 - x2 * y) / 2, 6) AS area, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 6) AS length FROM e GROUP BY 1")
def polygon_shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.polygon_measures(_polygons(spark, sf_dir), "label", "vec_id").select("label", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"))


@query(f"WITH {_POLY} SELECT label, count(*) FILTER ((y > 0.01) <> (y2 > 0.01) AND 0.02 < (x2 - x) * (0.01 - y) / (y2 - y) + x) % 2 = 1 AS inside FROM e GROUP BY 1")
def polygon_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.polygon_contains(_polygons(spark, sf_dir), "label", "vec_id", 0.02, 0.01)


@query()
def polygon_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.hull(_polygons(spark, sf_dir), "label")


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), l AS (SELECT label AS site, avg(CAST(embedding[1] AS DOUBLE)) AS sx, avg(CAST(embedding[2] AS DOUBLE)) AS sy FROM embeddings GROUP BY 1),
m AS (SELECT id, site, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d FROM v, l) SELECT id, arg_min(site, (d, site)) AS site, round(min(d), 9) AS distance FROM m GROUP BY 1""")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the labels' middles for every point, however far."""
    v = _polygons(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y")
    sites = _polygons(spark, sf_dir).groupBy(F.col("label").alias("site")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return geometry.nearest_site(v, sites, 0.1).select("id", "site", F.round("distance", 9).alias("distance"))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
m AS (SELECT v.id, s.id AS site, sqrt((v.x - s.x) * (v.x - s.x) + (v.y - s.y) * (v.y - s.y)) AS d FROM v JOIN v AS s ON v.id <> s.id) SELECT id, arg_min(site, (d, site)) AS site, round(min(d), 9) AS distance FROM m GROUP BY 1""")
def nearest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all other rows, however far."""
    v = _polygons(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y")
    return geometry.nearest_site(v, v.withColumnRenamed("id", "site"), 0.01, others=True).select("id", "site", F.round("distance", 9).alias("distance"))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
m AS (SELECT v.id, s.id AS site, sqrt((v.x - s.x) * (v.x - s.x) + (v.y - s.y) * (v.y - s.y)) AS d FROM v JOIN v AS s ON v.id <> s.id) SELECT id, arg_min(site, (d, site)) AS site, round(min(d), 9) AS distance FROM m GROUP BY 1""")
def quadtree_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by cells that split where the points crowd."""
    v = _polygons(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y")
    return quadtree.Quadtree(v.withColumnRenamed("id", "site"), others=True).nearest(v).select("id", "site", F.round("distance", 9).alias("distance"))


@query("""WITH c AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent, c_custkey AS k FROM customer), e AS (SELECT id, parent, k, 1.0 AS s FROM c
UNION ALL SELECT 'b' || k || '.' || i, parent, k, i / 10.0 FROM c, range(1, 3) t(i) WHERE k % 5 = 0 UNION ALL SELECT 'a' || k, parent, k, 1.5 FROM c WHERE k % 3 = 0)
SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY k, s) AS position FROM e""")
def sibling_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two new nodes before every fifth customer and one after every third, in two batches."""
    k = F.col("c_custkey")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    customers = table(spark, sf_dir, "customer").select(name("c", k).alias("id"), name("n", F.col("c_nationkey")).alias("parent"), "c_custkey")
    nodes = siblings.placed(customers, ["c_custkey"]).select("id", "parent", "place")
    edit = lambda rows, id, side, n: rows.select(id.alias("id"), F.lit(side).alias("side"), name("c", k).alias("anchor"), n.cast("long").alias("n"))
    fifth = customers.where(k % 5 == 0).select("c_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    nodes = siblings.insert(nodes, edit(fifth, F.concat(name("b", k), F.lit("."), F.col("i").cast("string")), "before", F.col("i")))
    nodes = siblings.insert(nodes, edit(customers.where(k % 3 == 0), name("a", k), "after", F.lit(1)))
    return nodes.select("id", "parent", F.row_number().over(Window.partitionBy("parent").orderBy("place")).cast("long").alias("position"))


@query("""WITH r AS (SELECT p_partkey, p_size AS s, p_retailprice AS x, rank() OVER (ORDER BY p_retailprice DESC) AS d, count(*) OVER () AS n FROM part)
SELECT p_partkey, round(CASE WHEN s < 10 THEN s / 10.0 * 100 WHEN s < 30 THEN 100 - (s - 10) / 20.0 * 50 ELSE 50 + (s - 30) / 20.0 * 150 END, 6) AS through, round((ln(x) - ln(900)) / (ln(2000) - ln(900)), 6) AS log, round(least(greatest((sqrt(x) - sqrt(2000)) / (sqrt(1000) - sqrt(2000)), 0), 1), 6) AS down,
round(0.5 + CASE WHEN x > 1400 THEN (x - 1400) / (1400 - 2000) * 0.5 ELSE (x - 1400) / (900 - 1400) * 0.5 END, 6) AS diverging, round((n - d) / (n - 1), 6) AS rank FROM r""")
def scale_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales through four points, bent, descending and clamped, diverging downwards, and by rank."""
    x = F.col("x")
    p = scales.by_rank(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("x")), "x", "rank")
    return p.select(
        "p_partkey", F.round(scales.through(F.col("s"), [0, 10, 30, 50], [0, 100, 50, 200]), 6).alias("through"), F.round(scales.sequential(x, (900, 2000), "log"), 6).alias("log"),
        F.round(scales.sequential(x, (2000, 1000), "sqrt", clamp=True), 6).alias("down"), F.round(scales.diverging(x, 2000, 1400, 900), 6).alias("diverging"), F.round("rank", 6).alias("rank"),
    )
