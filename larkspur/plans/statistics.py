"""Queries for grouping, statistics, windows, sets and joins."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators import sets, stats, windows
from larkspur.plans.registry import query
from larkspur.session import table


@query("SELECT l_orderkey, l_returnflag, count(*) AS n, string_agg(l_linenumber || ':' || l_linestatus, ',' ORDER BY l_linenumber, l_linestatus) AS items FROM lineitem GROUP BY ALL")
def group_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each order and flag in one array; groups that grow with the table are numbered instead (group_rows)."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag")
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus")))
    return rows.agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_linestatus"])), ",").alias("items"))


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) AS position FROM lineitem")
def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of lineitem with their place in their group. Groups are numbered by ranges of keys, so no task holds a whole one."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber").withColumn("part", F.floor(F.col("l_orderkey") / 4096))
    by = ["l_returnflag", "l_linestatus"]
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*by, "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(*by, "part").orderBy("l_orderkey", "l_linenumber"))
    return rows.withColumn("place", place).join(starts, [*by, "part"]).select(*by, "l_orderkey", "l_linenumber", (F.col("before") + F.col("place")).alias("position"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem GROUP BY ALL")
def flat_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n"))


@query("WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, '{' || string_agg('\"' || l_linestatus || '\":' || n, ',' ORDER BY l_linestatus) || '}' AS nested FROM g GROUP BY 1")
def rollup_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linestatus", "n"))))
    return g.groupBy("l_returnflag").agg(F.to_json(entries).alias("nested"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def index_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.unique_index(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")


@query("WITH g AS (SELECT l_shipdate AS day, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1) SELECT *, row_number() OVER (ORDER BY value, day) AS position FROM g")
def group_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_sort(table(spark, sf_dir, "lineitem").withColumnRenamed("l_shipdate", "day"), "day", F.round(F.sum("l_extendedprice"), 2))


_SUMMARY = "count({v}) AS count, round(coalesce(sum({v}), 0), 4) AS sum, round(avg({v}), 6) AS mean, min({v}) AS min, max({v}) AS max, round(var_samp({v}), 4) AS variance, round(stddev_samp({v}), 6) AS deviation"


def _summary(rows: DataFrame, key: str, x) -> DataFrame:
    digits = {"sum": 4, "mean": 6, "variance": 4, "deviation": 6}
    out = rows.groupBy(key).agg(*stats.summary(x))
    return out.select(key, *(F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns[1:]))


@query(f"SELECT event_type, {_SUMMARY.format(v='value')} FROM events GROUP BY 1")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(table(spark, sf_dir, "events"), "event_type", F.col("value"))


@query(f"WITH e AS (SELECT event_type, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_type = 'click' THEN NULL ELSE value END AS v FROM events) SELECT event_type, {_SUMMARY.format(v='v')} FROM e GROUP BY 1")
def agg_nan_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x = F.when((F.col("event_id") % 5 == 0) | (F.col("event_type") == "click"), F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value"))
    return _summary(e.withColumn("x", x), "event_type", F.col("x"))


@query("SELECT l_returnflag, round(var_samp(l_extendedprice), 2) AS variance, round(stddev_samp(l_extendedprice), 4) AS deviation FROM lineitem GROUP BY 1")
def variance_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.var_samp("l_extendedprice"), 2).alias("variance"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("deviation"))


_PS = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p90": 0.9, "p100": 1.0}


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS {k}" for k, p in _PS.items()) + " FROM lineitem GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.grouped_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", _PS)
    return out.select("l_returnflag", *(F.round(k, 4).alias(k) for k in _PS))


@query("WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, p_retailprice FROM r WHERE r = floor((n - 1) * 0.4) + 1")
def quantile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantile_index(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey", 0.4)


@query("WITH g AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM g) SELECT user_id, event_type AS mode, n FROM r WHERE r = 1")
def mode_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS b FROM part)
SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS size, CASE WHEN a = 1 THEN 'least' ELSE 'greatest' END AS kind FROM r WHERE a = 1 UNION ALL SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE), 'greatest' FROM r WHERE b = 1""")
def least_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("size"))
    return stats.extreme(p, ["p_brand"], "size", "p_partkey").withColumn("kind", F.lit("least")).unionByName(stats.extreme(p, ["p_brand"], "size", "p_partkey", False).withColumn("kind", F.lit("greatest")))


@query("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice * l_discount * pow(2.0, 56) AS HUGEINT)) AS DOUBLE) / pow(2.0, 56) AS total FROM lineitem GROUP BY 1")
def fsum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL sums whole multiples of 2**-56, of which every product here is one."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") * F.col("l_discount")).alias("x"))
    return stats.exact_sum(rows, ["l_returnflag"], "x")


@query("""WITH RECURSIVE g AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p(pass, user_id, i, n, value) AS (SELECT 0, user_id, i, n, value FROM g UNION ALL SELECT pass + 1, user_id, i, n, v FROM (SELECT a.pass, a.user_id, a.i, a.n,
  (sum(a.value) OVER w + greatest(0, 3 - a.i) * first(a.value) OVER e + greatest(0, a.i + 2 - a.n) * last(a.value) OVER e) / 5 AS v FROM p AS a
  WINDOW w AS (PARTITION BY a.pass, a.user_id ORDER BY a.i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), e AS (PARTITION BY a.pass, a.user_id ORDER BY a.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE pass < 3)
SELECT g.event_id, round(p.value, 6) AS smooth FROM p JOIN g USING (user_id, i) WHERE pass = 3""")
def blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return windows.blur(rows, ["user_id"], "event_id", "value", 2).select("event_id", F.round("value", 6).alias("smooth"))


_MEANS = "(sum(a.v) OVER w + greatest(0, 1 - a.{i}) * first(a.v) OVER e + greatest(0, a.{i} + 1 - 9) * last(a.v) OVER e) / 3"
_PASS = """(SELECT a.pass, a.i, a.j, {mean} AS v FROM {t} AS a WINDOW w AS (PARTITION BY a.pass, a.{other} ORDER BY a.{i} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), e AS (PARTITION BY a.pass, a.{other} ORDER BY a.{i} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def _passes(i: str, other: str, t: str) -> str:
    return _PASS.format(mean=_MEANS.format(i=i), i=i, other=other, t=t)


@query(f"""WITH RECURSIVE n AS (SELECT p_size % 10 AS i, p_partkey % 10 AS j, count(*) AS n FROM part GROUP BY 1, 2), g AS (SELECT CAST(a AS INT) AS i, CAST(b AS INT) AS j, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM range(10) x(a), range(10) y(b) LEFT JOIN n ON n.i = a AND n.j = b),
p(pass, i, j, v) AS (SELECT 0, i, j, v FROM g UNION ALL SELECT pass + 1, i, j, v FROM {_passes("j", "i", "p")} WHERE pass < 3),
q(pass, i, j, v) AS (SELECT 0, i, j, v FROM p WHERE pass = 3 UNION ALL SELECT pass + 1, i, j, v FROM {_passes("i", "j", "q")} WHERE pass < 3) SELECT i, j, round(v, 6) AS v FROM q WHERE pass = 3""")
def blur_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts counted on a grid of ten by ten, blurred along its rows and then its columns."""
    cells = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 10).cast("int").alias("i"), (F.col("p_partkey") % 10).cast("int").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return windows.blur_grid(windows.full_grid(cells, [], (10, 10), "v"), [], "v", 1, 1).select("i", "j", F.round("v", 6).alias("v"))


@query("SELECT CAST(k AS DOUBLE) / 100 AS x0, CAST(k + 1 AS DOUBLE) / 100 AS x1, coalesce(n, 0) AS n FROM range(0, 11) t(k) LEFT JOIN (SELECT CAST(round(l_discount * 100) AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY 1) USING (k)")
def bin_small_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundredths, each of which stands on the edge of a bin."""
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_discount", 10)


@query("SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000)) - 1 AS rank FROM supplier")
def rank_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return stats.ranked(s.select("s_suppkey", "s_nationkey", F.round(F.col("s_acctbal") / 1000).alias("x")), ["s_nationkey"], "x").drop("x")


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(windows.cumsum(F.col("value"), by), 4).alias("total"))


@query("WITH p AS (SELECT event_id, value, lead(value) OVER w AS next_x, lead(event_id) OVER w AS more FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, round(next_x - value, 6) AS delta FROM p WHERE more IS NOT NULL")
def pairs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return windows.pairs(table(spark, sf_dir, "events"), by, "value").select("event_id", F.round(F.col("next_x") - F.col("value"), 6).alias("delta"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events")
def moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(windows.moving_average(F.col("value"), by, 2), 6).alias("smooth"))


_MONTHS = "m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, sum(l_extendedprice * (l_discount - 0.04)) AS v FROM lineitem GROUP BY ALL)"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.04))
    return table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag").agg(v.alias("v"))


_STACKS = {
    "none": "sum(v) OVER up - v AS y0, sum(v) OVER up AS y1",
    "expand": "CASE WHEN sum(v) OVER a <> 0 THEN (sum(v) OVER up - v) / sum(v) OVER a ELSE 0 END AS y0, CASE WHEN sum(v) OVER a <> 0 THEN sum(v) OVER up / sum(v) OVER a ELSE 0 END AS y1",
    "diverging": "CASE WHEN v >= 0 THEN sum(greatest(v, 0)) OVER up - v ELSE sum(least(v, 0)) OVER up END AS y0, CASE WHEN v >= 0 THEN sum(greatest(v, 0)) OVER up ELSE sum(least(v, 0)) OVER up - v END AS y1",
    "silhouette": "sum(v) OVER up - v - sum(v) OVER a / 2 AS y0, sum(v) OVER up - sum(v) OVER a / 2 AS y1",
}
for _kind, _cols in _STACKS.items():

    @query(f"WITH {_MONTHS}, s AS (SELECT month, l_returnflag, {_cols} FROM m WINDOW a AS (PARTITION BY month), up AS (PARTITION BY month ORDER BY l_returnflag ROWS UNBOUNDED PRECEDING)) SELECT month, l_returnflag, round(y0, 5) AS y0, round(y1, 5) AS y1 FROM s", f"stack_{_kind}")
    def _stack(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return windows.stack(_months(spark, sf_dir), "month", "l_returnflag", "v", kind).select("month", "l_returnflag", F.round("y0", 5).alias("y0"), F.round("y1", 5).alias("y1"))


_ORDERS = {"none": "s", "reverse": "s DESC", "ascending": "t, s", "descending": "t DESC, s DESC", "appearance": "peak, s"}


@query(f"WITH {_MONTHS}, g AS (SELECT l_returnflag AS s, sum(v) AS t, arg_min(month, (-v, month)) AS peak FROM m GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, s AS l_returnflag, row_number() OVER (ORDER BY {o}) AS position FROM g" for k, o in _ORDERS.items()))
def stack_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, out = _months(spark, sf_dir), None
    for k in _ORDERS:
        one = windows.stack_order(m, "month", "l_returnflag", "v", k).select(F.lit(k).alias("kind"), "l_returnflag", "position")
        out = one if out is None else out.unionByName(one)
    return out


_SALES = "m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS s, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_SALES}, d AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY s ORDER BY month), v) AS dv FROM m),
t AS (SELECT a.month, sum(a.v * a.dv / 2) + coalesce((SELECT sum(b.dv * c.v) FROM d AS b JOIN d AS c ON b.month = c.month AND b.s < c.s WHERE b.month = a.month), 0) AS s2, sum(a.v) AS s1 FROM d AS a GROUP BY a.month)
SELECT month, round(-sum(s2 / s1) OVER (ORDER BY month), 4) AS base FROM t""")
def stack_wiggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    return windows.wiggle(months, "month", "l_returnflag", "v").select("month", F.round("base", 4).alias("base"))


@query(f"WITH g AS (SELECT o_orderpriority AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT k, round({2 * pi} * (sum(v) OVER w - v) / sum(v) OVER (), 6) AS start_angle, round({2 * pi} * sum(v) OVER w / sum(v) OVER (), 6) AS end_angle FROM g WINDOW w AS (ORDER BY v DESC, k ROWS UNBOUNDED PRECEDING)")
def pie_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return windows.pie(g, "k", "v").select("k", F.round("start_angle", 6).alias("start_angle"), F.round("end_angle", 6).alias("end_angle"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS position FROM customer")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal", "c_custkey")
    return stats.numbered_within(rows, ["c_nationkey"], "c_mktsegment", F.desc("c_acctbal"), "c_custkey").select("c_custkey", "position")


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def dim_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


@query(f"{_A} UNION {_B}")
def union_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union(*_nations(spark, sf_dir))


@query(f"{_A} INTERSECT {_B}")
def intersect_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersection(*_nations(spark, sf_dir))


@query(f"{_A} EXCEPT {_B}")
def except_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(*_nations(spark, sf_dir))


@query(f"WITH a AS ({_A}), b AS ({_B}) SELECT (SELECT count(*) = 0 FROM a WHERE k NOT IN (SELECT k FROM b)) AS subset, (SELECT count(*) = 0 FROM b WHERE k NOT IN (SELECT k FROM a)) AS superset, (SELECT count(*) = 0 FROM a WHERE k IN (SELECT k FROM b)) AS disjoint")
def subset_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.relation(*_nations(spark, sf_dir))


_ENDS = "e AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, stddev_samp(x) AS dev FROM v)"
_STURGES = "greatest(1, ceil(ln(n) / ln(2.0)) + 1)"


def step_sql(lo: str, hi: str, count: str) -> str:
    raw = f"(({hi} - {lo}) / {count})"
    power = f"pow(10.0, floor(log10({raw})))"
    return f"({power} * CASE WHEN {raw} / {power} >= sqrt(50) THEN 10 WHEN {raw} / {power} >= sqrt(10) THEN 5 WHEN {raw} / {power} >= sqrt(2) THEN 2 ELSE 1 END)"


@query(f"""WITH v AS (SELECT l_extendedprice AS x FROM lineitem), {_ENDS}, s AS (SELECT lo, hi, {step_sql('lo', 'hi', _STURGES)} AS step FROM e),
b AS (SELECT step, unnest(range(CAST(floor(lo / step) AS BIGINT), CAST(floor(hi / step) AS BIGINT) + 1)) AS k FROM s), c AS (SELECT CAST(floor(x / step) AS BIGINT) AS k, count(*) AS n FROM v, s GROUP BY 1)
SELECT k * step AS x0, (k + 1) * step AS x1, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (k)""")
def bin_sturges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


_EDGES = [0.0, 5.0, 10.0, 20.0, 40.0, 50.0]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS x0, {b}::DOUBLE AS x1, count(*) AS n FROM lineitem WHERE l_quantity >= {a} AND l_quantity {'<=' if b == _EDGES[-1] else '<'} {b}" for a, b in zip(_EDGES, _EDGES[1:])) + ")")
def bin_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram_at(table(spark, sf_dir, "lineitem"), "l_quantity", _EDGES)


@query(f"WITH v AS (SELECT l_extendedprice AS x FROM lineitem), {_ENDS} SELECT CAST({_STURGES} AS BIGINT) AS sturges, CAST(ceil((hi - lo) / (2 * iqr * pow(n, -1 / 3.0))) AS BIGINT) AS freedman_diaconis, CAST(ceil((hi - lo) * cbrt(n) / (3.49 * dev)) AS BIGINT) AS scott FROM e")
def bin_fd_scott(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", F.lit(1).alias("all"))
    e = lines.groupBy("all").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.stddev_samp(x).alias("dev"))
    e = e.join(stats.grouped_quantiles(lines, ["all"], "l_extendedprice", {"low": 0.25, "high": 0.75}), "all").withColumn("iqr", F.col("high") - F.col("low"))
    return e.select(*stats.bin_counts("n", "lo", "hi", "iqr", "dev"))


@query("""WITH RECURSIVE m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_partkey % 12 AS s, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
g AS (SELECT s, CAST(sum(v) AS DOUBLE) AS t, arg_min(month, (-v, month)) AS peak FROM m GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY peak, s) AS i FROM g),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS low, 0 AS side UNION ALL
SELECT n.i, n.s, CASE WHEN up < low THEN up + t ELSE up END, CASE WHEN up < low THEN low ELSE low + t END, CASE WHEN up < low THEN 1 ELSE -1 END FROM w JOIN n ON n.i = w.i + 1)
SELECT s AS series, row_number() OVER (ORDER BY i * side) AS position FROM w WHERE i > 0""")
def stack_inside_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_partkey") % 12).alias("series")).agg(F.sum("l_quantity").alias("v"))
    return windows.inside_out(months, "month", "series", "v")


# Units of 1/1024, as whole numbers.
@query("""WITH v AS (SELECT o_custkey % 3 AS g, o_orderkey, unnest([0, 1, 2]) AS place, unnest([1180591620717411303424::HUGEINT, CAST(round(o_totalprice * 100) AS HUGEINT), -1180591620717411303424::HUGEINT]) AS u FROM orders)
SELECT g, o_orderkey, place, CAST(sum(u) OVER (PARTITION BY g ORDER BY o_orderkey, place) AS DOUBLE) / 1024 AS running FROM v""")
def fcumsum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order between a huge number and its negative."""
    v = F.array(F.lit(2.0**60), F.round(F.col("o_totalprice") * 100) / 1024, F.lit(-(2.0**60)))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("g"), "o_orderkey", F.posexplode(v).alias("place", "x"))
    return stats.exact_running(rows, ["g"], ["o_orderkey", "place"], "x").drop("x")
