"""Queries for layouts of hierarchies: customers in nations in regions, as large as their balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import layout
from larkspur.plans.registry import query
from larkspur.plans.shapes import tree_nodes

# Totals of the four levels, each with its place among the children of its parent.
_SUMS = """l3 AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent, abs(c_acctbal) + 1 AS t FROM customer),
l2 AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, coalesce(sum(t), 0) AS t FROM nation LEFT JOIN l3 ON l3.parent = 'n' || n_nationkey GROUP BY ALL),
l1 AS (SELECT 'r' || r_regionkey AS id, 'all' AS parent, coalesce(sum(t), 0) AS t FROM region LEFT JOIN l2 ON l2.parent = 'r' || r_regionkey GROUP BY ALL),
p0 AS (SELECT 'all' AS id, NULL AS parent, 0 AS depth, sum(t) AS t, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 1000.0::DOUBLE AS x1, 600.0::DOUBLE AS y1 FROM l1)"""
_ROWS = "SELECT id, parent, CAST(depth AS BIGINT) AS depth, round(t, 2) AS total, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM (FROM p0 UNION ALL FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)"


def _worst(s: str, lo: str, hi: str) -> str:
    thick = f"greatest(x1 - x0, y1 - y0) * ({s}) / w"
    side = f"least(x1 - x0, y1 - y0) / ({s})"
    return f"greatest({thick} / ({side} * ({lo})) / {layout.GOLDEN!r}, {layout.GOLDEN!r} * ({side} * ({hi})) / ({thick}))"


def _squarify_sql(d: int) -> str:
    """p{d}: one child after another by recursion, then the tiles of each row."""
    return f"""o{d} AS (SELECT c.id, c.parent, c.t, row_number() OVER (PARTITION BY c.parent ORDER BY c.t DESC, c.id) AS k, p.t AS w, x0, y0, x1, y1 FROM l{d} c JOIN p{d - 1} p ON p.id = c.parent WHERE c.t > 0),
s{d}(id, parent, t, k, w, x0, y0, x1, y1, s, hi, r) AS (SELECT id, parent, t, k, w, x0, y0, x1, y1, t, t, 1 FROM o{d} WHERE k = 1 UNION ALL
SELECT id2, parent, t2, k2, CASE WHEN fits THEN w ELSE w - s END, CASE WHEN fits OR x1 - x0 < y1 - y0 THEN x0 ELSE x0 + (x1 - x0) * s / w END, CASE WHEN fits OR x1 - x0 >= y1 - y0 THEN y0 ELSE y0 + (y1 - y0) * s / w END, x1, y1,
CASE WHEN fits THEN s + t2 ELSE t2 END, CASE WHEN fits THEN hi ELSE t2 END, CASE WHEN fits THEN r ELSE r + 1 END
FROM (SELECT a.*, b.id AS id2, b.t AS t2, b.k AS k2, {_worst("a.s + b.t", "b.t", "a.hi").replace("x1", "a.x1").replace("x0", "a.x0").replace("y1", "a.y1").replace("y0", "a.y0").replace(" / w", " / a.w")} <=
{_worst("a.s", "a.t", "a.hi").replace("x1", "a.x1").replace("x0", "a.x0").replace("y1", "a.y1").replace("y0", "a.y0").replace(" / w", " / a.w")} AS fits FROM s{d} a JOIN o{d} b ON b.parent = a.parent AND b.k = a.k + 1)),
q{d} AS (SELECT *, max(s) OVER (PARTITION BY parent, r) AS total, sum(t) OVER (PARTITION BY parent, r ORDER BY k) AS e FROM s{d}),
p{d} AS (SELECT id, parent, {d} AS depth, t, CASE WHEN x1 - x0 < y1 - y0 THEN x0 + (x1 - x0) * (e - t) / total ELSE x0 END AS x0, CASE WHEN x1 - x0 < y1 - y0 THEN y0 ELSE y0 + (y1 - y0) * (e - t) / total END AS y0,
CASE WHEN x1 - x0 < y1 - y0 THEN x0 + (x1 - x0) * e / total ELSE x0 + (x1 - x0) * total / w END AS x1, CASE WHEN x1 - x0 < y1 - y0 THEN y0 + (y1 - y0) * total / w ELSE y0 + (y1 - y0) * e / total END AS y1 FROM q{d})"""


def _line_sql(d: int, across: bool, band: bool) -> str:
    """p{d}: running sums of shares along one side; `band` puts each level below the one above."""
    low, high, other = ("x0", "x1", ("y0", "y1")) if across else ("y0", "y1", ("x0", "x1"))
    sides = f"{d} * 150.0 AS y0, {d + 1} * 150.0 AS y1" if band else f"p.{other[0]}, p.{other[1]}"
    e = "sum(c.t) OVER (PARTITION BY c.parent ORDER BY c.t DESC, c.id ROWS UNBOUNDED PRECEDING)"
    ends = f"p.{low} + (p.{high} - p.{low}) * ({e} - c.t) / p.t AS {low}, p.{low} + (p.{high} - p.{low}) * {e} / p.t AS {high}"
    return f"p{d} AS (SELECT id, parent, depth, t, x0, y0, x1, y1 FROM (SELECT c.id, c.parent, {d} AS depth, c.t, {ends}, {sides} FROM l{d} c JOIN p{d - 1} p ON p.id = c.parent))"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer tree; a customer's value is its balance, whatever the sign, and 1."""
    return tree_nodes(spark, sf_dir).withColumn("v", F.when(F.col("id").startswith("c"), F.abs("v") + 1).otherwise(0.0))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("id", "parent", "depth", F.round("total", 2).alias("total"), *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"WITH RECURSIVE {_SUMS}, {', '.join(map(_squarify_sql, (1, 2, 3)))} {_ROWS}")
def treemap_squarified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(layout.rectangles(_nodes(spark, sf_dir), "v", 1000, 600))


@query(f"WITH {_SUMS}, {', '.join(_line_sql(d, d % 2 == 1, False) for d in (1, 2, 3))} {_ROWS}")
def treemap_slicedice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(layout.rectangles(_nodes(spark, sf_dir), "v", 1000, 600, "slicedice"))


@query(f"WITH {_SUMS.replace('600.0::DOUBLE', '150.0::DOUBLE')}, {', '.join(_line_sql(d, True, True) for d in (1, 2, 3))} {_ROWS}")
def partition_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bands, one a level."""
    return _rounded(layout.partition(_nodes(spark, sf_dir), "v", 1000, 600))
