"""Operators on the rows that narrower queries leave out; the whole queries themselves are held against SQL in test_queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import formatting
from larkspur.operators import geometry, hierarchy
from larkspur.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_si_number_carries_to_the_next_power(spark):
    rows = spark.createDataFrame([(9996.0,), (99960.0,), (999600.0,), (1002.0,), (123456.0,), (-9996.0,)], "x double")
    assert [r[0] for r in rows.select(formatting.si_number(F.col("x"))).collect()] == ["10.0k", "100k", "1.00M", "1.00k", "123k", "-10.0k"]


def test_every_order_is_formatted(spark):
    assert QUERIES["number_format_all"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/orders.parquet").count()


def test_every_line_has_a_place_in_its_group(spark):
    assert QUERIES["group_rows"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


def test_hull_of_parts_is_the_hull(spark):
    inner = [("a", x / 40, y / 41) for x in range(1, 40) for y in range(1, 40)]
    rows = spark.createDataFrame([*inner, *(("a", x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)), ("b", 1.0, 2.0)], "label string, x double, y double")
    assert sorted(tuple(r) for r in geometry.hull(rows, "label").collect()) == [("a", 4, 1.0), ("b", 1, 0.0)]


def test_far_points_have_a_nearest_site(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0), (3, -7.0, 0.31), (4, float("nan"), 0.0)], "id long, x double, y double")
    sites = spark.createDataFrame([(10, 0.05, 0.0), (11, -7.0, 1.31)], "site long, x double, y double")
    assert sorted((r.id, r.site, round(r.distance, 9)) for r in geometry.nearest_site(points, sites, 0.1).collect()) == [(1, 10, 0.05), (2, 10, 49.95), (3, 11, 1.0)]
    assert geometry.nearest_site(points, sites.limit(0), 0.1).count() == 0


def test_repeated_roots_are_all_but_one(spark):
    rows = spark.createDataFrame([("d", None), ("a", None), ("a", None), ("b", None), ("b", None), ("c", "a")], "id string, parent string")
    got = hierarchy.problems(rows)
    assert sorted(r.id for r in got.where("problem = 'multiple roots'").collect()) == ["a", "b", "b", "d"]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_every_customer_is_in_a_pair(spark):
    assert QUERIES["hier_path_lca"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/customer.parquet").count() - 1


def test_every_customer_meets_every_nation(spark):
    """The lowest common ancestor with one's own nation is that nation."""
    got = QUERIES["hier_path_lca_all"](spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/customer.parquet").count() * 25
    own = spark.read.parquet(f"{FOLDER}/customer.parquet").selectExpr("concat('c', c_custkey) AS a", "concat('n', c_nationkey) AS b")
    assert got.join(own, ["a", "b"]).where("lca <> b OR distance <> 1").count() == 0
