"""Exact running sums, orders from the inside, arcs, spherical areas and draws, with values known beforehand."""

from __future__ import annotations

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from larkspur.functions import draws, timeops
from larkspur.operators import geometry, hierarchy, stats, windows


def test_running_sums_are_rounded_once(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([1e-300, 5e-324, 0.1, 1.0, 1e16, 1e300]) * rng.uniform(-1, 1)) for g in ("a", "b", None) for i in range(400)]
    rows += [("c", 0, 1.0), ("c", 1, None), ("c", 2, float("nan")), ("c", 3, float("inf")), ("c", 4, 5.0), ("c", 5, float("-inf")), ("d", 0, 1.7e308), ("d", 1, 1.7e308), ("d", 2, -1.7e308)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(7)
    got = {(r.g, r.i): r.running for r in stats.exact_running(df, ["g"], ["i"], "x").collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        values = [x for _, x in sorted((i, x) for k, i, x in rows if k == g)]
        assert [got[g, i] for i in range(400)] == [float(f) for f in itertools.accumulate(map(Fraction, values))]
    assert [got["c", i] for i in range(5)] == [1.0, 1.0, 1.0, math.inf, math.inf] and math.isnan(got["c", 5])
    assert [got["d", i] for i in range(3)] == [1.7e308, math.inf, 1.7e308]


def test_running_sum_without_groups_passes_over_ranges(spark):
    df = spark.range(5000).select(F.col("id"), F.lit(None).cast("int").alias("none"), (F.col("id") / 8).alias("x")).repartition(5)
    got = stats.exact_running(df, [], ["id"], "x").orderBy("id").collect()
    assert [r.running for r in got] == [k * (k + 1) / 16 for k in range(5000)] and got[7].none is None
    assert stats.exact_running(df.where("false"), [], ["id"], "x").count() == 0


def test_inside_out(spark):
    rows = spark.createDataFrame([(1, "a", 5.0), (2, "b", 3.0), (3, "c", 1.0), (4, "d", 4.0), (5, "e", 1.0)], "at int, s string, v double")
    # a goes below (5), b above (3), c above (4), d above (8), e below.
    assert [r.s for r in windows.inside_out(rows, "at", "s", "v").orderBy("position").collect()] == ["e", "a", "b", "c", "d"]
    assert windows.inside_out(rows.where("false"), "at", "s", "v").count() == 0


def test_arcs(spark):
    rows = spark.createDataFrame([("a", "b", 1.0), ("a", "a", 2.0), ("b", "a", 1.0), ("a", "b", 0.0), ("c", "a", None)], "source string, target string, value double")
    unit = (2 * math.pi - 0.3) / 4
    want = [("a", "a", 0, 2 * unit), ("a", "b", 2 * unit, 3 * unit), ("b", "a", 3 * unit + 0.1, 4 * unit + 0.1)]
    got = sorted((r.source, r.target, r.start_angle, r.end_angle) for r in hierarchy.arcs(rows, 0.1).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [x for g in got for x in g[2:]] == pytest.approx([x for w in want for x in w[2:]])


def test_areas_on_the_sphere(spark):
    rings = {"octant": [(0, 0), (0, 90), (90, 0)], "rest": [(90, 0), (0, 90), (0, 0)], "lune": [(0, 0), (0, 90), (45, 0), (0, -90)]}
    rows = spark.createDataFrame([(k, i, float(x), float(y)) for k, ps in rings.items() for i, (x, y) in enumerate(ps)], "k string, i int, x double, y double")
    got = {r.k: r.area for r in geometry.sphere_area(rows, "k", "i").collect()}
    assert got == pytest.approx({"octant": math.pi / 2, "rest": 3.5 * math.pi, "lune": math.pi / 2 * 1})


@pytest.mark.parametrize(
    ("draw", "mean", "variance"),
    [
        (lambda k: draws.poisson(k, 1, 4.0), 4.0, 4.0), (lambda k: draws.gamma(k, 2, 2.5, 2.0), 5.0, 10.0), (lambda k: draws.gamma(k, 3, 0.5), 0.5, 0.5),
        (lambda k: draws.beta(k, 4, 2.0, 3.0), 0.4, 0.04),
    ],
)
def test_draws_have_their_moments(spark, draw, mean, variance):
    r = spark.range(20000).select(draw(F.col("id")).alias("x")).agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.count("x").alias("n")).first()
    assert r.n == 20000 and r.m == pytest.approx(mean, rel=0.03) and r.v == pytest.approx(variance, rel=0.08)


def test_chinese_dates(spark):
    r = spark.sql("SELECT timestamp'2024-02-29 10:00:00' AS t").select(timeops.chinese_month(F.col("t")), timeops.chinese_date(F.col("t"))).first()
    assert tuple(r) == ("二月", "2024年2月29日星期四")
