"""Places within groups by ranges, ribbons, subtrees, formats by name, and rings on the sphere, with values known beforehand."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import geometry, hierarchy, stats, trees


def test_places_within_groups_pass_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, float("nan"), 1.0, 2.0, 2.0, 3.5])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, x double").repartition(9)
    got = {r.k: r.position for r in stats.numbered_within(df, ["g"], F.desc("k")).collect()}
    ranks = {r.k: r["rank"] for r in stats.ranked(df, ["g"], "x").collect()}
    for g in ("a", "b", None):
        own = sorted((k for h, k, _ in rows if h == g), reverse=True)
        assert [got[k] for k in own] == list(range(1, len(own) + 1))
        values = {k: x for h, k, x in rows if h == g}
        shown = sorted(x for x in values.values() if x is not None and x == x)
        assert all(ranks[k] == (None if x is None or x != x else shown.index(x)) for k, x in values.items())
        at = {r.g: r for r in stats.quantile_index(df, ["g"], "x", "k", 0.7).collect()}[g]
        order = sorted(values, key=lambda k: (values[k] is None or values[k] != values[k], values[k] or 0, k))
        assert at.k == order[math.floor((len(shown) - 1) * 0.7)]
    assert len(ranks) == len(rows) and stats.numbered_within(df.where("false"), ["g"], "k").count() == 0


def test_places_without_keys_are_of_all_rows(spark):
    df = spark.range(500).withColumn("position2", F.col("id"))
    assert [r.position for r in stats.numbered_within(df, [], "id").orderBy("id").collect()] == list(range(1, 501))


def ribbons(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_ribbons(spark):
    rows = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0), ("a", "a", 2.0), ("a", "c", 1.0), ("c", "d", 0.0), ("b", None, 9.0)], "source string, target string, value double")
    # a sends 4 (a 2, b 1, c 1), b sends 3 (a 3), c and d nothing: seven parts of the circle.
    u = (2 * math.pi - 0.4) / 7
    at = {"a": 0, "b": 4 * u + 0.1, "c": 7 * u + 0.2, "d": 7 * u + 0.3}
    want = [("a", "a", 2.0, 2.0, 0, 2 * u, 0, 2 * u), ("a", "c", 1.0, 0.0, 3 * u, 4 * u, at["c"], at["c"]), ("b", "a", 3.0, 1.0, at["b"], at["b"] + 3 * u, 2 * u, 3 * u)]
    assert ribbons(hierarchy.chords(rows, 0.1)) == [tuple(round(v, 9) if isinstance(v, float) else v for v in w) for w in want]
    turned = hierarchy.chords(rows, 0.1, transposed=True).where("source = 'a' and target = 'b'")
    assert [(r.value, r.back) for r in turned.collect()] == [(3.0, 1.0)]


def test_directed_ribbons(spark):
    rows = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0), ("c", "a", 2.0)], "source string, target string, value double")
    u = 2 * math.pi / 12
    # a receives from c (2) and b (3), then sends to b (1); b receives 1 and sends 3; c sends 2.
    want = {("a", "b"): (5, 6, 6, 7), ("b", "a"): (7, 10, 2, 5), ("c", "a"): (10, 12, 0, 2)}
    got = {(r.source, r.target): (r.source_start, r.source_end, r.target_start, r.target_end) for r in hierarchy.chords(rows, directed=True).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx([v * u for v in want[k]]) for k in want)
    assert hierarchy.chords(rows.where("false")).collect() == []
    assert hierarchy.chords(rows.withColumn("value", F.lit(0.0))).collect() == []


def test_links_subtrees_and_tops(spark):
    t = spark.createDataFrame([("r", None, 1), ("a", "r", 2), ("b", "a", 3), ("c", "b", 4)], "id string, parent string, v int")
    assert sorted(map(tuple, hierarchy.links(t).collect())) == [("a", "b"), ("b", "c"), ("r", "a")]
    tops = spark.createDataFrame([("a",), ("b",), ("b",), ("gone",)], "id string")
    got = sorted(map(tuple, hierarchy.subtrees(t, hierarchy.closure(t), tops).collect()), key=str)
    assert got == [("a", "a", None, 0, 2), ("a", "b", "a", 1, 3), ("a", "c", "b", 2, 4), ("b", "b", None, 0, 3), ("b", "c", "b", 1, 4)]


def test_shown(spark):
    t = spark.createDataFrame([("r", None, True), ("a", "r", False), ("b", "r", True), ("c", "a", True), ("d", "b", None), ("e", "d", True)], "id string, parent string, expanded boolean")
    assert sorted(r.id for r in hierarchy.shown(t).collect()) == ["a", "b", "d", "r"]
    assert hierarchy.shown(t.where("false")).collect() == []


@pytest.mark.parametrize(
    ("paths", "want"),
    [
        (["x/y/a", "x/y/b"], {"x/y": (None, 0), "x/y/a": ("x/y", 1), "x/y/b": ("x/y", 1)}),
        (["x", "x/y/a"], {"x": (None, 0), "x/y": ("x", 1), "x/y/a": ("x/y", 2)}),
        (["a", "b"], {"": (None, 0), "a": ("", 1), "b": ("", 1)}),
        (["x/y"], {"x/y": (None, 0)}),
        ([], {}),
    ],
)
def test_imputed_tops_with_one_child_go(spark, paths, want):
    tree = hierarchy.from_paths(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r.id: (r.parent, r.depth) for r in hierarchy.without_imputed_top(tree).collect()} == want


def test_sides(spark):
    rows = [("a", "left"), ("b", "left"), ("b", None), ("c", "right"), ("c", None), ("d", "right"), ("e", "left"), ("e", None), ("e", "right")]
    got = {r.parent: r.side for r in hierarchy.next_side(spark.createDataFrame(rows, "parent string, side string")).collect()}
    assert got == {"a": "right", "b": "right", "c": "left", "d": "right", "e": "left"}


def test_formats_by_name(spark):
    rows = [(k, i, d, t, form) for k, form in enumerate(trees.FORMATS) for i, (d, t) in enumerate([(0, "top"), (1, 'a<"b">&'), (2, "c"), (1, "d")])]
    nodes = trees.with_parents(spark.createDataFrame(rows, "k long, position long, depth long, topic string, form string"), "k")
    texts = trees.write_trees(nodes, "k", "form")
    assert {r.k: r.form for r in texts.collect()} == dict(enumerate(trees.FORMATS))
    back = trees.read_trees(texts, "k", "text", "form").collect()
    names = {(r.k, r.id): r.topic for r in back}
    for k in range(3):
        assert sorted((r.topic, names.get((k, r.parent)) or "") for r in back if r.k == k) == [('a<"b">&', "top"), ("c", 'a<"b">&'), ("d", "top"), ("top", "")]
    for wrong in ("yaml", None):
        with pytest.raises(Exception, match="unknown tree format"):
            trees.read_trees(texts.withColumn("form", F.lit(wrong).cast("string")), "k", "text", "form").collect()


def spot(rng):
    z = rng.uniform(-1, 1)
    return rng.uniform(-180, 180), math.degrees(math.asin(z))


def angle(p, q):
    (a, b), (c, d) = (tuple(map(math.radians, t)) for t in (p, q))
    return math.acos(max(-1.0, min(1.0, math.sin(b) * math.sin(d) + math.cos(b) * math.cos(d) * math.cos(a - c))))


def test_caps_hold_what_is_near_their_middle(spark):
    """Rings of 90 corners round a middle, over poles and the date line, both ways round."""
    rng, rows, caps = random.Random(4), [], {}
    for k in range(40):
        lon, lat = [(0, 90), (0, -90), (180, 10), (179, -80)][k] if k < 4 else spot(rng)
        radius, way = rng.uniform(0.2, 1.4), rng.choice([1, -1])
        caps[k] = ((lon, lat), radius, way)
        for i in range(90):
            t, y = way * 2 * math.pi * i / 90, math.radians(lat)
            s = math.asin(math.sin(y) * math.cos(radius) + math.cos(y) * math.sin(radius) * math.cos(t))
            x = math.radians(lon) + math.atan2(math.sin(t) * math.sin(radius) * math.cos(y), math.cos(radius) - math.sin(y) * math.sin(s))
            if abs(lat) == 90:
                x, s = t, math.copysign(math.pi / 2 - radius, lat)
            rows.append((k, i, math.degrees(x) + rng.choice([0, 360]), math.degrees(s)))
    df = spark.createDataFrame(rows, "k int, i int, x double, y double").cache()
    area = {r.k: r.area for r in geometry.sphere_area(df, "k", "i").collect()}
    for _ in range(12):
        place = spot(rng)
        got = {r.k: r.inside for r in geometry.sphere_contains(df, "k", "i", *place).collect()}
        for k, (middle, radius, _) in caps.items():
            if abs(angle(middle, place) - radius) > 0.01:
                small = area[k] < 2 * math.pi
                assert got[k] == ((angle(middle, place) < radius) == small)


def test_lengths_and_places_between(spark):
    df = spark.createDataFrame([("q", 0, 170.0, 0.0), ("q", 1, -170.0, 0.0), ("q", 2, -170.0, 30.0), ("p", 0, 5.0, 5.0)], "k string, i int, x double, y double")
    assert {r.k: r.length for r in geometry.sphere_length(df, "k", "i").collect()} == pytest.approx({"q": math.radians(50), "p": 0.0})
    assert {r.k: r.length for r in geometry.sphere_length(df, "k", "i", closed=True).collect()} == pytest.approx({"q": math.radians(50) + angle((-170, 30), (170, 0)), "p": 0.0})
    pairs = spark.createDataFrame([(170.0, 0.0, -170.0, 0.0, 0.75), (0.0, 0.0, 90.0, 60.0, 0.5), (7.0, 8.0, 7.0, 8.0, 0.3)], "a double, b double, c double, d double, t double")
    x, y = geometry.sphere_between(*(F.col(c) for c in "abcdt"))
    got = [(r.x, r.y) for r in pairs.select(x.alias("x"), y.alias("y")).collect()]
    assert got[0] == pytest.approx((-175, 0)) and got[2] == pytest.approx((7, 8))
    assert angle((0, 0), got[1]) == pytest.approx(angle(got[1], (90, 60)))
