"""Operators on hand-made tables of edge cases; expected values are written out."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import draws, formatting, scales, timeops
from larkspur.operators import catalog, delimited, geometry, hierarchy, stats, telemetry, windows
from larkspur.plans import shapes


def values(spark, rows, kind, column):
    """A column over one value a row."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_sizes(spark):
    sizes = [-1, 0, 1, 1023, 1024, 1152, 1048575, 1048576, 1024**4, 1024**5]
    assert values(spark, sizes, "long", formatting.format_size) == ["0 B", "0 B", "1.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1024.00 KB", "1.00 MB", "1.00 TB", "1024.00 TB"]


def test_names(spark):
    names = ["a.TAR.GZ", "Makefile", "x.", "_y.md", ".z", "$q", "x.d.ts", "s.pptx"]
    assert values(spark, names, "string", formatting.extension) == ["gz", "", "", "md", "z", "", "ts", "pptx"]
    assert values(spark, names, "string", catalog.ignored_name) == [False, False, False, False, True, True, False, False]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.file_type for r in catalog.with_file_type(df).collect()}["s.pptx"] == catalog.OTHER


def test_ignored_paths(spark):
    paths = ["build/x", "builder/x", "src/node_modules/x", "a/__pycache__/x", "output/x", "a\\__pycache__\\x", "docs", ".obsidian/x"]
    assert values(spark, paths, "string", catalog.ignored_path) == [True, True, False, True, True, True, False, True]


def test_request_paths(spark):
    paths = ["a/b.md", "", None, "a..b/", "../a", "a/..", "css_js", "css_js/x", "css_jsx", "graphql", "graphqlhost", "api", "api/", "apix/y", "x/api/"]
    assert values(spark, paths, "string", catalog.safe_path) == [True, False, False, False, False, False, False, False, False, False, False, True, False, True, True]


def test_devices(spark):
    devices = ["/dev/sda1", "/dev/nvme0n1", "/dev/nvme0n1p2", "/dev/disk1s1", "/dev/disk1s1s1", "/dev/disk3p2", "/dev/md0", "/dev/mmcblk0p1", "/dev/mmcblk0", "disk1", "/dev/disk2x"]
    assert values(spark, devices, "string", telemetry.physical_id) == ["/dev/sda1", "nvme0n1", "nvme0n1p2", "disk1s1", "disk1s1s1", "disk3p2", "/dev/md0", "mmcblk0p1", "/dev/mmcblk0", "disk1", "disk2"]
    rows = spark.createDataFrame([("/dev/disk1s1", 1, 5.0, 10.0), ("/dev/disk1s1", 0, 5.0, 10.0), ("/dev/sda1", 2, 0.0, 0.0)], "device string, k int, used double, total double")
    assert sorted((r.physical_id, r.k, r.percent) for r in telemetry.busiest_partition(rows, "k").collect()) == [("/dev/sda1", 2, 0.0), ("disk1s1", 0, 50.0)]
    assert tuple(telemetry.disk_totals(rows, "k").first()) == (10.0, 5.0, 50.0)


def test_counters(spark):
    rows = spark.createDataFrame([("a", 0.0, 10.0), ("a", 5.0, 20.0), ("a", 5.0, 30.0), ("a", 10.0, 0.0)], "h string, t double, n double")
    assert sorted((r.t, r.n, r.rate) for r in telemetry.counter_rate(rows, "h", "t", "n", "n").collect()) == [(0.0, 10.0, 0.0), (5.0, 20.0, 2.0), (5.0, 30.0, 0.0), (10.0, 0.0, -6.0)]


def test_exact_sums(spark):
    rng = random.Random(1)
    groups = {
        "tiny": [1e-12] * 1000,
        "wide": [1e20, 1.0, -1e20, 1e-300, 3.0],
        "any": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(500)],
        "least": [5e-324, 5e-324, -5e-324],
        "zeros": [0.0, -0.0, None, float("nan")],
        "whole": [0.1] * 10,
    }
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x double")
    want = {k: math.fsum(x for x in xs if x is not None and x == x) for k, xs in groups.items()}
    assert {r.k: r.total for r in stats.exact_sum(df, ["k"], "x").collect()} == want
    odd = spark.createDataFrame([("over", 1.7e308), ("over", 1.7e308), ("inf", float("inf")), ("inf", 1.0), ("both", float("inf")), ("both", float("-inf"))], "k string, x double")
    got = {r.k: r.total for r in stats.exact_sum(odd, ["k"], "x").collect()}
    assert got["over"] == got["inf"] == float("inf") and math.isnan(got["both"])


def bins(spark, xs, count=None):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    return sorted((r.x0, r.x1, r.n) for r in stats.histogram(df, "x", count).collect())


def test_histograms(spark):
    assert bins(spark, [3.0, 3.0, None]) == [(3.0, 3.0, 2)]
    assert bins(spark, []) == bins(spark, [float("nan")]) == []
    assert bins(spark, [i / 10 for i in range(11)], 10) == [(i / 10, (i + 1) / 10, 1) for i in range(11)]
    assert bins(spark, [0.0, 1.0, 9.0], 5) == [(0.0, 2.0, 2), (2.0, 4.0, 0), (4.0, 6.0, 0), (6.0, 8.0, 0), (8.0, 10.0, 1)]
    assert bins(spark, [-0.3, -0.25, 0.3], 6) == [(-0.3, -0.2, 2), (-0.2, -0.1, 0), (-0.1, 0.0, 0), (0.0, 0.1, 0), (0.1, 0.2, 0), (0.2, 0.3, 0), (0.3, 0.4, 1)]


def test_quantiles_of_odd_groups(spark):
    groups = {"one": [4.0], "same": [2.0] * 9, "skew": [0.0] * 50 + [1e12, 1e12 + 1], "mixed": [None, float("nan"), 3.0, -1.0, 10.0, 7.0]}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x double")
    got = {r.k: (r.a, r.b, r.c) for r in stats.grouped_quantiles(df, ["k"], "x", {"a": 0.0, "b": 0.5, "c": 0.99}).collect()}
    assert got["one"] == (4.0, 4.0, 4.0) and got["same"] == (2.0, 2.0, 2.0)
    assert got["mixed"][:2] == (-1.0, 5.0)
    assert got["skew"] == (0.0, 0.0, pytest.approx(1e12 + 0.49))


def test_adjacency_tables(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s"), ("o", "gone")]
    got = sorted((r.problem, r.id) for r in hierarchy.problems(spark.createDataFrame(rows, "id string, parent string")).collect())
    assert got == [("cycle", "s"), ("cycle", "x"), ("cycle", "y"), ("cycle", "z"), ("missing", "o")]
    only = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")
    assert sorted((r.problem, r.id) for r in hierarchy.problems(only).collect()) == [("cycle", "a"), ("cycle", "b"), ("no root", None)]
    long = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "id int, parent int")
    assert hierarchy.problems(long).count() == 0


def test_moving_average_and_blur(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 4.0)], "i int, x double")
    by = windows.Window.orderBy("i")
    assert [r[0] for r in rows.select(windows.moving_average(F.col("x"), by, 1).alias("m"), "i").orderBy("i").select("m").collect()] == [1.0, 1.0, 4.0, 4.0]
    line = spark.createDataFrame([(0, i, x) for i, x in enumerate([0.0, 0.0, 27.0, 0.0, 0.0, 9.0])], "k int, i int, x double")
    want = [0.0, 0.0, 27.0, 0.0, 0.0, 9.0]
    for _ in range(3):
        want = [sum(want[min(5, max(0, j))] for j in (i - 1, i, i + 1)) / 3 for i in range(6)]
    assert [r.x for r in windows.blur(line, ["k"], "i", "x", 1).orderBy("i").collect()] == pytest.approx(want)


def test_positions_count_on_over_ranges(spark):
    rows = spark.createDataFrame([(f"k{i:03}", float(i * 37 % 101)) for i in range(101)], "k string, v double")
    got = stats.group_sort(rows, "k", F.max("v")).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.position)] == [r.k for r in sorted(got, key=lambda r: r.value)]
    assert sorted(r.position for r in got) == list(range(1, 102))


def test_dates(spark):
    texts = ["2024", "2024-02", "2024-02-29", "2023-02-29", "2024-13", "+012024-01-01", "2024-01-05T10:20", "2024-01-05T10:20:30.123Z", "2024-01-05T25:00", "2024-01-05T10:20:30+01:00", "2024-01-05Z", "2024-1-5", "T10:20", None]
    assert values(spark, texts, "string", formatting.is_date) == [True, True, True, False, False, True, True, True, False, True, False, False, False, False]


def test_xml_escape(spark):
    assert values(spark, ["<a b='c'>\"&amp;", None], "string", formatting.xml_escape) == ["&lt;a b=&apos;c&apos;&gt;&quot;&amp;amp;", None]


def plain_hull(points):
    """Area and corners of the convex hull: the points that lie on no segment or triangle of others, by angles."""
    points = sorted(set(points))
    at, ring = points[0], []
    while not ring or at != ring[0]:
        ring.append(at)
        best = points[0] if points[0] != at else points[1]
        for p in points:
            turn = (best[0] - at[0]) * (p[1] - at[1]) - (best[1] - at[1]) * (p[0] - at[0])
            if p != at and (turn < 0 or turn == 0 and math.dist(at, p) > math.dist(at, best)):
                best = p
        at = best
    return len(ring), sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def test_hulls_of_the_embeddings(spark):
    groups = {}
    for r in shapes._polygons(spark, "/root/testdata/sf0.001").collect():
        groups.setdefault(r.label, []).append((r.x, r.y))
    got = {r.label: (r.n_hull, r.area) for r in shapes.polygon_hull(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: (n, pytest.approx(area)) for k, (n, area) in ((k, plain_hull(p)) for k, p in groups.items())}


def test_quotes_that_are_never_closed(spark):
    """Such a quote holds the rest of the text; a quote within a cell is a character as any other."""
    texts = ['a,"b\nc\n1,2', '"x', 'a"b\nc"d,e', '"a""b\n', 'p,""\n"q', '"r\ns",t\nu', "", '"', "a,\n,b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got: dict[int, list] = {}
    for r in sorted(delimited.parse_rows(frame, "k", "t").collect()):
        got.setdefault(r.k, []).append(r.cells)
    assert [got.get(k, []) for k in range(len(texts))] == [[["a", "b\nc\n1,2"]], [["x"]], [['a"b'], ['c"d', "e"]], [['a"b\n']], [["p", ""], ["q"]], [["r\ns", "t"], ["u"]], [], [[""]], [["a", ""], ["", "b"]]]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_in_any_zone(spark, zone):
    """ISO texts are in UTC wherever the session is; local directives follow the zone."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # Twice half past one in New York on the day when its clocks go back.
        seconds = [0.0, 1730611800.25, 1730615400.25, -1.5]
        rows = spark.createDataFrame([(s,) for s in seconds], "s double").select(F.col("s").cast("timestamp").alias("t"))
        assert [r[0] for r in rows.select(timeops.iso_format(F.col("t"))).collect()] == ["1970-01-01T00:00:00.000Z", "2024-11-03T05:30:00.250Z", "2024-11-03T06:30:00.250Z", "1969-12-31T23:59:58.500Z"]
        assert rows.where(timeops.iso_parse(timeops.iso_format(F.col("t"))) != F.col("t")).count() == 0
        local = {"UTC": "1/1/1970, 12:00:00 AM +0000", "America/New_York": "12/31/1969, 7:00:00 PM -0500", "Asia/Kolkata": "1/1/1970, 5:30:00 AM +0530"}[zone]
        assert rows.select(timeops.strftime(F.col("t"), "%c %Z")).first()[0] == local
        assert rows.select(timeops.strftime(F.col("t"), "%s %Q")).first()[0] == "0 0"
        assert spark.range(1).select(timeops.strptime(F.lit("03/04/24 05:06 PM"), "%m/%d/%y %I:%M %p")).first()[0] is not None
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_further_directives(spark):
    day = lambda p: spark.range(1).select(timeops.strftime(F.lit("2024-12-30 05:07:09").cast("timestamp"), p)).first()[0]
    assert day("%G %g %V %-d %_H %-m %0e %-j %-I%p") == "2025 25 01 30  5 12 30 365 5AM"
    for f in (lambda: timeops.strptime(F.lit(""), "%k"), lambda: timeops.strftime(F.lit(""), "%k")):
        with pytest.raises(ValueError, match="unknown directive %k"):
            f()


def test_infinite_values(spark):
    inf = float("inf")
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", inf), ("b", -inf), ("b", 5.0)], "k string, x double")
    got = {r.k: (r.top, r.low, r.mid) for r in stats.grouped_quantiles(rows, ["k"], "x", {"top": 1.0, "low": 0.0, "mid": 0.5}).collect()}
    assert got["a"] == (inf, 1.0, 2.0) and got["b"][:2] == (5.0, -inf)
    assert sum(r.n for r in stats.histogram(rows, "x", 3).collect()) == 3
    words = spark.createDataFrame([("g", "x", "2024-02-01"), ("g", "y", "2024-01-01"), ("g", "z", "2024-01-02"), ("g", "z", "2024-03-01"), ("h", "x", "b"), ("h", "y", "a")], "g string, v string, at string")
    assert {r.g: (r["mode"], r.n) for r in stats.mode(words, ["g"], "v", "at").collect()} == {"g": ("z", 2), "h": ("y", 1)}


@pytest.mark.parametrize("mean", [800.0, 50_000.0])
def test_poisson_of_large_means(spark, mean):
    rows = spark.range(20_000).select(draws.poisson(F.col("id"), 5, mean).alias("n"))
    m, s, d = rows.agg(F.avg("n"), F.stddev("n"), F.count_distinct("n")).first()
    assert abs(m - mean) < 5 * (mean / 20_000) ** 0.5 and abs(s / mean**0.5 - 1) < 0.03 and d > 100


def test_typed_values(spark):
    texts = [" 12.5 ", "0x1F", "-Infinity", "true", "NaN", "2024-01-05", "2024", "2024-01-05T10:20Z", "2024-01-05T10:20:30.5", "abc", "", None]
    got = values(spark, texts, "string", lambda x: formatting.auto_value(x))
    assert [g.kind for g in got] == ["number", "number", "number", "boolean", "nan", "date", "number", "date", "string", "string", "null", "null"]
    assert [g.number for g in got[:3]] == [12.5, 31.0, -math.inf] and got[3].flag is True and math.isnan(got[4].number) and got[6].number == 2024
    assert [str(g["at"]) for g in (got[5], got[7])] == [str(x) for x in spark.sql("SELECT TIMESTAMP '2024-01-05 00:00:00Z' AS a, TIMESTAMP '2024-01-05 10:20:00Z' AS b").first()]
    assert all(g.number is None and g["at"] is None and g.flag is None for g in got[9:])


def test_scales_through_points(spark):
    at = lambda xs, column: values(spark, xs, "double", column)
    assert at([-1.0, 0.0, 5.0, 10.0, 15.0, None, math.nan], lambda x: scales.through(x, [0, 10, 20], [0, 1, 3])) == [-0.1, 0.0, 0.5, 1.0, 2.0, None, None]
    assert at([25.0, 5.0, -5.0], lambda x: scales.through(x, [20, 10, 0], [0, 1, 3], clamp=True)) == [0.0, 2.0, 3.0]
    assert at([1.0, 10.0, 100.0], lambda x: F.round(scales.through(x, [1, 100], [0, 1], "log"), 9)) == [0.0, 0.5, 1.0]
    assert at([4.0, 9.0], lambda x: scales.sequential(x, (4, 4))) == [0.5, 0.5]
    assert at([-10.0, -5.0, 0.0, 5.0, 10.0], lambda x: scales.diverging(x, 10, 0, -10)) == [1.0, 0.75, 0.5, 0.25, 0.0]
    assert at([-20.0, 20.0], lambda x: scales.diverging(x, -10, 0, 10, clamp=True)) == [0.0, 1.0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([5.0, 1.0, 5.0, 9.0, None, math.nan])], "i int, x double")
    assert [r.t for r in scales.by_rank(rows, "x").orderBy("i").collect()] == [2 / 3, 0.0, 2 / 3, 1.0, None, None]


def test_places_on_the_sphere(spark):
    rows = [("line", 170.0, 1.0), ("line", -175.0, -3.0), ("line", 185.0, 0.0), ("one", 10.0, 20.0), ("pole", 0.0, 80.0), ("pole", 180.0, 80.0), ("cancel", 0.0, 0.0), ("cancel", 180.0, 0.0), ("wide", -170.0, 0.0), ("wide", -60.0, 0.0), ("wide", 60.0, 0.0), ("wide", 170.0, 0.0), ("one", None, 1.0), ("one", math.nan, 1.0)]
    frame = spark.createDataFrame(rows, "k string, x double, y double")
    box = {r.k: tuple(r)[1:] for r in geometry.sphere_bounds(frame, "k").collect()}
    assert box["line"] == (170.0, -3.0, -175.0, 1.0) and box["one"] == (10.0, 20.0, 10.0, 20.0) and box["wide"] == (60.0, 0.0, -60.0, 0.0)
    middle = {r.k: r for r in geometry.sphere_centroid(frame, "k").collect()}
    assert middle["cancel"].x is None and middle["cancel"].y is None and middle["pole"].y == pytest.approx(90) and middle["one"].n == 1
    assert (middle["one"].x, middle["one"].y) == pytest.approx((10, 20)) and abs(middle["line"].x) == pytest.approx(180, abs=0.1)
