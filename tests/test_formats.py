"""Delimited text, trees as text, JSON, number formats, draws, streams and the catalog scan on hand-made rows."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import arrays, draws, formatting, numbers, timeops
from larkspur.operators import delimited, geometry, hierarchy, text, trees
from larkspur.sources import catalog_scan
from larkspur.streaming import telemetry


def one(spark, rows, kind, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_delimited_records_and_cells(spark):
    texts = ["", "a", "a\n", "a\n\n", "a,b\r\nc,d\re,", '"x ""y"" \n,z",2\n,', '"",""', None, ",", '"' + 'q""\n' * 20_000 + '",end']
    got = one(spark, texts, "string", lambda x: F.transform(delimited.records(x), lambda r: delimited.cells(r)))
    assert got[:-1] == [[], [["a"]], [["a"]], [["a"], [""]], [["a", "b"], ["c", "d"], ["e", ""]], [['x "y" \n,z', "2"], ["", ""]], [["", ""]], [], [["", ""]]]
    assert got[-1] == [['q"\n' * 20_000, "end"]]


def test_delimited_text_as_the_csv_module_reads_it(spark):
    rng = random.Random(4)
    tables = [[["".join(rng.choices('a",\n\r;é', k=rng.randint(0, 6))) for _ in range(3)] for _ in range(4)] for _ in range(20)]
    df = spark.createDataFrame([(i, j, row) for i, t in enumerate(tables) for j, row in enumerate(t)], "i int, j int, c array<string>")
    lines = {(r.i, r.j): r.line for r in df.select("i", "j", delimited.format_row([F.col("c")[k] for k in range(3)]).alias("line")).collect()}
    whole = ["\n".join(lines[i, j] for j in range(4)) + "\n" for i in range(20)]
    assert [list(csv.reader(io.StringIO(w, newline=""))) for w in whole] == tables
    assert one(spark, whole, "string", lambda x: F.transform(delimited.records(x), lambda r: delimited.cells(r))) == tables


def test_delimited_objects(spark):
    df = spark.createDataFrame([(1, "a;b\n1;2\n3"), (2, "only;header"), (3, None)], "k int, t string")
    got = sorted((r.k, r.row, r.name, r.value) for r in delimited.parse(df, "k", "t", ";").collect())
    assert got == [(1, 0, "a", "1"), (1, 0, "b", "2"), (1, 1, "a", "3"), (1, 1, "b", None)]


NODES = [(1, 0, 0, "root"), (1, 1, 1, 'a "<&>"'), (1, 2, 2, "b"), (1, 3, 2, "c"), (1, 4, 1, "d"), (2, 0, 0, "lone")]


def test_trees_as_text_and_back(spark):
    nodes = spark.createDataFrame(NODES, "k int, position long, depth long, topic string")
    want = [(1, "root", None), (1, 'a "<&>"', "root"), (1, "b", 'a "<&>"'), (1, "c", 'a "<&>"'), (1, "d", "root"), (2, "lone", None)]

    def named(rows, at="position"):
        topics = {(r.k, r[at]): r.topic for r in rows}
        return sorted((r.k, r.topic, topics.get((r.k, r.parent))) for r in rows)

    assert named(trees.from_indented(trees.to_indented(nodes, "k", 3), "k", "text", 3).collect()) == sorted(want, key=lambda r: r[:2])
    assert named(trees.from_xml(trees.to_xml(nodes, "k"), "k", "text").collect()) == sorted(want, key=lambda r: r[:2])
    arrays_ = trees.to_node_array(trees.with_parents(nodes, "k"), "k")
    assert named(trees.from_node_array(arrays_, "k", "text").collect(), "id") == sorted(want, key=lambda r: r[:2])
    entries = json.loads(arrays_.where("k = 1").first().text)
    assert [e["id"] for e in entries if e.get("isroot")] == [0]
    other = spark.createDataFrame([(1, "<map><node TEXT='x' FOLDED=\"true\"><node TEXT=\"y\" POSITION='left'/><node TEXT=\"z\"></node></node></map>")], "k int, text string")
    got = sorted((r.position, r.depth, r.topic, r.folded, r.side) for r in trees.from_xml(other, "k", "text").collect())
    assert [r[1:] for r in got] == [(0, "x", True, None), (1, "y", False, "left"), (1, "z", False, None)]


def test_tree_faults_and_edits(spark):
    bad = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 0), (2, 0, 1)], "k int, position long, depth long")
    assert sorted((r.k, r.problem, r.position) for r in trees.tree_problems(bad, "k").collect()) == [(1, "gap", 1), (1, "root", 2), (2, "gap", 0)]
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "r")], "id string, parent string")
    up = hierarchy.closure(nodes)
    assert sorted(r.id for r in trees.remove(nodes, up, spark.createDataFrame([("a",)], "id string")).collect()) == ["c", "r"]
    moved = trees.move(nodes, up, spark.createDataFrame([("b", "c"), ("r", "b"), ("a", "a")], "id string, to string"))
    assert {r.id: r.parent for r in moved.collect()} == {"r": None, "a": "r", "b": "c", "c": "r"}


def test_json_is_flattened(spark):
    value = {"a b": [1, {"x": None}], "c": "é\"", "d": {}, "e": [], "f": True, "g": -1.5}
    df = spark.createDataFrame([(1, json.dumps(value)), (2, "not json"), (3, "7"), (4, None), (5, "null")], "key int, js string")
    got = sorted((r.key, r.path, r.depth, r.kind, r.value) for r in trees.flatten_json(df, "key", "js").collect())
    assert got == sorted([
        (1, "$", 0, "object", None), (1, '$["a b"]', 1, "array", None), (1, '$["a b"][0]', 2, "number", "1"), (1, '$["a b"][1]', 2, "object", None), (1, '$["a b"][1].x', 3, "null", None),
        (1, "$.c", 1, "string", 'é"'), (1, "$.d", 1, "object", None), (1, "$.e", 1, "array", None), (1, "$.f", 1, "boolean", "true"), (1, "$.g", 1, "number", "-1.5"), (3, "$", 0, "number", "7"), (5, "$", 0, "null", None),
    ])
    assert one(spark, ["{}", "[1]", "3", "x", None], "string", trees.json_root) == [True, True, False, False, False]


def test_texts(spark):
    docs = spark.createDataFrame([(1, "// MARK: - Top\nx\n# region Part two \n"), (2, "a\r\nb\rc​"), (3, "a\nb\nc​"), (4, None)], "k int, t string")
    assert sorted((r.k, r.line, r.title) for r in text.section_marks(docs, "k", "t").collect()) == [(1, 1, "Top"), (1, 3, "Part two")]
    assert sorted((r.k, r.first, r.copies) for r in text.identical(docs, "k", "t").collect()) == [(1, 1, 1), (2, 2, 2), (3, 2, 2), (4, 4, 1)]
    assert {r.k: tuple(r)[1:] for r in text.character_profile(docs, "k", "t").collect()}[3] == (5, 1, 1)
    index = spark.createDataFrame([("the", 3), ("then", 5), ("they", 5), ("a", 9)], "word string, n long")
    assert [r.word for r in text.suggestions(index, "the", 5).collect()] == ["then", "they"]
    assert one(spark, ["a b/ä*~!'()", "100%"], "string", formatting.url_encode) == ["a%20b%2F%C3%A4*~!'()", "100%25"]
    assert one(spark, ["a%20b+c", "%zz"], "string", formatting.url_decode) == ["a b+c", None]


NUMBERS = [
    (".2f", 3.14159, "3.14"), (".0f", 2.5, "3"), (".1f", 9107.05, "9107.0"), (".2f", 1.005, "1.00"), (".2f", 1.255, "1.25"), (".1f", 0.25, "0.3"), (".2f", 1e20, "100000000000000000000.00"), (".1f", 0.95, "0.9"), ("+.1f", -0.04, "−0.0"), (".1f", -0.04, "0.0"), ("08.1f", -3.25, "−00003.3"), (",.0f", 1234567.0, "1,234,567"), (",.4f", 1234.5678, "1,234.5678"), (".1%", 0.123, "12.3%"), (".3~f", 1.5, "1.5"), (".2~f", 2.0, "2"),
    ("#x", 255.0, "0xff"), ("b", 5.0, "101"), ("o", 8.0, "10"), (".3e", 12345.0, "1.235e+4"), ("*^9d", 42.0, "***42****"), ("<6d", 7.0, "7     "), ("(.1f", -2.0, "(2.0)"), ("$,.2f", 1000.0, "$1,000.00"), (".3s", 1500.0, "1.50k"), (" d", 5.0, " 5"),
    # No type, and those of significant digits.
    ("", 1234.5, "1234.5"), (",", 1234.5, "1,234.5"), ("", 0.1 + 0.2, "0.3"), ("", 1e21, "1e+21"), ("", 1e-7, "1e-7"), ("", 0.000001, "0.000001"), ("", 0.0, "0"), ("d", 2.5, "3"), ("d", -2.5, "−3"), ("c", 65.0, "65"), ("c", -1.5, "-1.5"), ("010,d", 1234.0, "00,001,234"), ("08,d", 1234.0, "0,001,234"), ("$010,d", 1234.0, "$00,001,234"), ("09,.1f", 1234.56, "001,234.6"), ("03,d", 123456.0, "123,456"),
    ("g", 1234567.0, "1.23457e+6"), ("g", 12.0, "12.0000"), (".3g", 0.00001234, "0.0000123"), (".3g", 0.0000001234, "1.23e-7"), (".4~g", 12.5, "12.5"), ("n", 1234.5, "1,234.50"), (".3r", 1234567.0, "1230000"), (".3r", 0.0012345, "0.00123"), (".2r", 0.0, "0.0"), (".3p", 0.12345, "12.3%"), ("p", 0.5, "50.0000%"), ("+,.4r", 123456.0, "+123,500"),
    (".3r", 1.005, "1.00"), (".2e", 1.005, "1.00e+0"), (".2r", 2.5e10, "25000000000"), (".1r", 25.0, "30"), (".1r", 35.0, "40"), (".1r", 0.25, "0.3"), (".2r", 9.96, "10"), (".3e", 999999.0, "1.000e+6"), (".0e", 12345.0, "1e+4"), (".4r", 1e-300, "0." + "0" * 299 + "1000"),
    (".3s", 9996.0, "10.0k"), (".2s", 999999.0, "1.0M"), ("s", 1e-26, "0.01000y"), (".3s", 0.00015, "150µ"), (".2s", 3.0e27, "3000Y"), (".3s", 0.0, "0.00"), ("~s", 1500.0, "1.5k"), (".3~s", -1500.0, "−1.5k"), ("#X", 255.0, "0xFF"), ("#o", 8.0, "0o10"), ("$x", 255.0, "$ff"), ("x", -255.0, "−ff"), ("X", -10.0, "−A"),
    ("_=10,.1f", -1234.5, "−__1,234.5"), ("*<8", 1.5, "1.5*****"), ("^7d", 12.0, "  12   "), ("=8d", -5.0, "−      5"), ("(", -2.5, "(2.5)"), ("+", 0.0, "+0"), ("f", float("nan"), "NaN"), ("f", float("inf"), "Infinity"), (".1f", float("-inf"), "−Infinity"), ("f", None, None), ("+.1f", -0.01, "−0.0"), ("8.1%", 0.5, "   50.0%"),
]


def test_number_formats(spark):
    """All cases, a dozen columns to a job."""
    for at in range(0, len(NUMBERS), 12):
        part = NUMBERS[at : at + 12]
        rows = spark.createDataFrame([[x for _, x, _ in part]], ", ".join(f"x{i} double" for i in range(len(part))))
        got = rows.select(*(numbers.format_number(F.col(f"x{i}"), spec).alias(f"c{i}") for i, (spec, _, _) in enumerate(part))).first()
        assert list(got) == [want for _, _, want in part]


def test_precisions():
    assert [numbers.precision_fixed(s) for s in (1.0, 0.5, 0.01, 10.0)] == [0, 1, 2, 0]
    assert numbers.precision_round(0.01, 1.01) == 3
    assert [numbers.precision_round(s, m) for s, m in ((1, 10), (1, 11), (10, 5), (0.1, 1.1), (5, 5))] == [1, 2, 1, 2, 1]
    assert [numbers.precision_prefix(s, v) for s, v in ((1e5, 1.3e6), (1e-6, 1e-6), (1e-26, 1e-24), (1e23, 1e27), (1.0, 0.0))] == [1, 0, 2, 1, 0]
    assert [numbers.parse_spec(s).type for s in ("", ".2", "~", "z", "%")] == ["", "", "", "z", "%"]
    for bad in (".", ".f", "5..2f", "f,", "12é", "( d"):
        with pytest.raises(ValueError, match="number format"):
            numbers.parse_spec(bad)


@pytest.mark.parametrize(("spec", "step", "extent", "x", "want"), [
    (",f", 0.5, 10, 1234.5, "1,234.5"), (",f", 100, 1000, 500.0, "500"), ("%", 0.05, 1, 0.15, "15%"), (".1%", 0.05, 1, 0.15, "15.0%"), ("s", 1e5, 1.5e6, 5e5, "0.5M"), ("s", 1e-6, 5e-6, 2e-6, "2µ"), ("e", 1000, 10000, 5000.0, "5e+3"), ("", 0.01, 1.0, 0.25, "0.25"), ("r", 100, 1200, 300.0, "300"), ("d", 5, 50, 15.0, "15"), (".2s", 1e3, 1e4, 5000.0, "5.00k"), ("$,f", 20, 100, 40.0, "$40"),
])
def test_tick_formats(spark, spec, step, extent, x, want):
    assert one(spark, [x], "double", lambda c: numbers.tick_format(c, step, extent, spec)) == [want]


def test_significant_digits_by_decimal_arithmetic(spark):
    """Random doubles and near ties against exact decimals."""
    import random
    from decimal import ROUND_HALF_UP, Context, Decimal

    rng = random.Random(1)
    xs = [rng.random() * 10 ** rng.randint(-6, 15) for _ in range(600)] + [rng.randrange(10**6) / 200 for _ in range(600)] + [rng.randrange(1, 10**5) * 5.0 for _ in range(200)]
    for n in (1, 3, 7, 15):
        exact = [Context(prec=n, rounding=ROUND_HALF_UP).create_decimal(Decimal(x)) for x in xs]
        want = [(("".join(map(str, d.as_tuple().digits))).ljust(n, "0"), d.adjusted()) for d in exact]
        got = one(spark, xs, "double", lambda c: numbers.significant(c, n))
        assert [(g.digits, g.power) if x else None for g, x in zip(got, xs)] == [w if x else None for w, x in zip(want, xs)]


def test_draws_follow_their_laws(spark):
    k = F.col("id")
    columns = {"u": draws.uniform(k, 1, 2, 4), "i": draws.integer(k, 2, 0, 6), "n": draws.normal(k, 3, 5, 2), "e": draws.exponential(k, 4, 2.0), "b": draws.bernoulli(k, 5, 0.3), "g": draws.geometric(k, 6, 0.25), "w": draws.weibull(k, 7, 2.0), "p": draws.pareto(k, 8, 3.0), "m": draws.binomial(k, 9, 10, 0.3), "t": draws.bates(k, 20, 3), "l": draws.logistic(k, 30)}
    rows = spark.range(20_000).select("id", *(c.alias(n) for n, c in columns.items()))
    means = rows.agg(*(F.avg(n).alias(n) for n in columns), F.stddev("n").alias("sd"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.min("g").alias("least")).first()
    for name, want in {"u": 3, "i": 2.5, "n": 5, "e": 0.5, "b": 0.3, "g": 4, "w": 0.886, "p": 1.5, "m": 3, "t": 0.5, "l": 0, "sd": 2}.items():
        assert means[name] == pytest.approx(want, abs=0.06)
    assert 2 <= means.lo < means.hi < 4 and means.least == 1
    assert rows.repartition(3).orderBy("id").limit(50).collect() == rows.orderBy("id").limit(50).collect()


def test_arrays(spark):
    assert one(spark, [[3, 1, 2], [], None], "array<int>", lambda x: arrays.shuffled(x, 1))[1:] == [[], None]
    assert one(spark, [[[1.0, 2.0], [3.0]], []], "array<array<double>>", arrays.transpose) == [[[1.0, 3.0]], []]
    assert one(spark, [-0.5, 0.0, 0.25, 1.0], "double", lambda t: arrays.piecewise(t, [0, 2, 0])) == [-2.0, 0.0, 1.0, 0.0]


def test_time_units():
    assert timeops.tick_unit(30 * 86400, 10) == ("DAY", 2)
    assert [timeops.tick_unit(s, 1) for s in (1, 3, 12, 100, 4000, 20_000, 10**6, 10**7, 10**8)] == [("SECOND", 1), ("SECOND", 5), ("SECOND", 15), ("MINUTE", 1), ("HOUR", 1), ("HOUR", 6), ("WEEK", 1), ("MONTH", 3), ("YEAR", 1)]


def test_sphere(spark):
    df = spark.createDataFrame([(0.0, 0.0, 180.0, 0.0), (0.0, 90.0, 50.0, -90.0), (10.0, 20.0, 10.0, 20.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(geometry.sphere_distance(*map(F.col, "abcd"))).collect()] == pytest.approx([3.141592653589793, 3.141592653589793, 0.0])


def test_fan_out_leaves_failing_sinks_out(spark):
    seen = []

    def broken(batch):
        raise RuntimeError("gone")

    deliver = telemetry.fan_out(broken, lambda b: seen.append(b.count()))
    for n in (3, 4):
        deliver(spark.range(n), n)
    assert seen == [3, 4]


def test_heartbeats_are_a_stream(spark):
    beats = telemetry.heartbeats(spark, "api", 1)
    assert beats.isStreaming and beats.columns == ["status", "timestamp", "service"]


def test_catalog_scan_writes_json(spark, tmp_path):
    top = tmp_path / "in"
    for name, size in (("a.md", 5), ("src/b.py", 2048), ("src/deep/c.png", 1), ("build/x.o", 9), (".git/y", 9)):
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
    (top / "empty").mkdir()
    catalog_scan.write(spark, str(top), str(tmp_path / "out"))
    read = lambda n: spark.read.json(str(tmp_path / "out" / n)).collect()
    assert sorted((r.path, r.size_str, r.ext) for r in read("files")) == [("a.md", "5.00 B", "md"), ("src/b.py", "2.00 KB", "py"), ("src/deep/c.png", "1.00 B", "png")]
    assert sorted((r.dir, r.size, r.file_num) for r in read("folders")) == [("empty", 0, 0), ("src", 2049, 2), ("src/deep", 1, 1)]
    assert read("totals")[0].total_files == 3
    trees_ = {r.name: json.loads(r.tree) for r in read("trees")}
    assert trees_["src"]["children"][0]["name"] == "deep" and trees_["empty"]["value"] == 0
    assert catalog_scan.ignored(spark, str(top)).first()[0] == 2
    rows = spark.createDataFrame([("a//b\\", "/c"), ("", "d"), (None, "e")], "f string, n string")
    assert [r[0] for r in rows.select(catalog_scan.joined_path(F.col("f"), F.col("n"))).collect()] == ["a/b/c", "d", "e"]
