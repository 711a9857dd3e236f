"""JSON documents as rows and back, deep merges, and trees of many levels."""

from __future__ import annotations

import json

import pytest

from larkspur.operators import catalog, hierarchy, map_table, trees

DOCS = ['{"a": 1, "b": {"c": [1, {"d": null}, []], "e f": "x\\"y\\\\z\\n", "g": {}}, "z[\\"q": true, "": 0.5}', "[1, [2, [3]], {}]", '"text"', "7", "null", "true", '{"a": {"[0]": {"\\"]": 1}, "x.y": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]}}', "{bad", None]


def test_documents_are_rows_and_rows_are_documents(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "k int, t string")
    got = {r.k: json.loads(r.text) for r in trees.unflatten_json(trees.flatten_json(docs, "k", "t"), "k").collect()}
    assert got == {k: json.loads(t) for k, t in enumerate(DOCS) if t not in ("{bad", None)}
    assert trees.unflatten_json(trees.flatten_json(docs.limit(0), "k", "t"), "k").count() == 0


def test_a_document_of_many_levels(spark):
    """70 levels of objects and arrays: nothing is cut, nothing raises."""
    text = "1"
    for i in range(35):
        text = f'{{"n{i}": [{text}]}}'
    docs = spark.createDataFrame([(1, text), (2, "{}")], "k int, t string")
    flat = trees.flatten_json(docs, "k", "t")
    assert flat.agg({"depth": "max"}).first()[0] == 70
    got = {r.k: json.loads(r.text) for r in trees.unflatten_json(flat, "k").collect()}
    assert got == {1: json.loads(text), 2: {}}


def plain_merge(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: plain_merge(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) if k in b else a[k] for k in a | b}
    return b


@pytest.mark.parametrize(("a", "b"), [
    ('{"a": 1, "b": {"c": 2, "d": {"e": 3}}}', '{"b": {"c": null, "d": {"f": [1]}, "x": {}}, "g": "h"}'), ('{"a": [1, 2]}', '{"a": [3]}'), ('{"a": {"b": 1}}', '{"a": 5}'), ('{"a": 5}', '{"a": {"b": 1}}'), ("[1]", '{"a": 1}'), ("{}", "{}"), ('{"a": {}}', '{"a": {}}'), ('{"a\\"]": {"": 1}}', '{"a\\"]": {"": {"x": 1}, "y": "\\u00e9"}}'), ("1", "null"),
])
def test_merges(spark, a, b):
    one = lambda t: spark.createDataFrame([(1, t)], "k int, t string")
    got = trees.merge_json(one(a), one(b), "k", "t").collect()
    assert [json.loads(r.text) for r in got] == [plain_merge(json.loads(a), json.loads(b))]


def test_merges_of_one_side(spark):
    a = spark.createDataFrame([(1, '{"a": 1}'), (2, "{bad"), (4, "[1]"), (5, None)], "k int, t string")
    b = spark.createDataFrame([(2, '{"b": 2}'), (3, "3"), (4, "{worse"), (5, "{bad")], "k int, t string")
    assert {r.k: r.text for r in trees.merge_json(a, b, "k", "t").collect()} == {1: '{"a":1}', 2: '{"b":2}', 3: "3", 4: "[1]", 5: None}


def test_matchers_and_handlers_are_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, '{"a": {"id": 5, "n": "x"}, "id": 7}'), (2, "[]")], "k int, t string")
    found = trees.find_json(trees.flatten_json(docs, "k", "t"), lambda r: r.path.endswith(".id") & (r.kind == "number"), lambda r: {"twice": r.value.cast("int") * 2, "up": F.regexp_replace(r.path, r"\.id$", "")})
    assert sorted((r.up, r.twice) for r in found.collect()) == [("$", 14), ("$.a", 10)]


def test_deep_folders_and_hierarchies(spark, monkeypatch):
    """A path of 70 folders keeps all its levels; a chain longer than the look for cycles has its closure; a cycle is told from it."""
    path = "/".join(f"d{i}" for i in range(70))
    nodes = catalog.folder_nodes(spark.createDataFrame([("f", path, 5, 1, 1)], "name string, dir string, size long, mtime long, ctime long"))
    tree = json.loads(catalog.nested_trees(nodes).first().tree)
    names = []
    while tree:
        names.append(tree["name"])
        tree = tree.get("children", [None])[0]
    assert names == [f"d{i}" for i in range(70)]
    monkeypatch.setattr(hierarchy, "LOOKED_AT", 4)
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(8)], "id int, parent int")
    assert hierarchy.closure(chain).count() == 8 * 9 // 2
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id int, parent int"))


MAP = """<map version="1.0.1"><node TEXT="root &amp; all" ID="r"><node TEXT='left' POSITION="left" FOLDED="true" COLOR="#ff0000" BACKGROUND_COLOR="#00ff00" STYLE="bubble">
<icon BUILTIN="idea"/><icon BUILTIN="flag"/><attribute NAME="size" VALUE="5"/><richcontent TYPE="NOTE"><html><body><p>a <b>note</b></p><node TEXT="no node"/></body></html></richcontent></node>
<node LINK="http://x"><richcontent TYPE="NODE"><html><body>rich
 text</body></html></richcontent><node TEXT="leaf"/></node></node></map>"""


def test_maps_by_table_function(spark):
    """Rich content, notes, attributes and colours; breaks are told with the nodes before them."""
    map_table.register(spark)
    rows = [(1, MAP), (2, '<map><node TEXT="a"><node TEXT="b"></map>'), (3, None), (4, "<map/>"), (5, '<map><node TEXT="same"/></map>'), (5, '<map><node TEXT="same"/></map>')]
    spark.createDataFrame(rows, "k int, t string").createOrReplaceTempView("maps")
    got = spark.sql("SELECT * FROM freemind_nodes(TABLE(SELECT k, t FROM maps) PARTITION BY k, keep => 'STYLE')").collect()
    first = sorted((r for r in got if r.k == 1), key=lambda r: r.position)
    assert [(r.position, r.depth, r.parent, r.topic) for r in first] == [(0, 0, None, "root & all"), (1, 1, 0, "left"), (2, 1, 0, "rich text"), (3, 2, 2, "leaf")]
    r = first[1]
    assert (r.folded, r.side, r.color, r.background, r.note, r.attributes, r.icons, r.style) == (True, "left", "#ff0000", "#00ff00", "a note", {"size": "5"}, "idea,flag", "bubble")
    assert first[2].link == "http://x" and first[0].id == "r" and not any(x.problem for x in first)
    broken = [r for r in got if r.k == 2]
    assert sorted((r.position is None, r.topic or "") for r in broken) == [(False, "a"), (False, "b"), (True, "")]
    assert "mismatched tag" in next(r.problem for r in broken if r.problem)
    assert [r.problem is not None for r in got if r.k in (3, 4)] == [True, True]
    assert sum(r.k == 5 and r.topic == "same" for r in got) == 2


def test_table_function_equals_the_pattern_parser(spark):
    """On simple maps both give the same trees."""
    map_table.register(spark)
    maps = spark.createDataFrame([(1, '<map><node TEXT="a"><node TEXT="b" FOLDED="true"/><node TEXT="c"><node TEXT="d &lt; e"/></node></node></map>')], "k int, t string")
    maps.createOrReplaceTempView("simple_maps")
    a = sorted((r.position, r.depth, r.topic, r.folded) for r in trees.from_xml(maps, "k", "t").collect())
    b = sorted((r.position, r.depth, r.topic, r.folded) for r in spark.sql("SELECT * FROM freemind_nodes(TABLE(simple_maps))").collect())
    assert [x[1:] for x in a] == [x[1:] for x in b]


def test_table_function_says_what_it_takes(spark):
    map_table.register(spark)
    with pytest.raises(Exception, match="a key and a text"):
        spark.sql("SELECT * FROM freemind_nodes(TABLE(SELECT 1 AS k))").collect()
