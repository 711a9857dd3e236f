"""Trees as text: indented lines, XML with nested nodes, JSON edge lists and nested JSON, and JSON documents as rows.

Trees are rows (key, position, depth, topic, ...) in preorder within each key: a document is one tree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions.formatting import xml_escape, xml_unescape
from larkspur.operators import json_text


def with_parents(nodes: DataFrame, key: str) -> DataFrame:
    """Preorder rows with `parent`, the position of the last row before that is one level up (null at the top).

    Each row stands as a child on its own level and as a possible parent on the next; a running last over the
    levels of a key finds the parents, so nothing is compared in pairs. Rows that are dealt by key stay where they are.
    """
    both = nodes.withColumn("__below", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__level", F.col("depth") + F.col("__below"))
    by = Window.partitionBy(key, "__level").orderBy("position", "__below").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("parent", F.last(F.when(F.col("__below") == 1, F.col("position")), True).over(by))
    return both.where("__below = 0").drop("__level", "__below")


def tree_problems(nodes: DataFrame, key: str) -> DataFrame:
    """key, problem, position: further rows of depth 0 ("root") and rows more than one level below the one before ("gap")."""
    by = Window.partitionBy(key).orderBy("position")
    before = nodes.withColumn("__before", F.lag("depth").over(by))
    problem = F.when((F.col("depth") == 0) & F.col("__before").isNotNull(), "root").when(F.col("depth") > F.coalesce("__before", F.lit(-1)) + 1, "gap")
    return before.select(key, problem.alias("problem"), "position").where("problem is not null")


def _gathered(nodes: DataFrame, key: str, line: Column, separator: str) -> DataFrame:
    """key, text: a document is one text, and so its lines are gathered."""
    parts = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return nodes.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["line"]), separator).alias("text"))


def to_indented(nodes: DataFrame, key: str, step: int = 1) -> DataFrame:
    """key, text: a line a node, indented by `step` spaces a level. Line ends within topics become spaces."""
    topic = F.regexp_replace("topic", "[\r\n]+", " ")
    return _gathered(nodes, key, F.concat(F.repeat(F.lit(" " * step), F.col("depth").cast("int")), topic), "\n")


def from_indented(texts: DataFrame, key: str, text: str, step: int = 1) -> DataFrame:
    """key, position, depth, topic, parent of the lines that aren't blank."""
    lines = F.filter(F.split(F.col(text), "\r\n|\n|\r", -1), lambda x: F.trim(x) != "")
    rows = texts.select(key, F.posexplode(lines).alias("position", "line"))
    depth = F.floor(F.length(F.regexp_extract("line", "^([ \t]*)", 1)) / step).cast("long")
    return with_parents(rows.select(key, F.col("position").cast("long").alias("position"), depth.alias("depth"), F.trim("line").alias("topic")), key)


def to_xml(nodes: DataFrame, key: str) -> DataFrame:
    """key, text: nested <node TEXT="..."> elements within one <map>."""
    by = Window.partitionBy(key).orderBy("position")
    after = F.coalesce(F.lead("depth").over(by), F.lit(0))
    rows = nodes.withColumn("__closed", F.greatest(F.lit(0), F.col("depth") + 1 - after))
    line = F.concat(F.lit('<node TEXT="'), xml_escape(F.col("topic")), F.lit('">'), F.repeat(F.lit("</node>"), F.col("__closed").cast("int")))
    return _gathered(rows, key, line, "").select(key, F.concat(F.lit('<map version="1.0.1">'), "text", F.lit("</map>")).alias("text"))


def from_xml(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, depth, topic, folded, side, parent of the <node> elements of a map: attributes TEXT, FOLDED and POSITION."""
    tags = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"""(<node\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</node>)"""), F.lit(1))).alias("position", "tag"))
    opens, whole = F.col("tag").startswith("<node"), F.col("tag").endswith("/>")
    by = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(whole, 0).when(opens, 1).otherwise(-1)).over(by), F.lit(0))
    value = lambda name: F.concat(*(F.regexp_extract("tag", rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", k) for k in (1, 2)))
    rows = tags.select("*", before.cast("long").alias("depth")).where(opens)
    rows = rows.select(key, F.col("position").cast("long").alias("position"), "depth", xml_unescape(value("TEXT")).alias("topic"), (value("FOLDED") == "true").alias("folded"), F.nullif(value("POSITION"), F.lit("")).alias("side"))
    return with_parents(rows, key)


def to_node_array(nodes: DataFrame, key: str) -> DataFrame:
    """key, text: a JSON array of {id, parentid, isroot, topic} in preorder; rows need `parent`."""
    node = F.struct(F.col("position").alias("id"), F.col("parent").alias("parentid"), F.when(F.col("parent").isNull(), F.lit(True)).alias("isroot"), F.col("topic"))
    return _gathered(nodes, key, F.to_json(node), ",").select(key, F.concat(F.lit("["), "text", F.lit("]")).alias("text"))


def from_node_array(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, id, parent, topic of each entry; none for what is not such an array."""
    rows = texts.select(key, F.explode(F.from_json(text, "array<struct<id:bigint,parentid:bigint,isroot:boolean,topic:string>>")).alias("n"))
    return rows.select(key, "n.id", F.col("n.parentid").alias("parent"), "n.topic")


def remove(nodes: DataFrame, closure: DataFrame, ids: DataFrame) -> DataFrame:
    """Adjacency rows (id, parent) without the nodes `ids` (id) and all below them; closure: (id, ancestor)."""
    gone = closure.join(ids.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    return nodes.join(gone, "id", "left_anti")


def move(nodes: DataFrame, closure: DataFrame, moves: DataFrame) -> DataFrame:
    """Adjacency rows with the parents that `moves` (id, to) give; a move of a node under itself or one below it is not done."""
    under = closure.select(F.col("ancestor").alias("id"), F.col("id").alias("to"))
    allowed = moves.join(under, ["id", "to"], "left_anti").groupBy("id").agg(F.min("to").alias("to"))
    rest = [c for c in nodes.columns if c not in ("id", "parent")]
    return nodes.join(allowed, "id", "left").select("id", F.coalesce("to", "parent").alias("parent"), *rest)


# JSON documents

#: Names of JSON kinds, by the beginning of the type of a variant.
_KINDS = (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null"))


def json_kind(value: Column) -> Column:
    """object, array, string, boolean, null or number."""
    kind = F.schema_of_variant(value)
    out = F.lit("number")
    for begin, name in _KINDS:
        out = F.when(kind.startswith(begin), name).otherwise(out)
    return F.when(value.isNull(), "null").otherwise(out)


def _canonical(text: str) -> Column:
    """A JSON text as Spark writes it, null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def flatten_json(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, depth, kind, value for every value within each JSON document, itself at "$".

    Members are addressed as .name, or ["name"] where the name is no plain word, and entries as [i]. value: text of what
    is neither object nor array. A text that is no JSON has no rows. Documents are opened where they are, nothing is shuffled.
    A number beyond the doubles is the string "Infinity" or "-Infinity", as in Spark's to_json.
    """
    whole = docs.select(key, _canonical(text).alias("__json"))
    return whole.select(key, F.inline(F.arrow_udf(json_text.opened, "array<struct<path: string, depth: bigint, kind: string, value: string>>")("__json")))


def json_root(text: Column) -> Column:
    """Whether a text is a JSON object or array."""
    return F.coalesce(json_kind(F.try_parse_json(text)).isin("object", "array") & F.try_parse_json(text).isNotNull(), F.lit(False))


def unflatten_json(rows: DataFrame, key: str) -> DataFrame:
    """key, text: the JSON documents whose values are rows as those of flatten_json (key, path, depth, kind, value).

    Members stand in order of their names. A document without a row of path "$" has no text. The rows of a document are
    gathered, as the document is one text, in one shuffle for all levels.
    """
    gathered = rows.groupBy(key).agg(F.collect_list(F.struct("path", "depth", "kind", "value")).alias("__rows"))
    return gathered.select(key, F.explode(F.arrow_udf(json_text.built, "array<string>")("__rows")).alias("text"))


def find_json(flat: DataFrame, matches: Callable[[DataFrame], Column], handle: Callable[[DataFrame], dict[str, Column]] | None = None) -> DataFrame:
    """The rows of flatten_json that `matches` holds for, with the columns that `handle` makes of them: matcher and handler are columns, so both run where the rows are."""
    found = flat.where(matches(flat))
    return found.withColumns(handle(found)) if handle else found


def merge_json(target: DataFrame, source: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: each document of `target` with that of `source` merged into it: members of both that are objects are merged in turn, of others the source's counts, arrays too, and null is a value.

    A document of one side only stays as it is, as does one whose other side is no JSON; with none on either side the text
    is null. Members stand in order of their names. Documents meet in one full outer join; only where both are objects is
    anything taken apart. Keys must not repeat on a side.
    """
    a, b = (rows.select(F.col(key).alias(k), _canonical(text).alias(v)) for rows, k, v in ((target, "__id", "a"), (source, "__its", "b")))
    # A key that is null on both sides is told from one that the other side lacks by what it holds.
    both = a.join(b, F.col("__id").eqNullSafe(F.col("__its")), "full_outer").select(F.coalesce("__id", "__its").alias(key), "a", "b")
    objects = F.col("a").startswith("{") & F.col("b").startswith("{")
    met = F.arrow_udf(json_text.merged, "string")(F.when(objects, F.col("a")), F.when(objects, F.col("b")))
    return both.select(key, F.coalesce(met, "b", "a").alias("text"))


#: Names of the tree formats that read_trees and write_trees know.
FORMATS = ("indented", "xml", "node_array")


def _known(rows: DataFrame, form: str) -> DataFrame:
    """`rows` with __form, what the column `form` names; a name that is unknown or null fails the job."""
    kind = F.col(form)
    wrong = F.raise_error(F.concat(F.lit("unknown tree format: "), F.coalesce(kind, F.lit("null")))).cast("string")
    return rows.withColumn("__form", F.when(kind.isin(*FORMATS), kind).otherwise(wrong))


def read_trees(texts: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """key, id, parent, topic of texts, each in the format its column `form` names; an unknown name fails the job. The texts are read once for each format."""
    known = _known(texts, form)
    rows = [from_indented(known.where(F.col("__form") == "indented"), key, text), from_xml(known.where(F.col("__form") == "xml"), key, text)]
    rows = [r.withColumnRenamed("position", "id") for r in rows] + [from_node_array(known.where(F.col("__form") == "node_array"), key, text)]
    return reduce(DataFrame.unionByName, [r.select(key, "id", "parent", "topic") for r in rows])


def write_trees(nodes: DataFrame, key: str, form: str) -> DataFrame:
    """key, `form`, text: each tree in the format that its rows name in `form`, from preorder rows with parent; an unknown name fails the job."""
    known, made = _known(nodes, form), []
    for name, write in zip(FORMATS, (to_indented, to_xml, to_node_array), strict=True):
        made.append(write(known.where(F.col("__form") == name).drop("__form"), key).select(key, F.lit(name).alias(form), "text"))
    return reduce(DataFrame.unionByName, made)
