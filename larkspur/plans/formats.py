"""Queries for delimited text, trees as text, JSON documents and text tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import formatting
from larkspur.operators import delimited, map_table, text, trees
from larkspur.plans.registry import query
from larkspur.session import dealt, table

_QUOTED = "CASE WHEN regexp_matches({0}, '[\",\r\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"SELECT doc_id, doc_id || ',' || {_QUOTED.format('lang')} || ',' || {_QUOTED.format('source')} || ',' || {_QUOTED.format('text')} AS record FROM documents")
def csv_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "lang", "source", "text")
    return table(spark, sf_dir, "documents").select("doc_id", delimited.format_row([F.col(c) for c in columns]).alias("record"))


@query("""SELECT doc_id, CAST(i // 4 AS BIGINT) AS "row", CASE i % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'a"b' WHEN 2 THEN 'c,d' ELSE 'text' END AS name,
CASE i % 4 WHEN 0 THEN CAST(doc_id + i // 4 AS VARCHAR) WHEN 1 THEN lang WHEN 2 THEN '"' || source || '",' WHEN 3 THEN CASE WHEN i // 4 = 0 THEN sha256(text) END END AS value FROM documents, range(8) t(i)""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header, the document and a record that lacks the last cell are written as one text and read back."""
    docs = table(spark, sf_dir, "documents")
    cells = [F.col("doc_id"), F.col("lang"), F.concat(F.lit('"'), "source", F.lit('",')), F.col("text")]
    short = [F.col("doc_id") + 1, *cells[1:3]]
    whole = F.concat_ws("\r\n", F.lit(delimited.header(["id", 'a"b', "c,d", "text"])), delimited.format_row(cells), delimited.format_row(short), F.lit(""))
    back = delimited.parse(docs.select("doc_id", whole.alias("csv")), "doc_id", "csv")
    return back.withColumn("value", F.when((F.col("name") == "text") & F.col("value").isNotNull(), F.sha2("value", 256)).otherwise(F.col("value")))


@query("SELECT page_id, CAST(i AS BIGINT) AS \"row\", CASE WHEN i = 0 THEN page_id || '|' || url ELSE '|a\tb|' END AS cells FROM pages, range(2) t(i)")
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = delimited.format_row([F.col("page_id"), F.col("url")], "\t")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(line, F.lit('\n\t"a\tb"\t\n')).alias("tsv"))
    return delimited.parse_rows(rows, "page_id", "tsv", "\t").withColumn("cells", F.array_join("cells", "|"))


# Each order as a tree: its return flags, and under them its lines.
_TREES = """leaf AS (SELECT l_orderkey AS tree, l_returnflag AS flag, 'line ' || l_linenumber || ' <' || l_linestatus || '>' AS topic, l_linenumber AS k FROM lineitem),
raw AS (SELECT DISTINCT tree, '' AS flag, 0 AS k, 0 AS depth, 'o' || tree AS topic FROM leaf UNION ALL SELECT DISTINCT tree, flag, 0, 1, flag FROM leaf UNION ALL SELECT tree, flag, k, 2, topic FROM leaf),
nodes AS (SELECT tree, CAST(row_number() OVER (PARTITION BY tree ORDER BY flag, k, topic) - 1 AS BIGINT) AS position, CAST(depth AS BIGINT) AS depth, topic, flag FROM raw),
up AS (SELECT a.tree, a.position, a.depth, a.topic, max(b.position) AS parent FROM nodes a LEFT JOIN nodes b ON a.tree = b.tree AND b.depth = a.depth - 1 AND b.position < a.position GROUP BY ALL)"""


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree, position, depth, topic in preorder: each order, its return flags, and its lines.

    The lines are dealt by order once; the first line of an order or flag brings its node with it.
    """
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("k"), F.col("l_linestatus").alias("status"))
    by = Window.partitionBy("tree").orderBy("flag", "k", "status")
    first = F.row_number().over(by) == 1
    rows = dealt(l, "tree").select("*", F.row_number().over(by).alias("n"), (first | ~F.lag("flag").over(by).eqNullSafe(F.col("flag"))).alias("fresh"))
    rows = rows.withColumn("at", F.col("n") + F.sum(F.col("fresh").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    node = lambda at, depth, topic: F.struct(at.cast("long").alias("position"), F.lit(depth).cast("long").alias("depth"), topic.alias("topic"))
    line = F.concat(F.lit("line "), F.col("k").cast("string"), F.lit(" <"), "status", F.lit(">"))
    root, flag, leaf = node(F.lit(0), 0, F.concat(F.lit("o"), F.col("tree").cast("string"))), node(F.col("at") - 1, 1, F.col("flag")), node(F.col("at"), 2, line)
    nodes = F.when(F.col("n") == 1, F.array(root, flag, leaf)).when(F.col("fresh"), F.array(flag, leaf)).otherwise(F.array(leaf))
    return rows.select("tree", F.inline(nodes))


@query(f"WITH {_TREES} SELECT tree, string_agg(repeat('  ', depth) || topic, chr(10) ORDER BY position) AS text FROM nodes GROUP BY tree")
def tree_indented_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.to_indented(order_trees(spark, sf_dir), "tree", 2)


@query(f"WITH {_TREES} SELECT tree, position, depth, topic, parent FROM up")
def tree_indented_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.from_indented(tree_indented_build(spark, sf_dir), "tree", "text", 2)


@query(f"WITH {_TREES} SELECT tree, depth, topic, parent IS NULL AS is_root, count(*) AS n FROM up GROUP BY ALL")
def freemind_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as nested elements and read back; places in the text stand for positions, so only depths and topics are compared."""
    back = trees.from_xml(trees.to_xml(order_trees(spark, sf_dir), "tree"), "tree", "text")
    return back.groupBy("tree", "depth", "topic", F.col("parent").isNull().alias("is_root")).agg(F.count("*").alias("n"))


@query(f"WITH {_TREES} SELECT tree, position AS id, parent, topic FROM up")
def tree_node_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trees.with_parents(order_trees(spark, sf_dir), "tree")
    return trees.from_node_array(trees.to_node_array(nodes, "tree"), "tree", "text")


@query(f"WITH {_TREES} SELECT a.tree, (['indented', 'xml', 'node_array'])[a.tree % 3 + 1] AS form, a.topic, b.topic AS under, count(*) AS n FROM up a LEFT JOIN up b ON b.tree = a.tree AND b.position = a.parent GROUP BY ALL")
def tree_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's tree written in one of three formats and read back by the format's name."""
    form = F.element_at(F.array(*map(F.lit, trees.FORMATS)), (F.col("tree") % 3 + 1).cast("int"))
    texts = trees.write_trees(trees.with_parents(order_trees(spark, sf_dir).withColumn("form", form), "tree"), "tree", "form")
    back = trees.read_trees(texts, "tree", "text", "form")
    # Each row stands as a child at its parent and before its own children, whose topic it gives them.
    both = back.withColumn("above", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("node", F.when(F.col("above") == 1, F.col("id")).otherwise(F.col("parent")))
    by = Window.partitionBy("tree", "node").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, 0)
    under = both.withColumn("under", F.first(F.when(F.col("above") == 1, F.col("topic")), True).over(by)).where("above = 0")
    return under.groupBy("tree", form.alias("form"), "topic", "under").agg(F.count("*").alias("n"))


@query(f"WITH {_TREES} SELECT tree, count(*) FILTER (depth <= 1) AS shown, max(depth) AS deepest FROM nodes GROUP BY 1")
def tree_expand_to_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_trees(spark, sf_dir).groupBy("tree").agg(F.count_if(F.col("depth") <= 1).alias("shown"), F.max("depth").alias("deepest"))


@query(f"""WITH {_TREES}, b AS (SELECT tree, position, CASE WHEN position % 5 = 2 THEN depth + 2 WHEN position % 7 = 6 THEN 0 ELSE depth END AS depth FROM nodes), w AS (SELECT *, lag(depth) OVER (PARTITION BY tree ORDER BY position) AS was FROM b)
SELECT tree, CASE WHEN depth = 0 THEN 'root' ELSE 'gap' END AS problem, position FROM w WHERE (depth = 0 AND was IS NOT NULL) OR depth > coalesce(was, -1) + 1""")
def tree_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of orders with some lines moved too deep and some to the top."""
    k = F.col("position")
    depth = F.when(k % 5 == 2, F.col("depth") + 2).when(k % 7 == 6, 0).otherwise(F.col("depth"))
    return trees.tree_problems(order_trees(spark, sf_dir).withColumn("depth", depth), "tree")


_JSON = """j AS (SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '","tags":["x",null,' || (event_id % 2 = 0) || '],"inner":{"props":' || props || ',"none":{},"v":' || user_id || '}}' AS js FROM events)"""


def _json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = lambda c: F.col(c).cast("string")
    js = F.concat(F.lit('{"id":'), s("event_id"), F.lit(',"type":"'), "event_type", F.lit('","tags":["x",null,'), (F.col("event_id") % 2 == 0).cast("string"), F.lit('],"inner":{"props":'), "props", F.lit(',"none":{},"v":'), s("user_id"), F.lit("}}"))
    return e.select("event_id", js.alias("js"))


@query(f"""WITH {_JSON} SELECT event_id, fullkey AS path, CASE WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(type) WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind,
CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL WHEN type = 'VARCHAR' THEN trim(CAST(atom AS VARCHAR), '"') ELSE CAST(atom AS VARCHAR) END AS value FROM j, json_tree(j.js)""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.flatten_json(_json_events(spark, sf_dir), "event_id", "js").drop("depth")


@query(f"WITH {_JSON} SELECT path, kind, count(*) AS n FROM (SELECT regexp_replace(fullkey, '[0-9]+', '*', 'g') AS path, CASE WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(type) WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind FROM j, json_tree(j.js)) GROUP BY ALL")
def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trees.flatten_json(_json_events(spark, sf_dir), "event_id", "js")
    return rows.groupBy(F.regexp_replace("path", "[0-9]+", "*").alias("path"), "kind").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, word, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INT) AS rank FROM c) WHERE rank <= 20""")
def token_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top_words(table(spark, sf_dir, "documents"), "lang", "text", 20)


@query(r"WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g') AS t FROM documents) SELECT doc_id, min(doc_id) OVER w AS \"first\", count(*) OVER w AS copies FROM d WINDOW w AS (PARTITION BY t)".replace('\\"', '"').replace("\\\\", "\\"))
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.identical(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT doc_id, CAST(length(t) - len(regexp_extract_all(t, '[^\\x00-\\x7F]')) AS BIGINT) AS n_basic, CAST(len(regexp_extract_all(t, '[^\\x00-\\x7F]')) AS BIGINT) AS n_other,
CAST(len(regexp_extract_all(t, '[\\x{00AD}\\x{200B}-\\x{200F}\\x{2028}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]')) AS BIGINT) AS n_invisible FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def non_ascii_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.character_profile(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r')) AS line FROM documents), s AS (SELECT doc_id AS k, line, 1 AS x, 0 AS y FROM l UNION ALL SELECT doc_id - 1, line, 0, 1 FROM l),
c AS (SELECT k, line, sum(x) AS x, sum(y) AS y FROM s GROUP BY ALL)
SELECT k AS doc_id, CAST(sum(greatest(0, x - y)) AS BIGINT) AS removed, CAST(sum(greatest(0, y - x)) AS BIGINT) AS added, CAST(sum(least(x, y)) AS BIGINT) AS kept FROM c GROUP BY 1""")
def line_diff_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one with the next id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.line_differences(docs, docs.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", "text")


@query("""SELECT page_id, replace(replace(replace(replace(replace(url_encode(url || ' ä+*~!'), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS encoded, url || ' ä+*~!' AS decoded FROM pages""")
def url_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = formatting.url_encode(F.concat("url", F.lit(" ä+*~!")))
    return table(spark, sf_dir, "pages").select("page_id", encoded.alias("encoded")).withColumn("decoded", formatting.url_decode(F.col("encoded")))


@query(f"WITH {_TREES} SELECT tree, position, depth, topic, parent FROM up")
def freemind_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's map, read by the table function in SQL."""
    map_table.register(spark)
    trees.to_xml(order_trees(spark, sf_dir), "tree").createOrReplaceTempView("order_maps")
    return spark.sql("SELECT tree, position, depth, topic, parent FROM freemind_nodes(TABLE(SELECT tree, text FROM order_maps) PARTITION BY tree)")


def _inner(c, name: str):
    return F.get_json_object(c, f"$.inner.{name}")


@query(f"""WITH {_JSON}, m AS (SELECT event_id, json_merge_patch(js, '{{"inner":{{"v":[' || event_id || '],"w":{{"x":true}}}},"tags":"none"}}') AS t FROM j)
SELECT event_id, json_extract_string(t, '$.type') AS type, json_extract_string(t, '$.tags') AS tags, json_extract_string(t, '$.inner.props.k') AS k, json_extract_string(t, '$.inner.v[0]') AS v, json_extract_string(t, '$.inner.w.x') AS x FROM m""")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's document with another merged into it, whose members lie at two levels."""
    e = _json_events(spark, sf_dir)
    other = e.select("event_id", F.concat(F.lit('{"inner":{"v":['), F.col("event_id").cast("string"), F.lit('],"w":{"x":true}},"tags":"none"}')).alias("js"))
    t = F.col("text")
    return trees.merge_json(e, other, "event_id", "js").select("event_id", F.get_json_object(t, "$.type").alias("type"), F.get_json_object(t, "$.tags").alias("tags"), _inner(t, "props.k").alias("k"), _inner(t, "v[0]").alias("v"), _inner(t, "w.x").alias("x"))


@query(f"""WITH {_JSON} SELECT event_id, '{{"id":' || event_id || ',"inner":{{"none":{{}},"props":' || replace(props, ': ', ':') || ',"v":' || user_id || '}},"tags":["x",null,' || (event_id % 2 = 0) || '],"type":"' || event_type || '"}}' AS text FROM j JOIN events USING (event_id)""")
def json_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's document taken apart into rows and built again, members in order of their names."""
    return trees.unflatten_json(trees.flatten_json(_json_events(spark, sf_dir), "event_id", "js"), "event_id")
