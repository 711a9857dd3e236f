"""Hierarchies as adjacency tables (id, parent; the root's parent is null)."""

from __future__ import annotations

from functools import reduce
from itertools import count
from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions.formatting import valid
from larkspur.operators.catalog import ancestors, parent_dir
from larkspur.operators.stats import numbered
from larkspur.session import checkpointed


def problems(nodes: DataFrame) -> DataFrame:
    """problem, id: what keeps an adjacency table from being one tree (missing parent, ambiguous id, multiple roots, no root, cycle)."""
    roots = nodes.where("parent is null")
    missing = nodes.where("parent is not null").join(nodes.select(F.col("id").alias("p")), F.col("parent") == F.col("p"), "left_anti").select(F.lit("missing").alias("problem"), "id")
    ambiguous = nodes.groupBy("id").count().where("count > 1").select(F.lit("ambiguous").alias("problem"), "id")
    # All but one row of the least root.
    same = roots.groupBy("id").agg(F.count("*").alias("n"))
    least = F.broadcast(same.agg(F.min(F.struct("id")).alias("least")))
    extra = same.crossJoin(least).select("id", (F.col("n") - F.col("id").eqNullSafe(F.col("least.id")).cast("int")).cast("int").alias("n"))
    several = extra.select(F.explode(F.array_repeat(F.lit("multiple roots"), F.col("n"))).alias("problem"), "id")
    none = roots.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no root").alias("problem"), F.lit(None).cast(dict(nodes.dtypes)["id"]).alias("id"))
    cycle = endless(nodes).select(F.lit("cycle").alias("problem"), "id")
    return missing.unionByName(ambiguous).unionByName(several).unionByName(none).unionByName(cycle)


def endless(nodes: DataFrame) -> DataFrame:
    """id of the nodes that lie in a cycle or below one (of a repeated id the least parent counts).

    Every node's pointer is replaced by that of the node it points to, which doubles its reach, until the pointers that
    are left have gone more steps than there are nodes.
    """
    own = nodes.groupBy("id").agg(F.min("parent").alias("next"))
    # A parent that isn't there ends the way as a root does.
    there = own.select(F.col("id").alias("there"))
    at = checkpointed(own.join(there, own.next == there.there, "left").select("id", F.col("there").alias("next")).where("next is not null"))
    reach, n = 1, own.count()
    while reach <= n and not at.isEmpty():
        ahead = at.select(F.col("id").alias("via"), F.col("next").alias("then"))
        at, reach = checkpointed(at.join(ahead, at.next == ahead.via).select("id", F.col("then").alias("next"))), reach * 2
    return at.select("id")


#: Levels after which a hierarchy is looked through for cycles; a tree may have any number of levels.
LOOKED_AT = 64


def closure(nodes: DataFrame) -> DataFrame:
    """id, ancestor, distance for each node and all above it, itself at 0: one join a level, until no row goes higher. Raises for a cycle."""
    up = nodes.select(F.col("id").alias("above"), F.col("parent").alias("next"))
    level = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    out = level
    for k in count(1):
        if k == LOOKED_AT and not endless(nodes).isEmpty():
            raise ValueError("the hierarchy has a cycle")
        level = level.join(up, level.ancestor == up.above).where("next is not null").select("id", F.col("next").alias("ancestor"), F.lit(k).cast("long").alias("distance"))
        level = checkpointed(level)
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent").alias("p")).distinct(), F.col("id") == F.col("p"), "left_anti")


def by_level(nodes: DataFrame) -> list[DataFrame]:
    """The roots, their children, and so on: one join a level, however many. Nodes that no root reaches (problems() names them) are in none."""
    nodes, out = checkpointed(nodes), []
    level = nodes.where("parent is null")
    while not level.isEmpty():
        out.append(level)
        level = checkpointed(nodes.join(level.select(F.col("id").alias("above")), nodes.parent == F.col("above"), "left_semi"))
    return out


def totals(levels: list[DataFrame], value: str) -> list[DataFrame]:
    """Each level as id, parent, depth, total, n_leaves: a node's own value (null and NaN count 0) with those of all below it, and its leaves.

    Summed from the deepest level up, so that every node is summed once, and by parents before the shuffle.
    """
    out: list[DataFrame] = []
    for depth in reversed(range(len(levels))):
        own = F.coalesce(valid(F.col(value).cast("double")), F.lit(0.0))
        level = levels[depth].select("id", "parent", F.lit(depth).cast("long").alias("depth"), own.alias("total"))
        if out:
            below = out[0].groupBy(F.col("parent").alias("its")).agg(F.sum("total").alias("under"), F.sum("n_leaves").alias("leaves"))
            level = level.join(below, level.id == below.its, "left").select("id", "parent", "depth", (F.col("total") + F.coalesce("under", F.lit(0.0))).alias("total"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"))
        else:
            level = level.withColumn("n_leaves", F.lit(1).cast("long"))
        out.insert(0, checkpointed(level))
    return out


def lowest_common_ancestor(above: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, lca, distance: the nearest common ancestor of each pair and the length of the path through it."""
    a = above.select(F.col("id").alias("a"), F.col("ancestor").alias("lca"), F.col("distance").alias("da"))
    b = above.select(F.col("id").alias("b"), F.col("ancestor").alias("lca"), F.col("distance").alias("db"))
    met = pairs.join(a, "a").join(b, ["b", "lca"])
    return met.groupBy("a", "b").agg(F.min_by("lca", F.col("da")).alias("lca"), F.min(F.col("da") + F.col("db")).alias("distance"))


def from_paths(paths: DataFrame) -> DataFrame:
    """id, parent, depth, imputed, n: a tree from slash paths (path). Missing ancestors are made, one trailing slash is dropped."""
    clean = paths.select(F.regexp_replace("path", "(?<!\\\\)/$", "").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    every = clean.select(F.explode(ancestors(F.col("path"))).alias("id")).distinct()
    out = every.join(clean.withColumnRenamed("path", "id"), "id", "left")
    depth = F.when(F.col("id") == "", 0).otherwise(F.size(F.split("id", "/")))
    return out.select("id", F.when(F.col("id") != "", parent_dir(F.col("id"))).alias("parent"), depth.cast("long").alias("depth"), F.col("n").isNull().alias("imputed"), F.coalesce("n", F.lit(0)).alias("n"))


def slices(nodes: DataFrame, value: str) -> DataFrame:
    """`nodes` with x0 and x1: each child's share of its parent's extent, in order of id."""
    by = Window.partitionBy("parent")
    end = F.sum(value).over(by.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(value).over(by)
    return nodes.withColumn("x0", (end - F.col(value)) / total).withColumn("x1", end / total)


def flows(edges: DataFrame) -> DataFrame:
    """node, sent, received, own: totals of a flow table (source, target, value)."""
    both = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("value").alias("s"), F.lit(0.0).alias("r")), F.struct(F.col("target").alias("node"), F.lit(0.0).alias("s"), F.col("value").alias("r")))).alias("x"), (F.col("source") == F.col("target")).alias("loop"))
    return both.groupBy("x.node").agg(F.sum("x.s").alias("sent"), F.sum("x.r").alias("received"), F.sum(F.when(F.col("loop"), F.col("x.s")).otherwise(0.0)).alias("own"))


def orders(above: DataFrame) -> DataFrame:
    """id, breadth, pre, post: positions of each node, siblings by id, level by level, parents first, and children first; from a closure."""
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))), lambda p: p["ancestor"])
    rows = checkpointed(above.groupBy("id").agg(F.max("distance").alias("depth"), path.alias("path")))
    # A last part beyond all ids puts a node after those below it.
    rows = rows.withColumn("last", F.array_append("path", F.lit("\U0010ffff")))
    out = rows.select("id")
    for name, by in (("breadth", ("depth", "path")), ("pre", ("path",)), ("post", ("last",))):
        out = out.join(numbered(rows.select("id", *by), *by).select("id", F.col("position").alias(name)), "id")
    return out


def arcs(edges: DataFrame, gap: float = 0.0) -> DataFrame:
    """source, target, value, start_angle, end_angle, group_start, group_end of flows (source, target, value) drawn round a circle.

    Nodes that send follow one another by name with `gap` radians between them, and the flows of each by target; a node
    that sends nothing has an empty arc, which counts for the gaps but gives no row. Flows of a pair are summed.
    """
    cells = edges.where("value > 0").groupBy("source", "target").agg(F.sum("value").cast("double").alias("value"))
    names = edges.select(F.explode(F.array("source", "target")).alias("source")).where("source is not null").distinct()
    sums = names.join(cells.groupBy("source").agg(F.sum("value").alias("sent")), "source", "left").select("source", F.coalesce("sent", F.lit(0.0)).alias("sent"))
    # One row for each node.
    by = Window.orderBy("source")
    every = Window.partitionBy()
    unit = F.greatest(F.lit(0.0), 2 * pi - gap * F.count(F.lit(1)).over(every)) / F.sum("sent").over(every)
    start = (F.sum("sent").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("sent")) * unit + gap * (F.row_number().over(by) - 1)
    groups = sums.select("source", unit.alias("unit"), start.alias("group_start"), (start + F.col("sent") * unit).alias("group_end"))
    end = F.col("group_start") + F.col("unit") * F.sum("value").over(Window.partitionBy("source").orderBy("target").rowsBetween(Window.unboundedPreceding, 0))
    return cells.join(groups, "source").withColumn("end_angle", end).withColumn("start_angle", F.col("end_angle") - F.col("unit") * F.col("value")).drop("unit")


def chords(edges: DataFrame, gap: float = 0.0, directed: bool = False, transposed: bool = False) -> DataFrame:
    """source, target, value, back, source_start, source_end, target_start, target_end of flows (source, target, value) drawn as ribbons round a circle.

    Undirected, a pair of nodes is one ribbon: it starts at the node that sends more (the lesser name on ties) with `value`
    and ends at the other with `back`, what that one sends; a node's arc is what it sends, by the other's name. Directed,
    each flow is a ribbon of its own, as wide at both ends, and `back` is null; a node's arc is first what it receives, by
    falling names, then what it sends, by rising ones. Nodes follow by name with `gap` radians between them, and nodes
    without flows count for the gaps. `transposed` turns all flows over. Flows of a pair are summed; only those above 0 count.
    """
    ends = ("target", "source") if transposed else ("source", "target")
    flows = edges.select(*(F.col(e).alias(n) for e, n in zip(ends, ("source", "target"), strict=True)), "value")
    names = flows.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null").distinct()
    cells = flows.where("value > 0 and source is not null and target is not null").groupBy("source", "target").agg(F.sum("value").cast("double").alias("value"))
    sent = cells.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(True).alias("out"), "value")
    there = cells.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(directed is False).alias("out"), (F.col("value") if directed else F.lit(0.0)).alias("value"))
    # Undirected, the way back has a place even where nothing goes.
    parts = sent.unionByName(there).groupBy("node", "other", "out").agg(F.sum("value").alias("value"))
    sums = names.join(parts.groupBy("node").agg(F.sum("value").alias("all")), "node", "left").select("node", F.coalesce("all", F.lit(0.0)).alias("all"))
    # One row for each node.
    by, every = Window.orderBy("node"), Window.partitionBy()
    n, total = F.count(F.lit(1)).over(every), F.sum("all").over(every)
    unit = F.greatest(F.lit(0.0), 2 * pi - gap * n) / F.nullif(total, F.lit(0.0))
    space = F.when(unit > 0, F.lit(float(gap))).otherwise(2 * pi / n)
    begin = (F.sum("all").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")) * F.coalesce(unit, F.lit(0.0)) + space * (F.row_number().over(by) - 1)
    groups = sums.select("node", unit.alias("unit"), begin.alias("begin"))
    along = Window.partitionBy("node").orderBy("out", F.when(~F.col("out"), F.col("other")).desc(), "other").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("begin") + F.col("unit") * F.sum("value").over(along)
    arcs_ = parts.join(groups, "node").withColumn("end", end).withColumn("start", F.col("end") - F.col("unit") * F.col("value"))
    one = F.struct("value", "start", "end")
    if directed:
        pair = F.when(F.col("out"), F.struct("node", "other")).otherwise(F.struct(F.col("other").alias("node"), F.col("node").alias("other")))
        met = arcs_.groupBy(pair.alias("pair")).agg(F.max(F.when(F.col("out"), one)).alias("a"), F.max(F.when(~F.col("out"), one)).alias("b"))
        ways = (F.col("pair.node"), F.col("pair.other"), F.col("a.value"), F.lit(None).cast("double"))
        source, target = F.col("a"), F.col("b")
    else:
        lesser = F.col("node") <= F.col("other")
        met = arcs_.groupBy(F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high")).agg(F.max(F.when(lesser, one)).alias("a"), F.max(F.when(F.col("node") >= F.col("other"), one)).alias("b"))
        kept = F.col("a.value") >= F.col("b.value")
        source, target = F.when(kept, F.col("a")).otherwise(F.col("b")), F.when(kept, F.col("b")).otherwise(F.col("a"))
        ways = (F.when(kept, F.col("low")).otherwise(F.col("high")), F.when(kept, F.col("high")).otherwise(F.col("low")), source["value"], target["value"])
    angles = [x[e].alias(f"{name}_{e}") for name, x in (("source", source), ("target", target)) for e in ("start", "end")]
    return met.select(*(w.alias(name) for w, name in zip(ways, ("source", "target", "value", "back"), strict=True)), *angles)


def links(nodes: DataFrame) -> DataFrame:
    """source, target: every node but the roots with its parent as source."""
    return nodes.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"))


def subtrees(nodes: DataFrame, above: DataFrame, tops: DataFrame) -> DataFrame:
    """top and the columns of `nodes` with depth: for each id of `tops`, itself as a root of depth 0 and all below it; `above` is a closure."""
    under = above.join(tops.select(F.col("id").alias("ancestor")).distinct(), "ancestor").select("id", F.col("ancestor").alias("top"), F.col("distance").alias("depth"))
    rest = [c for c in nodes.columns if c not in ("id", "parent")]
    return nodes.join(under, "id").select("top", "id", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), "depth", *rest)


def without_imputed_top(tree: DataFrame) -> DataFrame:
    """from_paths() without the made-up nodes at its top that have one child only: the first node that was given, or branches, is the root, at depth 0."""
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("its")).agg(F.count("*").alias("children"))
    own = tree.join(children, F.col("id") == F.col("its"), "left")
    # Down to that node every level has one node; one number tells how many there are.
    root = own.where(~(F.col("imputed") & (F.coalesce("children", F.lit(0)) == 1))).agg(F.min("depth").alias("top"))
    below = tree.crossJoin(F.broadcast(root)).where("depth >= top")
    return below.select("id", F.when(F.col("depth") > F.col("top"), F.col("parent")).alias("parent"), (F.col("depth") - F.col("top")).alias("depth"), "imputed", "n")


def next_side(children: DataFrame) -> DataFrame:
    """parent, side: where the next child of each parent of a two-sided map goes, from its children (parent, side).

    Left if it has more than one child and fewer of them are on the left than elsewhere, otherwise right; a child without a side is on the right.
    """
    left = F.sum(F.when(F.col("side") == "left", 1).otherwise(0))
    n = F.count(F.lit(1))
    return children.groupBy("parent").agg(F.when((n > 1) & (left < n - left), "left").otherwise("right").alias("side"))


def shown(nodes: DataFrame) -> DataFrame:
    """The rows of `nodes` (id, parent, expanded) that a tree view shows: the roots, and the children of those shown and expanded (null: not).

    One join a level with the rows shown on the one above, so what lies below a closed node is never followed.
    """
    level, out = nodes.where("parent is null"), []
    while not out or not level.isEmpty():
        out.append(level)
        open_ = level.where("expanded").select(F.col("id").alias("above"))
        level = checkpointed(nodes.join(open_, F.col("parent") == F.col("above"), "left_semi"))
    return reduce(DataFrame.unionByName, out)
