"""Children in order: places with gaps between them, so that inserts leave the others alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Distance of the places of freshly numbered siblings.
GAP = 1 << 20


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` (id, parent, ...) with `place`: GAP apart among the siblings in order of `order`."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(*order)).cast("long") * GAP)


def insert(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """id, parent, place after a batch of edits (id, side, anchor, n): new nodes right before or after an existing sibling, or last under a parent.

    side: before, after (anchor: a node) or under (anchor: a parent). Edits are made in order of n, each as if alone: of
    several before one node the last stands next to it, and so does the last of several after it. Nodes keep their places;
    new ones are spread over the gap they fall in, and only where a gap is too narrow are all children of that parent placed
    anew. Edits of unknown anchors are left out. The siblings of one parent are sorted by Spark in one task.
    """
    by = Window.partitionBy("parent").orderBy("place", "id")
    old = nodes.select("id", "parent", "place", F.lag("id").over(by).alias("before"), F.lead("place").over(by).alias("next"), F.lag("place").over(by).alias("last"))
    far = F.col("place") + 2 * GAP
    after = edits.where("side = 'after'").join(old.withColumnRenamed("id", "at"), F.col("anchor") == F.col("at"))
    after = after.select("id", "parent", F.col("place").alias("low"), F.coalesce("next", far).alias("high"), F.lit(0).alias("kind"), (-F.col("n")).alias("turn"))
    first = edits.where("side = 'before'").join(old.withColumnRenamed("id", "at"), F.col("anchor") == F.col("at"))
    first = first.select("id", "parent", F.coalesce("last", F.col("place") - 2 * GAP).alias("low"), F.col("place").alias("high"), F.lit(1).alias("kind"), F.col("n").alias("turn"))
    ends = nodes.groupBy(F.col("parent").alias("up")).agg(F.max("place").alias("top"))
    known = nodes.select(F.col("id").alias("up")).distinct().join(ends, "up", "left")
    under = edits.where("side = 'under'").join(known, F.col("anchor") == F.col("up"))
    low = F.coalesce("top", F.lit(0).cast("long"))
    under = under.select("id", F.col("up").alias("parent"), low.alias("low"), (low + 2 * GAP).alias("high"), F.lit(1).alias("kind"), F.col("n").alias("turn"))
    new = after.unionByName(first).unionByName(under)
    gap = Window.partitionBy("parent", "low")
    nth, many = F.row_number().over(gap.orderBy("kind", "turn", "id")), F.count(F.lit(1)).over(gap)
    new = new.withColumns({"nth": nth, "many": many, "room": F.max(F.col("high") - F.col("low")).over(gap)})
    fits = F.col("room") > F.col("many")
    new = new.select("id", "parent", "low", "nth", fits.alias("fits"), (F.col("low") + F.when(fits, F.floor(F.col("room") * F.col("nth") / (F.col("many") + 1))).otherwise(0)).alias("place"))
    every = nodes.select("id", "parent", "place", F.lit(0).alias("nth"), F.lit(True).alias("fits")).unionByName(new.select("id", "parent", "place", "nth", "fits"))
    tight = F.min("fits").over(Window.partitionBy("parent"))
    # Where a gap is too narrow its new nodes stand at its low end, in their order.
    fresh = F.row_number().over(Window.partitionBy("parent").orderBy("place", "nth", "id")).cast("long") * GAP
    return every.select("id", "parent", F.when(tight, F.col("place")).otherwise(fresh).alias("place"))
