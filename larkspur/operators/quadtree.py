"""Nearest sites by a quadtree whose cells split where sites crowd."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.session import checkpointed

#: Sites of a leaf; a cell of more is split, down to 2**-DEEPEST of the extent. A split is of 2**STEP on each axis.
BOUND, DEEPEST, STEP = 32, 26, 2
#: Levels whose cells are broadcast: 16**3 at most.
FEW = 3


class Quadtree:
    """Cells (level, i, j, n, leaf) over sites (site, x, y), and the sites by leaf.

    Cells are counted from the top down, and only what lies in crowded ones goes a level further. Sites of one spot count
    once (the least site; `others`: the least two), so a leaf holds more than BOUND only where distinct spots are closer
    than the deepest cell. Sites without finite coordinates take no part.
    """

    def __init__(self, sites: DataFrame, others: bool = False, bound: int = BOUND) -> None:
        self.others = others
        place = F.row_number().over(Window.partitionBy("x", "y").orderBy("site"))
        spots = finite(sites).select("site", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("__place", place)
        spots = spots.where(F.col("__place") <= (2 if others else 1)).drop("__place")
        low_x, high_x, low_y, high_y = spots.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        self.empty = low_x is None
        self.x0, self.y0 = low_x or 0.0, low_y or 0.0
        self.size = max((high_x or 0.0) - self.x0, (high_y or 0.0) - self.y0) or 1.0
        rest = checkpointed(spots.withColumns({"ix": self._at("x", self.x0), "iy": self._at("y", self.y0)}))
        cells, leaves = [], []
        for level in range(DEEPEST // STEP + 1):
            rest = rest.withColumns({"i": F.shiftright("ix", DEEPEST - STEP * level), "j": F.shiftright("iy", DEEPEST - STEP * level)})
            counts = checkpointed(rest.groupBy("i", "j").agg(F.count("*").alias("n")).withColumn("leaf", (F.col("n") <= bound) | F.lit(STEP * level == DEEPEST)))
            cells.append(counts)
            whole = counts.where("leaf").select("i", "j")
            leaves.append(rest.join(whole, ["i", "j"], "left_semi").select(F.lit(level).alias("level"), "i", "j", "site", F.col("x").alias("sx"), F.col("y").alias("sy")))
            if counts.where("NOT leaf").isEmpty():
                break
            rest = checkpointed(rest.join(counts.where("NOT leaf").select("i", "j"), ["i", "j"], "left_semi"))
        self.cells, self.leaves = cells, reduce(DataFrame.unionByName, leaves)

    def _at(self, c: str, low: float) -> Column:
        last = (1 << DEEPEST) - 1
        return F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col(c) - low) / self.size * (1 << DEEPEST)))).cast("long")

    def nearest(self, points: DataFrame) -> DataFrame:
        """id, site, distance of the nearest site of every point (id, x, y) with finite coordinates, ties to the lesser site; with `others`, of those with another id.

        Each point goes down the tree with the cells that may hold its nearest site: a cell with a site is a bound to the
        distance, by its far corner, and cells whose near side lies beyond the least bound are dropped. So a point meets few
        leaves and at most BOUND sites in each, however many points or sites crowd in one place. Ids must not repeat.
        """
        points = finite(points).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        none = points.select("id", F.lit(None).cast(dict(self.leaves.dtypes)["site"]).alias("site"), F.lit(None).cast("double").alias("distance")).limit(0)
        if self.empty:
            return none
        root = self.cells[0].select("i", "j", F.col("n").alias("n"), "leaf")
        # One row: the root.
        front = points.crossJoin(F.broadcast(root)).withColumns({"level": F.lit(0), "near": F.lit(0.0)})
        done, bounds = [], points.select("id", F.lit(None).cast("double").alias("bound"))
        for level in range(len(self.cells)):
            done.append(front.where("leaf").select("id", "x", "y", "level", "i", "j", "near"))
            if level + 1 == len(self.cells):
                break
            below = self.cells[level + 1].select(F.shiftright("i", STEP).alias("up_i"), F.shiftright("j", STEP).alias("up_j"), F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("n").alias("cn"), F.col("leaf").alias("cleaf"))
            below = F.broadcast(below) if level < FEW else below
            open_ = front.where("NOT leaf")
            inner = open_.join(below, (open_.i == below.up_i) & (open_.j == below.up_j)).select("id", "x", "y", F.lit(level + 1).alias("level"), F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("cn").alias("n"), F.col("cleaf").alias("leaf"))
            side = self.size / (1 << STEP * (level + 1))
            inner = inner.withColumns({"near": self._reach(side, False), "far": self._reach(side, True)})
            sure = F.when(F.col("n") >= (2 if self.others else 1), F.col("far"))
            known = inner.select("id", sure.alias("bound")).unionByName(bounds)
            bounds = checkpointed(known.groupBy("id").agg(F.min("bound").alias("bound")))
            front = checkpointed(inner.join(bounds, "id").where(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).drop("far", "bound"))
            if front.isEmpty():
                break
        kept = reduce(DataFrame.unionByName, done).join(bounds, "id").where(F.col("bound").isNull() | (F.col("near") <= F.col("bound")))
        met = kept.join(self.leaves, ["level", "i", "j"])
        met = met.where(F.col("id") != F.col("site")) if self.others else met
        dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
        met = met.select("id", "site", F.sqrt(dx * dx + dy * dy).alias("distance"))
        return met.groupBy("id").agg(F.min_by("site", F.struct("distance", "site")).alias("site"), F.min("distance").alias("distance"))

    def _reach(self, side: float, far: bool) -> Column:
        """The distance to a cell's far corner, or to its nearest place; a little more, or less, than exact for what rounding may do."""
        slack = self.size * 1e-9

        def along(c: str, at: str, low: float) -> Column:
            a = F.col(at) * side + low
            out = F.greatest(F.abs(F.col(c) - a), F.abs(F.col(c) - (a + side))) + slack
            return out if far else F.greatest(F.lit(0.0), a - slack - F.col(c), F.col(c) - (a + side) - slack)

        dx, dy = along("x", "i", self.x0), along("y", "j", self.y0)
        return F.sqrt(dx * dx + dy * dy)


def finite(rows: DataFrame) -> DataFrame:
    return rows.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
