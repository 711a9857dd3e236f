"""Rectangles of hierarchies (id, parent; a root's parent is null): treemaps and nested partitions, level by level."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from larkspur.operators.hierarchy import by_level, totals
from larkspur.session import checkpointed

GOLDEN = (1 + sqrt(5)) / 2
TILES = ("squarify", "dice", "slice", "slicedice")
_CORNERS = ("x0", "y0", "x1", "y1")


def rectangles(nodes: DataFrame, value: str, width: float, height: float, tile: str = "squarify", ratio: float = GOLDEN) -> DataFrame:
    """id, parent, depth, total, x0, y0, x1, y1: a treemap. Each node's area is its share of the whole, and it lies within its parent's.

    tile: dice (side by side), slice (one above the other), slicedice (the roots' children by dice, theirs by slice, and so on) or squarify
    (rows along the shorter side, tiles of sides as near to `ratio` as a greedy choice gives). Children come by total, the
    largest first, ties by id. A node's own value leaves room at the end of its rectangle. Totals of 0 or less have an
    empty rectangle. Every root has the whole rectangle.
    """
    if tile not in TILES:
        raise ValueError(f"tile must be one of {', '.join(TILES)}")
    if not ratio > 0:
        raise ValueError("ratio must be above 0")

    def place(children: DataFrame, depth: int) -> DataFrame:
        if tile == "squarify":
            return _squarified(children, ratio)
        return _in_line(children, tile == "dice" or tile == "slicedice" and depth % 2 == 1)

    return _down(nodes, value, (width, height), place)


def partition(nodes: DataFrame, value: str, width: float, height: float) -> DataFrame:
    """id, parent, depth, total, x0, y0, x1, y1: each level is a band of the same height, and a node's children share its width by total, the largest first."""
    levels = totals(by_level(nodes), value)
    band = height / max(len(levels), 1)
    out = _down(nodes, value, (width, height), lambda children, depth: _in_line(children, True), levels)
    return out.withColumn("y0", F.col("depth") * band).withColumn("y1", (F.col("depth") + 1) * band)


def _down(nodes: DataFrame, value: str, size: tuple[float, float], place, levels: list[DataFrame] | None = None) -> DataFrame:
    """The levels with rectangles, each placed in those of the level above: `place` gets id, parent, total, whole and the parent's corners."""
    levels = totals(by_level(nodes), value) if levels is None else levels
    kept = ["id", "parent", "depth", "total", *_CORNERS]
    if not levels:
        return nodes.where("false").select("id", "parent", F.lit(0).cast("long").alias("depth"), *(F.lit(0.0).alias(c) for c in kept[3:]))
    corners = dict(zip(_CORNERS, (0.0, 0.0, *map(float, size)), strict=True))
    out = [levels[0].select("id", "parent", "depth", "total", *(F.lit(v).alias(c) for c, v in corners.items()))]
    for depth, level in enumerate(levels[1:], 1):
        above = out[-1].select(F.col("id").alias("above"), F.col("total").alias("whole"), *_CORNERS)
        children = level.join(above, level.parent == above.above).select("id", "parent", "total", "whole", *_CORNERS)
        out.append(checkpointed(place(children, depth).withColumn("depth", F.lit(depth).cast("long")).select(kept)))
    return reduce(DataFrame.unionByName, out)


def _in_line(children: DataFrame, across: bool) -> DataFrame:
    """Children side by side in their parent's rectangle, or one above the other: a running sum of totals in a window, which spills."""
    by = Window.partitionBy("parent").orderBy(F.desc("total"), "id")
    own = F.greatest(F.col("total"), F.lit(0.0))
    low, high = ("x0", "x1") if across else ("y0", "y1")
    step: Column = F.when(F.col("whole") > 0, (F.col(high) - F.col(low)) / F.col("whole")).otherwise(0.0)
    ends = children.withColumn("own", own * step).withColumn("end", F.sum(own).over(by.rowsBetween(Window.unboundedPreceding, 0)) * step + F.col(low))
    return ends.withColumn(low, F.col("end") - F.col("own")).withColumn(high, F.col("end")).drop("own", "end")


def _squarified(children: DataFrame, ratio: float) -> DataFrame:
    """Children in rows, each choice depending on those before it: the children of a parent pass through one task in order, which holds the open row only."""
    schema = StructType([children.schema[c] for c in ("id", "parent", "total")] + [StructField(c, DoubleType()) for c in _CORNERS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, waiting = _Rows(ratio), []
        for b in batches:
            waiting.append(b)
            for one in zip(*(b.column(c).to_pylist() for c in ("parent", "total", "whole", *_CORNERS)), strict=True):
                tiles.add(*one)
            while waiting and len(tiles.done) >= waiting[0].num_rows:
                yield tiles.taken(waiting.pop(0))
        tiles.close()
        for b in waiting:
            yield tiles.taken(b)

    inner = children.repartition("parent").sortWithinPartitions("parent", F.desc("total"), "id")
    return inner.mapInArrow(run, schema)


class _Rows:
    """Tiles of one parent after another. `done` has the corners of those whose rows are closed, in the order of add()."""

    def __init__(self, ratio: float) -> None:
        self.ratio, self.done = ratio, []
        self.parent, self.row = None, []

    def add(self, parent, total: float, whole: float, x0: float, y0: float, x1: float, y1: float) -> None:
        if parent != self.parent:
            self.close()
            self.parent, self.left, self.box = parent, whole, (x0, y0, x1, y1)
        if not total > 0 or not self.left > 0:
            # Nothing to show, and by the order nothing after it either.
            self.close()
            self.done.append((self.box[0], self.box[1], self.box[0], self.box[1]))
            return
        if self.row and self._worst(self.sum + total, total) > self._worst(self.sum, self.row[-1]):
            self.close()
        self.sum = self.sum + total if self.row else total
        self.row.append(total)

    def _worst(self, row: float, least: float) -> float:
        """How far the sides of a row's largest or smallest tile are from the ratio, as a factor; totals fall, so the first is the largest."""
        x0, y0, x1, y1 = self.box
        short, long = sorted((x1 - x0, y1 - y0))
        if not short > 0:
            return 1.0
        # The row is as thick as its share of the long side; a tile is as long as its share of the short one.
        thick = long * row / self.left
        return max(thick / (short * least / row) / self.ratio, self.ratio * (short * self.row[0] / row) / thick)

    def close(self) -> None:
        if not self.row:
            return
        x0, y0, x1, y1 = self.box
        across, share, at = x1 - x0 < y1 - y0, min(self.sum / self.left, 1.0), 0.0
        edge = y0 + (y1 - y0) * share if across else x0 + (x1 - x0) * share
        for total in self.row:
            a, at = at / self.sum, at + total
            b = at / self.sum
            self.done.append((x0 + (x1 - x0) * a, y0, x0 + (x1 - x0) * b, edge) if across else (x0, y0 + (y1 - y0) * a, edge, y0 + (y1 - y0) * b))
        self.box = (x0, edge, x1, y1) if across else (edge, y0, x1, y1)
        self.left, self.row = self.left - self.sum, []

    def taken(self, b: pa.RecordBatch) -> pa.RecordBatch:
        """A batch whose tiles are all placed, with their corners."""
        here, self.done = self.done[: b.num_rows], self.done[b.num_rows :]
        corners = [pa.array([t[k] for t in here], pa.float64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "parent", "total")), *corners], ["id", "parent", "total", *_CORNERS])
