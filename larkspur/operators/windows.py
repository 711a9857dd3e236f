"""Window operators: ranks, running sums, pairs, smoothing, stacks and pies."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from larkspur.functions.formatting import valid


def rank(x: Column, by: WindowSpec) -> Column:
    """0-based rank, ties sharing the least; null for null and NaN."""
    v = valid(x)
    return F.when(v.isNotNull(), (F.rank().over(by.orderBy(v.asc_nulls_last())) - 1).cast("long"))


def running(by: WindowSpec) -> WindowSpec:
    return by.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cumsum(x: Column, by: WindowSpec) -> Column:
    """Running sum in which null and NaN count 0."""
    return F.sum(F.coalesce(valid(x), F.lit(0.0))).over(running(by))


def pairs(rows: DataFrame, by: WindowSpec, x: str) -> DataFrame:
    """`rows` with next_x, without the last of each group."""
    return rows.withColumn("next_x", F.lead(x).over(by)).withColumn("__more", F.lead(F.lit(True)).over(by)).where("__more").drop("__more")


def moving_average(x: Column, by: WindowSpec, radius: int) -> Column:
    """Mean of the valid numbers up to `radius` rows away."""
    return F.avg(valid(x)).over(by.rowsBetween(-radius, radius))


def blur(rows: DataFrame, keys: list[str], order: str, x: str, radius: int, passes: int = 3) -> DataFrame:
    """`rows` with `x` replaced by its mean over 2 * radius + 1 places, three times over; beyond either end the value there goes on."""
    by = Window.partitionBy(*keys).orderBy(order)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, n = F.row_number().over(by), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    v = F.col(x)
    for _ in range(passes):
        before, after = F.greatest(F.lit(0), radius + 1 - place), F.greatest(F.lit(0), place + radius - n)
        total = F.sum(v).over(by.rowsBetween(-radius, radius)) + before * F.first(v).over(whole) + after * F.last(v).over(whole)
        rows = rows.withColumn(x, total / (2 * radius + 1))
    return rows


def full_grid(cells: DataFrame, keys: list[str], shape: tuple[int, int], x: str) -> DataFrame:
    """keys, i, j, `x` of every place of a grid of shape (rows, columns) for each key: 0 where `cells` (keys, i, j, x) has none. What lies outside is left out."""
    rows, columns = shape
    each = (cells.select(*keys).distinct() if keys else cells.sparkSession.range(1).select()).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"))
    every = each.select(*keys, "i", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"))
    return every.join(cells, [*keys, "i", "j"], "left").withColumn(x, F.coalesce(F.col(x), F.lit(0.0)))


def blur_grid(cells: DataFrame, keys: list[str], x: str, across: int, down: int, passes: int = 3) -> DataFrame:
    """A full grid (keys, i, j, x) blurred along its rows and then along its columns, each as blur() does; a radius of 0 leaves that way alone. A task holds one row or column."""
    out = blur(cells, [*keys, "i"], "j", x, across, passes) if across else cells
    return blur(out, [*keys, "j"], "i", x, down, passes) if down else out


def stack(rows: DataFrame, at: str, series: str, value: str, offset: str = "none") -> DataFrame:
    """`rows` with y0 and y1: each series on top of those before it (by name) at the same place.

    offset: none, expand (to 1), diverging (negative values downwards) or silhouette (centred on 0).
    """
    by = Window.partitionBy(at)
    up = running(by.orderBy(series))
    v = F.coalesce(valid(F.col(value)), F.lit(0.0))
    if offset == "diverging":
        above, below = F.sum(F.greatest(v, F.lit(0.0))).over(up), F.sum(F.least(v, F.lit(0.0))).over(up)
        y0, y1 = F.when(v >= 0, above - v).otherwise(below), F.when(v >= 0, above).otherwise(below - v)
        return rows.withColumn("y0", y0).withColumn("y1", y1)
    top, total = F.sum(v).over(up), F.sum(v).over(by)
    y0, y1 = top - v, top
    if offset == "expand":
        y0, y1 = (F.when(total != 0, y / total).otherwise(0.0) for y in (y0, y1))
    elif offset == "silhouette":
        y0, y1 = y0 - total / 2, y1 - total / 2
    return rows.withColumn("y0", y0).withColumn("y1", y1)


def stack_order(rows: DataFrame, at: str, series: str, value: str, order: str) -> DataFrame:
    """series and position. order: none (by name), reverse, ascending or descending (by sum), appearance (by place of the peak)."""
    v = F.coalesce(valid(F.col(value)), F.lit(0.0))
    sums = rows.groupBy(series).agg(F.sum(v).alias("total"), F.min_by(F.col(at), F.struct(-v, F.col(at))).alias("peak"))
    by = {"none": [F.col(series)], "reverse": [F.desc(series)], "ascending": [F.col("total"), F.col(series)], "descending": [F.desc("total"), F.desc(series)], "appearance": [F.col("peak"), F.col(series)]}[order]
    return sums.select(series, F.row_number().over(Window.orderBy(*by)).cast("long").alias("position"))


def pie(groups: DataFrame, key: str, value: str, start: float = 0.0, end: float = 2 * pi, gap: float = 0.0) -> DataFrame:
    """`groups` with start and end angle between `start` and `end`, largest value first, ties by key.

    Each arc is followed by `gap` radians, which belong to it, or by its even share of the whole where that is less. Values
    below 0 have no arc but the gap; if nothing is above 0, all arcs are that.
    """
    by = Window.orderBy(F.desc(value), key)
    every = Window.partitionBy()
    n, own = F.count(F.lit(1)).over(every), F.greatest(F.col(value).cast("double"), F.lit(0.0))
    pad = F.least(F.lit(abs(gap)), abs(end - start) / n) * (1 if end >= start else -1)
    total = F.sum(own).over(every)
    unit = F.when(total > 0, (F.lit(end - start) - n * pad) / total).otherwise(0.0)
    last = F.sum(own).over(running(by)) * unit + F.row_number().over(by) * pad + start
    return groups.withColumn("end_angle", last).withColumn("start_angle", F.col("end_angle") - own * unit - pad)


def wiggle(rows: DataFrame, at: str, series: str, value: str) -> DataFrame:
    """at and base: the baseline of a stacked graph that keeps slopes least.

    The weighted slopes are summed by place first, so the ordered running sum sees one row a place.
    """
    by = Window.partitionBy(series).orderBy(at)
    step = rows.withColumn("was", F.lag(value).over(by))
    up = Window.partitionBy(at).orderBy(series)
    delta = F.col(value) - F.coalesce("was", F.col(value))
    below = F.coalesce(F.sum(delta).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = step.withColumn("term", (below + delta / 2) * F.col(value)).groupBy(at).agg(F.sum("term").alias("s2"), F.sum(value).alias("s1"))
    slope = F.when(F.col("s1") != 0, F.col("s2") / F.col("s1")).otherwise(0.0)
    return s.select(at, (-F.sum(slope).over(running(Window.orderBy(at)))).alias("base"))


def inside_out(rows: DataFrame, at: str, series: str, value: str) -> DataFrame:
    """series and position: early peaks in the middle of the stack and later ones outside, each put on the side that is smaller so far.

    Every choice depends on those before it, so the series (one row of sums each) are gone through in one row.
    """
    v = F.coalesce(valid(F.col(value)), F.lit(0.0))
    sums = rows.groupBy(series).agg(F.sum(v).alias("total"), F.min_by(F.col(at), F.struct(-v, F.col(at))).alias("peak"))
    listed = sums.agg(F.array_sort(F.collect_list(F.struct("peak", F.col(series).alias("name"), "total"))).alias("s"))
    start = F.struct(F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.array().cast("array<int>").alias("sides"))

    def put(was: Column, one: Column) -> Column:
        above = was["upper"] < was["lower"]
        grown = lambda side, here: was[side] + F.when(here, one["total"]).otherwise(0.0)
        return F.struct(grown("upper", above).alias("upper"), grown("lower", ~above).alias("lower"), F.concat(was["sides"], F.array(F.when(above, 1).otherwise(-1))).alias("sides"))

    sides = listed.select("s", F.aggregate("s", start, put)["sides"].alias("sides"))
    placed = sides.select(F.posexplode(F.arrays_zip("s.name", "sides")).alias("k", "p")).select(F.col("p")["name"].alias(series), ((F.col("k") + 1) * F.col("p")["sides"]).alias("place"))
    return placed.select(series, F.row_number().over(Window.orderBy("place")).cast("long").alias("position"))
