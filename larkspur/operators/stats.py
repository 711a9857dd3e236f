"""Statistics over columns. Null and NaN are passed over throughout; ties by order of appearance need an explicit order column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, isinf, isnan, log2, log10, sqrt
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from larkspur.functions.formatting import valid
from larkspur.session import checkpointed


def summary(x: Column) -> list[Column]:
    """count, sum (0 if empty), mean, min, max, variance and deviation (of a sample) of the valid numbers."""
    v = valid(x)
    return [
        F.count(v).alias("count"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("deviation"),
    ]


def quantile(x: Column, p: float) -> Column:
    """Linear interpolation between order statistics; the least value for p of 0 or less, the largest from 1."""
    return F.percentile(valid(x), F.lit(min(1.0, max(0.0, p))))


def quantile_index(rows: DataFrame, keys: list[str], x: str, order: str, p: float) -> DataFrame:
    """The row of each group at sorted position floor((n - 1) * p), null and NaN last, ties by `order`. Groups are sorted by ranges."""
    placed = numbered_within(rows.withColumn("__v", valid(F.col(x))), keys, F.col("__v").asc_nulls_last(), order)
    counts = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count(valid(F.col(x))).alias("__n"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.lit(True))
    return placed.join(counts, same).where(F.col("position") == F.floor((F.col("__n") - 1) * p) + 1).select(*rows.columns)


def ranked(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """`rows` with rank: 0-based within each group, ties sharing the least; null for null and NaN. Groups are sorted by ranges."""
    own = rows.withColumn("__v", valid(F.col(x)))
    first = numbered_within(own.where("__v is not null").select(*keys, "__v"), keys, "__v").groupBy(*keys, "__v").agg((F.min("position") - 1).alias("rank"))
    first = first.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__v").alias("__w"), "rank")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("__v") == F.col("__w"))
    return own.join(first, same, "left").select(*rows.columns, "rank")


@F.pandas_udf(DoubleType())
def _total(powers: pd.Series, parts: pd.Series) -> pd.Series:
    """Of each row, the sum of parts[i] * 2**powers[i] in integers, rounded once."""

    def one(ks, ms) -> float:
        least = min(ks, default=0)
        whole = sum(int(m) << int(k - least) for k, m in zip(ks, ms, strict=True))
        try:
            return float(whole << int(least)) if least >= 0 else whole / (1 << int(-least))
        except OverflowError:
            return float("inf") if whole > 0 else float("-inf")

    return pd.Series([one(k, m) for k, m in zip(powers, parts, strict=True)], dtype="float64")


def exact_sum(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, total: the sum of the valid numbers as if added without any rounding and then rounded once, in any order of rows.

    A double is an integer of 53 bits times a power of two. The integers are summed by power, exactly and before the
    shuffle, so that what is left of a group is one row for each of its powers (some two thousand at most).
    """
    v = valid(F.col(x).cast("double"))
    finite = F.when(F.abs(v) < float("inf"), v)
    power = F.coalesce(F.floor(F.log2(F.abs(F.nullif(finite, F.lit(0.0))))).cast("int") - 53, F.lit(0))
    # In two steps, so that no factor is beyond the range of doubles.
    half = F.floor(power / 2).cast("int")
    whole = F.coalesce(finite * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power), F.lit(0.0)).cast("long")
    sums = rows.select(*keys, power.alias("__k"), whole.cast("decimal(20,0)").alias("__m"), F.when(~(F.abs(v) < float("inf")), v).alias("__beyond"))
    sums = sums.groupBy(*keys, "__k").agg(F.sum("__m").cast("string").alias("__m"), F.sum("__beyond").alias("__beyond"))
    sums = sums.groupBy(*keys).agg(F.collect_list("__k").alias("__ks"), F.collect_list("__m").alias("__ms"), F.sum("__beyond").alias("__beyond"))
    return sums.select(*keys, F.coalesce("__beyond", _total("__ks", "__ms")).alias("total"))


def exact_running(rows: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """`rows` with running: of each group, in order, the sum so far as if added without any rounding and then rounded once.

    Null and NaN count 0; from an infinite value on the sum is infinite, or NaN after both infinities. The rows are sorted
    by ranges of keys and order, so that no task holds a group. A range passes on one number, the exact sum of its last group.
    """
    one = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256) if keys else F.lit("")
    ranges = checkpointed(rows.orderBy(*keys, *order)).withColumn("__part", F.spark_partition_id()).withColumn("__group", one).withColumn("__x", F.col(x).cast("double"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, total, beyond = None, None, None, 0, 0.0
        for b in batches:
            for p, g, v in zip(*(b.column(n).to_pylist() for n in ("__part", "__group", "__x")), strict=True):
                if part is None:
                    part, first = p, g
                if g != last:
                    last, total, beyond = g, 0, 0.0
                total, beyond = _added(total, beyond, v)
        if part is not None:
            row = {"part": part, "head": first, "tail": last, "total": hex(total), "beyond": beyond}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("head", pa.string()), ("tail", pa.string()), ("total", pa.string()), ("beyond", pa.float64())]))

    ends = ranges.select("__part", "__group", "__x").mapInArrow(sums, "part int, head string, tail string, total string, beyond double")
    carried, group, total, beyond = {}, None, 0, 0.0
    # One row for each range.
    for r in sorted(ends.collect()):
        carried[r.part] = (group, total, beyond)
        more = r.head == r.tail == group
        group, total, beyond = r.tail, int(r.total, 16) + (total if more else 0), r.beyond + (beyond if more else 0.0)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, total, beyond = False, None, 0, 0.0
        for b in batches:
            out = []
            for p, g, v in zip(*(b.column(n).to_pylist() for n in ("__part", "__group", "__x")), strict=True):
                if not begun:
                    begun, (last, total, beyond) = True, carried[p]
                if g != last:
                    last, total, beyond = g, 0, 0.0
                total, beyond = _added(total, beyond, v)
                out.append(_rounded(total) if beyond == 0 else beyond)
            own = b.num_columns - 3
            yield pa.RecordBatch.from_arrays([*b.columns[:own], pa.array(out, pa.float64())], [*b.schema.names[:own], "running"])

    return ranges.mapInArrow(running, StructType([*rows.schema.fields, StructField("running", DoubleType())]))


def _added(total: int, beyond: float, v: float) -> tuple[int, float]:
    """A sum in units of 2**-1074, the least double, and what infinite values make, after one value more."""
    if v is None or isnan(v):
        return total, beyond
    if isinf(v):
        return total, beyond + v
    m, e = v.as_integer_ratio()
    return total + m * ((1 << 1074) // e), beyond


def _rounded(total: int) -> float:
    try:
        return total / (1 << 1074)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")

def mode(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, mode and n: the most frequent value of each group, the one that came first by `order` on ties."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.min_by(F.struct(F.col(value).alias("mode"), "n"), F.struct(-F.col("n"), "first"))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.mode", "b.n")


def extreme(rows: DataFrame, keys: list[str], x: str, order: str, least: bool = True) -> DataFrame:
    """The row of each group with the least (or greatest) valid `x`, the first by `order` on ties."""
    v = F.col(x) if least else -F.col(x)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(v, order))
    return rows.where(F.col(x).isNotNull() & ~F.isnan(x)).withColumn("__place", place).where("__place = 1").drop("__place")


def group_sort(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """key, value, position: the groups in order of an aggregate, ties by key."""
    return numbered(rows.groupBy(key).agg(value.alias("value")), "value", key)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with position, from 1 in the given order: the rows are sorted by ranges, and each range counts on from those before it."""
    by_range = checkpointed(rows.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    starts = by_range.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    out = by_range.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn("position", F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1).drop("__part", "__before", "__at")


def numbered_within(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """`rows` with position, from 1 within each group (a null key is one) in the given order.

    The rows are sorted by ranges of keys and order, so that no task holds a group; each stretch of a group counts on from
    its stretches in the ranges before. There is one such stretch more than groups for each border of ranges at most.
    """
    by_range = checkpointed(rows.orderBy(*keys, *order)).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    stretches = by_range.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = stretches.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__in"), (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("__part") == F.col("__in"))
    return by_range.join(starts, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("position"))


def unique_index(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows`, once it is known that no key repeats; otherwise the job fails with "duplicate key"."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("duplicate key")).cast("boolean")).otherwise(True)).drop("__n")


def bin_counts(n: str, lo: str, hi: str, iqr: str, deviation: str) -> list[Column]:
    """Numbers of bins after Sturges, Freedman and Diaconis, and Scott, from aggregates."""
    c = F.col
    sturges = F.greatest(F.lit(1.0), F.ceil(F.log(c(n)) / F.log(F.lit(2.0))) + 1)
    fd = F.when((c(n) > 0) & (c(iqr) > 0), F.ceil((c(hi) - c(lo)) / (2 * c(iqr) * F.pow(c(n), F.lit(-1 / 3))))).otherwise(1)
    scott = F.when((c(n) > 0) & (c(deviation) > 0), F.ceil((c(hi) - c(lo)) * F.cbrt(c(n)) / (3.49 * c(deviation)))).otherwise(1)
    return [sturges.cast("long").alias("sturges"), fd.cast("long").alias("freedman_diaconis"), scott.cast("long").alias("scott")]


@dataclass
class Ticks:
    """Round numbers about `count` of which span an extent: multiples of `scale` where `by` is 1, and of 1 / scale where it is -1.

    So a step of a tenth is held as 10, and its multiples are the doubles nearest to them. Null for an empty extent.
    """

    scale: Column
    by: Column

    def at(self, k: Column) -> Column:
        return F.when(self.by == 1, k * self.scale).otherwise(k / self.scale)

    def below(self, x: Column) -> Column:
        return F.floor(F.when(self.by == 1, x / self.scale).otherwise(x * self.scale)).cast("long")

    def above(self, x: Column) -> Column:
        return F.ceil(F.when(self.by == 1, x / self.scale).otherwise(x * self.scale)).cast("long")


def ticks(lo: Column, hi: Column, count: Column) -> Ticks:
    """Steps of 1, 2 or 5 times a power of ten, of which the one nearest in ratio to (hi - lo) / count is taken."""
    ratio = F.when(hi > lo, (hi - lo) / count)
    magnitude = F.floor(F.log10(ratio))
    lead = ratio / F.pow(F.lit(10.0), magnitude)
    digit = F.when(lead >= sqrt(50), 10.0).when(lead >= sqrt(10), 5.0).when(lead >= sqrt(2), 2.0).otherwise(1.0)
    small = magnitude < 0
    return Ticks(F.when(small, F.pow(F.lit(10.0), -magnitude) / digit).otherwise(digit * F.pow(F.lit(10.0), magnitude)), F.when(small, -1).otherwise(1))


def tick_step(lo: Column, hi: Column, count: Column) -> Column:
    """Step of about `count` round ticks."""
    t = ticks(lo, hi, count)
    return t.at(F.lit(1.0))


def tick_scale(lo: float, hi: float, count: int) -> tuple[float, bool]:
    """ticks() of two numbers: the scale, and whether multiples of its inverse are meant."""
    ratio = (hi - lo) / count
    magnitude = floor(log10(ratio))
    lead = ratio / 10.0**magnitude
    digit = next((d for d, from_ in ((10.0, 50), (5.0, 10), (2.0, 2)) if lead >= sqrt(from_)), 1.0)
    return (10.0**-magnitude / digit, True) if magnitude < 0 else (digit * 10.0**magnitude, False)


def histogram(rows: DataFrame, x: str, count: int | None = None) -> DataFrame:
    """x0, x1, n of equal round bins over the extent, empty bins kept: left-closed, and one bin more where the largest value is the last edge.

    The extent is widened to round numbers first; bins are about `count`, or as many as Sturges' rule gives. Equal values
    make one bin, and infinite ones lie in none. One row of aggregates sets the edges; each row finds its bin by division, and only counts are shuffled.
    """
    v = rows.select(valid(F.col(x)).alias("v")).where(F.abs("v") < float("inf"))
    lo, hi, n = v.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n or lo == hi:
        return v.groupBy().agg(F.min("v").cast("double").alias("x0"), F.max("v").cast("double").alias("x1"), F.count("*").alias("n")).where("n > 0")
    count = count or max(1, ceil(log2(n)) + 1)
    a, b, before = lo, hi, None
    scale, inverse = tick_scale(a, b, count)
    for _ in range(10):
        # The step of the widened extent may be a larger one.
        if (scale, inverse) == before:
            break
        a, b = (floor(a * scale) / scale, ceil(b * scale) / scale) if inverse else (floor(a / scale) * scale, ceil(b / scale) * scale)
        before, (scale, inverse) = (scale, inverse), tick_scale(a, b, count)
    t = Ticks(F.lit(float(scale)), F.lit(-1 if inverse else 1))

    def place(x: Column) -> Column:
        """The bin of a value; division may fall one short of it."""
        return F.when(t.at(t.below(x) + 1) <= x, t.below(x) + 1).otherwise(t.below(x))

    counts = v.groupBy(place(F.col("v")).alias("k")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("k").alias("first"), F.max("k").alias("last"))
    edges = ends.select(F.explode(F.sequence("first", "last")).alias("k"))
    return edges.join(counts, "k", "left").select(t.at(F.col("k")).alias("x0"), t.at(F.col("k") + 1).alias("x1"), F.coalesce("n", F.lit(0)).alias("n"))


def grouped_quantiles(rows: DataFrame, keys: list[str], x: str, ps: dict[str, float], cells: int = 4096) -> DataFrame:
    """keys and a column for each of `ps` (name: p): linear interpolation between order statistics, null and NaN passed over.

    The extent of each group is cut into equal cells and counted; only values of the cells in which a wanted order
    statistic lies are looked at again, as counts of distinct values. So no task holds a group.
    """
    v = rows.select(*keys, valid(F.col(x).cast("double")).alias("v")).where("v is not null")
    ends = v.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))).otherwise(0).cast("long")
    placed = v.join(ends, keys).select(*keys, "v", cell.alias("cell"))
    before = lambda by: F.coalesce(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy(*keys, "cell").agg(F.count("*").alias("c")).withColumn("before", before(Window.partitionBy(*keys).orderBy("cell")))
    at = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * min(1.0, max(0.0, p))).alias("h")) for name, p in ps.items()))
    asked = ends.select(*keys, F.explode(at).alias("a")).select(*keys, "a.name", "a.h", F.explode(F.array(F.floor("a.h"), F.ceil("a.h"))).alias("place"))
    found = asked.join(counts, keys).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("c")))
    found = checkpointed(found.select(*keys, "name", "h", "place", "cell", "before"))
    values = placed.join(found.select(*keys, "cell").distinct(), [*keys, "cell"], "left_semi").groupBy(*keys, "cell", "v").agg(F.count("*").alias("c"))
    values = values.withColumn("within", before(Window.partitionBy(*keys, "cell").orderBy("v")))
    hit = found.join(values, [*keys, "cell"]).where((F.col("before") + F.col("within") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("within") + F.col("c")))
    # Of both places the values; they are one where h is whole.
    share = F.col("h") - F.floor("h")
    between = F.min("v") + (F.max("v") - F.min("v")) * F.first(share)
    value = hit.groupBy(*keys, "name").agg(F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(between).alias("q"))
    return value.groupBy(*keys).pivot("name", list(ps)).agg(F.first("q"))


def histogram_at(rows: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """x0, x1, n of the bins between given edges: left-closed, the last closed; what lies outside is left out."""
    v = valid(F.col(x))
    k = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        inside = (v >= edges[i]) & ((v <= edges[i + 1]) if i == len(edges) - 2 else (v < edges[i + 1]))
        k = F.when(inside, i).otherwise(k)
    counts = rows.select(k.alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    bins = rows.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "k int, x0 double, x1 double")
    return bins.join(counts, "k", "left").select("x0", "x1", F.coalesce("n", F.lit(0)).alias("n"))
