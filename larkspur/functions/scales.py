"""Scales: column functions from a domain to a range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.stats import numbered
from larkspur.session import checkpointed


def linear(x: Column, domain: tuple, range_: tuple = (0.0, 1.0), clamp: bool = False) -> Column:
    """Linear map of a domain (numbers or columns) to a range; the middle of the range where the domain is one point."""
    a, b = (v if isinstance(v, Column) else F.lit(float(v)) for v in domain)
    t = F.when(b - a != 0, (x - a) / (b - a)).otherwise(0.5)
    if clamp:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.lit(float(range_[0])) + t * float(range_[1] - range_[0])


def _mapped(f, x: Column, domain: tuple, range_: tuple) -> Column:
    a, b = (v if isinstance(v, Column) else F.lit(float(v)) for v in domain)
    return linear(f(x), (f(a), f(b)), range_)


def log(x: Column, domain: tuple, range_: tuple = (0.0, 1.0)) -> Column:
    """Logarithmic scale; a negative domain is mirrored."""
    return _mapped(lambda v: F.when(v < 0, -F.log(-v)).otherwise(F.log(v)), x, domain, range_)


def power(x: Column, domain: tuple, exponent: float, range_: tuple = (0.0, 1.0)) -> Column:
    """Signed power scale (exponent 0.5: square root)."""
    return _mapped(lambda v: F.signum(v) * F.pow(F.abs(v), F.lit(exponent)), x, domain, range_)


def symlog(x: Column, domain: tuple, constant: float = 1.0, range_: tuple = (0.0, 1.0)) -> Column:
    return _mapped(lambda v: F.signum(v) * F.log1p(F.abs(v / constant)), x, domain, range_)


#: Ways to bend a domain: each maps a column to one on which the scale is linear.
BENDS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda v: v,
    "log": lambda v: F.when(v < 0, -F.log(-v)).otherwise(F.log(v)),
    "sqrt": lambda v: F.signum(v) * F.sqrt(F.abs(v)),
    "square": lambda v: F.signum(v) * v * v,
    "symlog": lambda v: F.signum(v) * F.log1p(F.abs(v)),
}


def through(x: Column, domain: list[float], range_: list[float], bend: str = "linear", clamp: bool = False) -> Column:
    """A scale through several points: between two of them, and beyond the outer ones, on the line of the nearest two. The domain ascends or descends; what one of both lists has more is left out."""
    stops, outs = [float(v) for v in domain[: len(range_)]], [float(v) for v in range_[: len(domain)]]
    if len(stops) < 2:
        raise ValueError("a scale needs two points at least")
    if stops[0] > stops[-1]:
        stops, outs = stops[::-1], outs[::-1]
    f = BENDS[bend]
    y = F.greatest(F.lit(stops[0]), F.least(F.lit(stops[-1]), x)) if clamp else x
    piece = lambda i: linear(f(y), (f(F.lit(stops[i])), f(F.lit(stops[i + 1]))), (outs[i], outs[i + 1]))
    out = piece(len(stops) - 2)
    for i in range(len(stops) - 3, -1, -1):
        out = F.when(x < stops[i + 1], piece(i)).otherwise(out)
    return F.when(x.isNotNull() & ~F.isnan(x), out)


def sequential(x: Column, domain: tuple, bend: str = "linear", clamp: bool = False) -> Column:
    """Place between 0 and 1 of a value within a domain (ascending or descending), bent; 0.5 where the domain is one point."""
    f = BENDS[bend]
    a, b = (v if isinstance(v, Column) else F.lit(float(v)) for v in domain)
    return linear(f(x.cast("double")), (f(a), f(b)), clamp=clamp)


def diverging(x: Column, low: float, middle: float, high: float, bend: str = "linear", clamp: bool = False) -> Column:
    """0 at low, 0.5 at the middle, 1 at high, on both sides linear on the bent domain, which ascends or descends; a side of no extent is at 0.5."""
    f, up = BENDS[bend], -1 if _descends(low, middle, high) else 1
    side = lambda a, b: F.when(f(F.lit(float(b))) != f(F.lit(float(a))), (f(x) - f(F.lit(float(middle)))) / (f(F.lit(float(b))) - f(F.lit(float(a)))) * 0.5).otherwise(0.0)
    t = 0.5 + F.when(up * x < up * middle, side(low, middle)).otherwise(side(middle, high))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) if clamp else t


def _descends(low: float, middle: float, high: float) -> bool:
    """Whether a domain of three points goes down."""
    return (middle < low) if middle != low else high < middle


def by_rank(rows: DataFrame, x: str, out: str = "t") -> DataFrame:
    """`rows` with `out`: the share of the other valid values that lie at or below that of the row, from 0 to 1; null for null and NaN, NaN where there is one value. Ranks are counted by ranges, in no single task."""
    values = rows.select(F.col(x).alias("__v")).where(F.col(x).isNotNull() & ~F.isnan(x))
    ranked = checkpointed(numbered(values, "__v").groupBy("__v").agg(F.max("position").alias("__last")))
    n = F.broadcast(values.agg(F.count("*").alias("__n")))
    share = F.when(F.col("__n") > 1, (F.col("__last") - 1) / (F.col("__n") - 1)).otherwise(float("nan"))
    return rows.join(ranked, rows[x] == ranked["__v"], "left").crossJoin(n).withColumn(out, F.when(F.col("__last").isNotNull(), share)).drop("__v", "__last", "__n")


def threshold(x: Column, cuts: list) -> Column:
    """Number of cuts at or below x."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(x >= c, 1).otherwise(0)
    return F.when(x.isNotNull() & ~F.isnan(x), out)


def quantize(x: Column, domain: tuple, n: int) -> Column:
    """Index of one of n equal parts of the domain, clamped to the first and last."""
    a, b = (v if isinstance(v, Column) else F.lit(float(v)) for v in domain)
    return F.least(F.greatest(F.floor((x - a) / (b - a) * n), F.lit(0)), F.lit(n - 1)).cast("int")


def band(index: Column, n: Column, range_: tuple = (0.0, 1.0), padding: float = 0.0) -> Column:
    """Start of the band of a category by its 0-based index among n, bands being parted by `padding` of a step."""
    a, b = map(float, range_)
    step = F.lit(b - a) / F.greatest(F.lit(1.0), n + padding)
    return a + (b - a - step * (n - padding)) / 2 + step * index


def invert(t: Column, domain: tuple) -> Column:
    """Value of the domain at a place between 0 and 1."""
    a, b = (v if isinstance(v, Column) else F.lit(float(v)) for v in domain)
    return a + t * (b - a)


def radial(x: Column, domain: tuple, range_: tuple = (0.0, 1.0)) -> Column:
    """Linear in the squares of the range, so that areas are."""
    y = linear(x, domain, tuple((1 if r >= 0 else -1) * r * r for r in range_))
    return F.signum(y) * F.sqrt(F.abs(y))


def point(index: Column, n: Column, range_: tuple = (0.0, 1.0), padding: float = 0.0) -> Column:
    """Place of a category by its 0-based index among n, the outer ones `padding` steps from the ends."""
    a, b = map(float, range_)
    step = F.lit(b - a) / F.greatest(F.lit(1.0), n - 1 + 2 * padding)
    return a + (b - a - step * (n - 1)) / 2 + step * index
