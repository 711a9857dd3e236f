"""Array functions: places in sorted arrays, orders, and arrays of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bisect_left(xs: Column, x: Column) -> Column:
    """First place in a sorted array at which x could stand: the number of values below it."""
    return F.size(F.filter(xs, lambda v: v < x))


def bisect_right(xs: Column, x: Column) -> Column:
    """Last such place: the number of values not above it."""
    return F.size(F.filter(xs, lambda v: v <= x))


def bisect_center(xs: Column, x: Column) -> Column:
    """Place of the value nearest to x, the later one of two as near."""
    right = F.least(bisect_left(xs, x), F.size(xs) - 1)
    left = F.greatest(right - 1, F.lit(0))
    return F.when(x - F.get(xs, left) < F.get(xs, right) - x, left).otherwise(right)


def permute(xs: Column, places: Column) -> Column:
    """The values at the given places (from 0), null beyond the array."""
    return F.transform(places, lambda i: F.get(xs, i))


def transpose(rows: Column) -> Column:
    """Columns of an array of arrays, as many as the shortest row has places."""
    width = F.array_min(F.transform(rows, F.size))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))).otherwise(F.array().cast("array<array<double>>"))


def merge(rows: Column) -> Column:
    """The values of all arrays, end to end."""
    return F.flatten(rows)


def shuffled(xs: Column, seed: int) -> Column:
    """The values in an order that depends on the values, their places and the seed only."""
    keyed = F.transform(xs, lambda x, i: F.struct(F.xxhash64(x, i, F.lit(seed)).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda p: p["x"])


def piecewise(t: Column, points: list[float]) -> Column:
    """Linear interpolation between points at equal distances over 0 to 1; t outside goes on with the first or last piece."""
    n = len(points) - 1
    i = F.least(F.greatest(F.floor(t * n), F.lit(0)), F.lit(n - 1)).cast("int")
    held = F.array(*map(F.lit, map(float, points)))
    a, b = F.get(held, i), F.get(held, i + 1)
    return a * (1 - (t * n - i)) + b * (t * n - i)


def mix_colors(t: Column, a: str, b: str) -> Column:
    """Colour between two of the form #rrggbb, each channel rounded."""
    channel = lambda k: F.lpad(F.lower(F.hex(F.floor(int(a[k : k + 2], 16) * (1 - t) + int(b[k : k + 2], 16) * t + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), *(channel(k) for k in (1, 3, 5)))
