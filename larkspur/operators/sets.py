"""Set operators over the distinct values of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, *others: DataFrame) -> DataFrame:
    for b in others:
        a = a.subtract(b)
    return a.distinct()


def relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: subset, superset and disjoint, by one full outer join of the distinct values."""
    k = a.columns[0]
    left, right = a.select(F.col(k).alias("k"), F.lit(True).alias("in_a")).distinct(), b.select(F.col(b.columns[0]).alias("k"), F.lit(True).alias("in_b")).distinct()
    both = left.join(right, "k", "full_outer")
    none: Column = F.lit(True)
    return both.agg(
        F.coalesce(F.bool_and(F.col("in_b").isNotNull() | F.col("in_a").isNull()), none).alias("subset"),
        F.coalesce(F.bool_and(F.col("in_a").isNotNull() | F.col("in_b").isNull()), none).alias("superset"),
        F.coalesce(F.bool_and(F.col("in_a").isNull() | F.col("in_b").isNull()), none).alias("disjoint"),
    )
