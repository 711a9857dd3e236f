"""Comparison of a Spark result with DuckDB SQL over the same parquet tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def cell(v) -> str:
    """A value as text: floats to nine digits, timestamps without zone."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return cell(list(v.values()))
    if hasattr(v, "asDict"):
        return cell(list(v.asDict().values()))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def assert_same(df: DataFrame, sql: str, folder: str) -> None:
    """The rows of `df`, in any order, are those of the SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(df.columns)
    got = sorted(",".join(cell(r[c]) for c in columns) for r in df.collect())
    want = sorted(",".join(cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert len(got) == len(want)
    assert got == want
