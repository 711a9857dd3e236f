"""Treemaps and nested partitions against plain versions and their own rules."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from larkspur.operators import layout


def tree(rng: random.Random, n: int) -> list[tuple[str, str | None, float | None]]:
    rows = [("0", None, 3.0)]
    for i in range(1, n):
        rows.append((str(i), str(rng.choice([0, rng.randrange(i), max(0, i - 1)])), rng.choice([0.0, None, float("nan"), 1.0, 1.0, rng.expovariate(0.01)])))
    return rows


def sums(rows) -> dict[str, float]:
    total = {i: 0.0 if v is None or math.isnan(v) else v for i, _, v in rows}
    for i, p, _ in reversed(rows):
        if p is not None:
            total[p] += total[i]
    return total


def plain_squares(values: list[float], box, whole: float) -> list[tuple[float, ...]]:
    """Every row is begun, and tried with one value more, from all its values."""

    def tiles(row, box, left):
        x0, y0, x1, y1 = box
        s = sum(row)
        if x1 - x0 < y1 - y0:
            cuts = [x0 + (x1 - x0) * sum(row[:k]) / s for k in range(len(row) + 1)]
            return [(a, y0, b, y0 + (y1 - y0) * s / left) for a, b in zip(cuts, cuts[1:])], (x0, y0 + (y1 - y0) * s / left, x1, y1)
        cuts = [y0 + (y1 - y0) * sum(row[:k]) / s for k in range(len(row) + 1)]
        return [(x0, a, x0 + (x1 - x0) * s / left, b) for a, b in zip(cuts, cuts[1:])], (x0 + (x1 - x0) * s / left, y0, x1, y1)

    def worst(row, box, left):
        # The side across the row over the side along it.
        flat = box[2] - box[0] < box[3] - box[1]
        shapes = [((d - b) / (c - a) if flat else (c - a) / (d - b)) / layout.GOLDEN for a, b, c, d in tiles(row, box, left)[0]]
        return max(max(s, 1 / s) for s in shapes)

    out, row = [], []
    for v in values:
        if row and worst([*row, v], box, whole) > worst(row, box, whole):
            done, box_next = tiles(row, box, whole)
            out, whole, box, row = out + done, whole - sum(row), box_next, []
        row = [*row, v]
    return out + tiles(row, box, whole)[0] if row else out


def placed(spark, rows, *more, **named):
    df = spark.createDataFrame(rows, "id string, parent string, v double").repartition(5)
    return {r.id: r for r in layout.rectangles(df, "v", *more, **named).collect()}


def test_squarified_equals_a_plain_version_at_every_parent(spark):
    rows = tree(random.Random(5), 400)
    got, total = placed(spark, rows, 300, 200), sums(rows)
    assert {i: r.total for i, r in got.items()} == pytest.approx(total)
    children = defaultdict(list)
    for i, p, _ in rows:
        children[p].append(i)
    for p, ids in children.items():
        shown = sorted((i for i in ids if total[i] > 0), key=lambda i: (-got[i].total, i))
        if p is None or not shown:
            continue
        box = got[p]
        want = plain_squares([got[i].total for i in shown], (box.x0, box.y0, box.x1, box.y1), box.total)
        for i, w in zip(shown, want, strict=True):
            assert (got[i].x0, got[i].y0, got[i].x1, got[i].y1) == pytest.approx(w, abs=1e-7)


@pytest.mark.parametrize("tile", layout.TILES)
def test_areas_are_shares_within_parents_and_apart(spark, tile):
    rows = tree(random.Random(8), 200)
    got, total = placed(spark, rows, 300, 200, tile=tile), sums(rows)
    assert len(got) == len(rows)
    area = lambda r: (r.x1 - r.x0) * (r.y1 - r.y0)
    for i, p, _ in rows:
        r = got[i]
        assert area(r) == pytest.approx(60000 * total[i] / total["0"], abs=1e-6)
        if p is not None:
            a = got[p]
            assert a.x0 - 1e-7 <= r.x0 <= r.x1 <= a.x1 + 1e-7 and a.y0 - 1e-7 <= r.y0 <= r.y1 <= a.y1 + 1e-7
    for i, p, _ in rows:
        for j, q, _ in rows:
            if i < j and p == q:
                a, b = got[i], got[j]
                both = max(0, min(a.x1, b.x1) - max(a.x0, b.x0)) * max(0, min(a.y1, b.y1) - max(a.y0, b.y0))
                assert both < 1e-6


def test_many_children_of_one_parent_pass_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = placed(spark, [("r", None, 0.0)] + [(f"{k:04}", "r", 1.0 + k % 3) for k in range(1000)] + [("z", "r", 0.0)], 100, 100)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = plain_squares([3.0] * 333 + [2.0] * 333 + [1.0] * 334, (0, 0, 100, 100), 1999.0)
    order = sorted((i for i in got if i not in "rz"), key=lambda i: (-got[i].total, i))
    for i, w in zip(order, want, strict=True):
        assert (got[i].x0, got[i].y0, got[i].x1, got[i].y1) == pytest.approx(w, abs=1e-7)
    assert got["z"].x0 == got["z"].x1


def test_partition_bands_and_edges(spark):
    rows = [("r", None, 2.0), ("a", "r", 1.0), ("b", "r", None), ("c", "b", 5.0), ("lost", "gone", 9.0)]
    df = spark.createDataFrame(rows, "id string, parent string, v double")
    got = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in layout.partition(df, "v", 80, 30).collect()}
    assert got == {"r": (0, 0, 80, 10), "b": (0, 10, 50, 20), "a": (50, 10, 60, 20), "c": (0, 20, 50, 30)}
    assert layout.rectangles(df.where("false"), "v", 1, 1).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (2, 1, None), (3, 1, -4.0)], "id int, parent int, v double")
    assert {r.id: r.x1 - r.x0 for r in layout.rectangles(nothing, "v", 1, 1).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    with pytest.raises(ValueError, match="tile"):
        layout.rectangles(df, "v", 1, 1, "round")
