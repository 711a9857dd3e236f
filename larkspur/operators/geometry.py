"""Polygons and nearest sites in the plane."""

from __future__ import annotations

from functools import reduce
from math import pi

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.session import checkpointed


def _edges(points: DataFrame, key: str, order: str) -> DataFrame:
    by = Window.partitionBy(key)
    w = by.orderBy(order)
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = F.coalesce(F.lead(F.struct("x", "y")).over(w), first)
    return points.withColumn("to", after).withColumn("cross", F.col("x") * F.col("to.y") - F.col("to.x") * F.col("y"))


def polygon_measures(points: DataFrame, key: str, order: str) -> DataFrame:
    """key, area (signed), length, cx, cy of polygons given by points (key, order, x, y)."""
    e = _edges(points, key, order)
    area = F.sum("cross") / 2
    step = F.sqrt((F.col("to.x") - F.col("x")) * (F.col("to.x") - F.col("x")) + (F.col("to.y") - F.col("y")) * (F.col("to.y") - F.col("y")))
    cx, cy = (F.sum((F.col(c) + F.col(f"to.{c}")) * F.col("cross")) for c in "xy")
    return e.groupBy(key).agg(area.alias("area"), F.sum(step).alias("length"), (cx / (6 * area)).alias("cx"), (cy / (6 * area)).alias("cy"))


def polygon_contains(points: DataFrame, key: str, order: str, x: float, y: float) -> DataFrame:
    """key, inside: whether a point lies in each polygon, by crossings of a ray."""
    e = _edges(points, key, order)
    straddles = (F.col("y") > y) != (F.col("to.y") > y)
    at = (F.col("to.x") - F.col("x")) * (y - F.col("y")) / (F.col("to.y") - F.col("y")) + F.col("x")
    return e.groupBy(key).agg((F.count_if(straddles & (F.lit(x) < at)) % 2 == 1).alias("inside"))


#: Parts of a group whose hulls are found apart.
PARTS = 64


def hull(points: DataFrame, key: str) -> DataFrame:
    """key, n_hull, area of the convex hull. Hulls of random parts are found first, and their corners alone meet."""
    kind = dict(points.dtypes)[key]

    def ring_of(frame: pd.DataFrame) -> list[tuple[float, float]]:
        pts = sorted(set(zip(frame["x"], frame["y"], strict=True)))

        def half(ps):
            out = []
            for p in ps:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out

        return pts if len(pts) < 3 else half(pts)[:-1] + half(pts[::-1])[:-1]

    def corners(frame: pd.DataFrame) -> pd.DataFrame:
        ring = ring_of(frame)
        return pd.DataFrame({key: [frame[key].iloc[0]] * len(ring), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        ring = ring_of(frame)
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
        return pd.DataFrame({key: [frame[key].iloc[0]], "n_hull": [len(ring)], "area": [area]})

    parts = points.select(key, "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(PARTS)).alias("part")).groupBy(key, "part").applyInPandas(corners, f"{key} {kind}, x double, y double")
    return parts.groupBy(key).applyInPandas(whole, f"{key} {kind}, n_hull long, area double")


def _site_within(points: DataFrame, sites: DataFrame, cell: float, others: bool) -> DataFrame:
    """id, site, distance of the nearest site within one cell: an equi-join on grid cells, each site in its cell and those around it."""
    k = lambda c: F.floor(F.col(c) / cell).cast("long")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-1, 2) for j in range(-1, 2)))
    s = sites.select("site", F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(around).alias("o"), k("x").alias("kx"), k("y").alias("ky"))
    s = s.select("site", "sx", "sy", (F.col("kx") + F.col("o.i")).alias("kx"), (F.col("ky") + F.col("o.j")).alias("ky"))
    d = F.sqrt((F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy")))
    met = points.withColumn("kx", k("x")).withColumn("ky", k("y")).join(s, ["kx", "ky"]).select("id", "site", d.alias("distance")).where(F.col("distance") <= cell)
    met = met.where(F.col("id") != F.col("site")) if others else met
    return met.groupBy("id").agg(F.min_by("site", F.struct("distance", "site")).alias("site"), F.min("distance").alias("distance"))


def nearest_site(points: DataFrame, sites: DataFrame, cell: float, others: bool = False) -> DataFrame:
    """id, site, distance of the nearest site of every point with finite coordinates; with `others`, of those with another id.

    What is found within one cell is the nearest. For points that are still without a site the cells are doubled, until one
    spans all points and sites.
    """
    finite = lambda df: df.where(F.abs("x") < float("inf")).where(F.abs("y") < float("inf"))
    rest, sites = finite(points), finite(sites)
    every = rest.select("x", "y").unionByName(sites.select("x", "y"))
    span = every.agg(F.max("x") - F.min("x") + F.max("y") - F.min("y")).first()[0] or 0.0
    found = []
    while True:
        found.append(checkpointed(_site_within(rest, sites, cell, others)))
        rest = checkpointed(rest.join(found[-1].select("id"), "id", "left_anti"))
        if cell > span or rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        cell *= 2


def sphere_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Angle in radians between two places given by longitude and latitude in degrees; exact for near and for opposite ones."""
    dx, a, b = F.radians(x2 - x1), F.radians(y1), F.radians(y2)
    across = F.sqrt(F.pow(F.cos(b) * F.sin(dx), F.lit(2.0)) + F.pow(F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dx), F.lit(2.0)))
    return F.atan2(across, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(dx))


def grid_counts(points: DataFrame, cell: float) -> DataFrame:
    """i, j, n: points in each square cell of a grid, empty cells left out."""
    k = lambda c: F.floor(F.col(c) / cell).cast("long")
    return points.groupBy(k("x").alias("i"), k("y").alias("j")).agg(F.count("*").alias("n"))


def sphere_area(points: DataFrame, key: str, order: str) -> DataFrame:
    """key, area (steradians) of polygons on the unit sphere given by points (key, order, x and y in degrees).

    Each edge makes a triangle with the south pole, whose signed excess follows from two sides and the angle between
    them. A ring run through the other way round has the rest of the sphere.
    """
    rings = _edges(points, key, order)
    half = lambda y: F.tan(F.radians(y) / 2 + pi / 4)
    turn, both = F.radians(F.col("to.x") - F.col("x")), half(F.col("y")) * half(F.col("to.y"))
    total = F.sum(2 * F.atan2(both * F.sin(turn), 1 + both * F.cos(turn)))
    return rings.groupBy(key).agg(F.when(total < 0, total + 4 * pi).otherwise(total).alias("area"))


def sphere_centroid(points: DataFrame, key: str) -> DataFrame:
    """key, x, y, n: the middle (degrees) of each key's places on the sphere, that of the sum of their unit vectors; null where they cancel out. Places without finite coordinates don't count."""
    at = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select(key, F.radians("x").alias("lon"), F.radians("y").alias("lat"))
    sums = at.groupBy(key).agg(F.sum(F.cos("lat") * F.cos("lon")).alias("u"), F.sum(F.cos("lat") * F.sin("lon")).alias("v"), F.sum(F.sin("lat")).alias("w"), F.count("*").alias("n"))
    known = F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w") > F.col("n") * F.col("n") * 1e-24
    level = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    return sums.select(key, F.when(known, F.degrees(F.atan2("v", "u"))).alias("x"), F.when(known, F.degrees(F.atan2(F.col("w"), level))).alias("y"), "n")


def sphere_bounds(points: DataFrame, key: str) -> DataFrame:
    """key, x0, y0, x1, y1: the box (degrees) round each key's places that is narrowest in longitude; x0 > x1 where it crosses the date line.

    The box leaves out the widest gap between neighbouring longitudes, the one over the date line on ties. Longitudes are
    taken between -180 and 180; each counts once, and Spark sorts those of a key.
    """
    lon = F.pmod(F.col("x") + 180, F.lit(360.0)) - 180
    at = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select(key, lon.alias("lon"), "y")
    lat = at.groupBy(key).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    by = Window.partitionBy(key).orderBy("lon")
    gaps = at.select(key, "lon").distinct().withColumn("after", F.lead("lon").over(by)).where("after IS NOT NULL")
    widest = gaps.groupBy(key).agg(F.max(F.struct((F.col("after") - F.col("lon")).alias("gap"), (-F.col("lon")).alias("first"), "after")).alias("g"))
    out = lat.join(widest.select(F.col(key).alias("its"), "g"), F.col(key).eqNullSafe(F.col("its")), "left")
    crossing = F.coalesce(F.col("g.gap") > F.col("west") + 360 - F.col("east"), F.lit(False))
    return out.select(key, F.when(crossing, F.col("g.after")).otherwise(F.col("west")).alias("x0"), "y0", F.when(crossing, -F.col("g.first")).otherwise(F.col("east")).alias("x1"), "y1")


def sphere_length(points: DataFrame, key: str, order: str, closed: bool = False) -> DataFrame:
    """key, length (radians): of the great arcs from each place (key, order, x and y in degrees) to the next, and from the last back to the first if `closed`. A single place has length 0."""
    step = F.when(F.col("to").isNotNull(), sphere_distance(F.col("x"), F.col("y"), F.col("to.x"), F.col("to.y"))).otherwise(0.0)
    rows = _edges(points, key, order) if closed else points.withColumn("to", F.lead(F.struct("x", "y")).over(Window.partitionBy(key).orderBy(order)))
    return rows.groupBy(key).agg(F.sum(step).alias("length"))


def sphere_between(x1: Column, y1: Column, x2: Column, y2: Column, t: Column) -> tuple[Column, Column]:
    """Longitude and latitude (degrees) of the place that divides the shorter great arc between two places in the ratio t to 1 - t. The first place if they are the same; some arc's if they are opposite."""
    far = sphere_distance(x1, y1, x2, y2)
    a, b = (F.when(far > 0, F.sin(s * far) / F.sin(far)).otherwise(o) for s, o in ((1 - t, 1.0), (t, 0.0)))
    part = lambda f, g: a * F.cos(F.radians(y1)) * f(F.radians(x1)) + b * F.cos(F.radians(y2)) * g(F.radians(x2))
    u, v = part(F.cos, F.cos), part(F.sin, F.sin)
    w = a * F.sin(F.radians(y1)) + b * F.sin(F.radians(y2))
    return F.degrees(F.atan2(v, u)), F.degrees(F.atan2(w, F.sqrt(u * u + v * v)))


def sphere_contains(points: DataFrame, key: str, order: str, x: float, y: float) -> DataFrame:
    """key, inside: whether a place (degrees) lies in each ring (key, order, x and y in degrees) of great arcs; of a ring that crosses itself, what it winds round is inside.

    The inside is that of sphere_area(): a ring run through the other way round has the rest of the sphere. The sphere is
    turned until the place is the south pole; whether that is inside follows from the ring's turns about it and its signed
    area. Every edge is looked at once, and sums before the shuffle.
    """
    lon, lat = F.radians(F.lit(float(x))), F.radians(F.lit(float(y)))
    u, v, w = (F.cos(F.radians("y")) * F.cos(F.radians("x")), F.cos(F.radians("y")) * F.sin(F.radians("x")), F.sin(F.radians("y")))
    away = F.cos(lat) * F.cos(lon) * u + F.cos(lat) * F.sin(lon) * v + F.sin(lat) * w
    round_it = F.atan2(F.sin(lat) * F.cos(lon) * u + F.sin(lat) * F.sin(lon) * v - F.cos(lat) * w, F.cos(lon) * v - F.sin(lon) * u)
    # x: the longitude seen from the place; y: the sine of the latitude, kept within its bounds.
    turned = points.select(key, order, round_it.alias("x"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -away)).alias("y"))
    step, both = F.col("to.x") - F.col("x"), (1 + F.col("y")) * (1 + F.col("to.y"))
    level = F.sqrt(1 - F.col("y") * F.col("y")) * F.sqrt(1 - F.col("to.y") * F.col("to.y"))
    sums = _edges(turned, key, order).groupBy(key).agg(
        F.sum(F.atan2(F.sin(step), F.cos(step))).alias("turns"), F.sum(2 * F.atan2(both * F.sin(step), level + both * F.cos(step))).alias("area")
    )
    return sums.select(key, ((F.abs("turns") > pi) != (F.col("area") < 0)).alias("inside"))
