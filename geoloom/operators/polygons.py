"""Rings as arrays of points: measures by higher-order functions, clipping and hulls by Arrow kernels, areas by cell masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.codecs import POINT

RING = T.ArrayType(POINT)


def _sides(ring: Column, of) -> Column:
    """Sum over the sides of an open ring of of(point, next point)."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.when(F.size(ring) > 0, F.aggregate(F.zip_with(ring, following, of), F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)


def signed_area(ring: Column) -> Column:
    """Positive counter-clockwise; 0 for fewer than three points."""
    return _sides(ring, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]) / 2)


def perimeter(ring: Column) -> Column:
    return _sides(ring, lambda p, q: F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) is inside by the even-odd rule: sides that cross its horizontal to the right are odd in number."""
    crosses = lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1.0).otherwise(0.0)
    return _sides(ring, crosses) % 2 == 1


def strip_width(ring: Column) -> Column:
    """Twice the area over the perimeter: about the width of a long thin ring."""
    return F.when(perimeter(ring) > 0, 2 * F.abs(signed_area(ring)) / perimeter(ring)).otherwise(0.0)


def clipped_points(points: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Sutherland and Hodgman's clip of an open ring to a box."""
    x0, y0, x1, y1 = box
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(points):
            break
        before = np.roll(points, 1, axis=0)
        here, there = sign * (points[:, axis] - limit), sign * (before[:, axis] - limit)
        out = []
        for p, q, a, b in zip(points, before, here, there, strict=True):
            if (a >= 0) != (b >= 0):
                out.append(q + (p - q) * (b / (b - a)))
            if a >= 0:
                out.append(p)
        points = np.array(out).reshape(-1, 2)
    return points


def hull_points(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the lowest x, without points along its sides."""
    points = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(points) < 3:
        return points

    def chain(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ordered:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def rectangle_points(points: np.ndarray) -> np.ndarray:
    """The corners of the rectangle of least area around points, one side along a side of their hull."""
    hull = hull_points(points)
    if len(hull) < 3:
        return hull
    sides = np.roll(hull, -1, axis=0) - hull
    best = None
    for u in sides / np.linalg.norm(sides, axis=1, keepdims=True):
        v = np.array([-u[1], u[0]])
        a, b = hull @ u, hull @ v
        area = (a.max() - a.min()) * (b.max() - b.min())
        if best is None or area < best[0] - 1e-12:
            best = (area, [s * u + t * v for s, t in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()))])
    return np.array(best[1])


def _kernel(of):
    def run(rings: pd.Series) -> pd.Series:
        def one(ring):
            if ring is None:
                return None
            return [{"x": float(x), "y": float(y)} for x, y in of(np.array([(p["x"], p["y"]) for p in ring]).reshape(-1, 2))]

        return rings.map(one)

    return F.pandas_udf(run, RING)


def clip_to_box(ring: Column, box: tuple[float, float, float, float]) -> Column:
    return _kernel(lambda p: clipped_points(p, box))(ring)


def convex_hull(ring: Column) -> Column:
    return _kernel(hull_points)(ring)


def least_rectangle(ring: Column) -> Column:
    return _kernel(rectangle_points)(ring)


def to_mask(polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """(id, row, col) of the cells whose centres each polygon (id, ring) holds, from the crossings of each row with its sides.

    Unions, intersections and differences of polygons are then distinct, semi and anti joins of their cells."""
    following = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    sides = polygons.select("id", F.explode(F.arrays_zip(F.col("ring").alias("p"), following.alias("q"))).alias("s")).select("id", *(F.col(f"s.{e}.{c}").alias(f"{e}{c}") for e in "pq" for c in "xy"))
    low, high = F.ceil(F.least("py", "qy") / size - 0.5), F.ceil(F.greatest("py", "qy") / size - 0.5) - 1
    crossed = sides.where(high >= low).withColumn("row", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    at = F.col("px") + (F.col("qx") - F.col("px")) * ((F.col("row") + 0.5) * size - F.col("py")) / (F.col("qy") - F.col("py"))
    runs = crossed.select("id", "row", at.alias("x")).groupBy("id", "row").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pairs = F.expr("transform(sequence(0, size(x) div 2 - 1), k -> struct(x[2 * k] as a, x[2 * k + 1] as b))")
    spans = runs.where(F.size("x") >= 2).select("id", "row", F.explode(pairs).alias("r"))
    first, last = F.ceil(F.col("r.a") / size - 0.5).cast("bigint"), (F.ceil(F.col("r.b") / size - 0.5) - 1).cast("bigint")
    return spans.where(last >= first).select("id", "row", F.explode(F.sequence(first, last)).alias("col")).distinct()


def row_crossings(rings: DataFrame, y0: float, step: float) -> DataFrame:
    """(id, row, x) where the edges of rings (id, ring) cross the lines y = y0 + row * step. An edge holds its lower end and not
    its upper one, so a vertex on a line counts once for each side that goes on; level edges cross nothing."""
    edge = lambda p, i: F.struct(p.alias("a"), F.get(F.col("ring"), (i + 1) % F.size("ring")).alias("b"))
    edges = rings.select("id", F.explode(F.transform("ring", edge)).alias("e")).select("id", "e.a", "e.b")
    low, high = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    first, last = F.ceil((low - y0) / step) - 1, F.ceil((high - y0) / step)  # one of slack: the test below decides
    y = F.col("row") * F.lit(step) + y0
    met = edges.where(low < high).withColumn("row", F.explode(F.sequence(first, last))).where((y >= low) & (y < high))
    return met.select("id", "row", (F.col("a.x") + (y - F.col("a.y")) / (F.col("b.y") - F.col("a.y")) * (F.col("b.x") - F.col("a.x"))).alias("x"))


def tidy_ring(ring: Column, tolerance: float = 1e-9) -> Column:
    """A ring without vertices that lie within tolerance, on both axes, of the one kept before, nor any at its end by its first."""
    by = lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)
    none = F.slice(ring, 1, 0)
    kept = F.aggregate(ring, none, lambda out, p: F.when(F.coalesce(by(F.try_element_at(out, F.lit(-1)), p), F.lit(False)), out).otherwise(F.concat(out, F.array(p))))
    away = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))), F.lit(1), lambda n, i: F.when(~F.coalesce(by(F.try_element_at(kept, i), kept[0]), F.lit(True)), i).otherwise(n))
    return F.slice(kept, 1, away)
