"""Geometry as Spark expressions: polygons are arrays of parts, parts arrays of closed rings, rings arrays of (x, y).

Everything here stays in the JVM. The first ring of a part is its shell, the others are holes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.transforms import linear_column

GEOM = "array<array<array<struct<x: double, y: double>>>>"
EDGES = "array<struct<x1: double, y1: double, x2: double, y2: double>>"


def affine_geom(geom: Column, m: np.ndarray) -> Column:
    """Each vertex under a homogeneous matrix over (x, y)."""
    point = lambda p: F.struct(linear_column(m[0], [p["x"], p["y"]]).alias("x"), linear_column(m[1], [p["x"], p["y"]]).alias("y"))
    return F.transform(geom, lambda part: F.transform(part, lambda ring: F.transform(ring, point)))


def edges(geom: Column) -> Column:
    """All edges of all rings."""
    rings = F.flatten(geom)
    of_ring = lambda r: F.zip_with(
        F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))),
        F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )
    return F.flatten(F.transform(rings, of_ring))


def _ring_sum(ring: Column, term) -> Column:
    i = F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))
    return F.aggregate(i, F.lit(0.0), lambda acc, k: acc + F.coalesce(term(F.get(ring, k - 1), F.get(ring, k)), F.lit(0.0)))


def _part_sum(geom: Column, term) -> Column:
    """Sum over parts of the shell's absolute sum less the holes'; ``term`` is signed by the ring's turn."""
    turn = lambda r: F.signum(_ring_sum(r, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))
    ring = lambda r, i: _ring_sum(r, term) * turn(r) * F.when(i == 0, 1.0).otherwise(-1.0)
    part = lambda p: F.aggregate(F.transform(p, ring), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(geom, part), F.lit(0.0), lambda s, v: s + v)


def area(geom: Column) -> Column:
    return _part_sum(geom, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def centroid(geom: Column) -> tuple[Column, Column]:
    """The centre weighted by area, over all parts, holes taken out."""
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    x = _part_sum(geom, lambda a, b: (a["x"] + b["x"]) * cross(a, b))
    y = _part_sum(geom, lambda a, b: (a["y"] + b["y"]) * cross(a, b))
    return x / (6 * area(geom)), y / (6 * area(geom))


def bounds(geom: Column) -> dict[str, Column]:
    points = F.flatten(F.flatten(geom))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def on_edge(px: Column, py: Column, e: Column) -> Column:
    cross = (px - e["x1"]) * (e["y2"] - e["y1"]) - (py - e["y1"]) * (e["x2"] - e["x1"])
    return (cross == 0) & (px >= F.least(e["x1"], e["x2"])) & (px <= F.greatest(e["x1"], e["x2"])) & (py >= F.least(e["y1"], e["y2"])) & (py <= F.greatest(e["y1"], e["y2"]))


def crosses(px: Column, py: Column, e: Column) -> Column:
    """Whether the ray to the right of the point crosses the edge."""
    return ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])


def point_in(px: Column, py: Column, edge_list: Column) -> Column:
    """Whether a point intersects a polygon given by its edges; the boundary counts."""
    inside = F.aggregate(edge_list, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(px, py, e), F.lit(False)))
    return inside | F.exists(edge_list, lambda e: on_edge(px, py, e))


def geom_literal(geom: list) -> Column:
    """A polygon of Python lists [[[(x, y), ...], ...], ...] as a constant column."""
    point = lambda p: F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    return F.array(*(F.array(*(F.array(*(point(p) for p in ring)) for ring in part)) for part in geom))


def edge_list(geom: list) -> list[tuple[float, float, float, float]]:
    return [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for part in geom for ring in part for a, b in zip(ring, ring[1:])]


def point_in_literal(px: Column, py: Column, geom: list) -> Column:
    """``point_in`` for one polygon known on the driver: few edges are unrolled into compiled comparisons."""
    found = edge_list(geom)
    if len(found) > 64:
        names = ("x1", "y1", "x2", "y2")
        return point_in(px, py, F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, e))) for e in found)))
    inside, edge = F.lit(False), F.lit(False)
    for x1, y1, x2, y2 in found:
        if y1 != y2:
            inside = inside != (((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1))
        cross = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)
        edge = edge | ((cross == 0) & px.between(min(x1, x2), max(x1, x2)) & py.between(min(y1, y2), max(y1, y2)))
    return inside | edge


def circle_polygon(cx: Column, cy: Column, r: Column, quad: int = 16) -> Column:
    """The polygon of ``4 * quad`` corners on a circle, clockwise from angle 0."""
    n = 4 * quad
    turn = [(math.cos(-2 * math.pi * i / n), math.sin(-2 * math.pi * i / n)) for i in range(n)]
    unit = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [*turn, turn[0]]))
    return F.array(F.array(F.transform(unit, lambda u: F.struct((cx + r * u["x"]).alias("x"), (cy + r * u["y"]).alias("y")))))


def box_geom(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(corner(minx, miny), corner(maxx, miny), corner(maxx, maxy), corner(minx, maxy), corner(minx, miny))))
