"""Operators that hold on streams of points: selections and joins with fixed regions keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.model import Element
from tessera.operators.aggregate import points_in_regions
from tessera.operators.spatial import BoundingBox, _inverse_polygon, as_polygons, inside_box


def box_stream(e: Element, box: BoundingBox) -> DataFrame:
    """The points of a stream that are inside a box."""
    return e.df.where(inside_box({a: F.col(a) for a in e.axes}, e.affine(box.cs), box))


def polygon_stream(e: Element, geom: list, cs: str = "global") -> DataFrame:
    return e.df.where(G.point_in_literal(F.col("x"), F.col("y"), _inverse_polygon(e, geom, cs)))


def regions_stream(points: DataFrame, regions: Element, cell: float) -> DataFrame:
    """The points of a stream with each region that holds them; regions are a fixed table (the cell size too)."""
    fixed = as_polygons(regions).df.select(F.col("id").alias("region_id"), "geom", "minx", "miny", "maxx", "maxy")
    return points_in_regions(points, fixed, cell)
