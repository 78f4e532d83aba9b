"""Bounding-box and polygon queries.

The region is taken back through an element's transform on the driver, so the data is compared as it is stored:
boxes under identity or scaling become plain comparisons of raw columns, which reach the Parquet scan. Points are
tested strictly inside a box; shapes and polygon queries count the boundary; circles are tested by their centre in
a box and by their outline in a polygon.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessera.functions import geometry as G
from tessera.functions import kernels as K
from tessera.model import GLOBAL, Element, polygons
from tessera.transforms import Sequence, Translation, check_axes, linear_column

#: Axes that a box leaves open reach this far.
FAR = float(np.finfo(np.float32).max - 1)


@dataclass(frozen=True)
class BoundingBox:
    axes: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    cs: str = GLOBAL

    def __post_init__(self):
        object.__setattr__(self, "axes", check_axes(self.axes))
        object.__setattr__(self, "low", tuple(map(float, self.low)))
        object.__setattr__(self, "high", tuple(map(float, self.high)))
        if "c" in self.axes:
            raise ValueError("a box has spatial axes only")
        if not len(self.axes) == len(self.low) == len(self.high):
            raise ValueError("a box needs a low and a high value for each axis")
        if any(a > b for a, b in zip(self.low, self.high)):
            raise ValueError("low values must not be above high ones")

    def along(self, axes: Seq[str]) -> BoundingBox:
        """The same box over just these axes; those it lacks are open."""
        at = {a: (lo, hi) for a, lo, hi in zip(self.axes, self.low, self.high)}
        return BoundingBox(tuple(axes), tuple(at.get(a, (-FAR, FAR))[0] for a in axes), tuple(at.get(a, (-FAR, FAR))[1] for a in axes), self.cs)


def box_corners(low: Seq[float], high: Seq[float]) -> np.ndarray:
    """The 4 or 8 corners of a box; the last axis changes fastest."""
    return np.array(list(product(*zip(low, high))), float)


def _inverse(e: Element, cs: str) -> np.ndarray:
    m = e.affine(cs)
    if np.linalg.matrix_rank(m) < len(m):
        raise ValueError("a query needs an invertible transform")
    return np.linalg.inv(m)


def inside_box(cols: dict[str, Column], m: np.ndarray, box: BoundingBox) -> Column:
    """Strictly inside, for coordinates ``cols`` under the matrix ``m`` (axes in the order of ``cols``)."""
    names, tests = list(cols), []
    for i, a in enumerate(names):
        lo, hi = box.along(names).low[i], box.along(names).high[i]
        used = [j for j in range(len(names)) if m[i, j] != 0]
        if used == [i]:  # the box moves to the raw column
            k, t = m[i, i], m[i, -1]
            lo, hi = sorted(((lo - t) / k, (hi - t) / k))
            value = cols[a]
        else:
            value = linear_column(m[i], list(cols.values()))
        if abs(lo) < FAR / 2:
            tests.append(value > F.lit(lo))
        if abs(hi) < FAR / 2:
            tests.append(value < F.lit(hi))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _points_box(e: Element, box: BoundingBox) -> DataFrame:
    cols = {a: F.col(a) for a in e.axes}
    return e.df.where(inside_box(cols, e.affine(box.cs), box))


def points_in_boxes(e: Element, boxes: list[BoundingBox]) -> DataFrame:
    """Points with ``box_id``, the number of a box that holds them; a row for each box.

    The boxes are a constant array beside the points, so there is neither a join nor a shuffle.
    """
    cols = {a: F.col(a) for a in e.axes}
    hits = F.array(*(F.when(inside_box(cols, e.affine(b.cs), b), F.lit(i)) for i, b in enumerate(boxes)))
    return e.df.withColumn("box_id", F.explode(F.array_compact(hits)))


def _query_ring(e: Element, box: BoundingBox) -> list:
    """The box as a quadrilateral in the element's own (x, y)."""
    b = box.along(("x", "y"))
    (x0, y0), (x1, y1) = b.low, b.high
    corners = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    inv = _inverse(e, box.cs)
    pick = [0, 1, -1]
    inv = inv[np.ix_(pick, pick)]
    return [[[tuple(map(float, p)) for p in corners @ inv[:2, :2].T + inv[:2, 2]]]]


@F.arrow_udf(BooleanType())
def shapes_meet(a: pa.Array, b: pa.Array) -> pa.Array:
    """Null geometries are pairs that were settled before."""
    return pa.array([x is not None and K.intersects(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def is_box(geom: str = "geom", prefix: str = "") -> Column:
    """Whether a polygon is its own bounding box: one ring of four corners that covers it."""
    g = F.col(geom)
    whole = (F.col(f"{prefix}maxx") - F.col(f"{prefix}minx")) * (F.col(f"{prefix}maxy") - F.col(f"{prefix}miny"))
    return (F.size(g) == 1) & (F.size(g[0]) == 1) & (F.size(g[0][0]) == 5) & (F.abs(G.area(g) - whole) <= whole * 1e-12)


def shapes_meeting(df: DataFrame, geom: list, circles: bool) -> DataFrame:
    """Shapes that meet a polygon known on the driver: bounding boxes first, then the exact test of what is left."""
    pts = np.concatenate([np.asarray(r, float) for part in geom for r in part])
    (lx, ly), (hx, hy) = pts.min(0), pts.max(0)
    near = (F.col("minx") <= float(hx)) & (F.col("maxx") >= float(lx)) & (F.col("miny") <= float(hy)) & (F.col("maxy") >= float(ly))
    df = df.where(near)
    if not _is_axis_box(geom):
        return df.where(shapes_meet(F.col("geom"), G.geom_literal(geom)))
    inside = (F.col("minx") >= float(lx)) & (F.col("maxx") <= float(hx)) & (F.col("miny") >= float(ly)) & (F.col("maxy") <= float(hy))
    known = inside if circles else inside | is_box()
    return df.where(known | shapes_meet(F.when(~known, F.col("geom")), G.geom_literal(geom)))


def _is_axis_box(geom: list) -> bool:
    r = np.asarray(geom[0][0], float)
    return len(geom) == len(geom[0]) == 1 and len(r) == 5 and all((abs(a - b) == 0).any() for a, b in zip(r, r[1:]))


def as_polygons(e: Element, quad: int = 16) -> Element:
    """Circles as polygons of ``4 * quad`` corners; polygons stay."""
    if not e.is_circles:
        return e
    df = e.df.withColumn("geom", G.circle_polygon(F.col("x"), F.col("y"), F.col("radius"), quad)).drop("x", "y", "radius")
    return Element("shapes", polygons(df).df, dict(e.transforms), dict(e.attrs))


def raster_window(e: Element, box: BoundingBox) -> dict[str, tuple[float, float]]:
    """The axis-aligned hull of the box in the raster's own axes."""
    axes = tuple(a for a in ("x", "y", "z") if a in e.axes)
    b = box.along(axes)
    inv = _inverse(e, box.cs)
    size = e.size()
    own = box_corners(b.low, b.high) @ inv[:-1, :-1].T + inv[:-1, -1]
    return {a: (max(float(own[:, i].min()), -1e18), min(float(own[:, i].max()), 1e18)) for i, a in enumerate(axes) if a in size}


def _raster_box(e: Element, box: BoundingBox, request_only: bool = False):
    window = raster_window(e, box)
    slices = {a: (max(0, int(np.ceil(lo - 0.5))), min(e.size()[a], int(np.floor(hi - 0.5)) + 1)) for a, (lo, hi) in window.items()}
    if request_only:
        return {a: slice(*s) for a, s in slices.items()}
    if any(b <= a for a, b in slices.values()):
        return None
    keep, sizes, moved, spans = [], {}, [], {}
    for scale in sorted(e.attrs["sizes"]):
        f = {a: e.size()[a] / e.size(scale)[a] for a in window}
        first = {a: max(0, int(np.ceil(lo / f[a] - 0.5))) for a, (lo, _) in window.items()}
        last = {a: min(e.size(scale)[a], int(np.floor(hi / f[a] - 0.5)) + 1) for a, (_, hi) in window.items()}
        if any(last[a] <= first[a] for a in window):
            continue
        sizes[scale] = {a: last[a] - first[a] for a in window}
        test = reduce(lambda p, q: p & q, [(F.col(a) >= first[a]) & (F.col(a) < last[a]) for a in window], F.col("scale") == scale)
        keep.append(test)
        moved.append((scale, first))
        spans[scale] = {a: (first[a], last[a]) for a in window}
    df = (e.window(spans) if e.window else e.df).where(reduce(lambda p, q: p | q, keep))
    for a in window:
        shift = reduce(lambda acc, s: F.when(F.col("scale") == s[0], s[1][a]).otherwise(acc), moved, F.lit(0))
        df = df.withColumn(a, (F.col(a) - shift).cast(e.df.schema[a].dataType))
    offset = {a: float(np.ceil(max(lo, 0.0))) for a, (lo, _) in window.items()}
    out = e.with_df(df, sizes=sizes)
    step = Translation([offset[a] for a in window], tuple(window))
    out.transforms = {cs: Sequence([step, t]) if any(offset.values()) else t for cs, t in e.transforms.items()}
    return out


def bounding_box_query(e: Element, box: BoundingBox) -> Element | None:
    """The part of an element inside a box, in its own coordinates. None: a raster of which nothing is left."""
    if e.kind == "points":
        return e.with_df(_points_box(e, box))
    if e.kind == "shapes":
        ring = _query_ring(e, box)
        if e.is_circles:
            return e.with_df(e.df.where(G.point_in_literal(F.col("x"), F.col("y"), ring)))
        return e.with_df(shapes_meeting(e.df, ring, False))
    return _raster_box(e, box)


def _inverse_polygon(e: Element, geom: list, cs: str) -> list:
    if "z" in e.axes:
        m = e.affine(cs)
        if not (np.allclose(m[:2, 2], 0) and np.allclose(m[2, :2], 0)):
            raise ValueError("a polygon query can't mix z with x and y")
    inv = _inverse(e, cs)[np.ix_([0, 1, -1], [0, 1, -1])]
    return [[[tuple(map(float, p)) for p in np.asarray(r, float) @ inv[:2, :2].T + inv[:2, 2]] for r in part] for part in geom]


def _clip_udf(geom: list):
    @F.arrow_udf(G.GEOM)
    def cut(a: pa.Array) -> pa.Array:
        return pa.array([[[[{"x": x, "y": y} for x, y in r] for r in part] for part in K.clip(g, geom)] for g in a.to_pylist()], K.ARROW)

    return cut


def polygon_query(e: Element, geom: list, cs: str = GLOBAL, clip: bool = False) -> Element | None:
    """The part of an element that meets a polygon (lists of parts of closed rings), boundary included.

    ``clip``: shapes are cut to the polygon (circles become polygons). Rasters are cut to its bounding box.
    """
    if e.kind in ("image", "labels"):
        pts = np.concatenate([np.asarray(r, float) for part in geom for r in part])
        return bounding_box_query(e, BoundingBox(("x", "y"), pts.min(0), pts.max(0), cs))
    own = _inverse_polygon(e, geom, cs)
    pts = np.concatenate([np.asarray(r, float) for part in own for r in part])
    (lx, ly), (hx, hy) = pts.min(0).tolist(), pts.max(0).tolist()
    if e.kind == "points":
        x, y = F.col("x"), F.col("y")
        return e.with_df(e.df.where(x.between(lx, hx) & y.between(ly, hy) & G.point_in_literal(x, y, own)))
    hit = shapes_meeting(as_polygons(e).df, own, e.is_circles)
    if not clip:
        return e.with_df(e.df.join(hit.select("id"), "id", "left_semi") if e.is_circles else hit)
    cut = hit.withColumn("geom", _clip_udf(own)("geom")).where(F.size("geom") > 0)
    return Element("shapes", cut.withColumns(G.bounds(F.col("geom"))), dict(e.transforms), dict(e.attrs))
