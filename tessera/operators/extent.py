"""Extents: the box of an element or of many, in a coordinate system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import GLOBAL, Element
from tessera.operators.spatial import box_corners
from tessera.operators.transform import transform_vectors

Extent = dict[str, tuple[float, float]]


def extent_frame(e: Element, m: np.ndarray | None = None) -> DataFrame:
    """One row (min_x, max_x, ...) over an element's own coordinates, or those under a matrix."""
    df = e.df if m is None else transform_vectors(e, m)
    out = []
    for a in e.axes:
        if e.kind == "points":
            lo, hi = F.col(a), F.col(a)
        elif e.is_circles:
            lo, hi = F.col(a) - F.col("radius"), F.col(a) + F.col("radius")
        else:
            lo, hi = F.col(f"min{a}"), F.col(f"max{a}")
        out += [F.min(lo).alias(f"min_{a}"), F.max(hi).alias(f"max_{a}")]
    return df.agg(*out)


def element_extent(e: Element, cs: str = GLOBAL, exact: bool = True) -> Extent:
    """The box of an element. ``exact``: of its transformed vertices; else of its transformed box's corners."""
    m = e.affine(cs)
    axes = tuple(a for a in ("x", "y", "z") if a in e.axes)
    if e.kind in ("image", "labels"):
        low, high = [0.0] * len(axes), [float(e.size()[a]) for a in axes]
    else:
        diagonal = np.count_nonzero(m[:-1, :-1] - np.diag(np.diag(m[:-1, :-1]))) == 0
        if exact and not diagonal:
            row = extent_frame(e, m).first()
            return {a: (row[f"min_{a}"], row[f"max_{a}"]) for a in axes}
        row = extent_frame(e).first()
        if row[f"min_{axes[0]}"] is None:
            raise ValueError("an empty element has no extent")
        low, high = [row[f"min_{a}"] for a in axes], [row[f"max_{a}"] for a in axes]
    corners = box_corners(low, high) @ m[:-1, :-1].T + m[:-1, -1]
    return {a: (float(corners[:, i].min()), float(corners[:, i].max())) for i, a in enumerate(axes)}


def extent(elements: dict[str, Element] | Element, cs: str = GLOBAL, exact: bool = True, kinds: tuple[str, ...] = ("points", "shapes", "image", "labels")) -> Extent:
    """The common box of all elements of some kinds that are in the coordinate system."""
    if isinstance(elements, Element):
        return element_extent(elements, cs, exact)
    found = [element_extent(e, cs, exact) for e in elements.values() if cs in e.transforms and e.kind in kinds]
    if not found:
        raise ValueError(f"no element is in the coordinate system {cs!r}")
    axes = [a for a in ("x", "y", "z") if any(a in x for x in found)]
    return {a: (min(x[a][0] for x in found if a in x), max(x[a][1] for x in found if a in x)) for a in axes}


def extents_equal(a: Extent, b: Extent, atol: float = 0.1) -> bool:
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=atol) for k in a)
