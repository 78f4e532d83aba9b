"""Elements taken through their transforms, and the bookkeeping of transforms."""

from __future__ import annotations

import warnings
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.model import GLOBAL, Element
from tessera.transforms import CoordinateGraph, Identity, Scale, Sequence, Transform, Translation, circle_factor, landmarks_transform, linear_column


def transform(e: Element, cs: str = GLOBAL, maintain_positioning: bool = False) -> Element:
    """The element's data in a coordinate system.

    Its transform there becomes the identity; with ``maintain_positioning`` all transforms are kept, preceded by the
    inverse, so the element stays where it was everywhere.
    """
    if cs not in e.transforms:
        raise ValueError(f"the element is not in the coordinate system {cs!r}")
    own = e.transforms[cs]
    if e.kind in ("image", "labels"):
        out, moved = _transform_raster(e, own)
    else:
        out, moved = e.with_df(transform_vectors(e, e.affine(cs))), Identity()
    if maintain_positioning:
        out.transforms = {k: Sequence([moved, own.inverse(), t]) for k, t in e.transforms.items()}
    else:
        out.transforms = {cs: moved}
    return out


def transform_vectors(e: Element, m: np.ndarray) -> DataFrame:
    """Coordinates under a matrix over (x, y[, z]); order and all other columns stay."""
    if np.allclose(m, np.eye(len(m))):
        return e.df
    if e.kind == "points" or e.is_circles:
        cols = [F.col(a) for a in e.axes]
        new = {a: linear_column(m[i], cols) for i, a in enumerate(e.axes)}
        if e.is_circles:
            factor, even = circle_factor(m[:2, :2])
            if not even:
                warnings.warn("the transform scales axes differently; radii take the mean", stacklevel=3)
            new["radius"] = F.col("radius") * F.lit(factor)
        return e.df.withColumns(new)
    df = e.df.withColumn("geom", G.affine_geom(F.col("geom"), m))
    return df.withColumns(G.bounds(F.col("geom")))


def output_grid(size: dict[str, int], m: np.ndarray, axes: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray]:
    """Size and origin of the pixel grid that holds a transformed raster."""
    from tessera.operators.spatial import box_corners

    corners = box_corners([0.0] * len(axes), [float(size[a]) for a in axes]) @ m[:-1, :-1].T + m[:-1, -1]
    low, high = corners.min(0), corners.max(0)
    return {a: int(high[i] - low[i]) for i, a in enumerate(axes)}, low


def resample(e: Element, back: np.ndarray, axes: tuple[str, ...], size: dict[str, int], scale: int = 0) -> DataFrame:
    """(dims, value) on a grid of ``size``: each pixel takes the source pixel at ``back`` of its centre (nearest).

    The target grid is generated by partitions and meets the source by an equality join on source pixels.
    """
    spark, n = e.df.sparkSession, int(np.prod(list(size.values())))
    grid, rest = spark.range(n), F.col("id")
    for a in reversed(axes):
        grid = grid.withColumn(a, F.pmod(rest, F.lit(size[a])).cast("int"))
        rest = F.floor(rest / size[a])
    at = [F.col(a) + 0.5 for a in axes]
    grid = grid.select(*axes, *(F.floor(linear_column(back[i], at)).cast("int").alias(f"_{a}") for i, a in enumerate(axes)))
    # only source pixels within the hull of the grid's centres can be met
    from tessera.operators.spatial import box_corners

    hull = box_corners([0.5] * len(axes), [size[a] - 0.5 for a in axes]) @ back[:-1, :-1].T + back[:-1, -1]
    inside = {a: (max(0, int(np.floor(hull[:, i].min())) - 1), min(e.size(scale)[a], int(np.floor(hull[:, i].max())) + 2)) for i, a in enumerate(axes)}
    whole = e.df if e.window is None or any(b <= a for a, b in inside.values()) else e.window({scale: inside})
    src = whole.where(reduce(lambda p, q: p & q, [F.col(a).between(lo, hi - 1) for a, (lo, hi) in inside.items()], F.col("scale") == scale))
    src = src.select(*(F.col(a).alias(f"_{a}") for a in axes), *(["c"] if "c" in e.attrs["dims"] else []), "value")
    if "c" in e.attrs["dims"]:
        chans = spark.range(len(e.attrs.get("channels") or [0])).select(F.col("id").cast("int").alias("c"))
        grid = grid.join(F.broadcast(chans), how="cross")
        return grid.join(src, [*(f"_{a}" for a in axes), "c"], "left").select("c", *axes, F.coalesce("value", F.lit(0)).alias("value"))
    kind = e.df.schema["value"].dataType
    return grid.join(src, [f"_{a}" for a in axes], "left").select(*axes, F.coalesce("value", F.lit(0)).cast(kind).alias("value"))


def _transform_raster(e: Element, t: Transform) -> tuple[Element, Transform]:
    """Nearest resampling; returns the new raster and the translation that places it."""
    axes = tuple(a for a in e.attrs["dims"] if a != "c")
    m = t.matrix(axes)
    parts, sizes, origin = [], {}, None
    for scale in sorted(e.attrs["sizes"]):
        f = np.diag([e.size()[a] / e.size(scale)[a] for a in axes] + [1.0])
        own = np.linalg.inv(f) @ m @ f
        size, low = output_grid(e.size(scale), own, axes)
        if min(size.values()) == 0:
            continue
        shift = np.eye(len(axes) + 1)
        shift[:-1, -1] = low
        parts.append(resample(e, np.linalg.inv(own) @ shift, axes, size, scale).withColumn("scale", F.lit(scale)))
        sizes[scale] = size
        origin = low if origin is None else origin
    df = reduce(DataFrame.unionByName, parts).select("scale", *e.attrs["dims"], "value")
    moved = Translation(origin, axes)
    return e.with_df(df, sizes=sizes), moved


# -- bookkeeping ----------------------------------------------------------------------------------------------------


def set_transform(e: Element, t: Transform | dict[str, Transform], cs: str = GLOBAL, set_all: bool = False) -> Element:
    if set_all:
        return replace(e, transforms=dict(t))
    return replace(e, transforms={**e.transforms, cs: t})


def get_transform(e: Element, cs: str = GLOBAL, get_all: bool = False) -> Transform | dict[str, Transform]:
    return dict(e.transforms) if get_all else e.transforms[cs]


def remove_transform(e: Element, cs: str | None = GLOBAL, remove_all: bool = False) -> Element:
    return replace(e, transforms={} if remove_all else {k: t for k, t in e.transforms.items() if k != cs})


def transform_between(elements: dict[str, Element], source: str, target: str, via: str | None = None, shortest: bool = True) -> Transform:
    """From one coordinate system or element (``@name``) to another."""
    return CoordinateGraph.of({n: e.transforms for n, e in elements.items()}).between(source, target, via, shortest)


#: Landmarks are brought to the driver, so their number has a bound.
MOST_LANDMARKS = 10_000


def align_by_landmarks(moving: Element, reference: Element, moving_marks: Element, reference_marks: Element, cs: str, new_cs: str) -> tuple[Element, Element, Transform]:
    """Both elements in ``new_cs``, the moving one by the similarity that its landmarks ask for.

    Landmarks are dozens of rows at most; they are read in order of id. More than ``MOST_LANDMARKS`` are refused.
    """

    def read(e: Element) -> np.ndarray:
        rows = e.df.orderBy("id").select("x", "y").limit(MOST_LANDMARKS + 1).collect()
        if len(rows) > MOST_LANDMARKS:
            raise ValueError(f"more than {MOST_LANDMARKS} landmarks")
        return np.array([tuple(r) for r in rows])

    t = landmarks_transform(read(moving_marks), read(reference_marks))
    base = reference.transforms.get(cs, Identity())
    return set_transform(moving, Sequence([moving.transforms.get(cs, Identity()), t]), new_cs), set_transform(reference, base, new_cs), t


def pixel_centres(e: Element, scale: int = 0) -> DataFrame:
    """The pixel table with coordinates of the pixels' centres in units of the finest scale ({axis}_center)."""
    axes = [a for a in e.attrs["dims"] if a != "c"]
    f = {a: e.size()[a] / e.size(scale)[a] for a in axes}
    return e.df.where(F.col("scale") == scale).withColumns({f"{a}_center": (F.col(a) + 0.5) * F.lit(float(f[a])) for a in axes})


def downscale_transform(e: Element, scale: int) -> Scale:
    """From a scale's pixels to those of the finest."""
    axes = tuple(a for a in e.attrs["dims"] if a != "c")
    return Scale([e.size()[a] / e.size(scale)[a] for a in axes], axes)
