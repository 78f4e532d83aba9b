"""Rasters: from points and shapes, resampling, pyramids, mapping over tiles, and back to vectors.

Pixels are rows. What looks at neighbours deals tiles with a border of copied pixels to Arrow functions; everything
else is aggregation and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import kernels as K
from tessera.model import GLOBAL, Element, Table, circles, known_categories, points, polygons, raster
from tessera.operators.extent import extent
from tessera.operators.spatial import as_polygons
from tessera.operators.transform import resample, transform
from tessera.transforms import Affine, Identity, Sequence, Translation


def target_size(low: list[float], high: list[float], axes: tuple[str, ...], unit_to_pixels: float | None = None, **sizes: int | None) -> dict[str, int]:
    """Pixels along each axis, from exactly one of unit_to_pixels, width (x), height (y), depth (z); halves round to even."""
    given = {k: v for k, v in {"unit": unit_to_pixels, "x": sizes.get("width"), "y": sizes.get("height"), "z": sizes.get("depth")}.items() if v is not None}
    if len(given) != 1:
        raise ValueError("exactly one of unit_to_pixels, width, height and depth is needed")
    (key, value), span = next(iter(given.items())), {a: h - lo for a, lo, h in zip(axes, low, high)}
    factor = value if key == "unit" else value / span[key]
    return {a: int(np.round(s * factor)) for a, s in span.items()}


def rasterize_points(e: Element, low: tuple[float, float], high: tuple[float, float], size: dict[str, int], value_key: str | None = None, agg: str | None = None, labels: bool = False) -> Element:
    """Points binned into pixels of the box (axes x, y).

    ``agg``: count (default without value key), sum (default for numbers), first (default for categories; the code
    of the category, from 1, of the point of smallest id), count_cat (a channel for each category). Pixels without
    points are 0 and are not stored.
    """
    categories = known_categories(e.df, value_key) if value_key and dict(e.df.dtypes)[value_key] == "string" else None
    agg = agg or ("count" if value_key is None else "first" if categories else "sum")
    (x0, y0), (x1, y1) = low, high
    w, h = size["x"], size["y"]
    df = e.df.where((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))
    pixel = lambda a, lo, hi, n: F.least(F.floor((F.col(a) - lo) * (n / (hi - lo))), F.lit(n - 1)).cast("int")
    df = df.select("id", *([value_key] if value_key else []), pixel("x", x0, x1, w).alias("px"), pixel("y", y0, y1, h).alias("py"))
    channel: list = [0]
    code = F.lit(0)
    if categories:
        if labels and len(categories) > 65535:
            raise ValueError("labels have at most 65535 categories")
        code = reduce(lambda acc, ic: F.when(F.col(value_key) == ic[1], ic[0] + 1).otherwise(acc), list(enumerate(categories)), F.lit(0))
    if agg == "count":
        out = df.groupBy("py", "px").agg(F.count("*").cast("double").alias("value")).withColumn("c", F.lit(0))
    elif agg == "sum":
        out = df.groupBy("py", "px").agg(F.sum(value_key).cast("double").alias("value")).withColumn("c", F.lit(0))
    elif agg == "first":
        what = code if categories else F.col(value_key)
        out = df.groupBy("py", "px").agg(F.min_by(what, F.struct("id", what)).cast("double").alias("value")).withColumn("c", F.lit(0))
    elif agg == "count_cat":
        channel = categories
        out = df.groupBy("py", "px", (code - 1).alias("c")).agg(F.count("*").cast("double").alias("value"))
    else:
        raise ValueError(f"unknown aggregation {agg!r}")
    return _placed(out, e, low, high, size, channel, labels, categories)


def _placed(out: DataFrame, e: Element, low, high, size: dict[str, int], channels: list, labels: bool, categories: list | None) -> Element:
    out = out.withColumnsRenamed({"py": "y", "px": "x"})
    dims = ("y", "x") if labels else ("c", "y", "x")
    if labels:
        out = out.withColumn("value", F.col("value").cast("bigint"))
    (x0, y0), (x1, y1) = low, high
    place = Affine([[(x1 - x0) / size["x"], 0, x0], [0, (y1 - y0) / size["y"], y0], [0, 0, 1]], ("x", "y"), ("x", "y"))
    r = raster(out.withColumn("scale", F.lit(0)), dims, {"y": size["y"], "x": size["x"]}, None if labels else channels, {GLOBAL: place})
    if categories:
        r.attrs["label_index_to_category"] = {i + 1: c for i, c in enumerate(categories)}
    return r


def rasterize_shapes(e: Element, low: tuple[float, float], high: tuple[float, float], size: dict[str, int], value_key: str | None = None, labels: bool = True) -> Element:
    """Shapes over the pixels whose centres they hold; the shape of smallest id wins.

    A pixel's value is the shape's number from 1 (in order of id), or its value or category code.
    """
    (x0, y0), (x1, y1) = low, high
    w, h = size["x"], size["y"]
    dx, dy = (x1 - x0) / w, (y1 - y0) / h
    p = as_polygons(e).df
    categories = known_categories(p, value_key) if value_key and dict(p.dtypes)[value_key] == "string" else None
    if value_key is None:
        p = p.join(_numbered(p), "id")
    elif categories:
        p = p.withColumn("_v", reduce(lambda acc, ic: F.when(F.col(value_key) == ic[1], ic[0] + 1).otherwise(acc), list(enumerate(categories)), F.lit(0)))
    else:
        p = p.withColumn("_v", F.col(value_key))
    p = p.withColumn("edges", G.edges(F.col("geom")))
    first = lambda c, lo, d: F.greatest(F.ceil((F.col(c) - lo) / d - 0.5), F.lit(0))
    last = lambda c, lo, d, n: F.least(F.floor((F.col(c) - lo) / d - 0.5), F.lit(n - 1))
    p = p.withColumns({"a": first("minx", x0, dx), "b": last("maxx", x0, dx, w), "f": first("miny", y0, dy), "g": last("maxy", y0, dy, h)}).where("a <= b and f <= g")
    p = p.select("id", "_v", "edges", "f", "g", F.explode(F.sequence("a", "b")).alias("px")).withColumn("py", F.explode(F.sequence("f", "g")))
    inside = p.where(G.point_in((F.col("px") + 0.5) * dx + x0, (F.col("py") + 0.5) * dy + y0, F.col("edges")))
    out = inside.groupBy("py", "px").agg(F.min_by("_v", "id").cast("double").alias("value")).withColumn("c", F.lit(0))
    out = out.withColumns({"px": F.col("px").cast("int"), "py": F.col("py").cast("int")})
    return _placed(out, e, low, high, size, [0], labels, categories)


def _numbered(df: DataFrame) -> DataFrame:
    """(id, _v): ids numbered from 1 in order, by ranks within range partitions and the partitions' offsets.

    The ranges are kept, so that ranks and offsets are of the same ones; only a count a partition reaches the driver.
    """
    ranged = df.select("id").repartitionByRange("id").withColumn("_p", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = sorted((r._p, r["count"]) for r in ranged.groupBy("_p").count().collect())
    offsets = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    place = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))[F.col("_p")] if len(offsets) > 1 else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("id"))
    return ranged.select("id", (rank + place).cast("bigint").alias("_v"))


def pick_scale(e: Element, size: dict[str, int], m: np.ndarray, low, high) -> int:
    """The coarsest scale that still has as many pixels along the box as the target, within a factor sqrt(axes)."""
    axes = tuple(size)
    best = 0
    for scale in sorted(e.attrs["sizes"]):
        f = np.array([e.size()[a] / e.size(scale)[a] for a in axes])
        span = np.abs(np.linalg.inv(m)[:-1, :-1] @ (np.array(high) - np.array(low))) / f
        if all(s * np.sqrt(len(axes)) >= size[a] for a, s in zip(axes, span)):
            best = scale
    return best


def rasterize_raster(e: Element, low, high, size: dict[str, int], cs: str = GLOBAL, colours: DataFrame | None = None) -> Element:
    """A raster resampled over a box, nearest pixel; axes in the order of ``size``. ``colours``: (label, value)."""
    axes = tuple(size)
    m = e.transforms[cs].matrix(axes)
    scale = pick_scale(e, size, m, low, high)
    f = np.diag([e.size()[a] / e.size(scale)[a] for a in axes] + [1.0])
    place = np.diag([(h - lo) / size[a] for a, lo, h in zip(axes, low, high)] + [1.0])
    place[:-1, -1] = low
    df = resample(e, np.linalg.inv(m @ f) @ place, axes, size, scale)
    if colours is not None:
        df = df.join(colours.select(F.col("label").alias("value"), F.col("value").alias("_new")), "value", "left").withColumn("value", F.coalesce("_new", F.lit(0))).drop("_new")
        df = df.withColumn("c", F.lit(0))
        return raster(df.withColumn("scale", F.lit(0)), ("c", *axes), size, [0], {cs: Affine(place, axes, axes)})
    return raster(df.withColumn("scale", F.lit(0)), e.attrs["dims"], size, e.attrs.get("channels"), {cs: Affine(place, axes, axes)})


def rasterize(e: Element, low, high, axes: tuple[str, ...] = ("x", "y"), cs: str = GLOBAL, value_key: str | None = None, agg: str | None = None, labels: bool = False, **size) -> Element:
    """Any element over a box of a coordinate system."""
    n = target_size(list(low), list(high), axes, **size)
    if e.kind in ("image", "labels"):
        order = tuple(a for a in e.attrs["dims"] if a != "c")
        at = [axes.index(a) for a in order]
        return rasterize_raster(e, [low[i] for i in at], [high[i] for i in at], {a: n[a] for a in order}, cs)
    moved = transform(e, cs)
    at = [axes.index("x"), axes.index("y")]
    lo, hi = tuple(low[i] for i in at), tuple(high[i] for i in at)
    if e.kind == "points":
        return rasterize_points(moved, lo, hi, n, value_key, agg, labels)
    return rasterize_shapes(moved, lo, hi, n, value_key, labels or value_key is None)


def rasterize_all(elements: dict[str, Element], low, high, axes: tuple[str, ...] = ("x", "y"), cs: str = GLOBAL, **size) -> dict[str, Element]:
    """All elements that are in a coordinate system, over one box of it: vectors become images of counts or labels."""
    return {f"{n}_rasterized_{'images' if e.kind in ('image', 'points') else 'labels'}": rasterize(e, low, high, axes, cs, **size) for n, e in elements.items() if cs in e.transforms}


def rasterize_bins(t: Table, bins: Element, col_key: str, row_key: str, value_key: str | list[str] | None = None, as_labels: bool = False) -> Element:
    """A table over grid bins as an image: a channel for each variable (or obs column), or labels of the instances.

    The place of the grid is the least-squares affine map from (col, row) to the bins' centres, over all bins.
    """
    low = t.obs.agg(F.min(col_key).alias("c0"), F.min(row_key).alias("r0"), F.max(col_key).alias("c1"), F.max(row_key).alias("r1")).first()
    size = {"y": int(low.r1 - low.r0 + 1), "x": int(low.c1 - low.c0 + 1)}
    at = t.obs.select("obs_pos", F.col(t.instance_key).alias("_id"), (F.col(row_key) - low.r0).cast("int").alias("y"), (F.col(col_key) - low.c0).cast("int").alias("x"), *([] if value_key is None else [k for k in ([value_key] if isinstance(value_key, str) else value_key) if k in t.obs.columns]))
    place = grid_affine(t, bins, col_key, row_key, low.c0, low.r0)
    if as_labels:
        numbers = _numbered(at.select(F.col("_id").alias("id")))
        df = at.join(numbers, at["_id"] == numbers["id"]).select("y", "x", F.col("_v").alias("value"))
        return raster(df.withColumn("scale", F.lit(0)), ("y", "x"), size, None, {GLOBAL: place})
    names = [value_key] if isinstance(value_key, str) else value_key
    if names is not None and all(k in t.obs.columns for k in names):
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(k).cast("double").alias("value")) for i, k in enumerate(names))))
        df = at.select("y", "x", cells.alias("e")).select("e.c", "y", "x", "e.value")
    else:
        v = t.var if names is None else t.var.where(F.col("var_name").isin(names))
        listed = [r.var_name for r in v.orderBy("var_pos").select("var_name").collect()]
        names = listed if names is None else [n for n in names if n in listed]
        code = reduce(lambda acc, ic: F.when(F.col("var_name") == ic[1], ic[0]).otherwise(acc), list(enumerate(names)), F.lit(0)) if len(names) <= 64 else (F.array_position(F.array(*map(F.lit, names)), F.col("var_name")) - 1).cast("int")
        picked = v.select("var_pos", code.alias("c"))
        df = t.x.where("layer is null").join(F.broadcast(picked), "var_pos").join(at.select("obs_pos", "y", "x"), "obs_pos").select("c", "y", "x", F.col("value").cast("double").alias("value"))
    return raster(df.withColumn("scale", F.lit(0)), ("c", "y", "x"), size, names, {GLOBAL: place})


def grid_affine(t: Table, bins: Element, col_key: str, row_key: str, c0: float, r0: float) -> Affine:
    """From pixels of the grid to the bins' coordinates: normal equations summed over all bins, solved on the driver."""
    centre = (F.col("x"), F.col("y")) if bins.kind == "points" or bins.is_circles else G.centroid(F.col("geom"))
    b = bins.df.select(F.col("id").alias(t.instance_key), centre[0].alias("_bx"), centre[1].alias("_by"))
    g = t.obs.select(t.instance_key, (F.col(col_key) - c0 + 0.5).alias("u"), (F.col(row_key) - r0 + 0.5).alias("v")).join(b, t.instance_key)
    cols = {"u": F.col("u"), "v": F.col("v"), "one": F.lit(1.0)}
    sums = g.agg(*(F.sum(cols[p] * cols[q]).alias(f"{p}_{q}") for p in cols for q in cols), *(F.sum(cols[p] * F.col(k)).alias(f"{p}{k}") for p in cols for k in ("_bx", "_by")), F.count("*").alias("n")).first()
    if sums.n < 3:
        raise ValueError("three bins at least are needed")
    a = np.array([[sums[f"{p}_{q}"] for q in cols] for p in cols], float)
    rhs = np.array([[sums[f"{p}{k}"] for k in ("_bx", "_by")] for p in cols], float)
    m = np.eye(3)
    m[:2] = np.linalg.lstsq(a, rhs, rcond=None)[0].T
    return Affine(m, ("x", "y"), ("x", "y"))


def link_bins(t: Table, name: str, region_key: str = "region") -> Table:
    """The table as an annotation of the labels made from its bins: instances become their numbers."""
    from dataclasses import replace

    numbers = _numbered(t.obs.select(F.col(t.instance_key).alias("id")))
    obs = t.obs.join(numbers, t.obs[t.instance_key] == numbers["id"]).drop("id").drop(t.instance_key).withColumnRenamed("_v", t.instance_key)
    return replace(t, obs=obs.withColumn(t.region_key, F.lit(name)), region=[name])


# -- pyramids -------------------------------------------------------------------------------------------------------


def pyramid(e: Element, factors: Iterable[int | dict[str, int]]) -> Element:
    """Adds coarser scales, each by its factor to the one before: means of images, nearest pixels of labels."""
    axes = [a for a in e.attrs["dims"] if a != "c"]
    level, parts, sizes = e.df.where("scale = 0"), [e.df.where("scale = 0")], {0: dict(e.size())}
    for k, f in enumerate(factors, 1):
        f = {a: (f.get(a, 1) if isinstance(f, dict) else (1 if a == "z" else f)) for a in axes}
        size = {a: sizes[k - 1][a] // f[a] for a in axes}
        inside = reduce(lambda p, q: p & q, [F.col(a) < size[a] * f[a] for a in axes])
        new = {a: F.floor(F.col(a) / f[a]).cast("int") for a in axes}
        if e.kind == "image":
            level = level.where(inside).withColumns(new).groupBy("c", *axes).agg(F.avg("value").alias("value"))
        else:
            middle = reduce(lambda p, q: p & q, [F.pmod(F.col(a), F.lit(f[a])) == f[a] // 2 for a in axes])
            level = level.where(inside & middle).withColumns(new)
        level = level.select(F.lit(k).alias("scale"), *e.attrs["dims"], "value")
        parts.append(level)
        sizes[k] = size
    return e.with_df(reduce(DataFrame.unionByName, parts), sizes=sizes)


def levels(e: Element) -> list[tuple[int, DataFrame]]:
    return [(k, e.df.where(F.col("scale") == k)) for k in sorted(e.attrs["sizes"])]


# -- mapping --------------------------------------------------------------------------------------------------------


def map_raster(e: Element, func: Callable[[np.ndarray], np.ndarray], tile: int = 256, depth: int = 0, relabel: bool = False) -> Element:
    """``func`` over 2D tiles (with channels, if any) of the finest scale, with ``depth`` pixels of each neighbour.

    Beyond the raster the border is reflected. ``func`` takes and gives arrays of one shape, (c, y, x) or (y, x).
    ``relabel``: labels of different tiles are kept apart by the tile's number in the low bits.
    """
    size, image = e.size(), e.kind == "image"
    ny, nx = -(-size["y"] // tile), -(-size["x"] // tile)
    channels = list(e.attrs.get("channels") or [0])
    df = e.df.where("scale = 0")

    def places(a: str, n: int) -> F.Column:
        """All tiles that want this pixel, with its place there: its own, neighbours, and reflections at the ends."""
        at, own = F.col(a), F.floor(F.col(a) / tile)
        last = size[a] - 1
        spot = lambda t, p: F.struct(t.cast("int").alias("t"), p.cast("int").alias("p"))
        options = []
        for d in (-1, 0, 1):
            t = own + d
            p = at - t * tile
            options.append(F.when((t >= 0) & (t < n) & (p >= -depth) & (p < tile + depth), spot(t, p)))
            if depth:
                for mirrored in (-1 - at, 2 * last + 1 - at):
                    p = mirrored - t * tile
                    options.append(F.when((t >= 0) & (t < n) & (p >= -depth) & (p < tile + depth) & ((mirrored < 0) | (mirrored > last)), spot(t, p)))
        return F.explode(F.array_distinct(F.array_compact(F.array(*options))))

    cells = df.withColumn("_y", places("y", ny)).withColumn("_x", places("x", nx))
    cells = cells.select(F.col("_y.t").alias("ty"), F.col("_x.t").alias("tx"), F.col("_y.p").alias("py"), F.col("_x.p").alias("px"), *(["c"] if image else []), "value")
    shift = max(ny * nx - 1, 0).bit_length()
    columns = (["c"] if image else []) + ["y", "x", "value"]

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(key[0]), int(key[1])
        h, w = min(tile, size["y"] - ty * tile), min(tile, size["x"] - tx * tile)
        block = np.zeros((len(channels), h + 2 * depth, w + 2 * depth), part["value"].dtype)
        y, x = part["py"].to_numpy() + depth, part["px"].to_numpy() + depth
        keep = (y < h + 2 * depth) & (x < w + 2 * depth)
        block[part["c"].to_numpy()[keep] if image else 0, y[keep], x[keep]] = part["value"].to_numpy()[keep]
        out = func(block if image else block[0])
        out = out if image else out[None]
        out = out[:, depth : depth + h, depth : depth + w]
        if relabel:
            if int(out.max(initial=0)).bit_length() + shift > 63:
                raise ValueError("the labels leave no room for tile numbers")
            out = np.where(out > 0, (out.astype(np.int64) << shift) | (ty * nx + tx), 0)
        c, y, x = (i.reshape(-1) for i in np.indices(out.shape))
        res = {"y": (y + ty * tile).astype(np.int32), "x": (x + tx * tile).astype(np.int32), "value": out.reshape(-1)}
        return pd.DataFrame(({"c": c.astype(np.int32)} if image else {}) | res)[columns]

    kind = "double" if image else "bigint"
    out = cells.groupBy("ty", "tx").applyInPandas(one, ("c int, " if image else "") + f"y int, x int, value {kind}")
    return e.with_df(out.withColumn("scale", F.lit(0)).select("scale", *e.attrs["dims"], "value"), sizes={0: dict(size)})


def relabel_blocks(e: Element, tile: int) -> Element:
    """Labels made unique across tiles: ``label << bits | tile number``; 0 stays."""
    ny, nx = -(-e.size()["y"] // tile), -(-e.size()["x"] // tile)
    bits = max(ny * nx - 1, 0).bit_length()
    block = F.floor(F.col("y") / tile) * nx + F.floor(F.col("x") / tile)
    new = F.when(F.col("value") == 0, F.lit(0)).otherwise(F.shiftleft(F.col("value").cast("bigint"), bits).bitwiseOR(block.cast("bigint")))
    return e.with_df(e.df.withColumn("value", new.cast("bigint")))


def relabel_sequential(e: Element) -> Element:
    """Labels as 1 .. n in their order; 0 stays."""
    ids = e.df.where("scale = 0 and value <> 0").select(F.col("value").cast("bigint").alias("id")).distinct()
    found = _numbered(ids).select(F.col("id").alias("value"), "_v")
    df = e.df.withColumn("value", F.col("value").cast("bigint")).join(found, "value", "left").withColumn("value", F.coalesce("_v", F.lit(0)).cast("bigint"))
    return e.with_df(df.select("scale", *e.attrs["dims"], "value"))


def unpad(e: Element) -> Element:
    """Without the borders that are 0 throughout; the transforms follow."""
    axes = [a for a in e.attrs["dims"] if a in ("y", "x")]
    r = e.df.where("scale = 0 and value <> 0").agg(*(F.min(a).alias(f"lo_{a}") for a in axes), *(F.max(a).alias(f"hi_{a}") for a in axes)).first()
    if r[f"lo_{axes[0]}"] is None:
        return e
    low = {a: int(r[f"lo_{a}"]) for a in axes}
    size = dict(e.size()) | {a: int(r[f"hi_{a}"]) - low[a] + 1 for a in axes}
    test = reduce(lambda p, q: p & q, [F.col(a).between(low[a], low[a] + size[a] - 1) for a in axes], F.col("scale") == 0)
    out = e.with_df(e.df.where(test).withColumns({a: (F.col(a) - low[a]).cast("int") for a in axes}), sizes={0: size})
    out.transforms = {cs: Sequence([Translation([low[a] for a in axes], axes), t]) for cs, t in e.transforms.items()}
    return out


# -- to vectors -----------------------------------------------------------------------------------------------------


def label_centroids(e: Element, background: bool = False) -> DataFrame:
    """(id, x, y[, z], count): centres of the pixels of each label, in one aggregation."""
    axes = [a for a in e.attrs["dims"]]
    df = e.df.where("scale = 0") if background else e.df.where("scale = 0 and value <> 0")
    return df.groupBy(F.col("value").alias("id")).agg(*(F.avg(F.col(a) + 0.5).alias(a) for a in reversed(axes)), F.count("*").alias("count"))


def centroids(e: Element, cs: str = GLOBAL, background: bool = False) -> Element:
    """Centres of instances as points in a coordinate system."""
    if e.kind == "image":
        raise ValueError("an image has no instances")
    if e.kind == "labels":
        df = label_centroids(e, background).drop("count")
    elif e.kind == "points" or e.is_circles:
        df = e.df.select("id", *(a for a in e.axes))
    else:
        x, y = G.centroid(F.col("geom"))
        df = e.df.select("id", x.alias("x"), y.alias("y"))
    found = points(df)
    found.transforms = {cs: e.transforms[cs]}
    return transform(found, cs)


def to_circles(e: Element, radius: float | str | None = None) -> Element:
    """Circles of the same centre and area; points need a radius."""
    if e.kind == "points":
        if radius is None:
            raise ValueError("points need a radius")
        return circles(e.df, radius=radius, transforms=e.transforms)
    if e.is_circles:
        return e
    if e.kind == "labels":
        df = label_centroids(e).withColumn("radius", F.sqrt(F.col("count") / F.pi())).drop("count")
        return circles(df.select("id", "x", "y", "radius"), transforms=e.transforms)
    x, y = G.centroid(F.col("geom"))
    extra = [c for c in e.df.columns if c not in ("geom", "minx", "miny", "maxx", "maxy")]
    return circles(e.df.select(*extra, x.alias("x"), y.alias("y"), F.sqrt(G.area(F.col("geom")) / F.pi()).alias("radius")), transforms=e.transforms)


def labels_to_polygons(e: Element) -> Element:
    """The outline of each label at one half, from its pixels alone: one row a label."""

    def outline(part: pd.DataFrame) -> pd.DataFrame:
        y, x = part["y"].to_numpy(), part["x"].to_numpy()
        mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        geom = K.contours(mask, float(y.min()), float(x.min()))
        return pd.DataFrame({"id": [int(part["value"].iloc[0])], "geom": [[[[{"x": a, "y": b} for a, b in r] for r in p] for p in geom]]})

    df = e.df.where("scale = 0 and value <> 0").select(F.col("value").cast("bigint").alias("value"), "y", "x").groupBy("value").applyInPandas(outline, f"id bigint, geom {G.GEOM}")
    return polygons(df, transforms=e.transforms)


def to_polygons(e: Element, quad: int = 16) -> Element:
    return labels_to_polygons(e) if e.kind == "labels" else as_polygons(e, quad)


# -- tiles for consumers --------------------------------------------------------------------------------------------


def instance_tiles(e: Element, image: Element, scale: float = 1.0, cs: str = GLOBAL) -> DataFrame:
    """(instance_id, minx, miny, maxx, maxy, pixels): for each instance the pixels of its box, ``scale`` times its circle.

    ``pixels`` is an array of (c, y, x, value); boxes are laid over cells of the pixel grid, so boxes and pixels meet
    by an equality join.
    """
    c = transform(to_circles(e), cs).df if e.kind != "points" else e.df
    box = c.select(F.col("id").alias("instance_id"), *(((F.col(a) + s * F.col("radius") * scale)).alias(f"{m}{a}") for m, s in (("min", -1), ("max", 1)) for a in ("x", "y")))
    inv = np.linalg.inv(image.transforms[cs].matrix(("x", "y")))
    low = lambda a, i: F.greatest(F.ceil(F.col(f"min{a}") * inv[i, i] + inv[i, 2] - 0.5), F.lit(0))
    high = lambda a, i: F.least(F.floor(F.col(f"max{a}") * inv[i, i] + inv[i, 2] - 0.5), F.lit(image.size()[a] - 1))
    box = box.withColumns({"x0": low("x", 0), "x1": high("x", 0), "y0": low("y", 1), "y1": high("y", 1)}).where("x0 <= x1 and y0 <= y1")
    cell = 64
    laid = box.withColumn("_cx", F.explode(F.expr(f"sequence(floor(x0 / {cell}), floor(x1 / {cell}))"))).withColumn("_cy", F.explode(F.expr(f"sequence(floor(y0 / {cell}), floor(y1 / {cell}))")))
    px = image.df.where("scale = 0").withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    hit = px.join(laid, ["_cx", "_cy"]).where("x between x0 and x1 and y between y0 and y1")
    return hit.groupBy("instance_id", "minx", "miny", "maxx", "maxy").agg(F.collect_list(F.struct("c", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "value")).alias("pixels"))


def tile_batches(tiles: DataFrame, channels: int, side: int, labels: DataFrame | None = None) -> Iterator[tuple[object, np.ndarray, dict]]:
    """(instance, array of channels x side x side, its annotation) one after the other, a partition at a time.

    ``tiles`` is what ``instance_tiles`` gives; each tile, whatever its size, is resampled to ``side`` pixels along
    both axes (nearest pixel). ``labels``: a frame with ``instance_id`` whose other columns annotate.
    """
    if labels is not None:
        tiles = tiles.join(labels, "instance_id", "left")
    extra = [c for c in tiles.columns if c not in ("instance_id", "minx", "miny", "maxx", "maxy", "pixels")]
    for r in tiles.toLocalIterator(prefetchPartitions=True):
        at = np.array([(p["c"], p["y"], p["x"]) for p in r["pixels"]], int).reshape(-1, 3)
        h, w = at[:, 1:].max(0) + 1 if len(at) else (1, 1)
        own = np.zeros((channels, h, w))
        own[tuple(at.T)] = [p["value"] for p in r["pixels"]]
        pick = lambda n: ((np.arange(side) + 0.5) * n / side).astype(int)
        yield r["instance_id"], own[:, pick(h)[:, None], pick(w)[None, :]], {c: r[c] for c in extra}


def transform_to_extent(elements: dict[str, Element], cs: str = GLOBAL, target_width: int | None = None, unit_to_pixels: float | None = None) -> dict[str, Element]:
    """All elements moved and scaled so that their common extent begins at 0; rasters are resampled to it."""
    found = extent(elements, cs)
    low, high = [found[a][0] for a in ("x", "y")], [found[a][1] for a in ("x", "y")]
    size = target_size(low, high, ("x", "y"), unit_to_pixels, width=target_width)
    k = size["x"] / (high[0] - low[0])
    place = Affine([[k, 0, -low[0] * k], [0, k, -low[1] * k], [0, 0, 1]], ("x", "y"), ("x", "y"))
    out = {}
    for n, e in elements.items():
        if e.kind in ("image", "labels"):
            r = rasterize(e, low, high, cs=cs, width=size["x"])
            r.transforms = {GLOBAL: Identity()}
            out[n] = r
        else:
            moved = transform(e, cs)
            moved.transforms = {GLOBAL: place}
            out[n] = transform(moved, GLOBAL)
    return out

