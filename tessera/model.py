"""Elements of a dataset: lazy DataFrames with transforms to named coordinate systems, and the rules they obey.

Points: (id, x, y[, z], ...). Circles: (id, x, y, radius, ...). Polygons: (id, geom, minx, miny, maxx, maxy, ...).
Images and labels are pixel tables (scale, [c,] [z,] y, x, value), scale 0 the finest. A table has rows ``obs``
(obs_pos, obs_name, region, instance_id, ...), columns ``var`` (var_pos, var_name, ...) and a sparse matrix ``x``
(obs_pos, var_pos, layer, value).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.transforms import AXES, Identity, Transform

GLOBAL = "global"
NUMERIC_POINT_TYPES = ("int", "bigint", "float", "double")
INSTANCE_TYPES = ("smallint", "int", "bigint", "string")


@dataclass
class Element:
    kind: str  # points, shapes, image or labels
    df: DataFrame
    transforms: dict[str, Transform] = field(default_factory=lambda: {GLOBAL: Identity()})
    attrs: dict = field(default_factory=dict)
    #: a stored raster's pixels out of the tiles that meet windows {scale: {axis: (first, end)}}
    window: Callable[[dict[int, dict[str, tuple[int, int]]]], DataFrame] | None = field(default=None, compare=False)

    @property
    def axes(self) -> tuple[str, ...]:
        """Spatial axes, in the element's order."""
        if self.kind in ("points", "shapes"):
            return ("x", "y", "z") if "z" in self.df.columns else ("x", "y")
        return tuple(a for a in self.attrs["dims"] if a != "c")

    @property
    def is_circles(self) -> bool:
        return self.kind == "shapes" and "radius" in self.df.columns

    @property
    def multiscale(self) -> bool:
        return len(self.attrs.get("sizes", {})) > 1

    def with_df(self, df: DataFrame, **attrs) -> Element:
        return replace(self, df=df, attrs={**self.attrs, **attrs}, transforms=dict(self.transforms), window=None)

    def affine(self, cs: str = GLOBAL, axes: tuple[str, ...] | None = None) -> np.ndarray:
        """The matrix over the element's spatial axes (points order) into a coordinate system."""
        if cs not in self.transforms:
            raise ValueError(f"the element is not in the coordinate system {cs!r}")
        return self.transforms[cs].matrix(axes or tuple(a for a in ("x", "y", "z") if a in self.axes))

    def size(self, scale: int = 0) -> dict[str, int]:
        return self.attrs["sizes"][scale]


@dataclass
class Table:
    obs: DataFrame
    var: DataFrame | None = None
    x: DataFrame | None = None
    region: list[str] | None = None
    region_key: str | None = None
    instance_key: str | None = None
    attrs: dict = field(default_factory=dict)

    @property
    def annotates(self) -> bool:
        return self.region_key is not None

    def with_obs(self, obs: DataFrame, **changes) -> Table:
        """The same table over other rows; the matrix follows when it is read."""
        x = None if self.x is None else self.x.join(obs.select("obs_pos"), "obs_pos", "left_semi")
        return replace(self, obs=obs, x=x, **changes)


# -- names ----------------------------------------------------------------------------------------------------------

#: What a name must not look like, and how that is told.
_BAD_NAMES = {
    r"": "a name can't be empty",
    r"\.\.?": "{!r} is not a name",
    r"__.*": "{!r} begins with two underscores",
    r".*[^\w.\-].*": "{!r} has characters besides letters, digits, '_', '-' and '.'",
}


def name_problem(name: object) -> str | None:
    """Why something can't be a name, or None."""
    if not isinstance(name, str):
        return "a name must be text"
    return next((told.format(name) for pattern, told in _BAD_NAMES.items() if re.fullmatch(pattern, name, re.DOTALL)), None)


def check_names(names: Iterable[str], columns: bool = False) -> None:
    """Raises one error with all problems of some names: each alone, and those equal but for case."""
    problems, seen = [], {}
    for n in names:
        if p := name_problem(n):
            problems.append(p)
        elif columns and n == "_index":
            problems.append("'_index' is reserved")
        elif n.lower() in seen:
            problems.append(f"{n!r} and {seen[n.lower()]!r} differ only by case")
        else:
            seen[n.lower()] = n
    if problems:
        raise ValueError("; ".join(problems))


def sanitize_name(name: object, is_column: bool = False) -> str:
    """The nearest valid name.

    Other characters become ``_``; several underscores at the front become one; a column ``_index`` becomes ``index``;
    what is left without a name is ``unnamed``.
    """
    out = re.sub(r"^_{2,}", "_", re.sub(r"[^\w.\-]", "_", str(name)))
    reserved = {"": "unnamed", ".": "unnamed", "..": "unnamed"} | ({"_index": "index"} if is_column else {})
    return reserved.get(out, out)


def sanitize_names(names: Iterable[str], is_column: bool = True) -> dict[str, str]:
    """Valid names, told apart by ``_1``, ``_2`` ... where they fall together (ignoring case)."""
    used: set[str] = set()
    out = {}
    for n in names:
        base, k = sanitize_name(n, is_column), 0
        new = base
        while new.lower() in used:
            k += 1
            new = f"{base}_{k}"
        used.add(new.lower())
        out[n] = new
    return out


def sanitize_table(t: Table) -> Table:
    fix = lambda df: None if df is None else df.select(*(F.col(f"`{a}`").alias(b) for a, b in sanitize_names(df.columns).items()))
    return replace(t, obs=fix(t.obs), var=fix(t.var))


# -- categories -----------------------------------------------------------------------------------------------------


def as_category(df: DataFrame, col: str, categories: list[str]) -> DataFrame:
    """Keeps the categories of a column, those without rows too, as its metadata."""
    return df.withColumn(col, F.col(col).alias(col, metadata={"categories": list(categories)}))


def categories_of(df: DataFrame, col: str) -> list[str] | None:
    return df.schema[col].metadata.get("categories")


def known_categories(df: DataFrame, col: str) -> list[str]:
    """The categories of a column; without metadata they are its distinct values, in order."""
    found = categories_of(df, col)
    return found if found is not None else [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


# -- constructors ---------------------------------------------------------------------------------------------------


def _transforms(transforms: dict[str, Transform] | None) -> dict[str, Transform]:
    return dict(transforms) if transforms else {GLOBAL: Identity()}


def points(df: DataFrame, x: str = "x", y: str = "y", z: str | None = None, feature_key: str | None = None, instance_key: str | None = None, transforms: dict[str, Transform] | None = None) -> Element:
    """Points from any DataFrame; ``id`` is made when missing."""
    names = {x: "x", y: "y"} | ({z: "z"} if z else {})
    for src in names:
        if dict(df.dtypes).get(src) not in NUMERIC_POINT_TYPES:
            raise ValueError(f"coordinate {src!r} must be one of {NUMERIC_POINT_TYPES}")
    for key in (feature_key, instance_key):
        if key is not None and key not in df.columns:
            raise ValueError(f"no column {key!r}")
    df = df.withColumnsRenamed({a: b for a, b in names.items() if a != b})
    if "id" not in df.columns:
        df = df.withColumn("id", F.monotonically_increasing_id())
    check_names(df.columns, columns=True)
    return Element("points", df, _transforms(transforms), {"feature_key": feature_key, "instance_key": instance_key})


def circles(df: DataFrame, x: str = "x", y: str = "y", radius: str | float = "radius", transforms: dict[str, Transform] | None = None) -> Element:
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else F.col(radius)
    if isinstance(radius, (int, float)) and radius <= 0:
        raise ValueError("a radius must be larger than 0")
    keep = [c for c in df.columns if c not in (x, y, radius, "x", "y", "radius")]
    df = df.select(*keep, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), r.cast("double").alias("radius"))
    if "id" not in df.columns:
        df = df.withColumn("id", F.monotonically_increasing_id())
    return Element("shapes", df, _transforms(transforms), {})


def polygons(df: DataFrame, geom: str = "geom", transforms: dict[str, Transform] | None = None) -> Element:
    """Polygons and multipolygons; their bounding boxes become columns, which filters and joins push down."""
    if geom != "geom":
        df = df.withColumnRenamed(geom, "geom")
    if "id" not in df.columns:
        df = df.withColumn("id", F.monotonically_increasing_id())
    return Element("shapes", df.withColumn("geom", F.col("geom").cast(G.GEOM)).withColumns(G.bounds(F.col("geom"))), _transforms(transforms), {})


def polygons_from_lists(spark: SparkSession, geoms: list, ids: list | None = None, **columns: list) -> Element:
    """Polygons of Python lists [[[(x, y), ...], ...], ...]; rings are closed if they aren't."""
    close = lambda r: [tuple(map(float, p)) for p in r] + ([tuple(map(float, r[0]))] if tuple(r[0]) != tuple(r[-1]) else [])
    ids = list(range(len(geoms))) if ids is None else ids
    rows = [(i, [[close(r) for r in part] for part in g], *(c[k] for c in columns.values())) for k, (i, g) in enumerate(zip(ids, geoms))]
    kind = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    extra = "".join(f", {n} {kind[type(v[0])]}" for n, v in columns.items())
    return polygons(spark.createDataFrame(rows, f"id {kind[type(ids[0])]}, geom {G.GEOM}{extra}"))


def geojson(spark: SparkSession, text: str) -> Element:
    """Shapes of a GeoJSON GeometryCollection: all polygons (with multipolygons), or all points (radius 1)."""
    found = json.loads(text)
    if found.get("type") != "GeometryCollection":
        raise ValueError("only a GeometryCollection is read")
    kinds = {g["type"] for g in found["geometries"]}
    if kinds <= {"Polygon", "MultiPolygon"}:
        return polygons_from_lists(spark, [[g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"] for g in found["geometries"]])
    if kinds == {"Point"}:
        rows = [(i, *map(float, g["coordinates"][:2]), 1.0) for i, g in enumerate(found["geometries"])]
        return circles(spark.createDataFrame(rows, "id bigint, x double, y double, radius double"))
    raise ValueError(f"shapes can't mix {sorted(kinds)}")


def raster(df: DataFrame, dims: tuple[str, ...], sizes: dict[int, dict[str, int]] | dict[str, int], channels: list | None = None, transforms: dict[str, Transform] | None = None) -> Element:
    """An image (dims with ``c``) or labels (without) from a pixel table."""
    dims = tuple(dims)
    if dims not in (("c", "y", "x"), ("c", "z", "y", "x"), ("y", "x"), ("z", "y", "x")):
        raise ValueError(f"dims {dims} are not those of an image or of labels")
    kind = "image" if "c" in dims else "labels"
    if kind == "labels" and dict(df.dtypes)["value"] not in ("tinyint", "smallint", "int", "bigint", "boolean"):
        raise ValueError("labels must be integers or booleans")
    if "scale" not in df.columns:
        df = df.withColumn("scale", F.lit(0))
    if not all(isinstance(k, int) for k in sizes):
        sizes = {0: sizes}
    if channels is not None and len(set(channels)) != len(channels):
        raise ValueError("channel names must differ")
    return Element(kind, df.select("scale", *dims, "value"), _transforms(transforms), {"dims": dims, "sizes": sizes, "channels": channels})


def raster_from_array(spark: SparkSession, a: np.ndarray, dims: tuple[str, ...], **options) -> Element:
    """From a NumPy array with axes in the order of ``dims``; stored as (c, z, y, x)."""
    order = tuple(d for d in AXES if d in dims)
    a = np.transpose(a, [dims.index(d) for d in order])
    where = [i.reshape(-1) for i in np.indices(a.shape)]
    import pandas as pd

    flat = a.reshape(-1)
    flat = flat.astype(np.int64 if np.issubdtype(a.dtype, np.integer) or a.dtype == bool else np.float64)
    df = spark.createDataFrame(pd.DataFrame({**{d: w.astype(np.int32) for d, w in zip(order, where)}, "value": flat}))
    channels = options.pop("channels", list(range(a.shape[0])) if "c" in order else None)
    return raster(df, order, {d: int(n) for d, n in zip(order, a.shape) if d != "c"}, channels, **options)


def table(obs: DataFrame, var: DataFrame | None = None, x: DataFrame | None = None, region: str | list[str] | None = None, region_key: str | None = None, instance_key: str | None = None, check: bool = True) -> Table:
    """A table; with keys it annotates elements. ``check`` runs the uniqueness test of instances within regions."""
    given = [region is not None, region_key is not None, instance_key is not None]
    if any(given) and not all(given):
        raise ValueError("region, region_key and instance_key go together")
    if all(given):
        region = [region] if isinstance(region, str) else list(region)
        for k in (region_key, instance_key):
            if k not in obs.columns:
                raise ValueError(f"obs has no column {k!r}")
        if dict(obs.dtypes)[instance_key] not in INSTANCE_TYPES:
            raise ValueError(f"{instance_key!r} must be integers or text")
        if check:
            keys = obs.groupBy(region_key, instance_key).count()
            bad = keys.agg(F.max("count").alias("n"), F.count_if(F.col(instance_key).isNull()).alias("nulls"), F.collect_set(region_key).alias("r")).first()
            if bad.nulls:
                raise ValueError(f"{instance_key!r} has nulls")
            if (bad.n or 0) > 1:
                raise ValueError("instances must be unique within a region")
            if set(bad.r) != set(region):
                raise ValueError(f"regions {sorted(bad.r)} in the rows, {sorted(region)} declared")
    check_names(obs.columns, columns=True)
    return Table(obs, var, x, region, region_key, instance_key)


def validate(e: Element) -> str:
    """The element's kind, after checks of its structure."""
    need = {"points": {"id", "x", "y"}, "shapes": {"id", "x", "y", "radius"} if e.is_circles else {"id", "geom"}, "image": {"scale", "c", "y", "x", "value"}, "labels": {"scale", "y", "x", "value"}}
    if e.kind not in need:
        raise ValueError(f"unknown kind {e.kind!r}")
    if missing := need[e.kind] - set(e.df.columns):
        raise ValueError(f"{e.kind} without {sorted(missing)}")
    if not e.transforms:
        raise ValueError("an element needs a transform")
    return e.kind


def channel_names(e: Element) -> list:
    return list(e.attrs.get("channels") or range(e.df.select(F.max("c")).first()[0] + 1))


def set_channel_names(e: Element, names: list) -> Element:
    if len(names) != len(channel_names(e)) or len(set(names)) != len(names):
        raise ValueError("as many different names as channels are needed")
    return e.with_df(e.df, channels=list(names))
