"""Aggregation of points or shapes by shapes, and of images by labels.

Vector pairs meet by grid cells: regions are laid over the cells they touch, values lie in one cell (points) or are
laid over cells too, and the pair is kept only in the first cell both touch. The cell join is an equality join, so
it shuffles by cell, splits hot cells, and never compares all pairs.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import geometry as G
from tessera.functions import kernels as K
from tessera.model import GLOBAL, Element, Table, known_categories
from tessera.operators.spatial import as_polygons, is_box, shapes_meet
from tessera.operators.transform import transform


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


#: No shape is laid over more cells than this along an axis.
SPREAD = 256


def cell_size(cell: float | None, *shapes: DataFrame) -> float:
    """The largest mean longer side of the tables' boxes, or what keeps the longest of all within ``SPREAD`` cells."""
    if cell:
        return float(cell)
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    found = [df.agg(F.avg(side).alias("mean"), F.max(side).alias("longest")).first() for df in shapes]
    size = max([v for r in found for v in (r.mean, r.longest / SPREAD if r.longest else 0.0) if v and math.isfinite(v)], default=0.0)
    return float(size) if size > 0 else 1.0


#: Regions laid over cells are broadcast only while their measured size is below this.
BROADCAST_BYTES = 32 << 20


def _laid(regions: DataFrame, bounds: tuple[str, str, str, str], size: float, geom: str) -> DataFrame:
    """Regions over the cells that they touch; broadcast if they are small, else hot cells are split by the join."""
    a, b, c, d = bounds
    vertices = F.size("edges") if "edges" in regions.columns else F.aggregate(F.flatten(F.col(geom)), F.lit(0), lambda n, ring: n + F.size(ring))
    cells = (F.floor((F.col(c) - F.col(a)) / size) + 2) * (F.floor((F.col(d) - F.col(b)) / size) + 2)
    total = regions.agg(F.sum(cells * (vertices * 48 + 160))).first()[0] or 0
    laid = regions.withColumn("_cx", _cells(F.col(a), F.col(c), size)).withColumn("_cy", _cells(F.col(b), F.col(d), size))
    return F.broadcast(laid) if total <= BROADCAST_BYTES else laid


def points_in_regions(points: DataFrame, regions: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs of points (x, y, ...) and regions (region_id, geom, minx .. maxy) that hold them, boundary included."""
    size = cell_size(cell, regions)
    r = regions.withColumns({"edges": G.edges(F.col("geom")), "_box": is_box()}).drop("geom")
    r = _laid(r, ("minx", "miny", "maxx", "maxy"), size, "geom")
    p = points.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    pairs = p.join(r, ["_cx", "_cy"]).where("x >= minx and x <= maxx and y >= miny and y <= maxy")
    # a region that is its own box needs no other test
    pairs = pairs.where(F.when(F.col("_box"), True).otherwise(G.point_in(F.col("x"), F.col("y"), F.col("edges"))))
    return pairs.drop("edges", "_box", "_cx", "_cy", "minx", "miny", "maxx", "maxy")


@F.arrow_udf(DoubleType())
def _shared_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Null geometries are pairs that were settled before."""
    return pa.array([0.0 if x is None else K.intersection_area(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def regions_meeting(values: DataFrame, regions: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs of shapes and regions whose boxes meet; each pair once.

    With both geometries (geom, region_geom), whether both are their bounding boxes, and the area these share.
    """
    size = cell_size(cell, regions, values)
    r = regions.select("region_id", F.col("geom").alias("region_geom"), *(F.col(c).alias(f"r_{c}") for c in ("minx", "miny", "maxx", "maxy")))
    r = r.withColumn("_r_box", is_box("region_geom", "r_"))
    values = values.withColumn("_box", is_box())
    r = _laid(r, ("r_minx", "r_miny", "r_maxx", "r_maxy"), size, "region_geom")
    v = values.withColumn("_cx", _cells(F.col("minx"), F.col("maxx"), size)).withColumn("_cy", _cells(F.col("miny"), F.col("maxy"), size))
    pairs = v.join(r, ["_cx", "_cy"]).where("minx <= r_maxx and maxx >= r_minx and miny <= r_maxy and maxy >= r_miny")
    first = (F.col("_cx") == F.floor(F.greatest("minx", "r_minx") / size)) & (F.col("_cy") == F.floor(F.greatest("miny", "r_miny") / size))
    shared = (F.least("maxx", "r_maxx") - F.greatest("minx", "r_minx")) * (F.least("maxy", "r_maxy") - F.greatest("miny", "r_miny"))
    pairs = pairs.where(first).withColumns({"boxes": F.col("_box") & F.col("_r_box"), "box_area": shared})
    return pairs.drop("_cx", "_cy", "_box", "_r_box", "r_minx", "r_miny", "r_maxx", "r_maxy")


#: Aggregate functions by name; a callable from a column to a column is taken too.
FUNCTIONS = {
    "sum": F.sum,
    "mean": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": F.median,
    "first": F.first,
}


def aggregate_pairs(values: Element, by: Element, keys: list[str], fractions: bool = False, cell: float | None = None, quad: int = 16) -> DataFrame:
    """(region_id, id, keys, fraction): a row for each value in each region."""
    regions = as_polygons(by, quad).df.select(F.col("id").alias("region_id"), "geom", "minx", "miny", "maxx", "maxy")
    if values.kind == "points":
        if fractions:
            raise ValueError("points have no area to take fractions of")
        return points_in_regions(values.df.select("id", "x", "y", *keys), regions, cell).withColumn("fraction", F.lit(1.0))
    own = as_polygons(values, quad).df.select("id", "geom", "minx", "miny", "maxx", "maxy", *keys)
    pairs = regions_meeting(own, regions, cell)
    # only pairs that aren't two boxes need their geometry compared
    unsettled = [F.when(~F.col("boxes"), F.col(g)) for g in ("geom", "region_geom")]
    if fractions:
        area = F.when(F.col("boxes"), F.col("box_area")).otherwise(_shared_area(*unsettled))
        pairs = pairs.withColumn("fraction", area / G.area(F.col("geom"))).where("fraction > 0")
    else:
        pairs = pairs.where(F.col("boxes") | shapes_meet(*unsettled)).withColumn("fraction", F.lit(1.0))
    return pairs.drop("geom", "region_geom", "boxes", "box_area", "minx", "miny", "maxx", "maxy")


def aggregate_shapes(values: Element, by: Element, value_key: str | list[str] | None = None, agg_func="sum", cs: str = GLOBAL, fractions: bool = False, categorical: bool | None = None, fill: bool = True, cell: float | None = None, quad: int = 16) -> DataFrame:
    """(region_id, a column for each value key or category): one row for every region, 0 where nothing is inside.

    ``fill=False`` leaves null instead of 0. A categorical key gives a column for each of its categories, seen or
    not, with counts (or sums of fractions).
    """
    if by.kind != "shapes" or values.kind not in ("points", "shapes"):
        raise NotImplementedError(f"{values.kind} by {by.kind} is not aggregated here")
    if any(not (len(e.transforms) and type(e.transforms.get(cs)).__name__ == "Identity") for e in (values, by)):
        values, by = transform(values, cs), transform(by, cs)
    if value_key is None:
        value_key = values.attrs.get("feature_key") or "_one"
    keys = [value_key] if isinstance(value_key, str) else list(value_key)
    if keys == ["_one"]:
        values = values.with_df(values.df.withColumn("_one", F.lit(1)))
    kinds = dict(values.df.dtypes)
    if categorical is None:
        categorical = kinds[keys[0]] == "string"
    name = agg_func if isinstance(agg_func, str) else "callable"
    if categorical:
        if len(keys) > 1:
            raise ValueError("one categorical key at a time")
        if name not in ("sum", "count"):
            raise ValueError(f"categories can't be aggregated by {name}")
        if fractions and name == "count":
            raise ValueError("a count of categories has no fractions")
        names = known_categories(values.df, keys[0])
        pairs = aggregate_pairs(values, by, keys, fractions, cell, quad)
        found = pairs.groupBy("region_id").pivot(keys[0], names).agg(F.sum("fraction") if fractions else F.count(F.lit(1)))
    else:
        names = keys
        pairs = aggregate_pairs(values, by, keys, fractions, cell, quad)
        func = FUNCTIONS[name] if isinstance(agg_func, str) else agg_func
        weighed = lambda k: F.col(k) * F.col("fraction") if fractions else F.col(k)
        found = pairs.groupBy("region_id").agg(*(func(weighed(k)).alias(k) for k in keys))
    out = by.df.select(F.col("id").alias("region_id")).join(found, "region_id", "left")
    if fill:
        out = out.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names})
    return out.withColumnRenamed("_one", "count")


#: Zonal statistics; spreads are those of the whole population.
ZONAL = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop, "count": F.count}


def zonal_stats(image: Element, labels: Element, stats: tuple[str, ...] = ("mean", "max", "min", "sum", "std", "var", "count"), zones: list[int] | None = None) -> DataFrame:
    """(zone, channel_{c}_{stat}) over the pixels of each label but 0; both rasters on one grid."""
    if image.size() != labels.size():
        raise ValueError("image and labels have different sizes")
    axes = [a for a in labels.attrs["dims"]]
    zone = labels.df.where("scale = 0 and value <> 0").select(*axes, F.col("value").alias("zone"))
    if zones is not None:
        zone = zone.where(F.col("zone").isin(zones))
    pixels = image.df.where("scale = 0").join(zone, axes)
    channels = image.attrs.get("channels") or [r[0] for r in image.df.select("c").distinct().orderBy("c").collect()]
    wide = pixels.groupBy("zone").agg(*(ZONAL[s](F.when(F.col("c") == i, F.col("value"))).alias(f"channel_{n}_{s}") for i, n in enumerate(channels) for s in stats))
    return wide


def as_table(found: DataFrame, region: str, region_key: str = "region", instance_key: str = "instance_id", id_col: str = "region_id") -> Table:
    """An aggregation as a table that annotates the regions: each column is a variable."""
    names = [c for c in found.columns if c != id_col]
    spark = found.sparkSession
    rows = found.withColumn("obs_pos", F.xxhash64(F.col(id_col).cast("string")))
    obs = rows.select("obs_pos", F.col(id_col).cast("string").alias("obs_name"), F.lit(region).alias(region_key), F.col(id_col).alias(instance_key))
    var = spark.createDataFrame(list(enumerate(names)), "var_pos int, var_name string")
    cells = F.array(*(F.struct(F.lit(i).alias("var_pos"), F.col(f"`{n}`").cast("double").alias("value")) for i, n in enumerate(names)))
    x = rows.select("obs_pos", F.explode(cells).alias("e")).select("obs_pos", "e.var_pos", F.lit(None).cast("string").alias("layer"), "e.value")
    return Table(obs, var, x.where("value <> 0"), [region], region_key, instance_key)


def aggregate(values: Element, by: Element, by_name: str = "by", **options) -> Table:
    """Either kind of aggregation, as a table that annotates ``by``."""
    if by.kind == "labels" and values.kind == "image":
        agg = options.get("agg_func", "sum")
        return as_table(zonal_stats(values, by, (agg,) if isinstance(agg, str) else tuple(agg), options.get("zones")), by_name, id_col="zone")
    return as_table(aggregate_shapes(values, by, **options), by_name)
