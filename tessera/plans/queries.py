"""A query for each operator over the common tables, and the SQL that gives the same rows.

Geometry is derived from keys with exact arithmetic, so both engines see the same coordinates.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model as M
from tessera.container import Dataset, concat_tables, concatenate
from tessera.functions import geometry as G
from tessera.operators import aggregate as A
from tessera.operators import extent as X
from tessera.operators import raster as P
from tessera.operators import relational as R
from tessera.operators import spatial as S
from tessera.operators import transform as T
from tessera.sources import store
from tessera.transforms import Affine, Scale, Sequence, Translation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- elements from the tables ---------------------------------------------------------------------------------------


def item_points(spark: SparkSession, d: str, **transforms) -> M.Element:
    df = read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_quantity").alias("x"),
        (F.col("l_partkey") % 50).cast("double").alias("y"),
        "l_returnflag",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
    )
    return M.points(M.as_category(df, "l_returnflag", ["A", "N", "R", "X"]), feature_key="l_returnflag", transforms=transforms or None)


ITEMS = "items AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, CAST(l_partkey % 50 AS DOUBLE) AS y, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM lineitem)"


def event_points(spark: SparkSession, d: str) -> M.Element:
    df = read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).cast("double").alias("x"), F.hour("ts").cast("double").alias("y"), "event_type", F.col("value").cast("decimal(18,6)").alias("value"))
    return M.points(df, feature_key="event_type")


EVENTS = "ev AS (SELECT event_id AS id, CAST(user_id % 10 AS DOUBLE) AS x, CAST(hour(ts) AS DOUBLE) AS y, event_type, CAST(value AS DECIMAL(18,6)) AS value FROM events)"


def part_circles(spark: SparkSession, d: str) -> M.Element:
    df = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).cast("double").alias("x"), (F.floor(F.col("p_partkey") / 100) % 100).cast("double").alias("y"), (F.col("p_size") / 8.0).alias("radius"), "p_size")
    return M.circles(df)


PARTS = "parts AS (SELECT p_partkey AS id, CAST(p_partkey % 100 AS DOUBLE) AS x, CAST((p_partkey // 100) % 100 AS DOUBLE) AS y, p_size / 8.0 AS radius, p_size FROM part)"


def supplier_squares(spark: SparkSession, d: str) -> M.Element:
    k = F.col("s_suppkey")
    cx, cy, h = (k % 20) * 5, (F.floor(k / 20) % 20) * 5, F.col("s_nationkey") % 4 + 1
    df = read(spark, d, "supplier").select(k.alias("id"), G.box_geom(cx - h, cy - h, cx + h, cy + h).alias("geom"), F.concat(F.lit("k"), (F.col("s_nationkey") % 3).cast("string")).alias("kind"), (F.col("s_nationkey") + 1).cast("double").alias("weight"))
    return M.polygons(M.as_category(df, "kind", ["k0", "k1", "k2", "k3"]))


SQUARES = "squares AS (SELECT id, cx - h AS minx, cy - h AS miny, cx + h AS maxx, cy + h AS maxy, kind, weight FROM (SELECT s_suppkey AS id, CAST((s_suppkey % 20) * 5 AS DOUBLE) AS cx, CAST(((s_suppkey // 20) % 20) * 5 AS DOUBLE) AS cy, CAST(s_nationkey % 4 + 1 AS DOUBLE) AS h, 'k' || CAST(s_nationkey % 3 AS VARCHAR) AS kind, CAST(s_nationkey + 1 AS DOUBLE) AS weight FROM supplier))"


def nation_grid(spark: SparkSession, d: str, side: float = 10.0) -> M.Element:
    k = F.col("n_nationkey")
    x, y = (k % 5) * side, F.floor(k / 5) * side
    return M.polygons(read(spark, d, "nation").select(k.cast("long").alias("id"), G.box_geom(x, y, x + side, y + side).alias("geom")))


def grid_sql(side: float = 10.0) -> str:
    return f"grid AS (SELECT CAST(n_nationkey AS BIGINT) AS region_id, (n_nationkey % 5) * {side} AS x0, (n_nationkey // 5) * {side} AS y0, (n_nationkey % 5) * {side} + {side} AS x1, (n_nationkey // 5) * {side} + {side} AS y1 FROM nation)"


def part_raster(spark: SparkSession, d: str) -> M.Element:
    """One pixel for each part: y = key / 100, x = key % 100."""
    df = read(spark, d, "part").select(F.lit(0).alias("c"), F.floor(F.col("p_partkey") / 100).cast("int").alias("y"), (F.col("p_partkey") % 100).cast("int").alias("x"), F.col("p_size").cast("double").alias("value"))
    top = df.agg(F.max("y")).first()[0] or 0
    return M.raster(df, ("c", "y", "x"), {"y": int(top) + 1, "x": 100}, [0])


def part_labels(spark: SparkSession, d: str) -> M.Element:
    e = part_raster(spark, d)
    return M.raster(e.df.select("scale", "y", "x", F.col("value").cast("long").alias("value")), ("y", "x"), e.size())


PIXELS = "px AS (SELECT CAST(p_partkey // 100 AS INTEGER) AS y, CAST(p_partkey % 100 AS INTEGER) AS x, CAST(p_size AS DOUBLE) AS value FROM part)"


def blocks(spark: SparkSession, d: str, side: int = 4) -> M.Element:
    """Labels in solid blocks over the parts' grid."""
    e = part_raster(spark, d)
    value = F.floor(F.col("y") / side) * 25 + F.floor(F.col("x") / side) + 1
    return M.raster(e.df.select("scale", "y", "x", value.cast("long").alias("value")), ("y", "x"), e.size())


BLOCKS = "bl AS (SELECT y, x, value AS v, CAST((y // 4) * 25 + x // 4 + 1 AS BIGINT) AS label FROM px)"


def order_element(spark: SparkSession, d: str) -> M.Element:
    o = read(spark, d, "orders").where("o_orderstatus <> 'F'")
    return M.points(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"), F.col("o_custkey").alias("pos")))


def item_table(spark: SparkSession, d: str) -> M.Table:
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    obs = g.select(F.col("l_orderkey").alias("obs_pos"), F.lit("orders").alias("region"), F.col("l_orderkey").alias("instance_id"), "n_items", "quantity")
    return M.table(obs, region="orders", region_key="region", instance_key="instance_id", check=False)


ORDERS = "el AS (SELECT o_orderkey AS id, o_custkey AS pos FROM orders WHERE o_orderstatus <> 'F'), tab AS (SELECT l_orderkey AS instance_id, count(*) AS n_items, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_orderkey)"


def customer_data(spark: SparkSession, d: str) -> Dataset:
    """Customers as points, annotated by a table whose variables are statistics of their orders."""
    c = read(spark, d, "customer")
    obs = c.select(F.col("c_custkey").alias("obs_pos"), F.lit("customers").alias("region"), F.col("c_custkey").alias("instance_id"), "c_acctbal", "c_mktsegment")
    stats = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("obs_pos"), "o_orderstatus").agg(F.count("*").cast("double").alias("value"))
    var = spark.createDataFrame([(0, "F", "done"), (1, "O", "open"), (2, "P", "open")], "var_pos int, var_name string, state string")
    x = stats.join(F.broadcast(var), stats["o_orderstatus"] == var["var_name"]).select("obs_pos", "var_pos", F.lit(None).cast("string").alias("layer"), "value")
    t = M.table(obs, var, x, "customers", "region", "instance_id", check=False)
    e = M.points(c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y")))
    return Dataset({"customers": e}, {"stats": t})


# -- box and polygon queries ----------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT id, x, y FROM items WHERE x > 10 AND x < 20 AND y > 5 AND y < 25")
def bbox_points(spark, d):
    return S.bounding_box_query(item_points(spark, d), S.BoundingBox(("x", "y"), (10, 5), (20, 25))).df.select("id", "x", "y")


@query(f"WITH {ITEMS}, b(box_id, x0, y0, x1, y1) AS (VALUES (0, 0, 0, 10, 10), (1, 5, 5, 30, 12), (2, 60, 0, 70, 9)) SELECT CAST(box_id AS INTEGER) AS box_id, id, x, y FROM items, b WHERE x > x0 AND x < x1 AND y > y0 AND y < y1")
def bbox_points_multi(spark, d):
    boxes = [S.BoundingBox(("x", "y"), (0, 0), (10, 10)), S.BoundingBox(("x", "y"), (5, 5), (30, 12)), S.BoundingBox(("x", "y"), (60, 0), (70, 9))]
    return S.points_in_boxes(item_points(spark, d), boxes).select("box_id", "id", "x", "y")


@query(f"WITH {ITEMS} SELECT id, x, y FROM items WHERE x + 2 * y + 3 > 30 AND x + 2 * y + 3 < 60 AND y - x > -10 AND y - x < 4")
def bbox_affine(spark, d):
    t = Affine([[1, 2, 3], [-1, 1, 0], [0, 0, 1]], ("x", "y"), ("x", "y"))
    return S.bounding_box_query(item_points(spark, d, **{"global": t}), S.BoundingBox(("x", "y"), (30, -10), (60, 4))).df.select("id", "x", "y")


@query(f"WITH {ITEMS} SELECT id, x, y FROM items WHERE -2 * x > -60 AND -2 * x < -20 AND y / 2 + 1 > 3 AND y / 2 + 1 < 10")
def bbox_negscale(spark, d):
    t = Sequence([Scale([-2, 0.5], ("x", "y")), Translation([1], ("y",))])
    return S.bounding_box_query(item_points(spark, d, **{"global": t}), S.BoundingBox(("x", "y"), (-60, 3), (-20, 10))).df.select("id", "x", "y")


RING = [(5, 5), (45, 5), (45, 45), (25, 20), (5, 45), (5, 5)]


def _ray_sql(points: str, ring: list) -> str:
    edges = ", ".join(f"({a[0]}.0, {a[1]}.0, {b[0]}.0, {b[1]}.0)" for a, b in zip(ring, ring[1:]))
    return f"""e AS (SELECT CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM (VALUES {edges}) v(x1, y1, x2, y2)),
        xy AS (SELECT DISTINCT x, y FROM {points}), hit AS (SELECT x, y FROM xy, e GROUP BY x, y HAVING
        sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1
        OR max(CASE WHEN (x - x1) * (y2 - y1) = (y - y1) * (x2 - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 1)"""


@query(f"WITH {ITEMS}, {_ray_sql('items', RING)} SELECT id, items.x, items.y FROM items JOIN hit ON items.x = hit.x AND items.y = hit.y")
def polygon_query_points(spark, d):
    return S.polygon_query(item_points(spark, d), [[RING]]).df.select("id", "x", "y")


@query(f"WITH {SQUARES} SELECT id FROM squares WHERE minx <= 42 AND maxx >= 20 AND miny <= 33 AND maxy >= 10")
def bbox_shapes(spark, d):
    return S.bounding_box_query(supplier_squares(spark, d), S.BoundingBox(("x", "y"), (20, 10), (42, 33))).df.select("id")


@query(f"WITH {PARTS} SELECT id, x, y, radius FROM parts WHERE x BETWEEN 20 AND 42 AND y BETWEEN 1 AND 33")
def bbox_circles(spark, d):
    return S.bounding_box_query(part_circles(spark, d), S.BoundingBox(("x", "y"), (20, 1), (42, 33))).df.select("id", "x", "y", "radius")


@query(f"WITH {SQUARES} SELECT id FROM squares WHERE greatest(0, minx - 50, 50 - maxx) + greatest(0, miny - 30, 30 - maxy) <= 20")
def polygon_query_shapes(spark, d):
    diamond = [(30, 30), (50, 10), (70, 30), (50, 50), (30, 30)]
    return S.polygon_query(supplier_squares(spark, d), [[diamond]]).df.select("id")


@query(f"WITH {PARTS} SELECT id FROM parts WHERE x - radius <= 30 AND x + radius >= 12")
def polygon_query_circles(spark, d):
    return S.polygon_query(part_circles(spark, d), [[[(12, -999), (30, -999), (30, 999), (12, 999), (12, -999)]]]).df.select("id")


@query(f"WITH {SQUARES} SELECT id, (least(maxx, 42) - greatest(minx, 20)) * (least(maxy, 33) - greatest(miny, 10)) AS area FROM squares WHERE minx < 42 AND maxx > 20 AND miny < 33 AND maxy > 10")
def polygon_query_clip(spark, d):
    box = [(20, 10), (42, 10), (42, 33), (20, 33), (20, 10)]
    return S.polygon_query(supplier_squares(spark, d), [[box]], clip=True).df.select("id", F.round(G.area(F.col("geom")), 6).alias("area"))


@query(f"WITH {PIXELS} SELECT y, CAST(x - 10 AS INTEGER) AS x, value FROM px WHERE x + 0.5 BETWEEN 10.2 AND 40.5 AND y + 0.5 BETWEEN 0.3 AND 15.9")
def bbox_raster(spark, d):
    return S.bounding_box_query(part_raster(spark, d), S.BoundingBox(("x", "y"), (10.2, 0.3), (40.5, 15.9))).df.select("y", "x", "value")


@query("SELECT c_custkey AS instance_id, c_acctbal FROM customer WHERE c_custkey > 100 AND c_custkey < 900 AND c_nationkey > 3 AND c_nationkey < 20")
def query_dataset_tables(spark, d):
    """A box over the dataset filters the table that annotates the points."""
    found = customer_data(spark, d).query(S.BoundingBox(("x", "y"), (100, 3), (900, 20)))
    return found.tables["stats"].obs.select("instance_id", "c_acctbal")


# -- joins ----------------------------------------------------------------------------------------------------------


def _joined(spark, d, how, **options):
    return R.join_elements_table({"orders": order_element(spark, d)}, item_table(spark, d), how, **options)


@query(f"WITH {ORDERS} SELECT instance_id, n_items, quantity FROM tab WHERE instance_id IN (SELECT id FROM el)")
def join_left(spark, d):
    return _joined(spark, d, "left")[1].obs.select("instance_id", "n_items", "quantity")


@query(f"WITH {ORDERS} SELECT id FROM el WHERE id NOT IN (SELECT instance_id FROM tab)")
def join_left_exclusive(spark, d):
    return _joined(spark, d, "left_exclusive")[0]["orders"].df.select("id")


@query(f"WITH {ORDERS} SELECT 'element' AS side, id FROM el WHERE id IN (SELECT instance_id FROM tab) UNION ALL SELECT 'table', instance_id FROM tab WHERE instance_id IN (SELECT id FROM el)")
def join_inner(spark, d):
    sides, t = _joined(spark, d, "inner", match_rows="left")
    return sides["orders"].df.select(F.lit("element").alias("side"), "id").union(t.obs.select(F.lit("table"), "instance_id"))


@query(f"WITH {ORDERS} SELECT 'element' AS side, id FROM el WHERE id IN (SELECT instance_id FROM tab) UNION ALL SELECT 'table', instance_id FROM tab")
def join_right(spark, d):
    sides, t = _joined(spark, d, "right")
    return sides["orders"].df.select(F.lit("element").alias("side"), "id").union(t.obs.select(F.lit("table"), "instance_id"))


@query(f"WITH {ORDERS} SELECT instance_id, n_items FROM tab WHERE instance_id NOT IN (SELECT id FROM el)")
def join_right_exclusive(spark, d):
    return _joined(spark, d, "right_exclusive")[1].obs.select("instance_id", "n_items")


@query(f"WITH {ORDERS} SELECT instance_id, pos FROM tab JOIN el ON id = instance_id")
def match_rows_left(spark, d):
    """The table in the order of the element: each row with the position it takes its place from."""
    e = order_element(spark, d)
    t = R.match_table_to_element("orders", e, item_table(spark, d))
    return t.obs.join(e.df.select(F.col("id").alias("instance_id"), "pos"), "instance_id").select("instance_id", "pos")


@query(f"WITH {ORDERS} SELECT id, instance_id AS obs_pos FROM tab JOIN el ON id = instance_id")
def match_rows_right(spark, d):
    t = item_table(spark, d)
    sides, t = R.match_element_to_table({"orders": order_element(spark, d)}, t)
    return sides["orders"].df.select("id").join(t.obs.select(F.col("instance_id").alias("id"), "obs_pos"), "id")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 1000 AND c_mktsegment LIKE 'B%' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) >= 3)")
def filter_by_table_query(spark, d):
    ds = customer_data(spark, d).filter_by_table("stats", obs=(F.col("c_acctbal") > 1000) & F.col("c_mktsegment").startswith("B"), x=F.col("O") >= 3, x_names=["O"])
    return ds.elements["customers"].df.select("id")


@query("SELECT o_custkey AS obs_pos, sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END)::DOUBLE AS n_open FROM orders GROUP BY 1 HAVING sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) > 0")
def filter_table_vars(spark, d):
    t = R.filter_rows(customer_data(spark, d).tables["stats"], var=F.col("state") == "open")
    return t.x.groupBy("obs_pos").agg(F.sum("value").alias("n_open"))


@query('SELECT c_custkey AS instance_id, coalesce(f, 0)::DOUBLE AS "F", coalesce(o, 0)::DOUBLE AS "O" FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = \'F\') AS f, count(*) FILTER (o_orderstatus = \'O\') AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey')
def get_values_var(spark, d):
    return R.get_values(["F", "O"], t=customer_data(spark, d).tables["stats"])


@query("SELECT c_custkey AS instance_id, c_acctbal, c_mktsegment FROM customer")
def get_values_obs(spark, d):
    return R.get_values(["c_acctbal", "c_mktsegment"], t=customer_data(spark, d).tables["stats"])


@query("SELECT vec_id AS instance_id, CAST(embedding[1] AS DOUBLE) AS e_0, CAST(embedding[64] AS DOUBLE) AS e_63 FROM embeddings")
def get_values_obsm(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("obs_pos"), F.lit("v").alias("region"), F.col("vec_id").alias("instance_id"), F.col("embedding").alias("e"))
    found = R.get_values("e", t=M.table(e, region="v", region_key="region", instance_key="instance_id", check=False))
    return found.select("instance_id", F.col("e_0").cast("double").alias("e_0"), F.col("e_63").cast("double").alias("e_63"))


@query(f"WITH {PARTS} SELECT id AS instance_id, p_size FROM parts")
def get_values_df(spark, d):
    return R.get_values("p_size", part_circles(spark, d))


@query("SELECT DISTINCT CAST(p_size AS BIGINT) AS instance_id FROM part WHERE p_size <> 0")
def element_instances(spark, d):
    return R.instances(part_labels(spark, d))


@query(f"WITH {PIXELS} SELECT y, x, CAST(CASE WHEN value IN (SELECT n_nationkey FROM nation) THEN value ELSE 0 END AS BIGINT) AS value FROM px")
def filter_label_pixels(spark, d):
    ids = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("instance_id"))
    return R.filter_pixels(part_labels(spark, d), ids).df.select("y", "x", "value")


@query("SELECT 'customers' AS element, 'stats' AS annotator")
def element_annotators(spark, d):
    found = customer_data(spark, d).annotators("customers")
    return spark.range(1).select(F.lit("customers").alias("element"), F.explode(F.array(*map(F.lit, sorted(found)))).alias("annotator"))


@query("SELECT DISTINCT 'customers' AS region FROM customer")
def annotated_regions(spark, d):
    return R.annotated_regions(customer_data(spark, d).tables["stats"])


@query("SELECT c_custkey AS instance_id FROM customer")
def subset_dataset(spark, d):
    ds = customer_data(spark, d)
    ds["items"] = item_points(spark, d)
    return ds.subset(["customers"]).tables["stats"].obs.select("instance_id")


@query("SELECT c_custkey AS id FROM customer")
def filter_by_coordinate_system(spark, d):
    ds = customer_data(spark, d)
    ds["items"] = item_points(spark, d, other=Scale([2, 2], ("x", "y")))
    kept = ds.filter_by_coordinate_system("global")
    if list(kept.elements) != ["customers"]:
        raise AssertionError("elements of another coordinate system were kept")
    return kept.elements["customers"].df.select("id")


# -- aggregation ----------------------------------------------------------------------------------------------------

_IN_GRID = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"


@query(f"WITH {ITEMS}, {grid_sql()}, j AS (SELECT * FROM items JOIN grid ON {_IN_GRID}) SELECT g.region_id, CAST(coalesce(sum(j.price), 0) AS DOUBLE) AS price FROM grid g LEFT JOIN j ON j.region_id = g.region_id GROUP BY 1")
def agg_points_sum(spark, d):
    """The flagship: points under a scale, summed by the regions of a grid, with every region in the result."""
    t = Scale([2.0, 2.0], ("x", "y"))
    values, by = item_points(spark, d, **{"global": t}), nation_grid(spark, d, 20.0)
    return A.aggregate_shapes(values, by, "price", "sum").select("region_id", F.col("price").cast("double").alias("price"))


def _agg_sql(select: str) -> str:
    return f"WITH {EVENTS}, {grid_sql(4.0)}, j AS (SELECT * FROM ev JOIN grid ON {_IN_GRID}) SELECT g.region_id, {select} FROM grid g LEFT JOIN j ON j.region_id = g.region_id GROUP BY 1"


@query(_agg_sql("round(coalesce(CAST(sum(value) AS DOUBLE) / count(value), 0), 6) AS mean, coalesce(CAST(min(value) AS DOUBLE), 0) AS low, coalesce(CAST(max(value) AS DOUBLE), 0) AS high, round(coalesce(stddev_samp(CAST(value AS DOUBLE)), 0), 6) AS std, count(value) AS n"))
def agg_points_stats(spark, d):
    values, by = event_points(spark, d), nation_grid(spark, d, 4.0)
    num = values.with_df(values.df.withColumn("value", F.col("value").cast("double")))
    parts = {"mean": "mean", "low": "min", "high": "max", "std": "std", "n": "count"}
    out = None
    for name, f in parts.items():
        one = A.aggregate_shapes(num, by, "value", f).select("region_id", F.col("value").alias(name))
        out = one if out is None else out.join(one, "region_id")
    return out.select("region_id", F.round("mean", 6).alias("mean"), "low", "high", F.round("std", 6).alias("std"), "n")


@query(_agg_sql("count(CASE WHEN event_type = 'click' THEN 1 END) AS click, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase, count(CASE WHEN event_type = 'none' THEN 1 END) AS none"))
def agg_points_categorical(spark, d):
    values = event_points(spark, d)
    values = values.with_df(M.as_category(values.df.where("event_type in ('click', 'purchase')"), "event_type", ["click", "purchase", "none"]))
    return A.aggregate_shapes(values, nation_grid(spark, d, 4.0))


@query(_agg_sql("count(j.id) AS count"))
def agg_points_count(spark, d):
    values = event_points(spark, d)
    values.attrs["feature_key"] = None
    return A.aggregate_shapes(values, nation_grid(spark, d, 4.0))


@query(f"WITH {ITEMS}, {grid_sql()}, j AS (SELECT * FROM items JOIN grid ON {_IN_GRID}) SELECT g.region_id, CAST(coalesce(sum(j.price), 0) AS DOUBLE) AS price, CAST(coalesce(sum(j.quantity), 0) AS DOUBLE) AS quantity FROM grid g LEFT JOIN j ON j.region_id = g.region_id GROUP BY 1")
def agg_points_multi(spark, d):
    found = A.aggregate_shapes(item_points(spark, d), nation_grid(spark, d), ["price", "quantity"], "sum")
    return found.select("region_id", F.col("price").cast("double").alias("price"), F.col("quantity").cast("double").alias("quantity"))


@query(f"WITH {EVENTS}, {grid_sql(4.0)}, j AS (SELECT * FROM ev JOIN grid ON {_IN_GRID}) SELECT g.region_id, CAST(coalesce(max(value) - min(value), 0) AS DOUBLE) AS value FROM grid g LEFT JOIN j ON j.region_id = g.region_id GROUP BY 1")
def agg_points_callable(spark, d):
    found = A.aggregate_shapes(event_points(spark, d), nation_grid(spark, d, 4.0), "value", lambda c: F.max(c) - F.min(c))
    return found.select("region_id", F.col("value").cast("double").alias("value"))


_MEET = "minx <= x1 AND maxx >= x0 AND miny <= y1 AND maxy >= y0"


@query(f"WITH {SQUARES}, {grid_sql(20.0)}, j AS (SELECT * FROM squares JOIN grid ON {_MEET}) SELECT g.region_id, count(CASE WHEN kind = 'k0' THEN 1 END) AS k0, count(CASE WHEN kind = 'k1' THEN 1 END) AS k1, count(CASE WHEN kind = 'k2' THEN 1 END) AS k2, count(CASE WHEN kind = 'k3' THEN 1 END) AS k3 FROM grid g LEFT JOIN j ON j.region_id = g.region_id GROUP BY 1")
def agg_shapes_categorical(spark, d):
    return A.aggregate_shapes(supplier_squares(spark, d), nation_grid(spark, d, 20.0), "kind")


@query(f"WITH {SQUARES}, {grid_sql(20.0)}, j AS (SELECT region_id, weight * greatest(0, least(maxx, x1) - greatest(minx, x0)) * greatest(0, least(maxy, y1) - greatest(miny, y0)) / ((maxx - minx) * (maxy - miny)) AS w FROM squares JOIN grid ON {_MEET}) SELECT g.region_id, round(coalesce(sum(w), 0), 6) AS weight FROM grid g LEFT JOIN j ON j.region_id = g.region_id GROUP BY 1")
def agg_fractions(spark, d):
    return A.aggregate_shapes(supplier_squares(spark, d), nation_grid(spark, d, 20.0), "weight", "sum", fractions=True).select("region_id", F.round("weight", 6).alias("weight"))


@query(f"WITH {EVENTS}, {grid_sql(4.0)}, j AS (SELECT * FROM ev JOIN grid ON {_IN_GRID}) SELECT region_id AS instance_id, 'cells' AS region, count(*)::DOUBLE AS value FROM j GROUP BY 1")
def agg_as_table(spark, d):
    values = event_points(spark, d)
    values.attrs["feature_key"] = None
    t = A.aggregate(values, nation_grid(spark, d, 4.0), "cells")
    return t.obs.join(t.x, "obs_pos").select("instance_id", "region", "value")


@query(f"WITH {PIXELS}, {BLOCKS} SELECT label AS zone, avg(v) AS channel_0_mean, max(v) AS channel_0_max, min(v) AS channel_0_min, sum(v) AS channel_0_sum, round(stddev_pop(v), 6) AS channel_0_std, round(var_pop(v), 6) AS channel_0_var, count(v) AS channel_0_count FROM bl GROUP BY 1")
def zonal_stats(spark, d):
    z = A.zonal_stats(part_raster(spark, d), blocks(spark, d))
    return z.withColumns({f"channel_0_{s}": F.round(f"channel_0_{s}", 6) for s in ("std", "var")})


@query(f"WITH {PIXELS}, {BLOCKS} SELECT label AS zone, sum(v) AS channel_0_sum FROM bl WHERE label IN (2, 5, 30) GROUP BY 1")
def zonal_stats_zones(spark, d):
    return A.zonal_stats(part_raster(spark, d), blocks(spark, d), ("sum",), [2, 5, 30])


# -- extents and centres --------------------------------------------------------------------------------------------


def _extent_row(spark, e: X.Extent) -> DataFrame:
    return spark.range(1).select(*(F.round(F.lit(float(v)), 6).alias(f"{m}_{a}") for a, (lo, hi) in e.items() for m, v in (("min", lo), ("max", hi))))


@query(f"WITH {ITEMS} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM items")
def extent_points(spark, d):
    return X.extent_frame(item_points(spark, d))


@query(f"WITH {PARTS} SELECT min(x - radius) AS min_x, max(x + radius) AS max_x, min(y - radius) AS min_y, max(y + radius) AS max_y FROM parts")
def extent_circles(spark, d):
    return X.extent_frame(part_circles(spark, d))


@query(f"WITH {SQUARES}, c AS (SELECT minx AS x, miny AS y FROM squares UNION ALL SELECT minx, maxy FROM squares UNION ALL SELECT maxx, miny FROM squares UNION ALL SELECT maxx, maxy FROM squares) SELECT min(x + 2 * y) AS min_x, max(x + 2 * y) AS max_x, min(y - x) AS min_y, max(y - x) AS max_y FROM c")
def extent_polygons_exact(spark, d):
    e = supplier_squares(spark, d)
    e.transforms["global"] = Affine([[1, 2, 0], [-1, 1, 0], [0, 0, 1]], ("x", "y"), ("x", "y"))
    return _extent_row(spark, X.extent(e))


@query(f"WITH {SQUARES}, b AS (SELECT min(minx) AS x0, max(maxx) AS x1, min(miny) AS y0, max(maxy) AS y1 FROM squares) SELECT x0 + 2 * y0 AS min_x, x1 + 2 * y1 AS max_x, y0 - x1 AS min_y, y1 - x0 AS max_y FROM b")
def extent_polygons_inexact(spark, d):
    e = supplier_squares(spark, d)
    e.transforms["global"] = Affine([[1, 2, 0], [-1, 1, 0], [0, 0, 1]], ("x", "y"), ("x", "y"))
    return _extent_row(spark, X.extent(e, exact=False))


@query(f"WITH {ITEMS}, {PARTS}, a AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM items UNION ALL SELECT min(x - radius), max(x + radius), min(y - radius), max(y + radius) FROM parts) SELECT round(min(x0), 6) AS min_x, round(max(x1), 6) AS max_x, round(min(y0), 6) AS min_y, round(max(y1), 6) AS max_y FROM a")
def extent_dataset(spark, d):
    return _extent_row(spark, X.extent({"items": item_points(spark, d), "parts": part_circles(spark, d)}))


@query("SELECT true AS equal")
def are_extents_equal(spark, d):
    a = X.extent(part_circles(spark, d))
    b = {k: (lo + 0.05, hi) for k, (lo, hi) in a.items()}
    return spark.range(1).select(F.lit(X.extents_equal(a, b) and not X.extents_equal(a, {k: (lo - 1, hi) for k, (lo, hi) in a.items()})).alias("equal"))


@query(f"WITH {PIXELS}, {BLOCKS} SELECT label AS id, round(avg(x + 0.5), 6) AS x, round(avg(y + 0.5), 6) AS y FROM bl GROUP BY 1")
def centroid_labels(spark, d):
    return P.centroids(blocks(spark, d)).df.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {SQUARES} SELECT id, round((minx + maxx) / 2, 6) AS x, round((miny + maxy) / 2, 6) AS y FROM squares")
def centroid_polygons(spark, d):
    return P.centroids(supplier_squares(spark, d)).df.select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query(f"WITH {PARTS} SELECT id, 2 * x + 1 AS x, 3 * y AS y FROM parts")
def centroid_circles(spark, d):
    e = part_circles(spark, d)
    e.transforms["global"] = Sequence([Scale([2, 3], ("x", "y")), Translation([1, 0], ("x", "y"))])
    return P.centroids(e).df.select("id", "x", "y")


# -- transforms -----------------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT id, 2 * x + y + 1 AS x, y - 4 * x AS y FROM items")
def transform_points(spark, d):
    t = Affine([[2, 1, 1], [-4, 1, 0], [0, 0, 1]], ("x", "y"), ("x", "y"))
    return T.transform(item_points(spark, d, **{"global": t})).df.select("id", "x", "y")


@query(f"WITH {PARTS} SELECT id, -2 * x AS x, 2 * y + 5 AS y, 2 * radius AS radius FROM parts")
def transform_circles(spark, d):
    e = part_circles(spark, d)
    e.transforms["global"] = Sequence([Scale([-2, 2], ("x", "y")), Translation([5], ("y",))])
    return T.transform(e).df.select("id", (F.col("x") + 0.0).alias("x"), "y", "radius")


@query(f"WITH {SQUARES} SELECT id, -maxy AS minx, minx AS miny, -miny AS maxx, maxx AS maxy FROM squares")
def transform_polygons(spark, d):
    e = supplier_squares(spark, d)
    e.transforms["global"] = Affine([[0, -1, 0], [1, 0, 0], [0, 0, 1]], ("x", "y"), ("x", "y"))
    return T.transform(e).df.select("id", *((F.col(c) + 0.0).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


@query(f"WITH {PIXELS}, o AS (SELECT * FROM (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) SELECT CAST(2 * y + i AS INTEGER) AS y, CAST(2 * x + j AS INTEGER) AS x, value FROM px, o")
def transform_raster(spark, d):
    e = part_raster(spark, d)
    e.transforms["global"] = Scale([2, 2], ("y", "x"))
    return T.transform(e).df.where("value <> 0").select("y", "x", "value")


# -- rasters --------------------------------------------------------------------------------------------------------

_BIN = "CAST(least(floor((x - 0) * (10 / 50.0)), 9) AS INTEGER) AS x, CAST(least(floor((y - 0) * (5 / 50.0)), 4) AS INTEGER) AS y"
_BOX = {"low": (0.0, 0.0), "high": (50.0, 50.0), "size": {"x": 10, "y": 5}}


@query(f"WITH {ITEMS}, b AS (SELECT {_BIN}, price FROM items) SELECT y, x, count(*)::DOUBLE AS value FROM b GROUP BY ALL")
def rasterize_points_count(spark, d):
    return P.rasterize_points(item_points(spark, d), **_BOX).df.select("y", "x", "value")


@query(f"WITH {ITEMS}, b AS (SELECT {_BIN}, price FROM items) SELECT y, x, CAST(sum(price) AS DOUBLE) AS value FROM b GROUP BY ALL")
def rasterize_points_sum(spark, d):
    return P.rasterize_points(item_points(spark, d), **_BOX, value_key="price").df.select("y", "x", "value")


@query(f"WITH {ITEMS}, b AS (SELECT {_BIN}, id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 4 END AS code FROM items) SELECT y, x, CAST(arg_min(code, id * 10 + code) AS BIGINT) AS value FROM b GROUP BY ALL")
def rasterize_points_first(spark, d):
    return P.rasterize_points(item_points(spark, d), **_BOX, value_key="l_returnflag", labels=True).df.select("y", "x", "value")


@query(f"WITH {ITEMS}, b AS (SELECT {_BIN}, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS c FROM items) SELECT CAST(c AS INTEGER) AS c, y, x, count(*)::DOUBLE AS value FROM b GROUP BY ALL")
def rasterize_points_count_cat(spark, d):
    return P.rasterize_points(item_points(spark, d), **_BOX, value_key="l_returnflag", agg="count_cat").df.select("c", "y", "x", "value")


@query(f"WITH {SQUARES}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM squares), p AS (SELECT CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x FROM range(50) a(i), range(50) b(i)) SELECT y, x, CAST(min(k) AS BIGINT) AS value FROM n JOIN p ON x * 2 + 1 BETWEEN minx AND maxx AND y * 2 + 1 BETWEEN miny AND maxy GROUP BY ALL")
def rasterize_shapes(spark, d):
    return P.rasterize_shapes(supplier_squares(spark, d), (0.0, 0.0), (100.0, 100.0), {"x": 50, "y": 50}).df.select("y", "x", "value")


@query(f"WITH {PIXELS} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, value FROM px WHERE y % 2 = 1 AND x % 2 = 1 AND x < 100 AND y < 2 * ((SELECT max(y) + 1 FROM px) // 2)")
def rasterize_raster(spark, d):
    e = part_raster(spark, d)
    h = e.size()["y"] // 2 * 2
    return P.rasterize_raster(e, (0, 0), (h, 100), {"y": h // 2, "x": 50}).df.where("value <> 0").select("y", "x", "value")


def _bin_table(spark, d) -> tuple[M.Table, M.Element]:
    p = read(spark, d, "part")
    obs = p.select(F.col("p_partkey").alias("obs_pos"), F.lit("bins").alias("region"), F.col("p_partkey").alias("instance_id"), (F.floor(F.col("p_partkey") / 100) + 3).cast("int").alias("row"), (F.col("p_partkey") % 100 + 7).cast("int").alias("col"), F.col("p_size").alias("size"))
    var = spark.createDataFrame([(0, "size"), (1, "price")], "var_pos int, var_name string")
    cells = F.explode(F.array(F.struct(F.lit(0).alias("var_pos"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit(1).alias("var_pos"), F.col("p_retailprice").alias("value"))))
    x = p.select(F.col("p_partkey").alias("obs_pos"), cells.alias("e")).select("obs_pos", "e.var_pos", F.lit(None).cast("string").alias("layer"), "e.value")
    t = M.table(obs.drop("size"), var, x, "bins", "region", "instance_id", check=False)
    return t, M.circles(obs.select(F.col("instance_id").alias("id"), (F.col("col") * 2.0).alias("x"), (F.col("row") * 3.0).alias("y")), radius=1.0)


@query("WITH b AS (SELECT p_partkey // 100 AS r, p_partkey % 100 AS c, CAST(p_size AS DOUBLE) AS s, p_retailprice AS p FROM part), m AS (SELECT min(r) AS r0, min(c) AS c0 FROM b) SELECT CAST(k.c AS INTEGER) AS c, CAST(r - r0 AS INTEGER) AS y, CAST(b.c - c0 AS INTEGER) AS x, CASE k.c WHEN 0 THEN s ELSE p END AS value FROM b, m, (VALUES (0), (1)) k(c)")
def rasterize_bins(spark, d):
    t, bins = _bin_table(spark, d)
    return P.rasterize_bins(t, bins, "col", "row").df.select("c", "y", "x", "value")


@query("WITH b AS (SELECT p_partkey // 100 AS r, p_partkey % 100 AS c, row_number() OVER (ORDER BY p_partkey) AS k FROM part), m AS (SELECT min(r) AS r0, min(c) AS c0 FROM b) SELECT CAST(r - r0 AS INTEGER) AS y, CAST(c - c0 AS INTEGER) AS x, k AS value FROM b, m")
def rasterize_bins_labels(spark, d):
    t, bins = _bin_table(spark, d)
    return P.rasterize_bins(t, bins, "col", "row", as_labels=True).df.select("y", "x", "value")


@query("SELECT 2.0::DOUBLE AS sx, 3.0::DOUBLE AS sy, round(2.0 * (min(p_partkey % 100) + 7) - 1, 6)::DOUBLE AS tx, round(3.0 * (min(p_partkey // 100) + 3) - 1.5, 6)::DOUBLE AS ty FROM part")
def rasterize_bins_affine(spark, d):
    t, bins = _bin_table(spark, d)
    low = t.obs.agg(F.min("col").alias("c"), F.min("row").alias("r")).first()
    m = P.grid_affine(t, bins, "col", "row", low.c, low.r).m
    return spark.range(1).select(*(F.round(F.lit(float(v)), 6).alias(n) for n, v in (("sx", m[0, 0]), ("sy", m[1, 1]), ("tx", m[0, 2]), ("ty", m[1, 2]))))


@query("WITH b AS (SELECT row_number() OVER (ORDER BY p_partkey) AS instance_id, 'bins_labels' AS region, p_partkey AS obs_pos FROM part) SELECT * FROM b")
def rasterize_bins_link(spark, d):
    return P.link_bins(_bin_table(spark, d)[0], "bins_labels").obs.select("instance_id", "region", "obs_pos")


@query("SELECT CAST(p_partkey // 100 AS INTEGER) AS y, CAST(p_partkey % 100 AS INTEGER) AS x, dense_rank() OVER (ORDER BY p_size) AS value FROM part")
def relabel_sequential(spark, d):
    return P.relabel_sequential(part_labels(spark, d)).df.select("y", "x", "value")


@query(f"WITH {PIXELS}, s AS (SELECT (max(y) + 32) // 32 AS ny FROM px), b AS (SELECT CAST(ceil(log2(greatest(ny * 4, 1))) AS INTEGER) AS bits FROM s) SELECT y, x, (CAST(value AS BIGINT) << bits) | CAST((y // 32) * 4 + x // 32 AS BIGINT) AS value FROM px, b WHERE value <> 0")
def relabel_blocks(spark, d):
    return P.relabel_blocks(part_labels(spark, d), 32).df.where("value <> 0").select("y", "x", "value")


@query(f"WITH {PIXELS} SELECT y, x, value * 2 + 1 AS value FROM px")
def map_raster(spark, d):
    e = part_raster(spark, d)
    out = P.map_raster(e, lambda a: a * 2 + 1, tile=64).df
    return out.join(e.df.select("y", "x"), ["y", "x"], "left_semi").select("y", "x", "value")


@query(f"WITH {PIXELS} SELECT a.y, a.x, max(b.value) AS value FROM px a JOIN px b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL")
def map_raster_overlap(spark, d):
    def largest(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, ((0, 0), (1, 1), (1, 1)))
        return np.max([p[:, i : i + a.shape[1], j : j + a.shape[2]] for i in range(3) for j in range(3)], axis=0)

    e = part_raster(spark, d)
    return P.map_raster(e, largest, tile=16, depth=1).df.join(e.df.select("y", "x"), ["y", "x"], "left_semi").select("y", "x", "value")


_LEVEL = "y < 2 * ((SELECT max(y) + 1 FROM px) // 2)"


@query(f"WITH {PIXELS} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, avg(value) AS value FROM px WHERE {_LEVEL} GROUP BY ALL")
def pyramid_mean(spark, d):
    return P.levels(P.pyramid(part_raster(spark, d), [2, 2]))[1][1].select("y", "x", "value")


@query(f"WITH {PIXELS} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(value AS BIGINT) AS value FROM px WHERE {_LEVEL} AND y % 2 = 1 AND x % 2 = 1")
def pyramid_nearest(spark, d):
    return P.levels(P.pyramid(part_labels(spark, d), [2, 2]))[1][1].select("y", "x", "value")


@query(f"WITH {PIXELS}, k AS (SELECT * FROM px WHERE value > 48), m AS (SELECT min(y) AS y0, min(x) AS x0 FROM k) SELECT CAST(y - y0 AS INTEGER) AS y, CAST(x - x0 AS INTEGER) AS x, value FROM k, m")
def unpad(spark, d):
    e = part_raster(spark, d)
    e = e.with_df(e.df.withColumn("value", F.when(F.col("value") > 48, F.col("value")).otherwise(0.0)))
    return P.unpad(e).df.where("value <> 0").select("y", "x", "value")


@query(f"WITH {PIXELS} SELECT y, x, x + 0.5::DOUBLE AS x_center, y + 0.5::DOUBLE AS y_center FROM px")
def pixel_centres(spark, d):
    return T.pixel_centres(part_raster(spark, d)).select("y", "x", "x_center", "y_center")


# -- vectors of rasters and back ------------------------------------------------------------------------------------


@query(f"WITH {SQUARES} SELECT id, round((minx + maxx) / 2, 6) AS x, round((miny + maxy) / 2, 6) AS y, round(sqrt((maxx - minx) * (maxy - miny) / pi()), 6) AS radius FROM squares")
def to_circles_polygons(spark, d):
    return P.to_circles(supplier_squares(spark, d)).df.select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), F.round("radius", 6).alias("radius"))


@query(f"WITH {PIXELS}, {BLOCKS} SELECT label AS id, round(avg(x + 0.5), 6) AS x, round(avg(y + 0.5), 6) AS y, round(sqrt(count(*) / pi()), 6) AS radius FROM bl GROUP BY 1")
def to_circles_labels(spark, d):
    return P.to_circles(blocks(spark, d)).df.select("id", *(F.round(c, 6).alias(c) for c in ("x", "y", "radius")))


@query(f"WITH {PARTS} SELECT id, round(32 * radius * radius * {math.sin(2 * math.pi / 64)!r}, 6) AS area, round(x - radius, 6) AS minx FROM parts")
def to_polygons_circles(spark, d):
    return P.to_polygons(part_circles(spark, d)).df.select("id", F.round(G.area(F.col("geom")), 6).alias("area"), F.round("minx", 6).alias("minx"))


@query(f"WITH {PIXELS}, {BLOCKS}, b AS (SELECT label, count(*) AS n, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS whole FROM bl GROUP BY 1) SELECT label AS id, n - 0.5::DOUBLE AS area FROM b WHERE n = whole")
def to_polygons_labels(spark, d):
    """Outlines of the blocks; those cut by the table's ends have gaps and are left to the tests."""
    e = blocks(spark, d)
    whole = e.df.groupBy("value").agg(F.count("*").alias("n"), ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("full")).where("n = full").select(F.col("value").alias("id"))
    return P.to_polygons(e).df.join(whole, "id", "left_semi").select("id", F.round(G.area(F.col("geom")), 6).alias("area"))


@query(f"WITH {PARTS}, {PIXELS} SELECT id AS instance_id, count(*) AS n, sum(value) AS total FROM parts JOIN px ON px.x + 0.5 BETWEEN parts.x - radius AND parts.x + radius AND px.y + 0.5 BETWEEN parts.y - radius AND parts.y + radius GROUP BY 1")
def instance_tiles(spark, d):
    tiles = P.instance_tiles(part_circles(spark, d), part_raster(spark, d))
    return tiles.select("instance_id", F.size("pixels").cast("long").alias("n"), F.aggregate("pixels", F.lit(0.0), lambda s, p: s + p["value"]).alias("total"))


# -- set operations, names, storage ---------------------------------------------------------------------------------


@query("SELECT 'customers' AS region, c_custkey AS instance_id FROM customer UNION ALL SELECT 'suppliers', s_suppkey FROM supplier")
def concat_annotations(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("obs_pos"), F.lit("customers").alias("region"), F.col("c_custkey").alias("instance_id"), "c_mktsegment")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("obs_pos"), F.lit("suppliers").alias("reg"), F.col("s_suppkey").alias("inst"), "s_acctbal")
    a = M.table(c, region="customers", region_key="region", instance_key="instance_id", check=False)
    b = M.table(s, region="suppliers", region_key="reg", instance_key="inst", check=False)
    return concat_tables([a, b], "region", "instance_id").obs.select("region", "instance_id")


@query("SELECT region, count(*) AS n FROM (SELECT 'customers-a' AS region FROM customer UNION ALL SELECT 'customers-b' FROM customer) GROUP BY 1")
def concatenate_datasets(spark, d):
    one = customer_data(spark, d)
    both = concatenate({"a": one, "b": one.deepcopy()}, concatenate_tables=True)
    return both.tables["stats"].obs.groupBy("region").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT DISTINCT '__' || p_brand || ' @' AS name FROM part UNION ALL SELECT '___index') SELECT name, CASE WHEN name = '___index' THEN 'index' ELSE regexp_replace(regexp_replace(name, '[^A-Za-z0-9_.\\-]', '_', 'g'), '^_{2,}', '_') END AS clean FROM n")
def sanitize_names(spark, d):
    """The brands (a fixed list) as names of columns."""
    names = [r[0] for r in read(spark, d, "part").select(F.concat(F.lit("__"), "p_brand", F.lit(" @"))).distinct().collect()]
    return spark.createDataFrame(sorted(M.sanitize_names([*names, "___index"]).items()), "name string, clean string")


def _stored(spark: SparkSession, d: Dataset) -> Dataset:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    path = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/store-{uuid.uuid4().hex}"
    store.write(spark, d, path)
    return store.read(spark, path)


@query(f"WITH {ITEMS} SELECT id, x, y, l_returnflag FROM items")
def store_points(spark, d):
    return _stored(spark, Dataset({"items": item_points(spark, d)})).elements["items"].df.select("id", "x", "y", "l_returnflag")


@query(f"WITH {SQUARES} SELECT id, minx, maxy, (maxx - minx) * (maxy - miny) AS area FROM squares")
def store_polygons(spark, d):
    e = _stored(spark, Dataset({"squares": supplier_squares(spark, d)})).elements["squares"]
    return e.df.select("id", "minx", "maxy", F.round(G.area(F.col("geom")), 6).alias("area"))


@query(f"WITH {PIXELS} SELECT y, x, value FROM px WHERE value <> 0")
def store_raster(spark, d):
    return _stored(spark, Dataset({"parts": part_raster(spark, d)})).elements["parts"].df.where("value <> 0").select("y", "x", "value")


@query("SELECT o_custkey AS obs_pos, o_orderstatus AS var_name, count(*)::DOUBLE AS value FROM orders GROUP BY ALL")
def store_table(spark, d):
    ds = customer_data(spark, d)
    t = _stored(spark, Dataset({}, {"stats": ds.tables["stats"]})).tables["stats"]
    return t.x.join(t.var, "var_pos").select("obs_pos", "var_name", "value")


# -- containers, rasters and transforms together --------------------------------------------------------------------


def _mixed(spark: SparkSession, d: str) -> Dataset:
    """Points, squares and a raster in one system, and customers' table beside them."""
    ds = customer_data(spark, d)
    return Dataset({**ds.elements, "squares": supplier_squares(spark, d), "parts": part_raster(spark, d)}, ds.tables)


_TWO = [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]], [[(20.0, 0.0), (40.0, 0.0), (40.0, 6.0), (20.0, 6.0), (20.0, 0.0)]]]


@query(f"WITH {PIXELS} SELECT CAST(y AS INTEGER) AS y, CAST(x - 3 AS INTEGER) AS x, value FROM px WHERE x BETWEEN 3 AND 29 AND y BETWEEN 0 AND 11 AND value <> 0")
def polygon_query_raster(spark, d):
    """A raster is cut to the polygon's box."""
    tri = [[[(3.0, -4.0), (30.0, 2.0), (12.0, 12.0), (3.0, -4.0)]]]
    return S.polygon_query(part_raster(spark, d), tri).df.where("value <> 0").select("y", "x", "value")


@query(f"WITH {SQUARES}, {PIXELS}, q AS (SELECT * FROM (VALUES (0, 0, 10, 10), (20, 0, 40, 6)) q(a, b, c, e)) "
    "SELECT 'customers' AS element, c_custkey AS id FROM customer JOIN q ON c_custkey BETWEEN a AND c AND c_nationkey BETWEEN b AND e "
    "UNION ALL SELECT DISTINCT 'squares', id FROM squares JOIN q ON minx <= c AND maxx >= a AND miny <= e AND maxy >= b "
    "UNION ALL SELECT 'stats', c_custkey FROM customer JOIN q ON c_custkey BETWEEN a AND c AND c_nationkey BETWEEN b AND e "
    "UNION ALL SELECT 'parts', y * 1000 + x FROM px WHERE x < 40 AND y < 10 AND value <> 0")
def polygon_query_dataset(spark, d):
    """A multipolygon over all elements of a dataset; its table follows."""
    found = _mixed(spark, d).polygon_query(_TWO)
    parts = [found.elements[n].df.select(F.lit(n).alias("element"), "id") for n in ("customers", "squares")]
    parts.append(found.tables["stats"].obs.select(F.lit("stats").alias("element"), F.col("instance_id").alias("id")))
    parts.append(found.elements["parts"].df.where("value <> 0").select(F.lit("parts").alias("element"), (F.col("y") * 1000 + F.col("x")).cast("long").alias("id")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"WITH {PIXELS}, l1 AS (SELECT y // 2 AS y, x // 2 AS x, avg(value) AS value FROM px WHERE {_LEVEL} GROUP BY ALL) SELECT 0 AS scale, CAST(2 * y + j AS INTEGER) AS y, CAST(2 * x + i AS INTEGER) AS x, value FROM px, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE value <> 0 UNION ALL SELECT 1, CAST(2 * y + j AS INTEGER), CAST(2 * x + i AS INTEGER), value FROM l1, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE value <> 0")
def transform_multiscale(spark, d):
    """Every scale resampled under a scaling by two; levels with whole numbers of pixels only."""
    e = P.pyramid(part_raster(spark, d), [2])
    e.transforms = {"big": Scale([2.0, 2.0], ("y", "x"))}
    return T.transform(e, "big").df.where("value <> 0").select("scale", "y", "x", "value")


@query(f"WITH {SQUARES} SELECT 'customers' AS element, c_custkey AS id, c_custkey * 2.0::DOUBLE + 1 AS x, c_nationkey * 3.0::DOUBLE AS y FROM customer UNION ALL SELECT 'squares', id, minx - 5, miny + 7 FROM squares")
def transform_dataset(spark, d):
    """Every element of a dataset in one coordinate system, each by its own transform."""
    ds = customer_data(spark, d)
    ds.elements["customers"].transforms["lab"] = Sequence([Scale([2.0, 3.0], ("x", "y")), Translation([1.0, 0.0], ("x", "y"))])
    ds["squares"] = M.Element("shapes", supplier_squares(spark, d).df, {"lab": Translation([-5.0, 7.0], ("x", "y"))}, {})
    out = ds.transform_to("lab").elements
    return out["customers"].df.select(F.lit("customers").alias("element"), "id", "x", "y").union(out["squares"].df.select(F.lit("squares").alias("element"), "id", F.col("minx"), F.col("miny")))


@query(f"WITH {ITEMS} SELECT id, round(10 - 2 * y, 6) AS x, round(2 * x + 5, 6) AS y FROM items")
def align_by_landmarks(spark, d):
    """A quarter turn, doubled and moved, found from four landmarks and applied to the items."""
    marks = lambda pts: M.points(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double"))
    own = [(0, 0), (4, 0), (4, 3), (0, 7)]
    e = item_points(spark, d)
    moved, _, _ = T.align_by_landmarks(e, e, marks(own), marks([(10 - 2 * y, 2 * x + 5) for x, y in own]), M.GLOBAL, "aligned")
    return T.transform(moved, "aligned").df.select("id", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y")))


@query(f"WITH {ITEMS}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0 FROM items) SELECT id, round((x - x0) * 200 / (x1 - x0), 6) AS x, round((y - y0) * 200 / (x1 - x0), 6) AS y FROM items, e")
def transform_to_extent(spark, d):
    """The items moved and scaled so that their extent begins at 0 and is 200 wide."""
    out = P.transform_to_extent({"items": item_points(spark, d)}, target_width=200)["items"]
    return out.df.select("id", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y")))


@query("SELECT c_custkey AS id, c_custkey AS instance_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def match_dataset_to_table(spark, d):
    """A dataset cut to the instances that its (filtered) table annotates."""
    ds = customer_data(spark, d)
    t = ds.tables["stats"]
    ds.tables["stats"] = t.with_obs(t.obs.where("c_mktsegment = 'BUILDING'"))
    found = ds.match_to_table("stats")
    return found.elements["customers"].df.select("id").join(found.tables["stats"].obs.select("instance_id"), F.col("id") == F.col("instance_id"))


@query(f"WITH {EVENTS}, {grid_sql(4.0)}, mv AS (SELECT id, x * 2.0 + 1 AS x, y + 0.5 AS y, value FROM ev), j AS (SELECT region_id, sum(value) AS value FROM mv JOIN grid ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1) SELECT g.region_id, coalesce(round(CAST(value AS DOUBLE), 6), 0) AS value FROM grid g LEFT JOIN j USING (region_id)")
def agg_under_transforms(spark, d):
    """Points under a scaling, summed by regions under another system's identity: both are aligned first."""
    e = event_points(spark, d)
    e.transforms = {"lab": Sequence([Scale([2.0, 1.0], ("x", "y")), Translation([1.0, 0.5], ("x", "y"))])}
    by = nation_grid(spark, d, 4.0)
    by.transforms = {"lab": Translation([0.0, 0.0], ("x", "y"))}
    return A.aggregate_shapes(e, by, "value", "sum", cs="lab").select("region_id", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(f"WITH {ITEMS}, b AS (SELECT CAST(floor((x - 1) * 2 / 5) AS INTEGER) AS px, CAST(floor(y * 2 / 5) AS INTEGER) AS py, quantity FROM items WHERE x >= 1 AND x < 51 AND y >= 0 AND y < 50) SELECT px AS x, py AS y, CAST(sum(quantity) AS DOUBLE) AS value FROM b GROUP BY ALL")
def rasterize_any(spark, d):
    """The entry point for any element, under a transform: items as an image of 20 by 20 pixels."""
    e = item_points(spark, d)
    e.transforms = {"lab": Translation([-1.0, 0.0], ("x", "y"))}
    return P.rasterize(e, (0.0, 0.0), (50.0, 50.0), cs="lab", value_key="quantity", agg="sum", width=20).df.select("x", "y", "value")
