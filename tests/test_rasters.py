import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import model as M
from tessera.functions import geometry as G
from tessera.functions import kernels as K
from tessera.operators import aggregate as A
from tessera.operators import raster as P
from tessera.operators import transform as T
from tessera.transforms import Scale


def dense(e, scale=0):
    dims = e.attrs["dims"]
    size = e.size(scale)
    shape = [len(e.attrs["channels"] or [0]) if d == "c" else size[d] for d in dims]
    out = np.zeros(shape)
    for r in e.df.where(f"scale = {scale}").collect():
        out[tuple(r[d] for d in dims)] = r["value"]
    return out


def test_points_to_pixels(spark):
    pts = [(0.5, 0.5, "A", 0.1), (0.5, 0.6, "A", 0.2), (1.5, 0.5, "B", 0.3), (4.5, 4.5, "B", 0.4), (2.5, 2.5, "C", 0.5), (2.4, 2.5, "C", 0.6), (2.5, 2.6, "C", 0.7), (0.5, 4.5, "D", 0.8)]
    e = M.points(M.as_category(spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, x double, y double, gene string, v double"), "gene", ["A", "B", "C", "D"]))
    box = {"low": (0.0, 0.0), "high": (5.0, 5.0), "size": {"x": 5, "y": 5}}
    count = dense(P.rasterize_points(e, **box))[0]
    assert count[0].tolist() == [2, 1, 0, 0, 0] and count[2, 2] == 3 and count[4, 0] == 1 and count.sum() == 8
    assert math.isclose(dense(P.rasterize_points(e, **box, value_key="v"))[0][2, 2], 1.8)
    first = P.rasterize_points(e, **box, value_key="gene", labels=True)
    assert dense(first)[0].tolist() == [1, 2, 0, 0, 0] and first.attrs["label_index_to_category"][3] == "C"
    cats = P.rasterize_points(e, **box, value_key="gene", agg="count_cat")
    assert cats.attrs["channels"] == ["A", "B", "C", "D"] and dense(cats)[2, 2, 2] == 3


def test_target_size():
    assert P.target_size([0, 0], [10, 5], ("x", "y"), width=4) == {"x": 4, "y": 2}
    assert P.target_size([0, 0], [5, 3], ("x", "y"), unit_to_pixels=0.5) == {"x": 2, "y": 2}
    with pytest.raises(ValueError):
        P.target_size([0], [1], ("x",), width=1, height=2)


def test_shapes_to_pixels(spark):
    e = M.polygons_from_lists(spark, [[[[(0, 0), (2, 0), (2, 2), (0, 2)]]], [[[(1, 1), (4, 1), (4, 3), (1, 3)]]]], v=[5.0, 7.0])
    got = dense(P.rasterize_shapes(e, (0.0, 0.0), (4.0, 4.0), {"x": 4, "y": 4}))
    assert got.tolist() == [[1, 1, 0, 0], [1, 1, 2, 2], [0, 2, 2, 2], [0, 0, 0, 0]]
    got = dense(P.rasterize(e, (0, 0), (4, 4), width=4, value_key="v", labels=False))
    assert got[0, 1].tolist() == [5, 5, 7, 7]


def test_pyramids_and_levels(spark):
    a = np.arange(64).reshape(8, 8)
    image = P.pyramid(M.raster_from_array(spark, a[None].astype(float), ("c", "y", "x")), [2, 2])
    assert dense(image, 1)[0].tolist() == a.reshape(4, 2, 4, 2).mean((1, 3)).tolist()
    assert dense(image, 2)[0].tolist() == a.reshape(2, 4, 2, 4).mean((1, 3)).tolist()
    labels = P.pyramid(M.raster_from_array(spark, a, ("y", "x")), [2])
    assert dense(labels, 1).tolist() == a[1::2, 1::2].tolist() and [k for k, _ in P.levels(labels)] == [0, 1]
    assert T.downscale_transform(image, 2).scale.tolist() == [4, 4]


def test_resampling(spark):
    a = np.arange(16).reshape(4, 4)
    e = M.raster_from_array(spark, a, ("y", "x"), transforms={"global": Scale([2, 2], ("y", "x"))})
    assert dense(T.transform(e)).tolist() == np.kron(a, np.ones((2, 2))).tolist()
    got = P.rasterize(e, (0, 0), (8, 8), width=4)
    assert dense(got).tolist() == a.tolist()
    colours = spark.createDataFrame([(5, 50.0), (6, 60.0)], "label long, value double")
    col = dense(P.rasterize_raster(e, (0, 0), (8, 8), {"y": 4, "x": 4}, colours=colours))[0]
    assert col.sum() == 110 and col[1, 1] == 50


def test_zonal(spark):
    image = M.raster_from_array(spark, np.arange(8.0).reshape(2, 2, 2), ("c", "y", "x"), channels=["r", "g"])
    labels = M.raster_from_array(spark, np.array([[0, 1], [2, 2]]), ("y", "x"))
    got = {r.zone: r for r in A.zonal_stats(image, labels, ("sum", "std")).collect()}
    assert set(got) == {1, 2} and got[2].channel_r_sum == 5 and got[2].channel_g_std == 0.5
    t = A.aggregate(image, labels, "lab", agg_func="mean")
    assert t.region == ["lab"] and t.var.count() == 2


def test_map_and_relabel(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 9, (11, 13))
    image = M.raster_from_array(spark, a[None].astype(float), ("c", "y", "x"))

    def mean3(b):
        p = np.pad(b, ((0, 0), (1, 1), (1, 1)), mode="edge")
        return sum(p[:, i : i + b.shape[1], j : j + b.shape[2]] for i in range(3) for j in range(3)) / 9

    p = np.pad(a[None].astype(float), ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    want = sum(p[:, i : i + 11, j : j + 13] for i in range(3) for j in range(3)) / 9
    assert np.allclose(dense(P.map_raster(image, mean3, tile=4, depth=2)), want)
    labels = M.raster_from_array(spark, a, ("y", "x"))
    blocks = dense(P.relabel_blocks(labels, 4)).astype(int)
    assert ((blocks == 0) == (a == 0)).all() and len(np.unique(blocks[blocks > 0])) >= len(np.unique(a[a > 0]))
    assert blocks[5, 6] == (0 if a[5, 6] == 0 else (int(a[5, 6]) << 4) | (1 * 4 + 1))
    same = dense(P.map_raster(labels, lambda b: b, tile=4, relabel=True)).astype(int)
    assert (same == blocks).all()
    seq = dense(P.relabel_sequential(M.raster_from_array(spark, a * 100, ("y", "x"))))
    assert sorted(np.unique(seq)) == list(range(len(np.unique(a))))


def test_unpad(spark):
    a = np.zeros((6, 7))
    a[2:4, 3:6] = 1
    got = P.unpad(M.raster_from_array(spark, a[None], ("c", "y", "x")))
    assert got.size() == {"y": 2, "x": 3} and got.transforms["global"].matrix(("y", "x"))[:2, 2].tolist() == [2, 3]


def test_outlines(spark):
    a = np.zeros((8, 8), int)
    a[1:5, 1:5] = 1
    a[2:4, 2:4] = 0
    a[6, 6] = 2
    a[0, 7] = a[7, 0] = 3
    got = {r.id: r for r in P.to_polygons(M.raster_from_array(spark, a, ("y", "x"))).df.withColumn("area", G.area(F.col("geom"))).collect()}
    assert math.isclose(got[1].area, 15.5 - 3.5) and math.isclose(got[2].area, 0.5) and len(got[3].geom) == 2
    assert len(got[1].geom) == 1 and len(got[1].geom[0]) == 2
    ring = K.contours(np.ones((2, 3), bool))[0][0]
    assert math.isclose(abs(K.ring_area(np.array(ring))), 5.5)


def test_circles_and_centres(spark):
    square = M.polygons_from_lists(spark, [[[[(0, 0), (2, 0), (2, 2), (0, 2)]]]])
    r = P.to_circles(square).df.first()
    assert (r.x, r.y) == (1, 1) and math.isclose(r.radius, math.sqrt(4 / math.pi))
    lab = M.raster_from_array(spark, np.array([[1, 1], [0, 2]]), ("y", "x"))
    got = {r.id: (r.x, r.y) for r in P.centroids(lab).df.collect()}
    assert got == {1: (1, 0.5), 2: (1.5, 1.5)}
    pts = M.points(spark.createDataFrame([(0, 1.0, 2.0)], "id long, x double, y double"))
    assert P.to_circles(pts, 3.0).df.first().radius == 3
    with pytest.raises(ValueError):
        P.to_circles(pts)
    poly = P.to_polygons(P.to_circles(pts, 3.0)).df.select(G.area(F.col("geom")).alias("a"), F.size(F.col("geom")[0][0]).alias("n")).first()
    assert poly.n == 65 and math.isclose(poly.a, 32 * 9 * math.sin(2 * math.pi / 64))


def test_bins(spark):
    rows = [(i, "bins", i, 2 + i // 3, 5 + i % 3) for i in range(9)]
    t = M.table(spark.createDataFrame(rows, "obs_pos long, region string, instance_id long, row int, col int"), spark.createDataFrame([(0, "g")], "var_pos int, var_name string"), spark.createDataFrame([(i, 0, None, float(i)) for i in range(9)], "obs_pos long, var_pos int, layer string, value double"), "bins", "region", "instance_id")
    bins = M.circles(spark.createDataFrame([(i, 10.0 * (5 + i % 3) + (2 + i // 3), 4.0 * (2 + i // 3), 1.0) for i in range(9)], "id long, x double, y double, radius double"))
    e = P.rasterize_bins(t, bins, "col", "row", "g")
    assert dense(e)[0].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    m = e.transforms["global"].matrix(("x", "y"))
    assert np.allclose(m @ [0.5, 0.5, 1], [52, 8, 1]) and np.allclose(m[:2, :2], [[10, 1], [0, 4]])
    assert dense(P.rasterize_bins(t, bins, "col", "row", as_labels=True)).tolist() == [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    assert P.link_bins(t, "lab").obs.agg(F.min("instance_id"), F.max("instance_id")).first()[:] == (1, 9)


def test_tiles(spark):
    image = M.raster_from_array(spark, np.arange(100.0).reshape(1, 10, 10), ("c", "y", "x"))
    e = M.circles(spark.createDataFrame([(0, 5.0, 5.0, 1.0)], "id long, x double, y double, radius double"))
    r = P.instance_tiles(e, image).first()
    assert sorted((p.y, p.x, p.value) for p in r.pixels) == [(0, 0, 44), (0, 1, 45), (1, 0, 54), (1, 1, 55)]
    ((who, tile, extra),) = P.tile_batches(P.instance_tiles(e, image), 1, 4, spark.createDataFrame([(0, "a")], "instance_id long, kind string"))
    assert who == 0 and tile[0].tolist() == [[44, 44, 45, 45]] * 2 + [[54, 54, 55, 55]] * 2 and extra == {"kind": "a"}
    wide = M.circles(spark.createDataFrame([(0, 5.0, 5.0, 4.0)], "id long, x double, y double, radius double"))
    ((_, tile, _),) = P.tile_batches(P.instance_tiles(wide, image), 1, 2)
    assert tile[0].tolist() == [[33, 37], [73, 77]]  # the whole tile of 8 by 8 counts, whatever the side


def test_many_elements(spark):
    image = M.raster_from_array(spark, np.arange(16.0).reshape(1, 4, 4), ("c", "y", "x"))
    pts = M.points(spark.createDataFrame([(0, -2.0, 0.5), (1, 6.0, 3.5)], "id long, x double, y double"))
    box = M.polygons_from_lists(spark, [[[[(0, 0), (2, 0), (2, 2), (0, 2)]]]])
    out = P.rasterize_all({"im": image, "pts": pts, "box": box}, (0, 0), (4, 4), width=2)
    assert set(out) == {"im_rasterized_images", "pts_rasterized_images", "box_rasterized_labels"}
    assert dense(out["im_rasterized_images"])[0].tolist() == [[5, 7], [13, 15]] and out["pts_rasterized_images"].df.count() == 0
    assert dense(out["box_rasterized_labels"]).tolist() == [[1, 0], [0, 0]]
    moved = P.transform_to_extent({"im": image, "pts": pts}, target_width=16)
    assert [(r.x, r.y) for r in moved["pts"].df.orderBy("id").collect()] == [(0, 1), (16, 7)]
    assert moved["im"].size() == {"y": 8, "x": 16} and moved["im"].df.where("value = 15").count() == 4
