import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import model as M
from tessera.container import Dataset, datasets_equal, elements_equal
from tessera.functions import kernels as K
from tessera.operators.spatial import BoundingBox, bounding_box_query
from tessera.sources import store
from tessera.sources.samples import annotation_for, blobs
from tessera.streaming import stateless
from tessera.transforms import Scale


@pytest.fixture(scope="module")
def sample(spark):
    return blobs(spark, length=48, n_points=40, n_shapes=4, n_channels=2)


def test_round_trip(spark, sample, tmp_path):
    path = f"file://{tmp_path}/d"
    sample["blobs_circles"].transforms["other"] = Scale([2, 2], ("x", "y"))
    store.write(spark, sample, path, tile=20)
    back = store.read(spark, path)
    assert datasets_equal(back, sample) and back.elements["blobs_multiscale_image"].attrs["sizes"][2] == {"y": 12, "x": 12}
    assert M.categories_of(back.elements["blobs_points"].df, "genes") == ["gene_a", "gene_b"]
    assert set(store.read(spark, path, ("points", "table")).names()) == {"blobs_points", "table"}
    assert store.is_self_contained(back, path) and "blobs_image" in store.peek(spark, path)
    with pytest.raises(ValueError, match="exists"):
        store.write(spark, back, path)
    with pytest.raises(ValueError, match="being read"):
        store.write(spark, back, path, overwrite=True)
    with pytest.raises(ValueError, match="being read"):
        store.write_element(spark, path, "blobs_points", back.elements["blobs_points"], overwrite=True)
    back.elements["blobs_points"].transforms = {"elsewhere": Scale([3], ("x",))}
    store.write_metadata(spark, back, path, "blobs_points")
    assert list(store.read(spark, path).elements["blobs_points"].transforms) == ["elsewhere"]
    store.delete_element(spark, path, "blobs_points")
    assert "blobs_points" not in store.read(spark, path)
    (tmp_path / "d/points/broken").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    with pytest.warns(UserWarning, match="left out"):
        store.read(spark, path, on_bad_files="warn")


def test_large_tiles_are_written_and_pruned(spark, tmp_path):
    n = 2048
    df = spark.range(n * n).select(F.lit(0).alias("c"), F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"), (F.col("id") % 251).cast("double").alias("value"))
    path, began = f"file://{tmp_path}/big", time.time()
    store.write(spark, Dataset({"im": M.raster(df, ("c", "y", "x"), {"y": n, "x": n}, [0])}), path)
    part = bounding_box_query(store.read(spark, path).elements["im"], BoundingBox(("x", "y"), (300, 500), (340, 530)))
    got = {(r.y, r.x): r.value for r in part.df.collect()}
    assert got == {(y - 500, x - 300): float((y * n + x) % 251) for y in range(500, 530) for x in range(300, 340)}
    assert time.time() - began < 120
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = bounding_box_query(store.read(spark, path).elements["im"], BoundingBox(("x", "y"), (300, 500), (340, 530))).df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    for f in ("GreaterThanOrEqual(ty,1)", "LessThanOrEqual(ty,2)", "GreaterThanOrEqual(tx,1)", "LessThanOrEqual(tx,1)"):
        assert f in pushed, pushed


def test_tile_sizes(spark, tmp_path):
    assert store.tile_grid(7) == (7, 7) and store.tile_grid((3, 4)) == (3, 4) and store.tile_grid({"c": 1, "x": 4, "y": 3}) == (3, 4)
    assert store.tile_grid(((5, 5, 2), (9,))) == (5, 9)
    for bad in (0, -1, 2.5, True, "8", None, (3,), (3, 0), {"y": 3}, {"y": 3, "x": 3, "c": 2}, ((5, 4, 5), 3), ((5, 6), 3), ((), 3)):
        with pytest.raises(ValueError):
            store.tile_grid(bad)
    a = np.arange(11 * 23).reshape(11, 23)
    e = M.raster_from_array(spark, a, ("y", "x"))
    path = f"file://{tmp_path}/d"
    store.write(spark, Dataset({"l": e}), path, tile=(4, 9))
    back = store.read(spark, path).elements["l"]
    assert elements_equal(back, e)
    part = bounding_box_query(back, BoundingBox(("x", "y"), (8, 3), (19, 9)))
    assert sorted((r.y, r.x, r.value) for r in part.df.collect()) == sorted((y - 3, x - 8, int(a[y, x])) for y in range(3, 9) for x in range(8, 19))
    with pytest.raises(ValueError):
        store.write_element(spark, path, "m", e, tile=0)


def test_a_failed_write_leaves_the_old_data(spark, sample, tmp_path):
    path = f"file://{tmp_path}/d"
    one = Dataset({"p": sample.elements["blobs_points"]})
    store.write(spark, one, path)
    bad = Dataset({"p": sample.elements["blobs_points"].with_df(sample.elements["blobs_points"].df.withColumn("x", F.raise_error(F.lit("no")).cast("double")))})
    for again in (lambda: store.write(spark, bad, path, overwrite=True), lambda: store.write_element(spark, path, "p", bad.elements["p"], overwrite=True)):
        with pytest.raises(Exception, match="no"):
            again()
        assert store.read(spark, path).elements["p"].df.count() == 40
    store.write(spark, Dataset({"q": sample.elements["blobs_circles"]}), path, overwrite=True)
    assert store.read(spark, path).names() == ["q"] and sorted(p.name for p in tmp_path.iterdir()) == ["d"]


def test_only_errors_of_files_are_downgraded(spark, sample, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/d"
    store.write(spark, Dataset({"p": sample.elements["blobs_points"], "q": sample.elements["blobs_circles"]}), path)
    (tmp_path / "d/points/p/meta.json").write_text("{")
    (tmp_path / "d/points/p/.meta.json.crc").unlink(missing_ok=True)
    with pytest.warns(UserWarning, match="left out"):
        assert store.read(spark, path, on_bad_files="warn").names() == ["q"]
    monkeypatch.setattr(store, "from_dict", None)  # a fault of the program
    with pytest.raises(TypeError):
        store.read(spark, path, ("shapes",), on_bad_files="warn")


def test_names():
    for name, want in {"____a": "_a", "__private": "_private", "my@bad#name": "my_bad_name", "": "unnamed", "..": "unnamed", "é-1.b": "é-1.b", "_index": "_index"}.items():
        assert M.sanitize_name(name) == want
    assert M.sanitize_name("___index", True) == M.sanitize_name("_index", True) == "index"
    assert M.sanitize_names(["a b", "A_b", "a_b"]) == {"a b": "a_b", "A_b": "A_b_1", "a_b": "a_b_2"}
    for bad in ("", ".", "..", "__x", "a b", "a\n", 5):
        assert M.name_problem(bad)
    assert not M.name_problem("a_.-é")


def test_wkb():
    poly = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]
    multi = poly + [[[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)], [(5.2, 5.1), (5.4, 5.1), (5.4, 5.2), (5.2, 5.1)]]]
    assert K.from_wkb(K.to_wkb(poly)) == poly and K.from_wkb(K.to_wkb(multi)) == multi and K.from_wkb(K.point_wkb(1, 2)) == (1, 2)


def test_geojson(spark):
    text = '{"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,2],[0,0]]]}, {"type": "MultiPolygon", "coordinates": [[[[9,9],[10,9],[10,10],[9,9]]]]}]}'
    assert M.geojson(spark, text).df.select(F.max("maxx")).first()[0] == 10
    assert M.geojson(spark, '{"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}]}').is_circles
    with pytest.raises(ValueError):
        M.geojson(spark, '{"type": "Point", "coordinates": [1, 2]}')


def test_model_rules(spark):
    df = spark.createDataFrame([("a", 1.0)], "x string, y double")
    with pytest.raises(ValueError):
        M.points(df)
    with pytest.raises(ValueError):
        M.raster_from_array(spark, np.ones((2, 2)), ("y", "x"))
    with pytest.raises(ValueError):
        M.circles(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), radius=0)
    e = M.raster_from_array(spark, np.ones((2, 3, 4)), ("c", "y", "x"), channels=["a", "b"])
    assert M.validate(e) == "image" and M.channel_names(M.set_channel_names(e, ["p", "q"])) == ["p", "q"]
    with pytest.raises(ValueError):
        M.set_channel_names(e, ["p", "p"])


def test_annotation(spark, sample):
    t = annotation_for(spark, sample, "blobs_labels")
    ds = Dataset({"blobs_labels": sample.elements["blobs_labels"]}, {"t": t})
    assert ds.check_table("t") == [] and t.obs.count() > 0 and elements_equal(sample.elements["blobs_labels"], ds.elements["blobs_labels"])


def test_streams(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    square = M.polygons_from_lists(spark, [[[[(2, 2), (4, 2), (4, 4), (2, 4)]]]])
    for name, make in {
        "box": lambda e: stateless.box_stream(e, BoundingBox(("x", "y"), (1, 1), (5, 5))),
        "polygon": lambda e: stateless.polygon_stream(e, [[[(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]]]),
        "regions": lambda e: stateless.regions_stream(e.df, square, 2.0),
    }.items():
        q = make(M.points(stream)).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / name)).count() == 9
