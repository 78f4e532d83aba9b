import pytest
from pyspark.sql import functions as F

from tessera import model as M
from tessera.container import Dataset, concat_tables, concatenate, datasets_equal
from tessera.operators import relational as R
from tessera.operators import spatial as S


@pytest.fixture(scope="module")
def sides(spark):
    circles = M.circles(spark.createDataFrame([(i, i, float(i), 0.0, 1.0) for i in range(9)], "id long, pos long, x double, y double, radius double"))
    squares = M.polygons_from_lists(spark, [[[[(i, 0), (i + 1, 0), (i + 1, 1), (i, 1)]]] for i in range(12)])
    obs = [(i, f"o{i}", "circles", i, float(i), "ab"[i % 2]) for i in range(9)] + [(9 + i, f"o{9 + i}", "squares", i, float(i), "c") for i in range(12)]
    t = M.table(
        spark.createDataFrame(obs, "obs_pos long, obs_name string, region string, instance_id long, num double, cat string"),
        spark.createDataFrame([(0, "v"), (1, "w")], "var_pos int, var_name string"),
        spark.createDataFrame([(i, 0, None, float(i)) for i in range(21)] + [(i, 0, "twice", 2.0 * i) for i in range(21)] + [(3, 1, None, 9.0)], "obs_pos long, var_pos int, layer string, value double"),
        ["circles", "squares"],
        "region",
        "instance_id",
    )
    return {"circles": circles, "squares": squares}, t


def first(e, n):
    return e.with_df(e.df.where(f"id < {n}"))


def ids(df, col="obs_pos"):
    return [r[0] for r in df.select(col).collect()]


def test_counts_of_joins(sides):
    elements, t = sides
    five = {n: first(e, 5) for n, e in elements.items()}
    assert R.join_elements_table(five, t, "inner")[1].obs.count() == 10
    assert R.join_elements_table(five, t, "right_exclusive")[1].obs.count() == 11
    assert R.join_elements_table(five, t, "right")[1].obs.count() == 21
    left, joined = R.join_elements_table(five, t, "left")
    assert joined.obs.count() == 10 and left["circles"].df.count() == 5


def test_right_exclusive_rows(sides):
    elements, t = sides
    some = {"circles": first(elements["circles"], 7), "squares": first(elements["squares"], 10)}
    none, gone = R.join_elements_table(some, t, "right_exclusive")
    assert sorted(ids(gone.obs)) == [7, 8, 19, 20] and set(none.values()) == {None}


def test_left_exclusive(sides):
    elements, t = sides
    few = t.with_obs(t.obs.where("obs_pos < 5"))
    out, none = R.join_elements_table({"circles": elements["circles"]}, few, "left_exclusive")
    assert none is None and sorted(ids(out["circles"].df, "id")) == [5, 6, 7, 8]


def test_order_follows(sides, spark):
    elements, t = sides
    backwards = elements["circles"].with_df(elements["circles"].df.withColumn("pos", -F.col("id")))
    assert ids(R.match_table_to_element("circles", backwards, t).obs, "instance_id") == list(range(8, -1, -1))
    mixed = t.with_obs(t.obs.withColumn("obs_pos", (F.col("obs_pos") * 5) % 9).where("region = 'circles'"))
    got, _ = R.match_element_to_table({"circles": elements["circles"]}, mixed)
    assert ids(got["circles"].df, "id") == sorted(range(9), key=lambda i: i * 5 % 9)
    with pytest.warns(UserWarning, match="not supported"):
        R.join_elements_table({"circles": elements["circles"]}, t, "left", "right")


def test_metadata_and_errors(sides, spark):
    elements, t = sides
    assert R.join_elements_table({"circles": elements["circles"]}, t, "left")[1].region == ["circles"]
    with pytest.warns(UserWarning, match="not annotated"):
        out, none = R.join_elements_table({"other": elements["circles"]}, t, "inner")
        assert out == {"other": None} and none is None
    with pytest.raises(TypeError):
        R.join_elements_table(elements, t, "outer")
    image = M.raster(spark.createDataFrame([(0, 0, 0, 1.0)], "c int, y int, x int, value double"), ("c", "y", "x"), {"y": 1, "x": 1})
    with pytest.raises(ValueError):
        R.join_elements_table({"circles": image}, t)
    assert R.annotators({"t": t}, "squares") == {"t"} and R.annotators({"t": t}, "x") == set()


def test_labels_in_joins(spark):
    lab = M.raster(spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 0), (1, 1, 3)], "y int, x int, value long"), ("y", "x"), {"y": 2, "x": 2})
    t = M.table(spark.createDataFrame([(0, "lab", 1), (1, "lab", 3), (2, "lab", 9)], "obs_pos long, region string, instance_id long"), region="lab", region_key="region", instance_key="instance_id")
    assert sorted(ids(R.instances(lab), "instance_id")) == [1, 2, 3]
    assert sorted(ids(R.instances(lab, True), "instance_id")) == [0, 1, 2, 3]
    assert sorted(ids(R.join_elements_table({"lab": lab}, t, "left")[1].obs)) == [0, 1]
    got, _ = R.join_elements_table({"lab": lab}, t, "inner", filter_label_pixels=True)
    assert sorted(ids(got["lab"].df, "value")) == [0, 0, 1, 3]
    with pytest.warns(UserWarning, match="not filtered"):
        R.join_elements_table({"lab": lab}, t, "right")


def test_string_instances(spark):
    e = M.points(spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0)], "id string, x double, y double"))
    t = M.table(spark.createDataFrame([(0, "e", "b"), (1, "e", "z")], "obs_pos long, region string, instance_id string"), region="e", region_key="region", instance_key="instance_id")
    out, joined = R.join_elements_table({"e": e}, t, "inner", "left")
    assert ids(out["e"].df, "id") == ["b"] and ids(joined.obs) == [0]


def test_values(sides, spark):
    elements, t = sides
    assert R.locate_values("num", t=t) == ["obs"] and R.locate_values("v", t=t) == ["var"] and R.locate_values("radius", elements["circles"]) == ["df"]
    got = R.get_values(["v", "w"], elements["circles"], t, "circles")
    assert {tuple(r) for r in got.collect()} == {(i, float(i), 9.0 if i == 3 else 0.0) for i in range(9)}
    assert R.get_values("v", t=t, name="circles", layer="twice").agg(F.sum("v")).first()[0] == 72
    with pytest.raises(ValueError):
        R.get_values(["num", "v"], t=t)
    with pytest.raises(ValueError):
        R.get_values("nothing", t=t)


def test_filters(sides):
    elements, t = sides
    ds = Dataset(elements, {"t": t})
    out = ds.filter_by_table("t", obs=F.col("cat") == "a", elements=["circles"])
    assert sorted(ids(out.elements["circles"].df, "id")) == [0, 2, 4, 6, 8] and "squares" not in out
    out = ds.filter_by_table("t", x=(F.col("v") > 3) & (F.col("v") < 6), x_names=["v"], how="inner")
    assert sorted(ids(out.elements["circles"].df, "id")) == [4, 5] and sorted(ids(out.tables["t"].obs)) == [4, 5]
    got = R.filter_rows(t, obs_names=F.col("obs_name").rlike("1$"), var_names=F.col("var_name") == "w")
    assert sorted(ids(got.obs)) == [1, 11] and got.var.count() == 1 and got.x.count() == 0


def test_table_rules(spark):
    rows = lambda r: spark.createDataFrame(r, "obs_pos long, region string, instance_id long")
    key = {"region_key": "region", "instance_key": "instance_id"}
    with pytest.raises(ValueError, match="unique"):
        M.table(rows([(0, "a", 1), (1, "a", 1)]), region="a", **key)
    with pytest.raises(ValueError, match="nulls"):
        M.table(rows([(0, "a", None)]), region="a", **key)
    with pytest.raises(ValueError, match="declared"):
        M.table(rows([(0, "a", 1)]), region="b", **key)
    with pytest.raises(ValueError, match="together"):
        M.table(rows([(0, "a", 1)]), region="a")


def test_names():
    M.check_names(["a", "b.c-d_e", "é1"])
    for bad in ("", ".", "..", "__x", "a b", "a/b"):
        with pytest.raises(ValueError):
            M.check_names([bad])
    with pytest.raises(ValueError, match="case"):
        M.check_names(["a", "A"])
    with pytest.raises(ValueError):
        M.check_names(["_index"], columns=True)
    assert M.sanitize_name("a b#c") == "a_b_c" and M.sanitize_name("__x") == "x" and M.sanitize_name("..") == "unnamed" and M.sanitize_name("") == "unnamed"
    assert M.sanitize_names(["a b", "a_b", "A_b"]) == {"a b": "a_b", "a_b": "a_b_1", "A_b": "A_b_2"}


def test_dataset(sides, spark):
    elements, t = sides
    ds = Dataset(elements, {"t": t}, {"a": {"b": 1, "c": {"d": 2}}})
    assert ds.names() == ["circles", "squares", "t"] and ds.annotators("circles") == {"t"} and ds.flat_attrs("a") == {"b": 1, "c_d": 2}
    with pytest.raises(ValueError):
        ds["Circles"] = elements["squares"]
    sub = ds.subset(["circles"])
    assert sub.names() == ["circles", "t"] and sub.tables["t"].obs.count() == 9
    assert ds.subset(["circles", "t"]).tables["t"].obs.count() == 21
    out = ds.query(S.BoundingBox(("x", "y"), (2.5, -1), (4.5, 1)), drop_empty=True)
    assert out.elements["circles"].df.count() == 2 and out.elements["squares"].df.count() == 3 and out.tables["t"].obs.count() == 5
    ds.rename_coordinate_systems({"global": "g"})
    assert ds.coordinate_systems == ["g"] and ds.check_table("t") == []
    ds.rename_coordinate_systems({"g": "global"})
    ds.set_annotation("t", "circles")
    assert ds.tables["t"].region == ["circles"]
    ds.update_regions("t")
    assert ds.tables["t"].region == ["circles", "squares"] and "circles" in ds.describe()
    assert datasets_equal(ds, ds.deepcopy())
    del ds["t"]
    assert "t" not in ds and ds.get("t") is None


def test_concatenation(sides, spark):
    elements, t = sides
    a, b = Dataset({"circles": elements["circles"]}, {"t": t.with_obs(t.obs.where("region = 'circles'"), region=["circles"])}), Dataset({"squares": elements["squares"]}, {"t": t.with_obs(t.obs.where("region = 'squares'"), region=["squares"])})
    with pytest.raises(KeyError):
        concatenate([a, b])
    with pytest.raises(KeyError):
        concatenate([a, a], concatenate_tables=True)
    both = concatenate([a, b], concatenate_tables=True)
    assert both.tables["t"].obs.count() == 21 and both.tables["t"].region == ["circles", "squares"]
    assert both.tables["t"].obs.select("obs_pos").distinct().count() == 21 and both.tables["t"].x.where("layer is null").count() == 22
    named = concatenate({"p": a, "q": a.deepcopy()})
    assert named.names() == ["circles-p", "circles-q", "t-p", "t-q"] and named.tables["t-q"].region == ["circles-q"]
    with pytest.raises(ValueError, match="same regions"):
        concat_tables([a.tables["t"], a.tables["t"]])
