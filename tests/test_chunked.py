"""Stores of chunked arrays, written here by hand in both formats."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators.spatial import BoundingBox, bounding_box_query
from tessera.sources import chunked

LAB = [{"type": "sequence", "input": {"name": "xy", "axes": [{"name": "x"}, {"name": "y"}]}, "output": {"name": "lab", "axes": [{"name": "x"}, {"name": "y"}]}, "transformations": [{"type": "scale", "scale": [2.0, 3.0]}, {"type": "translation", "translation": [1.0, -1.0]}]}]


class Writer:
    def __init__(self, root, version, codec):
        self.root, self.version, self.codec = root, version, codec

    def pack(self, raw):
        return {"zstd": zstandard.ZstdCompressor().compress, "zlib": zlib.compress, None: bytes}[self.codec](raw)

    def group(self, path, attrs=None):
        at = self.root / path
        at.mkdir(parents=True, exist_ok=True)
        if self.version == 3:
            (at / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attrs or {}}))
        else:
            (at / ".zgroup").write_text('{"zarr_format": 2}')
            (at / ".zattrs").write_text(json.dumps(attrs or {}))

    def array(self, path, a, chunks=None, attrs=None):
        at = self.root / path
        at.mkdir(parents=True, exist_ok=True)
        a = np.asarray(a)
        text = a.dtype.kind in "OU"
        chunks = tuple(chunks or [max(1, n) for n in a.shape])
        if self.version == 3:
            codecs = [{"name": "vlen-utf8"}] if text else [{"name": "bytes", "configuration": {"endian": "little"}}]
            codecs += [{"name": self.codec, "configuration": {}}] if self.codec else []
            (at / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": "string" if text else a.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": codecs, "fill_value": "" if text else 0, "attributes": attrs or {}}))
        else:
            (at / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": "|O" if text else a.dtype.str, "compressor": {"id": self.codec} if self.codec else None, "filters": [{"id": "vlen-utf8"}] if text else None, "fill_value": None, "order": "C"}))
            (at / ".zattrs").write_text(json.dumps(attrs or {}))
        for k in np.ndindex(*(-(-n // c) for n, c in zip(a.shape, chunks))):
            part = np.asarray(a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(k, chunks))], a.dtype)
            if not text and not part.any():
                continue  # as fill values, not stored
            if text:
                whole = np.full(chunks, "", object)
                whole[tuple(slice(0, n) for n in part.shape)] = part if part.ndim else part.item()
                part = whole
                raw = struct.pack("<I", part.size) + b"".join(struct.pack("<I", len(t.encode())) + t.encode() for t in part.reshape(-1).tolist())
            else:
                whole = np.zeros(chunks, a.dtype)
                whole[tuple(slice(0, n) for n in part.shape)] = part if part.ndim else part.item()
                raw = whole.tobytes()
            name = "/".join(["c", *map(str, k)]) if self.version == 3 else (".".join(map(str, k)) or "0")
            (at / name).parent.mkdir(parents=True, exist_ok=True)
            (at / name).write_bytes(self.pack(raw))


IMAGE = np.arange(2 * 13 * 17, dtype=np.uint16).reshape(2, 13, 17)
LABELS = np.arange(13 * 17, dtype=np.int32).reshape(13, 17) // 40
SQUARE = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]]
HOLED = [[[(9.0, 9.0), (12.0, 9.0), (12.0, 12.0), (9.0, 9.0)], [(10.0, 9.5), (10.5, 9.5), (10.5, 9.8), (10.0, 9.5)]], [[(20.0, 20.0), (21.0, 20.0), (21.0, 21.0), (20.0, 20.0)]]]


@pytest.fixture(scope="module", params=[(3, "zstd"), (2, "zlib"), (3, None)], ids=str)
def store(request, tmp_path_factory):
    version, codec = request.param
    w = Writer(tmp_path_factory.mktemp("store"), version, codec)
    w.group("", {"spatialdata_attrs": {"version": "0.2"}, "note": "hello"})
    for kind, a, axes in (("images", IMAGE, "cyx"), ("labels", LABELS, "yx")):
        placed = [{"type": "translation", "input": {"name": axes, "axes": [{"name": x} for x in axes]}, "output": {"name": "global", "axes": [{"name": x} for x in axes]}, "translation": [0.0] * (len(axes) - 2) + [5.0, 7.0]}]
        meta = {"multiscales": [{"axes": [{"name": x} for x in axes], "datasets": [{"path": "0"}, {"path": "s1"}], "coordinateTransformations": placed}]}
        if kind == "images":
            meta["omero"] = {"channels": [{"label": "red"}, {"label": "blue"}]}
        name = "im" if kind == "images" else "lab"
        w.group(f"{kind}/{name}", {"ome": meta} if version == 3 else meta)
        w.array(f"{kind}/{name}/0", a, (1, 5, 6) if a.ndim == 3 else (5, 6))
        w.array(f"{kind}/{name}/s1", a[..., ::2, ::2])
    w.group("points/pts", {"coordinateTransformations": LAB, "spatialdata_attrs": {"feature_key": "gene", "version": "0.2"}})
    pq.write_table(pa.table({"x": [1.0, 2.5], "y": [3, 4], "gene": pa.array(["a", "b"]).dictionary_encode(), "__null_dask_index__": [10, 20]}), w.root / "points/pts/points.parquet")
    attrs = {"coordinateTransformations": LAB}
    for name, table in {
        "wkb": {"geometry": pa.array([K.to_wkb(SQUARE), K.to_wkb(HOLED)], pa.binary()), "__index_level_0__": ["p", "q"]},
        "nested": {"geometry": pa.array([[[[{"x": x, "y": y} for x, y in r] for r in part] for part in g] for g in (SQUARE, HOLED)], K.ARROW)},
        "circles": {"geometry": pa.array([K.point_wkb(1, 2), K.point_wkb(3, 4)], pa.binary()), "radius": [0.5, 1.5]},
    }.items():
        w.group(f"shapes/{name}", attrs)
        pq.write_table(pa.table(table), w.root / f"shapes/{name}/shapes.parquet")
    w.group("shapes/ragged", attrs)
    rings = [r for g in (SQUARE, HOLED) for part in g for r in part]
    w.array("shapes/ragged/coords", np.concatenate([np.array(r) for r in rings]), (4, 2))
    for n, counts in enumerate(([len(r) for r in rings], [len(p) for g in (SQUARE, HOLED) for p in g], [len(g) for g in (SQUARE, HOLED)])):
        w.array(f"shapes/ragged/offset{n}", np.cumsum([0, *counts]))
    w.array("shapes/ragged/Index", np.array([7, 8]))
    for part in ("obs", "var", "layers", "uns", "uns/spatialdata_attrs", "X", "obs/kind"):
        w.group(f"tables/t/{part}")
    w.group("tables/t")
    w.group("tables/t/obs", {"_index": "_index", "column-order": ["region", "instance", "kind", "size"]})
    names = [f"cell{i}" for i in range(7)]
    w.array("tables/t/obs/_index", np.array(names, object), (3,))
    w.array("tables/t/obs/region", np.array(["im"] * 7, object))
    w.array("tables/t/obs/instance", np.arange(7), (2,))
    w.array("tables/t/obs/size", np.linspace(0, 3, 7), (4,))
    w.group("tables/t/obs/kind", {"encoding-type": "categorical"})
    w.array("tables/t/obs/kind/codes", np.array([0, 1, -1, 0, 1, 1, 0], np.int8), (3,))
    w.array("tables/t/obs/kind/categories", np.array(["k0", "k1"], object))
    w.group("tables/t/var", {"_index": "_index", "column-order": []})
    w.array("tables/t/var/_index", np.array(["g0", "g1", "g2"], object))
    dense = np.arange(21.0).reshape(7, 3) * (np.arange(21).reshape(7, 3) % 4 > 1)
    at = [np.flatnonzero(r) for r in dense]
    w.group("tables/t/X", {"encoding-type": "csr_matrix", "shape": [7, 3]})
    w.array("tables/t/X/data", np.concatenate([r[a] for r, a in zip(dense, at)]), (5,))
    w.array("tables/t/X/indices", np.concatenate(at).astype(np.int32), (5,))
    w.array("tables/t/X/indptr", np.cumsum([0, *map(len, at)]))
    w.array("tables/t/layers/raw", dense + 1, (2, 2))
    w.array("tables/t/uns/spatialdata_attrs/region", np.array("im", object))
    w.array("tables/t/uns/spatialdata_attrs/region_key", np.array("region", object))
    w.array("tables/t/uns/spatialdata_attrs/instance_key", np.array("instance", object))
    return w.root, dense


def pixels(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[(r.c, r.y, r.x) if len(shape) == 3 else (r.y, r.x)] = r.value
    return out


def test_store(spark, store):
    root, dense = store
    d = chunked.read(spark, str(root))
    assert d.attrs == {"note": "hello"} and set(d.names()) == {"circles", "im", "lab", "nested", "pts", "ragged", "t", "wkb"}
    only = chunked.read(spark, f"file://{root}", ("images", "tables"))
    image = only.elements["im"]
    assert image.attrs["channels"] == ["red", "blue"] and image.size(1) == {"y": 7, "x": 9}
    assert (pixels(image.df.where("scale = 0"), IMAGE.shape) == IMAGE).all() and (pixels(image.df.where("scale = 1"), (2, 7, 9)) == IMAGE[:, ::2, ::2]).all()
    labels = chunked.read(spark, str(root), ("labels",)).elements["lab"]
    assert labels.kind == "labels" and (pixels(labels.df.where("scale = 0"), LABELS.shape) == LABELS).all()
    # a box reads the chunks that it meets only: those beyond may be damaged
    for f in (root / "images/im/0").rglob("*"):
        if f.is_file() and "zarr" not in f.name and not str(f.relative_to(root / "images/im/0")).replace("/", ".").removeprefix("c.").endswith(".0.0"):
            f.write_bytes(b"")
    part = bounding_box_query(image, BoundingBox(("x", "y"), (7, 5), (11, 9)))
    assert (pixels(part.df.where("scale = 0"), (2, 4, 4)) == IMAGE[:, :4, :4]).all()
    t = only.tables["t"]
    obs = sorted(t.obs.collect(), key=lambda r: r.obs_pos)
    assert [(r.obs_name, r.instance, r.kind) for r in obs] == [(f"cell{i}", i, k) for i, k in enumerate(["k0", "k1", None, "k0", "k1", "k1", "k0"])] and obs[2]["size"] == 1.0
    assert (t.region, t.region_key, t.instance_key) == (["im"], "region", "instance") and [r.var_name for r in t.var.orderBy("var_pos").collect()] == ["g0", "g1", "g2"]
    for layer, want in ((None, dense), ("raw", dense + 1)):
        got = np.zeros((7, 3))
        for r in t.x.where(F.col("layer").eqNullSafe(F.lit(layer))).collect():
            got[r.obs_pos, r.var_pos] = r.value
        assert (got == want).all()


def test_vectors(spark, store):
    root, _ = store
    d = chunked.read(spark, str(root), ("points", "shapes"))
    p = d.elements["pts"]
    assert sorted((r.id, r.x, r.y, r.gene) for r in p.df.collect()) == [(10, 1.0, 3, "a"), (20, 2.5, 4, "b")] and p.attrs["feature_key"] == "gene"
    assert np.allclose(p.affine("lab"), [[2, 0, 1], [0, 3, -1], [0, 0, 1]])
    plain = lambda g: [[[(q.x, q.y) for q in r] for r in part] for part in g]
    for name, ids in (("wkb", ["p", "q"]), ("nested", [0, 1]), ("ragged", [7, 8])):
        assert {r.id: plain(r.geom) for r in d.elements[name].df.collect()} == dict(zip(ids, (SQUARE, HOLED)))
    assert sorted((r.id, r.x, r.y, r.radius) for r in d.elements["circles"].df.collect()) == [(0, 1.0, 2.0, 0.5), (1, 3.0, 4.0, 1.5)]


def test_bad_stores(spark, tmp_path):
    w = Writer(tmp_path, 3, "zstd")
    w.group("")
    w.group("images/im", {"ome": {"multiscales": [{"axes": [{"name": "y"}], "datasets": [{"path": "0"}]}]}})
    w.codec = None
    w.array("images/im/0", np.ones(3))
    m = json.loads((tmp_path / "images/im/0/zarr.json").read_text())
    m["codecs"].append({"name": "blosc"})
    (tmp_path / "images/im/0/zarr.json").write_text(json.dumps(m))
    with pytest.raises(NotImplementedError, match="blosc"):
        chunked.read(spark, str(tmp_path))
    with pytest.warns(UserWarning, match="left out"):
        assert chunked.read(spark, str(tmp_path), on_bad_files="warn").names() == []
    with pytest.raises(FileNotFoundError):
        chunked.read(spark, str(tmp_path / "none"))


def test_matrices():
    axes = ["c", "y", "x"]
    cyx = {"name": "in", "axes": [{"name": a} for a in axes]}
    to = lambda name: {"name": name, "axes": [{"name": a} for a in axes]}
    t = chunked.stored_transforms([
        {"type": "affine", "input": cyx, "output": to("a"), "affine": [[1, 0, 0, 0], [0, 2, 1, 5], [0, 0, 3, 7]]},
        {"type": "mapAxis", "input": cyx, "output": to("m"), "mapAxis": {"c": "c", "x": "y", "y": "x"}},
        {"type": "byDimension", "input": cyx, "output": to("b"), "transformations": [{"type": "scale", "scale": [4.0], "input": {"axes": [{"name": "x"}]}, "output": {"axes": [{"name": "x"}]}}, {"type": "identity", "input": {"axes": [{"name": "c"}, {"name": "y"}]}, "output": {"axes": [{"name": "c"}, {"name": "y"}]}}]},
        {"type": "identity", "input": cyx, "output": to("i")},
    ], axes)
    xy = lambda name: t[name].matrix(("x", "y")).tolist()
    assert xy("a") == [[3, 0, 7], [1, 2, 5], [0, 0, 1]] and xy("m") == [[0, 1, 0], [1, 0, 0], [0, 0, 1]]
    assert xy("b") == [[4, 0, 0], [0, 1, 0], [0, 0, 1]] and type(t["i"]).__name__ == "Identity"
