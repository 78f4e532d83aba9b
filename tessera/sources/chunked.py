"""Stores of chunked arrays (Zarr, formats 2 and 3) as lazy datasets.

The layout is the public one of multi-modal spatial stores: groups ``images``, ``labels``, ``points``, ``shapes`` and
``tables``. Rasters are multiscale images of next-generation file formats; points and shapes are Parquet files (shapes
as well-known binary or as nested coordinates, the oldest version as ragged arrays); tables are annotated matrices.

Only metadata is read on the driver. Pixels come out of their chunks on the executors, a task for some chunks each; a
window reads just the chunks that it meets. Rows of tables are read by ranges, whatever the chunks of their columns.
Ragged shapes, the oldest version, are decoded on the driver.

Codecs: none, zlib, gzip, zstd, with or without a CRC-32C behind, and text of variable length. Others (Blosc, shards)
have no library here and raise ``NotImplementedError`` with their name when a dataset is opened.
"""

from __future__ import annotations

import gzip
import json
import struct
import warnings
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.container import Dataset
from tessera.functions import geometry as G
from tessera.functions import kernels as K
from tessera.model import GLOBAL, Element, Table, circles, points, polygons, polygons_from_lists, raster
from tessera.sources.store import BAD_FILES
from tessera.transforms import Affine, Identity, Transform

#: What each group of a store holds.
GROUPS = {"images": "image", "labels": "labels", "points": "points", "shapes": "shapes", "tables": "table"}
#: Pixels or rows that a task turns into a batch at a time.
BATCH = 1 << 19


# -- files ----------------------------------------------------------------------------------------------------------


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _read(path: str) -> bytes | None:
    """A file's bytes, or None if there is none: a chunk that is all fill value isn't stored."""
    fs, name = _files(path)
    if fs.get_file_info(name).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(name, compression=None) as f:
        return f.read()


def _folders(path: str) -> list[str]:
    fs, name = _files(path)
    found = fs.get_file_info(pafs.FileSelector(name, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == pafs.FileType.Directory and not i.base_name.startswith("."))


def _json(path: str) -> dict | None:
    raw = _read(path)
    return None if raw is None else json.loads(raw)


def attributes(path: str) -> dict:
    """The attributes of a group or array of either format."""
    if (node := _json(f"{path}/zarr.json")) is not None:
        return node.get("attributes", {})
    if (found := _json(f"{path}/.zattrs")) is None and _read(f"{path}/.zgroup") is None and _read(f"{path}/.zarray") is None:
        raise FileNotFoundError(path)
    return found or {}


# -- arrays ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChunkedArray:
    """What it takes to read an array's chunks; small, and sent to the executors."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str | None  # None: text
    fill: object
    codecs: tuple[str, ...]  # of bytes, in the order in which they were applied
    prefix: str
    separator: str
    order: str = "C"

    @classmethod
    def open(cls, path: str) -> ChunkedArray:
        if (m := _json(f"{path}/zarr.json")) is not None:
            if m.get("node_type") != "array":
                raise ValueError(f"{path} is not an array")
            return cls._format3(path, m)
        if (m := _json(f"{path}/.zarray")) is None:
            raise FileNotFoundError(path)
        filters = [f["id"] for f in m.get("filters") or []]
        text = "vlen-utf8" in filters
        packed = [c for c in filters if c != "vlen-utf8"] + ([m["compressor"]["id"]] if m.get("compressor") else [])
        return cls(path, tuple(m["shape"]), tuple(m["chunks"]), None if text else m["dtype"], m.get("fill_value"), _known(packed, path), "", m.get("dimension_separator", "."), m.get("order", "C"))

    @classmethod
    def _format3(cls, path: str, m: dict) -> ChunkedArray:
        keys = m.get("chunk_key_encoding", {"name": "default"})
        default = keys["name"] == "default"
        separator = keys.get("configuration", {}).get("separator", "/" if default else ".")
        names = {c["name"]: c.get("configuration") or {} for c in m["codecs"]}
        kind = m["data_type"]
        text = kind == "string" if isinstance(kind, str) else kind.get("name") in ("string", "fixed_length_utf32") and "vlen-utf8" in names
        order = "<" if names.get("bytes", {}).get("endian", "little") == "little" else ">"
        packed = [n for n in names if n not in ("bytes", "vlen-utf8")]
        return cls(path, tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), None if text else np.dtype(kind).newbyteorder(order).str, m.get("fill_value"), _known(packed, path), "c" if default else "", separator)

    def _key(self, at: tuple[int, ...]) -> str:
        parts = [self.prefix] * bool(self.prefix) + [str(i) for i in at]
        return self.separator.join(parts) if parts else "0"

    def chunk(self, at: tuple[int, ...]) -> np.ndarray:
        """A whole chunk, also where it reaches beyond the array's end."""
        raw = _read(f"{self.path}/{self._key(at)}")
        if raw is None:
            fill = ("" if self.dtype is None else 0) if self.fill is None else self.fill
            return np.full(self.chunks, fill, dtype=object if self.dtype is None else self.dtype)
        for codec in reversed(self.codecs):
            raw = _CODECS[codec](raw)
        if self.dtype is None:
            return np.array(_texts(raw), dtype=object).reshape(self.chunks)
        return np.frombuffer(raw, self.dtype).reshape(self.chunks, order=self.order)

    def rows(self, start: int, stop: int) -> np.ndarray:
        """The part from ``start`` to ``stop`` along the first axis."""
        if not self.shape:
            return self.chunk(())
        stop = min(stop, self.shape[0])
        grid = [range(-(-n // c)) for n, c in zip(self.shape[1:], self.chunks[1:])]
        out = np.empty((max(0, stop - start), *self.shape[1:]), dtype=object if self.dtype is None else self.dtype)
        for i in range(start // self.chunks[0], -(-stop // self.chunks[0]) if stop > start else 0):
            first = i * self.chunks[0]
            a, b = max(start, first), min(stop, first + self.chunks[0])
            for rest in np.ndindex(*(len(g) for g in grid)):
                block = self.chunk((i, *rest))[a - first : b - first]
                target = tuple(slice(k * c, min(n, (k + 1) * c)) for k, c, n in zip(rest, self.chunks[1:], self.shape[1:]))
                out[(slice(a - start, b - start), *target)] = block[(slice(None), *(slice(0, t.stop - t.start) for t in target))]
        return out

    def all(self) -> np.ndarray:
        return self.rows(0, self.shape[0]) if self.shape else self.chunk(())


#: Decoders of bytes by codec name.
_CODECS = {
    "zlib": zlib.decompress,
    "gzip": gzip.decompress,
    "zstd": lambda raw: zstandard.ZstdDecompressor().decompressobj().decompress(raw),
    "crc32c": lambda raw: raw[:-4],
}


def _known(codecs: list[str], path: str) -> tuple[str, ...]:
    if unknown := [c for c in codecs if c not in _CODECS]:
        raise NotImplementedError(f"{path} is packed by {', '.join(unknown)}, for which there is no library here")
    return tuple(codecs)


def _texts(raw: bytes) -> list[str]:
    """Texts with their lengths before them, and their number first."""
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        (size,) = struct.unpack_from("<I", raw, at)
        out.append(raw[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return out


# -- transforms -----------------------------------------------------------------------------------------------------


def _axes(system: object, default: list[str]) -> list[str]:
    return [a["name"] for a in system["axes"]] if isinstance(system, dict) and "axes" in system else default


def _matrix(t: dict, axes: list[str]) -> tuple[np.ndarray, list[str]]:
    """The matrix of a stored transform from ``axes``, and the axes that it gives."""
    n, kind = len(axes), t["type"]
    to = _axes(t.get("output"), axes)
    m = np.eye(n + 1)
    if kind == "identity":
        return m, axes
    if kind == "scale":
        return np.diag([*t["scale"], 1.0]), to
    if kind == "translation":
        m[:-1, -1] = t["translation"]
        return m, to
    if kind == "affine":
        given = np.asarray(t["affine"], float)
        return np.vstack([given, [0.0] * n + [1.0]]) if given.shape[0] < len(to) + 1 else given, to
    if kind == "rotation":
        m[:-1, :-1] = np.asarray(t["rotation"], float).reshape(n, n)
        return m, to
    if kind == "mapAxis":
        out = np.zeros((len(to) + 1, n + 1))
        out[-1, -1] = 1
        for i, a in enumerate(to):
            out[i, axes.index(t["mapAxis"][a])] = 1
        return out, to
    if kind == "sequence":
        for part in t["transformations"]:
            step, axes = _matrix(part, axes)
            m = step @ m
        return m, to
    if kind == "byDimension":
        out = np.zeros((len(to) + 1, n + 1))
        out[-1, -1] = 1
        for part in t["transformations"]:
            own = _axes(part.get("input"), axes)
            step, given = _matrix(part, own)
            for i, a in enumerate(given):
                out[to.index(a), -1] = step[i, -1]
                for j, b in enumerate(own):
                    out[to.index(a), axes.index(b)] = step[i, j]
        return out, to
    raise NotImplementedError(f"a stored transform of type {kind!r}")


def stored_transforms(found: list[dict], axes: list[str]) -> dict[str, Transform]:
    """The transforms by coordinate system, over the spatial axes."""
    out: dict[str, Transform] = {}
    for t in found:
        if not isinstance(t.get("output"), dict):
            continue
        own = _axes(t.get("input"), axes)
        m, to = _matrix(t, own)
        here, there = [a for a in ("x", "y", "z") if a in own], [a for a in ("x", "y", "z") if a in to]
        m = m[np.ix_([*(to.index(a) for a in there), -1], [*(own.index(a) for a in here), -1])]
        out[t["output"]["name"]] = Identity() if m.shape[0] == m.shape[1] and np.allclose(m, np.eye(len(m))) else Affine(m, tuple(here), tuple(there))
    return out or {GLOBAL: Identity()}


# -- elements -------------------------------------------------------------------------------------------------------


def _pixels(spark: SparkSession, arrays: dict[int, ChunkedArray], dims: tuple[str, ...], kind: str, windows: dict[int, dict[str, tuple[int, int]]] | None = None) -> DataFrame:
    """(scale, dims, value) of the chunks of each scale that meet its window (first, end)."""

    def of(scale: int, a: ChunkedArray, window: dict[str, tuple[int, int]]) -> DataFrame:
        grid = [-(-n // c) for n, c in zip(a.shape, a.chunks)]
        span = [(window[d][0] // c, -(-window[d][1] // c)) if d in window else (0, n) for d, c, n in zip(dims, a.chunks, grid)]
        size = [max(0, min(hi, n) - max(0, lo)) for (lo, hi), n in zip(span, grid)]

        def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    at = tuple(int(i) + max(0, lo) for i, (lo, _) in zip(np.unravel_index(k, size), span))
                    block = a.chunk(at)[tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(at, a.chunks, a.shape))]
                    flat = block.reshape(-1)
                    for i in range(0, len(flat), BATCH):
                        part = flat[i : i + BATCH]
                        where = np.unravel_index(np.arange(i, i + len(part)), block.shape)
                        places = [pa.array((w + j * c).astype(np.int32)) for w, j, c in zip(where, at, a.chunks)]
                        value = part.astype(np.float64 if kind == "image" else np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), scale, np.int32)), *places, pa.array(value)], ["scale", *dims, "value"])

        fields = ", ".join(f"{d} int" for d in dims)
        n = prod(size)
        return spark.range(0, n, 1, max(1, min(n, 4096))).mapInArrow(read, f"scale int, {fields}, value {'double' if kind == 'image' else 'long'}")

    wanted = list(arrays) if windows is None else [s for s in arrays if s in windows]
    return reduce(DataFrame.unionByName, [of(s, arrays[s], {} if windows is None else windows[s]) for s in wanted])


def read_raster(spark: SparkSession, path: str, kind: str) -> Element:
    found = attributes(path)
    found = found.get("ome", found)
    scales = found["multiscales"][0]
    dims = tuple(a["name"] if isinstance(a, dict) else a for a in scales["axes"])
    arrays = {i: ChunkedArray.open(f"{path}/{d['path']}") for i, d in enumerate(scales["datasets"])}
    sizes = {i: {d: n for d, n in zip(dims, a.shape) if d != "c"} for i, a in arrays.items()}
    channels = None
    if kind == "image":
        named = (found.get("omero") or found.get("channels_metadata") or {}).get("channels")
        channels = [c["label"] for c in named] if named else list(range(arrays[0].shape[dims.index("c")]))
    e = raster(_pixels(spark, arrays, dims, kind), dims, sizes, channels, stored_transforms(scales.get("coordinateTransformations", []), list(dims)))
    e.window = lambda windows: _pixels(spark, arrays, dims, kind, windows)
    return e


def _indexed(df: DataFrame, *names: str) -> DataFrame:
    """The frame with ``id``: its stored index if it has one, else the number of the row in its file."""
    if "id" in df.columns:
        return df
    for n in names:
        if n in df.columns:
            return df.withColumnRenamed(n, "id")
    return df.withColumn("id", F.col("_metadata.row_index"))


def read_points(spark: SparkSession, path: str) -> Element:
    found = attributes(path)
    df = _indexed(spark.read.parquet(f"{path}/points.parquet"), "__null_dask_index__", "__index_level_0__", "index")
    keys = found.get("spatialdata_attrs", {})
    e = points(df, z="z" if "z" in df.columns else None, feature_key=keys.get("feature_key"), instance_key=keys.get("instance_key"))
    e.transforms = stored_transforms(found.get("coordinateTransformations", []), list(e.axes))
    return e


def read_shapes(spark: SparkSession, path: str) -> Element:
    found = attributes(path)
    if "coords" in _folders(path):
        e = _ragged_shapes(spark, path)
    else:
        df = _indexed(spark.read.parquet(f"{path}/shapes.parquet"), "__index_level_0__", "index")
        kind = dict(df.dtypes)["geometry"]
        if "radius" in df.columns:
            if kind == "binary":  # byte order, kind, then two coordinates of 8 bytes
                df = _point_columns(df)
            else:
                df = df.withColumns({"x": F.col("geometry.x"), "y": F.col("geometry.y")}).drop("geometry")
            e = circles(df)
        else:
            if kind == "binary":
                df = _polygon_column(df)
            else:
                depth = kind.count("array<")
                geom = F.col("geometry") if depth == 3 else F.array(F.col("geometry"))
                pick = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
                df = df.withColumn("geom", F.transform(geom, lambda part: F.transform(part, lambda r: F.transform(r, pick)))).drop("geometry")
            e = polygons(df)
    e.transforms = stored_transforms(found.get("coordinateTransformations", []), list(e.axes))
    return e


def _point_columns(df: DataFrame) -> DataFrame:
    @F.arrow_udf("x double, y double")
    def decode(raw: pa.Array) -> pa.Array:
        found = [K.from_wkb(b) for b in raw.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p[i] for p in found], pa.float64()) for i in (0, 1)], ["x", "y"])

    return df.withColumn("_p", decode("geometry")).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p", "geometry")


def _polygon_column(df: DataFrame) -> DataFrame:
    @F.arrow_udf(G.GEOM)
    def decode(raw: pa.Array) -> pa.Array:
        return pa.array([[[[{"x": x, "y": y} for x, y in r] for r in part] for part in K.from_wkb(b)] for b in raw.to_pylist()], K.ARROW)

    return df.withColumn("geom", decode("geometry")).drop("geometry")


def _ragged_shapes(spark: SparkSession, path: str) -> Element:
    """The oldest version: all coordinates in one array, and where each ring, polygon and shape ends."""
    coords, ids = (ChunkedArray.open(f"{path}/{n}").all() for n in ("coords", "Index"))
    ids = [i if isinstance(i, str) else int(i) for i in ids.tolist()]
    ends = [ChunkedArray.open(f"{path}/{n}").all() for n in sorted(f for f in _folders(path) if f.startswith("offset"))]
    if not ends:
        radius = ChunkedArray.open(f"{path}/radius").all()
        kind = "string" if ids and isinstance(ids[0], str) else "long"
        return circles(spark.createDataFrame([(i, float(x), float(y), float(r)) for i, (x, y), r in zip(ids, coords[:, :2], radius)], f"id {kind}, x double, y double, radius double"))
    level: list = [tuple(map(float, p[:2])) for p in coords]
    for offsets in ends:
        level = [level[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return polygons_from_lists(spark, level if len(ends) == 3 else [[g] for g in level], ids)


# -- tables ---------------------------------------------------------------------------------------------------------

_SQL = {"b": "boolean", "i": "long", "u": "long", "f": "double"}


def _column(path: str) -> tuple[dict, str]:
    """How a column of a frame is read, and its type in Spark."""
    found = attributes(path)
    encoding = found.get("encoding-type", "array")
    if encoding == "categorical":
        names = ChunkedArray.open(f"{path}/categories").all()
        kind = "string" if names.dtype == object else _SQL[names.dtype.kind]
        return {"codes": ChunkedArray.open(f"{path}/codes"), "names": names}, kind
    if encoding.startswith("nullable"):
        values = ChunkedArray.open(f"{path}/values")
        return {"values": values, "mask": ChunkedArray.open(f"{path}/mask")}, "string" if values.dtype is None else _SQL[np.dtype(values.dtype).kind]
    a = ChunkedArray.open(path)
    return {"values": a}, "string" if a.dtype is None or np.dtype(a.dtype).kind in "US" else _SQL[np.dtype(a.dtype).kind]


def _slice(how: dict, start: int, stop: int, kind: str) -> pa.Array:
    to = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}[kind]
    if "codes" in how:
        codes = how["codes"].rows(start, stop)
        values = how["names"][np.maximum(codes, 0)] if len(how["names"]) else np.zeros(len(codes), object)
        return pa.array(values.tolist(), to, mask=codes < 0)
    mask = how["mask"].rows(start, stop).astype(bool) if "mask" in how else None
    return pa.array(how["values"].rows(start, stop).tolist(), to, mask=mask)


def _ranges(spark: SparkSession, n: int, rows: int = BATCH) -> DataFrame:
    """(start, stop): row ranges, a task for each."""
    k = max(1, -(-n // rows))
    return spark.range(0, k, 1, min(k, 4096)).select((F.col("id") * rows).alias("start"), F.least(F.col("id") * rows + rows, F.lit(n)).alias("stop"))


def _frame(spark: SparkSession, path: str, position: str, name: str) -> tuple[DataFrame, int]:
    """A stored frame with its rows' positions and names, and its number of rows."""
    found = attributes(path)
    index, columns = found["_index"], list(found["column-order"])
    read = {name: _column(f"{path}/{index}")} | {c: _column(f"{path}/{c}") for c in columns}
    first = read[name][0]
    n = (first.get("values") or first["codes"]).shape[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, stop)), *(_slice(how, start, stop, kind) for how, kind in read.values())], [position, *read])

    return _ranges(spark, n).mapInArrow(run, f"{position} long, " + ", ".join(f"`{c}` {kind}" for c, (_, kind) in read.items())), n


def _entries(spark: SparkSession, path: str, layer: str | None, n_obs: int) -> DataFrame:
    """(obs_pos, var_pos, layer, value): the entries of a stored matrix, dense (without zeros) or sparse by rows or columns."""
    found = attributes(path)
    kind = found.get("encoding-type", "array")
    if kind in ("csr_matrix", "csc_matrix"):
        data, indices, indptr = (ChunkedArray.open(f"{path}/{p}") for p in ("data", "indices", "indptr"))
        n = indptr.shape[0] - 1

        def entries(start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            ends = indptr.rows(start, stop + 1).astype(np.int64)
            outer = np.repeat(np.arange(start, stop), np.diff(ends))
            for a in range(int(ends[0]), int(ends[-1]), BATCH):
                b = min(a + BATCH, int(ends[-1]))
                own, other = outer[a - ends[0] : b - ends[0]], indices.rows(a, b).astype(np.int64)
                yield (own, other, data.rows(a, b)) if kind == "csr_matrix" else (other, own, data.rows(a, b))
    else:
        whole = ChunkedArray.open(path)
        n = n_obs

        def entries(start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            block = whole.rows(start, stop)
            i, j = np.nonzero(block)
            yield i + start, j, block[i, j]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                for i, j, v in entries(start, stop):
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int32)), pa.array([layer] * len(i), pa.string()), pa.array(v.astype(np.float64))], ["obs_pos", "var_pos", "layer", "value"])

    return _ranges(spark, n, 4096).mapInArrow(run, "obs_pos long, var_pos int, layer string, value double")


def read_table(spark: SparkSession, path: str) -> Table:
    obs, n = _frame(spark, f"{path}/obs", "obs_pos", "obs_name")
    var, _ = _frame(spark, f"{path}/var", "var_pos", "var_name")
    parts = [("X", None)] * ("X" in _folders(path)) + [(f"layers/{name}", name) for name in _folders(f"{path}/layers")]
    x = [_entries(spark, f"{path}/{p}", layer, n) for p, layer in parts]
    keys: dict = {}
    for key in _folders(f"{path}/uns/spatialdata_attrs"):
        value = ChunkedArray.open(f"{path}/uns/spatialdata_attrs/{key}").all()
        keys[key] = value.tolist() if value.ndim else value.item()
    region = keys.get("region")
    return Table(obs, var.withColumn("var_pos", F.col("var_pos").cast("int")), reduce(DataFrame.union, x) if x else None, [region] if isinstance(region, str) else region, keys.get("region_key"), keys.get("instance_key"))


# -- datasets -------------------------------------------------------------------------------------------------------


def read(spark: SparkSession, path: str, selection: tuple[str, ...] | None = None, on_bad_files: str = "error") -> Dataset:
    """A store as a dataset, lazily. ``selection``: only these groups. ``on_bad_files``: error or warn (and skip)."""
    if on_bad_files not in ("error", "warn"):
        raise ValueError("on_bad_files must be error or warn")
    path = path.rstrip("/")
    top = attributes(path)
    out = Dataset(attrs={k: v for k, v in top.items() if k not in ("spatialdata_attrs", "encoding-type", "encoding-version")})
    readers = {"points": read_points, "shapes": read_shapes, "table": read_table}
    for group, kind in GROUPS.items():
        if selection is not None and group not in selection:
            continue
        for name in _folders(f"{path}/{group}"):
            at = f"{path}/{group}/{name}"
            try:
                value = readers[kind](spark, at) if kind in readers else read_raster(spark, at, kind)
            except (*BAD_FILES, NotImplementedError) as e:
                if on_bad_files == "error":
                    raise
                warnings.warn(f"{group}/{name} is left out: {type(e).__name__}: {str(e)[:200]}", stacklevel=2)
                continue
            (out.tables if kind == "table" else out.elements)[name] = value
    return out
