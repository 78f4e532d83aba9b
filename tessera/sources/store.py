"""A dataset on disk: Parquet for data and one JSON sidecar an element for everything else.

Layout: ``dataset.json``; ``<kind>/<name>/meta.json`` and its data under ``data`` (tables: obs, var, x). Sidecars
are read and written through Spark's file systems, so a dataset can live wherever Spark reads. Circles and polygons
are stored with their geometry as well-known binary beside the bounding-box columns that scans prune by; rasters as
tiles partitioned by scale.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable, Mapping
from collections.abc import Sequence as Seq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.container import Dataset
from tessera.functions import geometry as G
from tessera.functions import kernels as K
from tessera.model import Element, Table, check_names
from tessera.transforms import from_dict

#: Version of the layout of each kind; readers take all versions up to it.
VERSIONS = {"dataset": 1, "points": 1, "shapes": 1, "image": 1, "labels": 1, "table": 1}
#: What missing, truncated and malformed files raise; any other error is not the files' fault.
BAD_FILES = (OSError, KeyError, ValueError, PySparkException)


@dataclass
class Settings:
    """Defaults of what is written: the pixels of a tile, and the Parquet codec."""

    tile: int | tuple | dict = 256
    compression: str = "zstd"


settings = Settings()
KINDS = ("points", "shapes", "image", "labels", "table")


# -- files by way of Spark's file systems ---------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith((".", "_"))) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _replace(spark: SparkSession, path: str, build: Callable[[str], None]) -> None:
    """Builds aside and renames: what was at the path stays until the new data is whole, also when building fails."""
    folder, _, name = path.rstrip("/").rpartition("/")
    new, old = (f"{folder}/.{name}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    try:
        build(new)
        had = exists(spark, path)
        if had:
            _rename(spark, path, old)
        _rename(spark, new, path)
    except BaseException:
        _delete(spark, new)
        if exists(spark, old) and not exists(spark, path):
            _rename(spark, old, path)
        raise
    if had:
        _delete(spark, old)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    p, fs = _fs(spark, source)
    if not fs.rename(p, _fs(spark, target)[0]):
        raise OSError(f"{source} can't be renamed to {target}")


# -- encoding -------------------------------------------------------------------------------------------------------


@F.arrow_udf(BinaryType())
def _encode(geom: pa.Array) -> pa.Array:
    return pa.array(list(map(K.to_wkb, geom.to_pylist())), pa.binary())


def _decode(df: DataFrame) -> DataFrame:
    @F.arrow_udf(G.GEOM)
    def decode(raw: pa.Array) -> pa.Array:
        return pa.array([[[[{"x": x, "y": y} for x, y in r] for r in part] for part in K.from_wkb(b)] for b in raw.to_pylist()], K.ARROW)

    return df.withColumn("geom", decode("wkb")).drop("wkb")


#: A tile's size: along both axes, along (y, x), by axis, or as the sizes of all blocks of a regular grid.
TileSize = int | Seq | Mapping


def tile_grid(tile: TileSize, axes: tuple[str, ...] = ("y", "x")) -> tuple[int, ...]:
    """The pixels of a tile along each axis.

    A sequence has an entry for each axis, a mapping one for each axis by name; channels and planes have tiles of their
    own, so other axes may only ask for 1. An entry is a number, or the sizes of all blocks, equal but for a smaller
    last one. Anything else is refused.
    """
    if isinstance(tile, Mapping):
        if missing := [a for a in axes if a not in tile]:
            raise ValueError(f"no tile size for {missing}")
        if other := {a: n for a, n in tile.items() if a not in axes and n not in (1, None)}:
            raise ValueError(f"tiles are one pixel along other axes than {axes}: {other}")
        sizes = [tile[a] for a in axes]
    elif isinstance(tile, (list, tuple)):
        if len(tile) != len(axes):
            raise ValueError(f"{len(tile)} tile sizes for the axes {axes}")
        sizes = list(tile)
    else:
        sizes = [tile] * len(axes)
    out = []
    for axis, n in zip(axes, sizes):
        if isinstance(n, (list, tuple)):
            if not n or any(b != n[0] for b in n[:-1]) or n[-1] > n[0]:
                raise ValueError(f"blocks {n} along {axis} are not a regular grid")
            n = n[0]
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError(f"a tile has a whole number of pixels along {axis}, 1 at least, not {n!r}")
        out.append(n)
    return tuple(out)


def to_tiles(e: Element, tile: TileSize = 256) -> DataFrame:
    """(scale, [c, z,] ty, tx, h, w, data): dense tiles of pixels in row order; missing pixels are 0."""
    rows, columns = tile_grid(tile)
    lead = [d for d in e.attrs["dims"] if d in ("c", "z")]
    size = F.create_map(*(x for k, s in e.attrs["sizes"].items() for x in (F.lit(k), F.struct(F.lit(s["y"]).alias("y"), F.lit(s["x"]).alias("x")))))[F.col("scale")]
    kind, number = ("double", np.float64) if e.kind == "image" else ("bigint", np.int64)
    df = e.df.withColumns({"ty": F.floor(F.col("y") / rows).cast("int"), "tx": F.floor(F.col("x") / columns).cast("int")})
    df = df.withColumns({"h": F.least(F.lit(rows), size["y"] - F.col("ty") * rows), "w": F.least(F.lit(columns), size["x"] - F.col("tx") * columns)})
    at = (F.col("y") - F.col("ty") * rows) * F.col("w") + F.col("x") - F.col("tx") * columns
    key = ["scale", *lead, "ty", "tx", "h", "w"]
    df = df.select(*(F.col(k).cast("int").alias(k) for k in key), at.cast("int").alias("at"), F.coalesce(F.col("value").cast(kind), F.lit(0).cast(kind)).alias("value"))

    def dense(part: pa.Table) -> pa.Table:
        data = np.zeros(part["h"][0].as_py() * part["w"][0].as_py(), number)
        data[part["at"].to_numpy()] = part["value"].to_numpy()
        return pa.table({**{k: part[k].slice(0, 1) for k in key}, "data": pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data))})

    return df.groupBy(*key).applyInArrow(dense, ", ".join(f"{k} int" for k in key) + f", data array<{kind}>")


def from_tiles(df: DataFrame, dims: tuple[str, ...], tile: TileSize) -> DataFrame:
    rows, columns = tile_grid(tile)
    df = df.select(*df.columns[:-1], F.posexplode("data").alias("_i", "value"))
    y, x = F.floor(F.col("_i") / F.col("w")) + F.col("ty") * rows, F.pmod(F.col("_i"), F.col("w")) + F.col("tx") * columns
    return df.withColumns({"y": y.cast("int"), "x": x.cast("int")}).select("scale", *dims, "value")


def tiles_meeting(df: DataFrame, windows: dict[int, dict[str, tuple[int, int]]], tile: TileSize) -> DataFrame:
    """The tiles that meet a window of pixels (first, end) at each scale: comparisons of stored columns."""
    tests, sides = [], list(zip(("y", "x"), ("ty", "tx"), tile_grid(tile)))
    for scale, w in windows.items():
        test = F.col("scale") == scale
        for axis, col, n in sides:
            if axis in w:
                test = test & (F.col(col) >= w[axis][0] // n) & (F.col(col) <= (w[axis][1] - 1) // n)
        tests.append(test)
    # bounds over all scales, which the scan can prune by whatever it makes of the alternatives
    for axis, col, n in sides:
        if all(axis in w for w in windows.values()):
            df = df.where((F.col(col) >= min(w[axis][0] for w in windows.values()) // n) & (F.col(col) <= (max(w[axis][1] for w in windows.values()) - 1) // n))
    return df.where(reduce(lambda a, b: a | b, tests))


# -- writing --------------------------------------------------------------------------------------------------------


def _plain(path: str) -> str:
    """A path without the scheme of local files."""
    return "/" + path.removeprefix("file:").strip("/") if path.startswith(("file:", "/")) else path.rstrip("/")


def backing_files(value: Element | Table) -> list[str]:
    frames = [value.df] if isinstance(value, Element) else [d for d in (value.obs, value.var, value.x) if d is not None]
    return sorted({f for d in frames for f in d.inputFiles()})


def is_self_contained(d: Dataset, path: str) -> bool:
    """Whether all files that the dataset reads are under the path."""
    return all(_plain(f).startswith(f"{_plain(path)}/") for _, _, v in d.walk() for f in backing_files(v))


def _meta(kind: str, v: Element | Table) -> dict:
    if isinstance(v, Table):
        return {"kind": kind, "version": VERSIONS[kind], "region": v.region, "region_key": v.region_key, "instance_key": v.instance_key, "attrs": v.attrs}
    attrs = dict(v.attrs)
    if "sizes" in attrs:
        attrs["sizes"] = {str(k): s for k, s in attrs["sizes"].items()}
    return {"kind": kind, "version": VERSIONS[kind], "transforms": {c: t.to_dict() for c, t in v.transforms.items()}, "circles": v.is_circles, "attrs": attrs}


def write_element(spark: SparkSession, path: str, name: str, value: Element | Table, overwrite: bool = False, tile: TileSize | None = None, compression: str | None = None) -> None:
    """Writes one element. An existing one is only replaced on demand, and never while ``value`` reads from it."""
    check_names([name])
    tile, compression = tile_grid(settings.tile if tile is None else tile), compression or settings.compression
    kind = "table" if isinstance(value, Table) else value.kind
    at = f"{path.rstrip('/')}/{kind}/{name}"
    if exists(spark, at):
        if not overwrite:
            raise ValueError(f"{at} exists; pass overwrite=True to replace it")
        if any(_plain(f).startswith(f"{_plain(at)}/") for f in backing_files(value)):
            raise ValueError(f"{at} is being read by what would replace it")
    meta = _meta(kind, value)

    def build(where: str) -> None:
        save = lambda df, part: df.write.option("compression", compression).parquet(f"{where}/{part}")
        if isinstance(value, Table):
            for part in ("obs", "var", "x"):
                if (df := getattr(value, part)) is not None:
                    save(df, part)
        elif kind in ("image", "labels"):
            meta["tile"] = list(tile)
            # tiles of a neighbourhood lie together, so that the files' bounds tell them apart
            tiles = to_tiles(value, tile).repartitionByRange("scale", "ty", "tx").sortWithinPartitions("scale", "ty", "tx")
            tiles.write.option("compression", compression).partitionBy("scale").parquet(f"{where}/data")
        elif kind == "shapes" and not value.is_circles:
            save(value.df.withColumn("wkb", _encode("geom")).drop("geom"), "data")
        else:
            save(value.df, "data")
        _write_text(spark, f"{where}/meta.json", json.dumps(meta))

    _replace(spark, at, build)


def write(spark: SparkSession, d: Dataset, path: str, overwrite: bool = False, **options) -> None:
    """Writes a dataset to a new path; an existing path is replaced on demand unless the dataset reads from it.

    The new data is written aside first: if that fails, the old dataset is still there.
    """
    check_names(d.names())
    if exists(spark, path):
        if not overwrite:
            raise ValueError(f"{path} exists; pass overwrite=True to replace it")
        if any(_plain(f).startswith(f"{_plain(path)}/") for _, _, v in d.walk() for f in backing_files(v)):
            raise ValueError(f"{path} is being read by this dataset")

    def build(where: str) -> None:
        for _, name, v in d.walk():
            write_element(spark, where, name, v, **options)
        write_attrs(spark, d, where)

    _replace(spark, path, build)


def write_attrs(spark: SparkSession, d: Dataset, path: str) -> None:
    _write_text(spark, f"{path.rstrip('/')}/dataset.json", json.dumps({"version": VERSIONS["dataset"], "attrs": d.attrs}))


def write_metadata(spark: SparkSession, d: Dataset, path: str, name: str | None = None) -> None:
    """Sidecars only: transforms, channel names, keys and attributes; no data is read or written."""
    for kind, n, v in d.walk():
        if name in (None, n):
            at = f"{path.rstrip('/')}/{kind}/{n}/meta.json"
            _write_text(spark, at, json.dumps(json.loads(_read_text(spark, at)) | _meta(kind, v)))
    if name is None:
        write_attrs(spark, d, path)


def delete_element(spark: SparkSession, path: str, name: str) -> None:
    found = [k for k in KINDS if exists(spark, f"{path.rstrip('/')}/{k}/{name}")]
    if not found:
        raise ValueError(f"no element {name!r} in {path}")
    for k in found:
        _delete(spark, f"{path.rstrip('/')}/{k}/{name}")


# -- reading --------------------------------------------------------------------------------------------------------


def read_element(spark: SparkSession, path: str, kind: str, name: str) -> Element | Table:
    at = f"{path.rstrip('/')}/{kind}/{name}"
    meta = json.loads(_read_text(spark, f"{at}/meta.json"))
    if meta["version"] > VERSIONS[kind]:
        raise ValueError(f"{at} has version {meta['version']}, newer than {VERSIONS[kind]}")
    if kind == "table":
        part = lambda p: spark.read.parquet(f"{at}/{p}") if exists(spark, f"{at}/{p}") else None
        return Table(part("obs"), part("var"), part("x"), meta["region"], meta["region_key"], meta["instance_key"], meta["attrs"])
    transforms = {c: from_dict(t) for c, t in meta["transforms"].items()}
    attrs, df = meta["attrs"], spark.read.parquet(f"{at}/data")
    if kind in ("image", "labels"):
        attrs["dims"], attrs["sizes"] = tuple(attrs["dims"]), {int(k): s for k, s in attrs["sizes"].items()}
        lead = [d for d in attrs["dims"] if d in ("c", "z")]
        tiles, dims, tile = df.select("scale", *lead, "ty", "tx", "h", "w", "data"), attrs["dims"], meta["tile"]
        return Element(kind, from_tiles(tiles, dims, tile), transforms, attrs, lambda windows: from_tiles(tiles_meeting(tiles, windows, tile), dims, tile))
    elif kind == "shapes" and not meta["circles"]:
        df = _decode(df)
    return Element(kind, df, transforms, attrs)


def read(spark: SparkSession, path: str, selection: tuple[str, ...] | None = None, on_bad_files: str = "error") -> Dataset:
    """A dataset, lazily. ``selection``: only these kinds are looked at. ``on_bad_files``: error or warn (and skip)."""
    if on_bad_files not in ("error", "warn"):
        raise ValueError("on_bad_files must be error or warn")
    top = json.loads(_read_text(spark, f"{path.rstrip('/')}/dataset.json"))
    if top["version"] > VERSIONS["dataset"]:
        raise ValueError(f"{path} has version {top['version']}")
    out = Dataset(attrs=top["attrs"])
    for kind in KINDS:
        if selection is not None and kind not in selection:
            continue
        for name in _children(spark, f"{path.rstrip('/')}/{kind}"):
            try:
                value = read_element(spark, path, kind, name)
            except BAD_FILES as e:
                if on_bad_files == "error":
                    raise
                warnings.warn(f"{kind}/{name} is left out: {type(e).__name__}: {str(e)[:200]}", stacklevel=2)
                continue
            (out.tables if kind == "table" else out.elements)[name] = value
    return out


def peek(spark: SparkSession, path: str, selection: tuple[str, ...] | None = None) -> str:
    return read(spark, path, selection, "warn").describe()


