"""Joins between elements and the tables that annotate them, and what is read through them.

A table's row belongs to an element's instance when its region is the element's name and its instance key the id.
A join gives two filtered sides. Rows have explicit positions (``obs_pos``; ``pos`` on elements that have an
order), and a side that must follow the other is ordered by the other's.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import Element, Table, categories_of

HOWS = ("left", "left_exclusive", "inner", "right", "right_exclusive")


def instances(e: Element, background: bool = False) -> DataFrame:
    """(instance_id): an element's ids, or the labels of its finest scale (0 is background)."""
    if e.kind == "image":
        raise ValueError("an image has no instances")
    if e.kind == "labels":
        ids = e.df.where("scale = 0").select(F.col("value").alias("instance_id")).distinct()
        return ids if background else ids.where("instance_id <> 0")
    return e.df.select(F.col("id").alias("instance_id"))


def annotators(tables: dict[str, Table], name: str) -> set[str]:
    """Names of the tables that annotate an element."""
    return {n for n, t in tables.items() if t.region and name in t.region}


def annotated_regions(t: Table) -> DataFrame:
    return t.obs.select(F.col(t.region_key).alias("region")).distinct()


def _keys(elements: dict[str, Element], t: Table) -> DataFrame:
    """(region, instance key, element number, pos) of all instances of some elements."""
    parts = []
    for i, (name, e) in enumerate(elements.items()):
        pos = F.col("pos") if "pos" in e.df.columns else F.col("id" if e.kind != "labels" else "instance_id")
        df = e.df if e.kind != "labels" else instances(e)
        parts.append(df.select(F.lit(name).alias(t.region_key), F.col("id" if e.kind != "labels" else "instance_id").alias(t.instance_key), F.lit(i).alias("_element"), pos.cast("string" if dict(df.dtypes).get("id") == "string" else "long").alias("_pos")))
    return reduce(DataFrame.unionByName, parts)


def _shrunk(t: Table, obs: DataFrame, names: list[str]) -> Table:
    return t.with_obs(obs, region=[n for n in t.region if n in names])


def filter_pixels(e: Element, ids: DataFrame) -> Element:
    """Labels whose pixels of other instances (column ``instance_id`` of ``ids``) become background."""
    if "z" in e.attrs["dims"]:
        raise NotImplementedError("labels in 3D are not filtered")
    hit = ids.select(F.col("instance_id").alias("value"), F.lit(True).alias("_hit")).distinct()
    df = e.df.join(hit, "value", "left").withColumn("value", F.when(F.col("_hit"), F.col("value")).otherwise(F.lit(0)).cast(e.df.schema["value"].dataType))
    return e.with_df(df.select(e.df.columns))


def join_elements_table(elements: dict[str, Element], t: Table, how: str = "left", match_rows: str = "no", filter_label_pixels: bool | None = None) -> tuple[dict[str, Element | None], Table | None]:
    """Both sides of a join; see ``HOWS``. ``match_rows``: "left" orders the table by the elements, "right" the elements by the table."""
    if how not in HOWS:
        raise TypeError(f"how must be one of {HOWS}")
    if match_rows not in ("no", "left", "right"):
        raise TypeError("match_rows must be no, left or right")
    for name, e in elements.items():
        if e.kind == "image":
            raise ValueError(f"{name}: an image can't be joined with a table")
    if not t.annotates:
        raise ValueError("the table annotates nothing")
    if how == "right" and match_rows == "left" or how == "left" and match_rows == "right":
        warnings.warn(f"matching rows {match_rows!r} is not supported for the {how} join", stacklevel=2)
        match_rows = "no"
    known = {}
    for name, e in elements.items():
        if name in t.region:
            known[name] = e
        else:
            warnings.warn(f"the element {name!r} is not annotated by the table; it is skipped", stacklevel=2)
    mine = lambda name: t.obs.where(F.col(t.region_key) == name).select(F.col(t.instance_key).alias("id"), F.col("obs_pos").alias("_obs_pos"))

    def matched(name: str, e: Element, by_table: bool) -> Element:
        ids = mine(name)
        if e.kind == "labels":
            if filter_label_pixels is None:
                warnings.warn(f"the pixels of {name!r} are not filtered; pass filter_label_pixels", stacklevel=3)
            return filter_pixels(e, ids.select(F.col("id").alias("instance_id"))) if filter_label_pixels else e
        if by_table:
            return e.with_df(e.df.join(ids, "id").orderBy("_obs_pos").select(e.df.columns))
        return e.with_df(e.df.join(ids, "id", "left_semi"))

    if how == "left_exclusive":
        out: dict[str, Element | None] = {}
        for name, e in elements.items():
            if e.kind == "labels":
                warnings.warn("the left exclusive join has no labels", stacklevel=2)
                out[name] = None
            else:
                out[name] = e.with_df(e.df.join(mine(name), "id", "left_anti")) if name in known else e
        return out, None
    if how == "right_exclusive":
        if not known:
            return dict.fromkeys(elements), None
        keys = _keys(known, t).select(t.region_key, t.instance_key)
        gone = t.obs.where(F.col(t.region_key).isin(list(known))).join(keys, [t.region_key, t.instance_key], "left_anti")
        return dict.fromkeys(elements), _shrunk(t, gone.select(t.obs.columns), list(known))
    if how == "right":
        return {n: matched(n, e, True) if n in known else e for n, e in elements.items()}, t
    if not known:
        return ({n: e if how == "left" else None for n, e in elements.items()}), None
    keys = _keys(known, t)
    if match_rows == "left":
        obs = t.obs.join(keys, [t.region_key, t.instance_key]).orderBy("_element", "_pos").select(t.obs.columns)
    else:
        obs = t.obs.join(keys, [t.region_key, t.instance_key], "left_semi").select(t.obs.columns)
    joined = _shrunk(t, obs, list(known))
    if how == "left":
        return dict(elements), joined
    return {n: matched(n, e, match_rows != "left") if n in known else None for n, e in elements.items()}, joined


def match_table_to_element(name: str, e: Element, t: Table) -> Table | None:
    return join_elements_table({name: e}, t, "left", "left")[1]


def match_element_to_table(elements: dict[str, Element], t: Table) -> tuple[dict[str, Element | None], Table | None]:
    return join_elements_table(elements, t, "right", "right")


def filter_table(t: Table, elements: dict[str, Element], orphans: bool = False) -> Table | None:
    """The rows that annotate instances of some elements; None if no element is annotated."""
    if not t.annotates:
        return t if orphans else None
    own = {n: e for n, e in elements.items() if e.kind != "image" and n in t.region}
    return join_elements_table(own, t, "left")[1] if own else None


def rename_keys(t: Table, region_key: str, instance_key: str) -> Table:
    from dataclasses import replace

    return replace(t, obs=t.obs.withColumnsRenamed({t.region_key: region_key, t.instance_key: instance_key}), region_key=region_key, instance_key=instance_key)


# -- values ---------------------------------------------------------------------------------------------------------


def matrix_columns(t: Table, names: list[str], layer: str | None = None, fill: float = 0.0) -> DataFrame:
    """(obs_pos, one column for each variable): only the variables asked for leave the sparse matrix."""
    picked = t.var.where(F.col("var_name").isin(names)).select("var_pos", "var_name")
    cells = t.x.where(F.col("layer").eqNullSafe(F.lit(layer))).join(F.broadcast(picked), "var_pos")
    return cells.groupBy("obs_pos").pivot("var_name", names).agg(F.first("value")).na.fill(fill, names)


def locate_values(key: str, e: Element | None = None, t: Table | None = None) -> list[str]:
    """Where a value key is found: df, obs, var or obsm."""
    out = []
    if e is not None and e.kind in ("points", "shapes") and key in e.df.columns:
        out.append("df")
    if t is not None:
        kind = dict(t.obs.dtypes).get(key, "")
        if kind.startswith("array"):
            out.append("obsm")
        elif kind:
            out.append("obs")
        if t.var is not None and not t.var.where(F.col("var_name") == key).isEmpty():
            out.append("var")
    return out


def get_values(keys: str | list[str], e: Element | None = None, t: Table | None = None, name: str | None = None, layer: str | None = None, arrays_as_are: bool = False) -> DataFrame:
    """(instance_id, a column for each key), from the element, the table's obs, its matrix, or an array column."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    found = {k: locate_values(k, e, t) for k in keys}
    for k, where in found.items():
        if len(where) != 1:
            raise ValueError(f"{k!r} is found in {where or 'no place'}")
    where = {w[0] for w in found.values()}
    if len(where) > 1:
        raise ValueError(f"the keys are in several places: {sorted(where)}")
    place = where.pop()
    if place == "df":
        kinds = {categories_of(e.df, k) is not None for k in keys}
        if len(kinds) > 1:
            raise ValueError("categories and other values can't be mixed")
        return e.df.select(F.col("id").alias("instance_id"), *keys)
    obs = t.obs if name is None else t.obs.where(F.col(t.region_key) == name)
    if e is not None and name is not None:
        obs = obs.join(instances(e).withColumnRenamed("instance_id", t.instance_key), t.instance_key, "left_semi")
    who = F.col(t.instance_key).alias("instance_id") if t.annotates else F.col("obs_pos").alias("instance_id")
    if place == "obs":
        return obs.select(who, *keys)
    if place == "obsm":
        if len(keys) > 1:
            raise ValueError("one array column at a time")
        if arrays_as_are:
            return obs.select(who, keys[0])
        n = obs.select(F.max(F.size(keys[0]))).first()[0] or 0
        return obs.select(who, *(F.get(keys[0], F.lit(i)).alias(f"{keys[0]}_{i}") for i in range(n)))
    return obs.select("obs_pos", who).join(matrix_columns(t, keys, layer), "obs_pos", "left").na.fill(0.0, keys).select("instance_id", *keys)


def filter_rows(t: Table, obs: Column | None = None, var: Column | None = None, x: Column | None = None, x_names: list[str] | None = None, obs_names: Column | None = None, var_names: Column | None = None, layer: str | None = None) -> Table:
    """The table where all predicates hold. ``x`` is over columns named by variables, listed in ``x_names``."""
    from dataclasses import replace

    rows = t.obs
    for p in (obs, obs_names):
        if p is not None:
            rows = rows.where(p)
    if x is not None:
        cells = matrix_columns(t, x_names or [], layer)
        hits = t.obs.select("obs_pos").join(cells, "obs_pos", "left").na.fill(0.0, x_names).where(x).select("obs_pos")
        rows = rows.join(hits, "obs_pos", "left_semi")
    out = t.with_obs(rows)
    if var is not None or var_names is not None:
        v = t.var
        for p in (var, var_names):
            if p is not None:
                v = v.where(p)
        out = replace(out, var=v, x=None if out.x is None else out.x.join(v.select("var_pos"), "var_pos", "left_semi"))
    return out
