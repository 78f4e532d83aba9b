"""The dataset: named elements and tables, and what is asked of all of them at once."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import GLOBAL, Element, Table, check_names, validate
from tessera.operators import relational as R
from tessera.operators import spatial as S
from tessera.operators.transform import transform


class Dataset:
    """Lazy DataFrames under names that are unique, ignoring case, across elements and tables."""

    def __init__(self, elements: dict[str, Element] | None = None, tables: dict[str, Table] | None = None, attrs: dict | None = None):
        self.elements: dict[str, Element] = {}
        self.tables: dict[str, Table] = {}
        self.attrs = {} if attrs is None else attrs
        for n, e in (elements or {}).items():
            self[n] = e
        for n, t in (tables or {}).items():
            self[n] = t

    # names
    def __setitem__(self, name: str, value: Element | Table) -> None:
        check_names([*(n for n in self.names() if n != name), name])
        if isinstance(value, Table):
            self.elements.pop(name, None)
            self.tables[name] = value
        else:
            validate(value)
            self.tables.pop(name, None)
            self.elements[name] = value

    def __getitem__(self, name: str) -> Element | Table:
        return self.elements[name] if name in self.elements else self.tables[name]

    def get(self, name: str, default=None):
        return self[name] if name in self else default

    def __contains__(self, name: object) -> bool:
        return name in self.elements or name in self.tables

    def __delitem__(self, name: str) -> None:
        del (self.elements if name in self.elements else self.tables)[name]

    def names(self) -> list[str]:
        return [*self.elements, *self.tables]

    def of_kind(self, kind: str) -> dict[str, Element]:
        return {n: e for n, e in self.elements.items() if e.kind == kind}

    def walk(self) -> Iterator[tuple[str, str, Element | Table]]:
        """(kind, name, element) of everything."""
        yield from ((e.kind, n, e) for n, e in self.elements.items())
        yield from (("table", n, t) for n, t in self.tables.items())

    def locate(self, value: Element | Table) -> list[str]:
        return [n for _, n, v in self.walk() if v is value]

    def deepcopy(self) -> Dataset:
        """A copy that shares the (immutable) frames and nothing else."""
        own = lambda e: replace(e, transforms=dict(e.transforms), attrs=copy.deepcopy(e.attrs))
        return Dataset({n: own(e) for n, e in self.elements.items()}, {n: replace(t, attrs=copy.deepcopy(t.attrs)) for n, t in self.tables.items()}, copy.deepcopy(self.attrs))

    # annotation
    def annotators(self, name: str) -> set[str]:
        return R.annotators(self.tables, name)

    def set_annotation(self, table: str, region: str | list[str], region_key: str | None = None, instance_key: str | None = None) -> None:
        """Points a table at regions; keys that aren't given stay as they are."""
        t = self.tables[table]
        region = [region] if isinstance(region, str) else list(region)
        region_key, instance_key = region_key or t.region_key, instance_key or t.instance_key
        if not region_key or not instance_key:
            raise ValueError("the table has no keys; give region_key and instance_key")
        for k in (region_key, instance_key):
            if k not in t.obs.columns:
                raise ValueError(f"obs has no column {k!r}")
        self.tables[table] = replace(t, region=region, region_key=region_key, instance_key=instance_key)

    def update_regions(self, table: str) -> None:
        """The declared regions become those that rows have."""
        t = self.tables[table]
        self.tables[table] = replace(t, region=sorted(r[0] for r in R.annotated_regions(t).collect()))

    def check_table(self, table: str) -> list[str]:
        """Problems between a table and the elements it names."""
        t, out = self.tables[table], []
        for n in t.region or []:
            if n not in self.elements:
                out.append(f"{table} annotates {n!r}, which isn't here")
                continue
            kind = dict(self.elements[n].df.dtypes)["value" if self.elements[n].kind == "labels" else "id"]
            if (kind == "string") != (dict(t.obs.dtypes)[t.instance_key] == "string"):
                out.append(f"{table}: {t.instance_key!r} and the instances of {n!r} have different types")
        return out

    # subsets
    def _with_tables(self, elements: dict[str, Element], filter_tables: bool, keep: Iterable[str] = (), orphans: bool = False) -> Dataset:
        tables = {}
        for n, t in self.tables.items():
            if n in keep or not filter_tables:
                tables[n] = t
            elif (found := R.filter_table(t, elements, orphans)) is not None:
                tables[n] = found
        return Dataset(elements, tables, self.attrs)

    def subset(self, names: list[str], filter_tables: bool = True, orphans: bool = False) -> Dataset:
        """Some elements, and the rows that annotate them; a table named itself is kept whole."""
        return self._with_tables({n: e for n, e in self.elements.items() if n in names}, filter_tables, [n for n in names if n in self.tables], orphans)

    def filter_by_coordinate_system(self, cs: str | list[str], filter_tables: bool = True, orphans: bool = False) -> Dataset:
        cs = [cs] if isinstance(cs, str) else list(cs)
        if unknown := [c for c in cs if c not in self.coordinate_systems]:
            raise ValueError(f"no element is in {unknown}")
        kept = {n: replace(e, transforms={c: t for c, t in e.transforms.items() if c in cs}) for n, e in self.elements.items() if any(c in e.transforms for c in cs)}
        return self._with_tables(kept, filter_tables, (), orphans)

    # coordinate systems
    @property
    def coordinate_systems(self) -> list[str]:
        return sorted({c for e in self.elements.values() for c in e.transforms})

    def rename_coordinate_systems(self, names: dict[str, str]) -> None:
        have = set(self.coordinate_systems)
        if unknown := set(names) - have:
            raise ValueError(f"no coordinate systems {sorted(unknown)}")
        new = [names.get(c, c) for c in have]
        if len(set(new)) != len(new):
            raise ValueError("two coordinate systems would have one name")
        for e in self.elements.values():
            e.transforms = {names.get(c, c): t for c, t in e.transforms.items()}

    def transform_to(self, cs: str, maintain_positioning: bool = False) -> Dataset:
        """All elements of a coordinate system, with data in it."""
        kept = {n: transform(e, cs, maintain_positioning) for n, e in self.elements.items() if cs in e.transforms}
        return self._with_tables(kept, True)

    # queries
    def query(self, request: S.BoundingBox, filter_tables: bool = True, drop_empty: bool = False) -> Dataset:
        """What is inside a box. ``drop_empty`` runs a job for each vector element to leave out the empty ones."""
        return self._queried(lambda e: S.bounding_box_query(e, request), request.cs, filter_tables, drop_empty)

    def polygon_query(self, geom: list, cs: str = GLOBAL, filter_tables: bool = True, clip: bool = False, drop_empty: bool = False) -> Dataset:
        return self._queried(lambda e: S.polygon_query(e, geom, cs, clip), cs, filter_tables, drop_empty)

    def _queried(self, ask: Callable[[Element], Element | None], cs: str, filter_tables: bool, drop_empty: bool) -> Dataset:
        found = {n: r for n, e in self.elements.items() if cs in e.transforms and (r := ask(e)) is not None}
        if drop_empty:
            found = {n: e for n, e in found.items() if e.kind in ("image", "labels") or not e.df.isEmpty()}
        return self._with_tables(found, filter_tables)

    def match_to_table(self, table: str, how: str = "right", filter_label_pixels: bool | None = None) -> Dataset:
        """The regions a table annotates, joined with it."""
        t = self.tables[table]
        sides, joined = R.join_elements_table({n: self.elements[n] for n in t.region if n in self.elements}, t, how, "no", filter_label_pixels)
        return Dataset({n: e for n, e in sides.items() if e is not None}, {} if joined is None else {table: joined}, self.attrs)

    def filter_by_table(self, table: str, obs: Column | None = None, var: Column | None = None, x: Column | None = None, x_names: list[str] | None = None, obs_names: Column | None = None, var_names: Column | None = None, layer: str | None = None, elements: list[str] | None = None, how: str = "right", filter_label_pixels: bool | None = None) -> Dataset:
        """The dataset where predicates over a table hold, by the join ``how``."""
        base = self if elements is None else self.subset([*elements, table])
        t = R.filter_rows(base.tables[table], obs, var, x, x_names, obs_names, var_names, layer)
        own = Dataset({n: e for n, e in base.elements.items() if t.region and n in t.region}, {}, self.attrs)
        own.tables[table] = t
        return own.match_to_table(table, how, filter_label_pixels)

    def flat_attrs(self, key: str, sep: str = "_") -> dict:
        """Nested attributes under one level of joined keys."""
        out: dict = {}

        def visit(prefix: str, value) -> None:
            if isinstance(value, dict):
                for k, v in value.items():
                    visit(f"{prefix}{sep}{k}" if prefix else str(k), v)
            else:
                out[prefix] = value

        visit("", self.attrs[key])
        return out

    def describe(self) -> str:
        """A summary from metadata alone; runs no job."""
        lines = ["Dataset"]
        for kind, n, v in self.walk():
            if isinstance(v, Table):
                lines.append(f"  table   {n}: obs {v.obs.columns}" + (f", annotates {v.region}" if v.annotates else ""))
            elif v.kind in ("image", "labels"):
                lines.append(f"  {kind:<7} {n}: {', '.join(v.attrs['dims'])}; " + "; ".join(f"scale {k} {s}" for k, s in v.attrs["sizes"].items()))
            else:
                lines.append(f"  {kind:<7} {n}: {'circles ' if v.is_circles else ''}{v.df.columns}")
        for cs in self.coordinate_systems:
            lines.append(f"  in {cs!r}: {', '.join(n for n, e in self.elements.items() if cs in e.transforms)}")
        return "\n".join(lines)

    __repr__ = describe


# -- concatenation --------------------------------------------------------------------------------------------------


def common_keys(datasets: list[Dataset]) -> set[str]:
    """Table names that several datasets have."""
    seen: dict[str, int] = {}
    for d in datasets:
        for n in d.tables:
            seen[n] = seen.get(n, 0) + 1
    return {n for n, k in seen.items() if k > 1}


def concat_tables(tables: list[Table], region_key: str | None = None, instance_key: str | None = None, how: str = "inner") -> Table:
    """Rows one table after the other; columns and variables that all have (``inner``) or any has (``outer``)."""
    regions = [r for t in tables for r in t.region or []]
    if len(set(regions)) != len(regions):
        raise ValueError("the tables annotate the same regions")
    keys = {(t.region_key, t.instance_key) for t in tables if t.annotates}
    if len(keys) > 1 and not (region_key and instance_key):
        raise ValueError("the tables have different keys; give region_key and instance_key")
    if keys and region_key is None:
        region_key, instance_key = next(iter(keys))
    tables = [R.rename_keys(t, region_key, instance_key) if t.annotates else t for t in tables]
    common = [c for c in tables[0].obs.columns if all(c in t.obs.columns for t in tables)]
    # a row's position keeps its table in the high bits, so positions stay unique and in order
    place = lambda i: (F.lit(i).cast("long") * F.lit(1 << 40) + F.col("obs_pos")).alias("obs_pos")
    obs = x = var = None
    for i, t in enumerate(tables):
        own = t.obs.select(place(i), *(c for c in (common if how == "inner" else t.obs.columns) if c != "obs_pos"))
        obs = own if obs is None else obs.unionByName(own, allowMissingColumns=how == "outer")
        if t.var is not None:
            names = t.var.select("var_name")
            var = names if var is None else (var.join(names, "var_name", "left_semi") if how == "inner" else var.union(names).distinct())
    if var is not None:
        numbered = var.select("var_name", F.xxhash64("var_name").alias("var_pos"))
        for i, t in enumerate(tables):
            cells = t.x.join(t.var.select("var_pos", "var_name"), "var_pos").drop("var_pos").join(numbered, "var_name").select(place(i), "var_pos", "layer", "value")
            x = cells if x is None else x.union(cells)
        var = numbered
    return Table(obs, var, x, regions or None, region_key, instance_key)


def concatenate(datasets: list[Dataset] | dict[str, Dataset], concatenate_tables: bool = False, region_key: str | None = None, instance_key: str | None = None, obs_names_make_unique: bool = False, merge_coordinate_systems: bool = True, attrs_merge: Callable[[list[dict]], dict] | None = None) -> Dataset:
    """One dataset of many. A list must have no name twice; with a dict, names get ``-key`` appended."""
    named = datasets if isinstance(datasets, dict) else None
    parts = list(datasets.values()) if named else list(datasets)
    if named:
        renamed = []
        for key, d in named.items():
            fix = {n: f"{n}-{key}" for n in d.names()}
            out = Dataset(attrs=d.attrs)
            for n, e in d.elements.items():
                cs = e.transforms if merge_coordinate_systems else {f"{c}-{key}": t for c, t in e.transforms.items()}
                out.elements[fix[n]] = replace(e, transforms=dict(cs))
            for n, t in d.tables.items():
                if t.annotates:
                    new = F.coalesce(*(F.when(F.col(t.region_key) == r, F.lit(fix.get(r, r))) for r in t.region), F.col(t.region_key))
                    t = replace(t, obs=t.obs.withColumn(t.region_key, new), region=[fix.get(r, r) for r in t.region])
                out.tables[n if concatenate_tables else fix[n]] = t
            renamed.append(out)
        parts = renamed
    names = [n for d in parts for n in d.elements]
    if len({n.lower() for n in names}) != len(names):
        raise KeyError("elements have the same name; pass a dict to tell them apart")
    tables: dict[str, Table] = {}
    shared = common_keys(parts)
    if shared and not concatenate_tables:
        raise KeyError(f"tables {sorted(shared)} are in several datasets; concatenate them or pass a dict")
    for n in dict.fromkeys(n for d in parts for n in d.tables):
        own = [d.tables[n] for d in parts if n in d.tables]
        tables[n] = concat_tables(own, region_key, instance_key) if len(own) > 1 else own[0]
        if obs_names_make_unique and len(own) > 1:
            tables[n] = replace(tables[n], obs=tables[n].obs.withColumn("obs_name", F.concat_ws("-", "obs_name", F.shiftright("obs_pos", 40).cast("string"))))
    attrs: dict = {}
    if attrs_merge is not None:
        attrs = attrs_merge([d.attrs for d in parts])
    else:
        for d in parts:
            for k, v in d.attrs.items():
                if k in attrs and attrs[k] != v:
                    attrs[k] = None
                else:
                    attrs[k] = v
        attrs = {k: v for k, v in attrs.items() if v is not None}
    return Dataset({n: e for d in parts for n, e in d.elements.items()}, tables, attrs)


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same rows, in any order, with repetitions."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def elements_equal(a: Element, b: Element, transforms: bool = True) -> bool:
    return a.kind == b.kind and (not transforms or (a.transforms.keys() == b.transforms.keys() and all(a.transforms[k] == b.transforms[k] for k in a.transforms))) and frames_equal(a.df, b.df)


def datasets_equal(a: Dataset, b: Dataset) -> bool:
    if a.elements.keys() != b.elements.keys() or a.tables.keys() != b.tables.keys():
        return False
    return all(elements_equal(a.elements[n], b.elements[n]) for n in a.elements) and all(frames_equal(a.tables[n].obs, b.tables[n].obs) for n in a.tables)
