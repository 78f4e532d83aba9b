"""Affine maps between named axes, on the driver.

A transform is a set of linear forms: each output axis is a combination of input axes plus an offset. Axes that a
transform doesn't mention pass through it. Sequences substitute forms into forms, so any chain folds into one form
per axis before Spark sees it, as plain arithmetic over columns.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence as Seq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("c", "z", "y", "x")
Form = tuple[dict[str, float], float]  # coefficients by axis, offset


def check_axes(axes: Iterable[str]) -> tuple[str, ...]:
    axes = tuple(axes)
    if bad := [a for a in axes if a not in AXES]:
        raise ValueError(f"invalid axes {bad}; allowed: {AXES}")
    if len(set(axes)) != len(axes):
        raise ValueError(f"repeated axes {axes}")
    return axes


class Transform:
    """Base of all transforms; ``rows(present)`` gives the forms it defines and the inputs it uses up."""

    def rows(self, present: tuple[str, ...]) -> tuple[dict[str, Form], set[str]]:
        raise NotImplementedError

    def inverse(self) -> Transform:
        raise NotImplementedError

    def forms(self, current: dict[str, Form]) -> dict[str, Form]:
        """Forms of all axes after this transform, given those before it."""
        own, used = self.rows(tuple(current))
        out = {a: f for a, f in current.items() if a not in used and a not in own}
        for a, (coefficients, offset) in own.items():
            total: dict[str, float] = {}
            for b, k in coefficients.items():
                if b in current:
                    for c, v in current[b][0].items():
                        total[c] = total.get(c, 0.0) + k * v
                    offset += k * current[b][1]
            out[a] = (total, offset)
        return out

    def output_axes(self, inputs: Seq[str]) -> tuple[str, ...]:
        return tuple(self.forms({a: ({a: 1.0}, 0.0) for a in check_axes(inputs)}))

    def matrix(self, inputs: Seq[str], outputs: Seq[str] | None = None) -> np.ndarray:
        """The homogeneous matrix from ``inputs`` to ``outputs`` (the same axes, if not given)."""
        inputs = check_axes(inputs)
        outputs = inputs if outputs is None else check_axes(outputs)
        forms = self.forms({a: ({a: 1.0}, 0.0) for a in inputs})
        m = np.zeros((len(outputs) + 1, len(inputs) + 1))
        m[-1, -1] = 1
        for i, a in enumerate(outputs):
            coefficients, offset = forms.get(a, ({}, 0.0))
            m[i, -1] = offset
            for j, b in enumerate(inputs):
                m[i, j] = coefficients.get(b, 0.0)
        return m

    def affine(self, inputs: Seq[str], outputs: Seq[str] | None = None) -> Affine:
        outputs = inputs if outputs is None else outputs
        return Affine(self.matrix(inputs, outputs), inputs, outputs)

    def then(self, other: Transform) -> Sequence:
        return Sequence([self, other])

    def columns(self, inputs: dict[str, Column], outputs: Seq[str] | None = None) -> dict[str, Column]:
        """The output axes as expressions over input columns; constants are folded beforehand."""
        m, names = self.matrix(tuple(inputs), outputs), list(inputs)
        return {a: linear_column(m[i], [inputs[n] for n in names]) for i, a in enumerate(outputs or names)}

    def to_dict(self) -> dict:
        raise NotImplementedError

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Transform) and self.to_dict() == other.to_dict()

    __hash__ = None  # type: ignore[assignment]

    def same_as(self, other: Transform, axes: Seq[str] = ("y", "x")) -> bool:
        return np.allclose(self.matrix(axes), other.matrix(axes))


def linear_column(row: np.ndarray, cols: list[Column]) -> Column:
    """``row[:-1] . cols + row[-1]`` without the terms that do nothing."""
    out = None
    for k, c in zip(row[:-1], cols):
        if k != 0:
            term = c if k == 1 else c * F.lit(float(k))
            out = term if out is None else out + term
    if out is None:
        return F.lit(float(row[-1]))
    return out if row[-1] == 0 else out + F.lit(float(row[-1]))


class Identity(Transform):
    def rows(self, present):
        return {}, set()

    def inverse(self):
        return Identity()

    def to_dict(self):
        return {"type": "identity"}


class Translation(Transform):
    def __init__(self, translation: Seq[float], axes: Seq[str]):
        self.axes, self.translation = check_axes(axes), np.asarray(translation, float)
        if self.translation.shape != (len(self.axes),):
            raise ValueError("one value an axis is needed")

    def rows(self, present):
        return {a: ({a: 1.0}, float(v)) for a, v in zip(self.axes, self.translation) if a in present}, set()

    def inverse(self):
        return Translation(-self.translation, self.axes)

    def to_dict(self):
        return {"type": "translation", "translation": self.translation.tolist(), "axes": list(self.axes)}


class Scale(Transform):
    def __init__(self, scale: Seq[float], axes: Seq[str]):
        self.axes, self.scale = check_axes(axes), np.asarray(scale, float)
        if self.scale.shape != (len(self.axes),):
            raise ValueError("one value an axis is needed")

    def rows(self, present):
        return {a: ({a: float(v)}, 0.0) for a, v in zip(self.axes, self.scale) if a in present}, set()

    def inverse(self):
        return Scale(1 / self.scale, self.axes)

    def to_dict(self):
        return {"type": "scale", "scale": self.scale.tolist(), "axes": list(self.axes)}


class MapAxis(Transform):
    """``mapping[out] = in``."""

    def __init__(self, mapping: dict[str, str]):
        check_axes(mapping)
        check_axes(set(mapping.values()))
        self.mapping = dict(mapping)

    def rows(self, present):
        own = {o: ({i: 1.0}, 0.0) for o, i in self.mapping.items() if i in present}
        return own, set(self.mapping.values()) - set(self.mapping)

    def inverse(self):
        if len(set(self.mapping.values())) != len(self.mapping):
            raise ValueError("only a mapping that uses each axis once has an inverse")
        return MapAxis({i: o for o, i in self.mapping.items()})

    def to_dict(self):
        return {"type": "mapAxis", "mapAxis": self.mapping}


class Affine(Transform):
    def __init__(self, matrix, input_axes: Seq[str], output_axes: Seq[str]):
        self.input_axes, self.output_axes_ = check_axes(input_axes), check_axes(output_axes)
        self.m = np.asarray(matrix, float)
        if self.m.shape != (len(self.output_axes_) + 1, len(self.input_axes) + 1):
            raise ValueError(f"the matrix has shape {self.m.shape}")
        if not np.array_equal(self.m[-1], [0.0] * len(self.input_axes) + [1.0]):
            raise ValueError("the last row must be 0 ... 0 1")

    def rows(self, present):
        own = {}
        for i, o in enumerate(self.output_axes_):
            own[o] = ({a: float(k) for a, k in zip(self.input_axes, self.m[i]) if k}, float(self.m[i, -1]))
        return own, set(self.input_axes) - set(self.output_axes_)

    def inverse(self):
        return Affine(np.linalg.inv(self.m), self.output_axes_, self.input_axes)

    def to_dict(self):
        return {"type": "affine", "affine": self.m[:-1].tolist(), "input": list(self.input_axes), "output": list(self.output_axes_)}


class Sequence(Transform):
    """Transforms one after the other; the first is applied first."""

    def __init__(self, parts: Seq[Transform]):
        self.parts = list(parts)

    def rows(self, present):
        raise TypeError("a sequence has no rows of its own")

    def forms(self, current):
        for t in self.parts:
            current = t.forms(current)
        return current

    def inverse(self):
        return Sequence([t.inverse() for t in reversed(self.parts)])

    def to_dict(self):
        return {"type": "sequence", "transformations": [t.to_dict() for t in self.parts]}


class ByDimension(Sequence):
    """Transforms of separate axes, side by side."""

    def to_dict(self):
        return {"type": "byDimension", "transformations": [t.to_dict() for t in self.parts]}


def rotation(theta: float) -> Affine:
    """Counter-clockwise in (x, y)."""
    c, s = float(np.cos(theta)), float(np.sin(theta))
    return Affine([[c, -s, 0], [s, c, 0], [0, 0, 1]], ("x", "y"), ("x", "y"))


def from_dict(d: dict) -> Transform:
    """The transform that ``to_dict`` described; a ``rotation`` is read too."""
    kind = d["type"]
    if kind == "identity":
        return Identity()
    if kind == "translation":
        return Translation(d["translation"], d["axes"])
    if kind == "scale":
        return Scale(d["scale"], d["axes"])
    if kind == "mapAxis":
        return MapAxis(d["mapAxis"])
    if kind == "affine":
        return Affine([*d["affine"], [0.0] * len(d["input"]) + [1.0]], d["input"], d["output"])
    if kind == "rotation":
        n = len(d["axes"])
        m = np.eye(n + 1)
        m[:n, :n] = d["rotation"]
        return Affine(m, d["axes"], d["axes"])
    if kind in ("sequence", "byDimension"):
        return (Sequence if kind == "sequence" else ByDimension)([from_dict(x) for x in d["transformations"]])
    raise ValueError(f"unknown transform {kind!r}")


def decompose(t: Transform, axes: Seq[str], simple: bool = True) -> Sequence:
    """(linear, translation), or (reflection, rotation, shear, scale, translation) of a 2D transform."""
    axes = tuple(a for a in check_axes(axes) if a != "c")
    if "z" in axes or t.output_axes(axes) != axes:
        raise ValueError("a 2D transform that keeps its axes is needed")
    if "c" in t.output_axes(("c", *axes)) and not np.allclose(t.matrix(("c", *axes))[0], [1] + [0] * (len(axes) + 1)):
        raise ValueError("the channel axis must not be transformed")
    m = t.matrix(axes)
    a, move = m[:-1, :-1], Translation(m[:-1, -1], axes)
    linear = lambda k: Affine(np.block([[k, np.zeros((2, 1))], [np.zeros((1, 2)), np.ones((1, 1))]]), axes, axes)
    if simple:
        return Sequence([linear(a), move])
    # a = upper triangular @ orthogonal, from the QR factors of the matrix turned around
    flip = np.eye(2)[::-1]
    q0, r0 = np.linalg.qr((flip @ a).T)
    r, q = flip @ r0.T @ flip, flip @ q0.T
    signs = np.diag(np.sign(np.diag(r)))
    r, q = r @ signs, signs @ q
    mirror = np.diag([1.0, np.sign(np.linalg.det(q))])
    turn = q @ mirror
    size = np.diag(np.diag(r))
    shear = np.linalg.inv(size) @ r
    return Sequence([Scale(np.diag(mirror), axes), linear(turn), linear(shear), Scale(np.diag(size), axes), move])


def circle_factor(m: np.ndarray) -> tuple[float, bool]:
    """What a radius is multiplied by under a linear map (mean modulus of its eigenvalues), and whether all agree."""
    sizes = np.abs(np.linalg.eigvals(np.asarray(m, float)))
    return float(sizes.mean()), bool(np.allclose(sizes, sizes[0]))


def fit_affine(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The least-squares affine matrix from points to points (rows)."""
    a = np.column_stack([source, np.ones(len(source))])
    m = np.eye(3)
    m[:2] = np.linalg.lstsq(a, target, rcond=None)[0].T
    return m


def fit_similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The least-squares similarity (turn, size, move) from points to points."""
    p, q = source - source.mean(0), target - target.mean(0)
    u, s, vt = np.linalg.svd(q.T @ p / len(p))
    d = np.array([1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    turn = u @ np.diag(d) @ vt
    size = (s * d).sum() / p.var(axis=0).sum()
    m = np.eye(3)
    m[:2, :2] = size * turn
    m[:2, 2] = target.mean(0) - size * turn @ source.mean(0)
    return m


def landmarks_transform(moving: np.ndarray, reference: np.ndarray) -> Transform:
    """A similarity that takes landmarks to their references, after a reflection if they are mirrored."""
    moving, reference = np.asarray(moving, float), np.asarray(reference, float)
    if len(moving) != len(reference) or len(moving) < 3:
        raise ValueError("as many landmarks as references are needed, three at least")
    flip = np.eye(3)
    if np.linalg.det(fit_affine(moving, reference)[:2, :2]) < 0:
        flip[0, 0] = -1
    m = fit_similarity(moving @ flip[:2, :2].T, reference)
    return Sequence([Affine(flip, ("x", "y"), ("x", "y")), Affine(m, ("x", "y"), ("x", "y"))])


@dataclass
class CoordinateGraph:
    """Elements and coordinate systems, linked by transforms and their inverses."""

    edges: dict[str, dict[str, Transform]]

    @classmethod
    def of(cls, elements: dict[str, dict[str, Transform]]) -> CoordinateGraph:
        """``elements``: the transforms of each element by coordinate system; element nodes are named ``@name``."""
        edges: dict[str, dict[str, Transform]] = {}
        for name, transforms in elements.items():
            for cs, t in transforms.items():
                edges.setdefault(f"@{name}", {})[cs] = t
                edges.setdefault(cs, {})
                try:
                    edges[cs][f"@{name}"] = t.inverse()
                except (ValueError, np.linalg.LinAlgError):
                    continue
        return cls(edges)

    def paths(self, source: str, target: str) -> list[list[str]]:
        """All paths without repeated nodes, shortest first."""
        found, queue = [], deque([[source]])
        while queue:
            path = queue.popleft()
            for n in self.edges.get(path[-1], {}):
                if n == target:
                    found.append([*path, n])
                elif n not in path:
                    queue.append([*path, n])
        return found

    def between(self, source: str, target: str, via: str | None = None, shortest: bool = True) -> Transform:
        if source == target:
            return Identity()
        paths = self.paths(source, target)
        if not paths:
            raise RuntimeError(f"no path leads from {source} to {target}")
        if via is not None:
            paths = [p for p in paths if via in p]
            if not paths:
                raise RuntimeError(f"no path leads from {source} to {target} by {via}")
        direct = [p for p in paths if len(p) == 2]
        if len(paths) > 1 and via is None and len(direct) == 1:
            paths = direct
        elif len(paths) > 1 and shortest:
            paths = [p for p in paths if len(p) == len(paths[0])]
        if len(paths) > 1:
            raise RuntimeError(f"several paths lead from {source} to {target}: {paths}; name one on the way")
        return Sequence([self.edges[a][b] for a, b in zip(paths[0], paths[0][1:])])
