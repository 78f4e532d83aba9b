import math

import numpy as np
import pytest

from tessera.transforms import Affine, ByDimension, CoordinateGraph, Identity, MapAxis, Scale, Sequence, Translation, circle_factor, decompose, from_dict, landmarks_transform, rotation


def test_forms_pass_unmentioned_axes():
    t = Translation([5], ("x",))
    assert t.matrix(("x", "y")).tolist() == [[1, 0, 5], [0, 1, 0], [0, 0, 1]]
    assert Scale([2, 3], ("y", "z")).matrix(("x", "y")).tolist() == [[1, 0, 0], [0, 2, 0], [0, 0, 1]]
    assert t.matrix(("c", "y")).tolist() == np.eye(3).tolist()


def test_map_axis_and_inverse():
    t = MapAxis({"x": "y", "y": "x"})
    assert t.matrix(("x", "y")).tolist() == [[0, 1, 0], [1, 0, 0], [0, 0, 1]]
    assert t.inverse().matrix(("x", "y")).tolist() == t.matrix(("x", "y")).tolist()
    with pytest.raises(ValueError):
        MapAxis({"x": "y", "z": "y"}).inverse()


def test_affine_changes_axes():
    t = Affine([[1, 2, 3], [4, 5, 6], [7, 8, 9], [0, 0, 1]], ("x", "y"), ("x", "y", "z"))
    assert t.output_axes(("x", "y")) == ("x", "y", "z")
    assert t.matrix(("x", "y"), ("z", "x")).tolist() == [[7, 8, 9], [1, 2, 3], [0, 0, 1]]
    with pytest.raises(ValueError):
        Affine([[1, 0], [1, 1]], ("x",), ("x",))
    with pytest.raises(ValueError):
        Affine([[1, 0, 0], [0, 0, 1]], ("x",), ("x",))


def test_sequence_order_and_inverse():
    t = Sequence([Translation([1], ("x",)), Scale([2], ("x",)), rotation(0.3)])
    p = np.array([3.0, 4.0, 1.0])
    c, s = math.cos(0.3), math.sin(0.3)
    assert np.allclose(t.matrix(("x", "y")) @ p, [c * 8 - s * 4, s * 8 + c * 4, 1])
    assert np.allclose(t.inverse().matrix(("x", "y")) @ t.matrix(("x", "y")), np.eye(3))


def test_dict_round_trip():
    t = Sequence([Identity(), Translation([1], ("x",)), ByDimension([Scale([2], ("x",)), Scale([3], ("y",))]), MapAxis({"x": "y", "y": "x"}), rotation(1)])
    assert from_dict(t.to_dict()) == t
    assert np.allclose(from_dict({"type": "rotation", "rotation": [[0, -1], [1, 0]], "axes": ["x", "y"]}).matrix(("x", "y"))[:2, :2], [[0, -1], [1, 0]])


@pytest.mark.parametrize("m", [[[2, 1], [0.5, 3]], [[-1, 0.3], [0.2, 2]], [[0, 1], [1, 0]]])
def test_decompose(m):
    t = Affine([[*m[0], 7], [*m[1], 8], [0, 0, 1]], ("x", "y"), ("x", "y"))
    for simple in (True, False):
        parts = decompose(t, ("x", "y"), simple)
        assert np.allclose(parts.matrix(("x", "y")), t.matrix(("x", "y")))
    turn = parts.parts[1].matrix(("x", "y"))[:2, :2]
    assert np.allclose(turn @ turn.T, np.eye(2)) and np.isclose(np.linalg.det(turn), 1)
    assert np.allclose(np.tril(parts.parts[2].matrix(("x", "y"))[:2, :2], -1), 0) and (parts.parts[3].scale > 0).all()


def test_circle_factor():
    assert circle_factor(np.diag([2.0, 2.0])) == (2.0, True)
    assert circle_factor(np.diag([1.0, 3.0])) == (2.0, False)


def test_landmarks():
    src = np.array([[0, 0], [4, 0], [4, 2], [1, 5.0]])
    t = Sequence([Scale([-1, 1], ("x", "y")), rotation(0.5), Scale([3, 3], ("x", "y")), Translation([1, 2], ("x", "y"))])
    m = t.matrix(("x", "y"))
    found = landmarks_transform(src, src @ m[:2, :2].T + m[:2, 2])
    assert np.allclose(found.matrix(("x", "y")), m)


def test_graph():
    a, b = Scale([2], ("x",)), Translation([3], ("x",))
    g = CoordinateGraph.of({"e": {"one": a, "two": b}, "f": {"two": a}})
    assert g.between("one", "one") == Identity()
    assert np.allclose(g.between("one", "two").matrix(("x",)), Sequence([a.inverse(), b]).matrix(("x",)))
    assert np.allclose(g.between("@e", "two").matrix(("x",)), b.matrix(("x",)))
    assert len(g.between("@f", "one").parts) == 3
    with pytest.raises(RuntimeError, match="no path"):
        g.between("one", "three")
    two = CoordinateGraph.of({"e": {"one": a, "two": b}, "f": {"one": a, "two": b}})
    with pytest.raises(RuntimeError, match="several"):
        two.between("one", "two")
    assert len(two.between("one", "two", via="@f").parts) == 2
    with pytest.raises(RuntimeError, match="by @g"):
        two.between("one", "two", via="@g")
