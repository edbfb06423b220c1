from collections import Counter
from itertools import product

import numpy as np
import pytest

from orbweave.operators import mesh as M


def built(mask, scale):
    """Triangles of the whole mesh of a padded mask, cube by cube."""
    out = []
    for z, y, x in product(*[range(n - 1) for n in mask.shape]):
        config = sum(1 << k for k, (a, b, c) in enumerate(M.CORNERS) if mask[z + a, y + b, x + c])
        out.append(M.triangles(config, scale) + np.array([z, y, x]) * scale)
    return np.concatenate(out)


def test_cases():
    assert M.cube(0) == (0, 0) and M.cube(255) == (0, pytest.approx(1))
    one, most = M.cube(1), M.cube(254)
    assert one == (pytest.approx(3**0.5 / 8), pytest.approx(1 / 48)) and most == (pytest.approx(one[0]), pytest.approx(47 / 48))
    assert M.cube(0b1111) == (pytest.approx(1), pytest.approx(1 / 2))
    assert M.cube(1, (2.0, 2.0, 2.0)) == (pytest.approx(4 * one[0]), pytest.approx(8 * one[1]))


def test_measures_equal_those_of_the_mesh(spark):
    rng, scale = np.random.default_rng(4), (1.0, 0.5, 0.25)
    masks = {k: np.pad(rng.random((5, 6, 4)) < share, 1) for k, share in ((1, 0.2), (2, 0.5), (3, 0.8))}
    rows = [(*map(int, c), k) for k, m in masks.items() for c in np.argwhere(m)] + [(0, 0, 0, 0)]
    got = {r.label: r for r in M.mesh_measures(spark.createDataFrame(rows, "z long, y long, x long, label long"), scale).collect()}
    assert got.keys() == masks.keys()
    for k, mask in masks.items():
        t = built(mask, np.array(scale))
        sides = Counter((tuple(a), tuple(b)) for p in np.round(t, 6) for a, b in zip(p, p[[1, 2, 0]], strict=True))
        assert all(sides[b, a] == n for (a, b), n in sides.items())  # closed
        assert got[k].surface == pytest.approx(np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1).sum() / 2)
        assert got[k].volume == pytest.approx(np.einsum("ij,ij->i", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6)
    assert M.mesh_measures(spark.createDataFrame([], "z long, y long, x long, label long")).count() == 0


def test_ball(spark):
    r = 9
    rows = [(z, y, x, 1) for z, y, x in product(range(-r, r + 1), repeat=3) if z * z + y * y + x * x <= r * r]
    got = M.mesh_measures(spark.createDataFrame(rows, "z long, y long, x long, label long")).first()
    assert 1 < got.surface / (4 * np.pi * r**2) < 1.12 and got.volume == pytest.approx(len(rows), rel=0.05)
