import itertools

import numpy as np
import pytest

from orbweave.functions.scalar import voxel_size
from orbweave.operators import geometry as G
from orbweave.operators import paths as P
from orbweave.operators.matching import assignment


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = sorted(rng.integers(1, 6, 2).tolist())
        cost = rng.integers(0, 9, (n, m)).astype(float)
        best = min(sum(cost[k, c] for k, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        got = assignment(cost)
        assert len(set(got)) == n and cost[np.arange(n), got].sum() == best


def test_hulls():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])
    assert G.polygon_area(G.hull(square)) == 1.0 and len(G.hull(square)) == 4
    assert G.intersection_over_union(square, square + 0.5) == pytest.approx(1 / 7)
    assert G.intersection_over_union(square, square + 5) == 0 and G.intersection_over_union(square, square[:2]) is None
    cube = np.array(list(itertools.product([0, 2], repeat=3)), float)
    assert G.hull_volume(np.concatenate([cube, cube / 2])) == pytest.approx(8) and G.hull_volume(cube[:4] * [0, 1, 1]) == 0
    ball = np.random.default_rng(1).normal(size=(400, 3))
    assert 3.5 < G.hull_volume(ball / np.linalg.norm(ball, axis=1, keepdims=True)) < 4 * np.pi / 3


def test_depth_matches_brute_force():
    mask = np.random.default_rng(2).random((5, 6, 7)) < 0.8
    empty = np.argwhere(~mask)
    want = np.array([[[min(np.linalg.norm(np.array(c) - e) for e in empty) for c in row] for row in plane] for plane in np.moveaxis(np.indices(mask.shape), 0, -1)])
    assert np.allclose(P.distance_to_background(mask), want)


def test_central_path_keeps_to_the_middle():
    mask = np.ones((3, 3, 9), bool)
    path = P.central_cells(mask, (1, 1, 0), (1, 1, 8))
    assert path == [(1, 1, k) for k in range(9)]
    mask[:, :, 4] = False
    assert P.central_cells(mask, (1, 1, 0), (1, 1, 8)) == []


def test_tree_edge_and_hops():
    p = np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0], [5, 0, 0]], float)
    assert P.longest_tree_edge(p) == 3
    graph = P.radius_graph(p, 3)
    assert P.most_distant(graph) == (0, 3) and P.fewest_hops(graph, 0, 3) == [0, 2, 3]
    assert P.smooth(p, 1)[0].tolist() == [pytest.approx(1 / 3), 0, 0]


def test_voxel_sizes():
    assert voxel_size(0.38) == (0.38,) * 3 and voxel_size("0.38,0.38,1") == (0.38, 0.38, 1.0) and voxel_size([2]) == (2.0,) * 3
    with pytest.raises(ValueError):
        voxel_size("1,2")
    assert G.downscale_factors(10.0, (0.38, 3.0, 20.0)) == (26, 3, 1)
    assert G.crop_box({"x": 5.0}, {"x": 2.0}, {"x": 0.5}, {"x": 13}) == {"x": (6, 13)}
