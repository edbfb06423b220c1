"""Grid operators against numpy on whole arrays."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import grids as G
from orbweave.operators import paths as P

BY = ("part",)


def frame(spark, masks):
    rows = [(part, *map(int, c)) for part, mask in masks.items() for c in np.argwhere(mask)]
    return spark.createDataFrame(rows, "part string, z long, y long, x long")


def box_of(spark, masks):
    rows = [(part, 0, 0, 0, *[n - 1 for n in mask.shape]) for part, mask in masks.items()]
    return spark.createDataFrame(rows, "part string, lo_z long, lo_y long, lo_x long, hi_z long, hi_y long, hi_x long")


def array(df, shape, part):
    out = np.zeros(shape, bool)
    for r in df.where(F.col("part") == part).collect():
        out[r.z, r.y, r.x] = True
    return out


def blobs(seed, shape, share):
    return np.random.default_rng(seed).random(shape) < share


@pytest.fixture(scope="module")
def masks():
    solid = np.ones((4, 5, 6), bool)
    dot = np.zeros((3, 3, 3), bool)
    dot[1, 1, 1] = True
    return {"a": blobs(1, (5, 9, 20), 0.9), "b": blobs(2, (12, 4, 7), 0.5), "full": solid, "dot": dot}


def plain_depth(mask, padded=False):
    empty = np.argwhere(~(np.pad(mask, 1) if padded else mask)) - (1 if padded else 0)
    return {tuple(map(int, c)): (float(((empty - c) ** 2).sum(1).min()) ** 0.5 if len(empty) else np.inf) for c in np.argwhere(mask)}


def kernel_depth(mask):
    """The same with an empty border, by the numpy kernel, which test_kernels holds against brute force."""
    deep = P.distance_to_background(np.pad(mask, 1))[1:-1, 1:-1, 1:-1]
    return {tuple(map(int, c)): float(deep[tuple(c)]) for c in np.argwhere(mask)}


def test_depth_is_exact(spark, masks):
    cells = frame(spark, masks)
    for box, padded in ((box_of(spark, masks), False), (None, True)):
        got = {}
        for r in G.depth(cells, box, BY).collect():
            got.setdefault(r.part, {})[r.z, r.y, r.x] = r.depth
        for part, mask in masks.items():
            want = plain_depth(mask, padded)
            assert got[part].keys() == want.keys() and all(got[part][c] == pytest.approx(want[c], abs=1e-12) for c in want), part


def test_depth_of_no_cells_and_repeats(spark):
    none = spark.createDataFrame([], "part string, z long, y long, x long")
    assert G.depth(none, None, BY).count() == 0
    twice = spark.createDataFrame([(None, 0, 0, 0)] * 2 + [("a", -3, 0, 5)], "part string, z long, y long, x long")
    assert sorted((r.part or "", r.depth) for r in G.depth(twice, None, BY).collect()) == [("", 1.0), ("a", 1.0)]


def plain_dilated(mask):
    p = np.pad(mask, 1)
    out = np.zeros_like(mask)
    for s in itertools.product(range(3), repeat=3):
        out |= p[s[0] : s[0] + mask.shape[0], s[1] : s[1] + mask.shape[1], s[2] : s[2] + mask.shape[2]]
    return out


def plain_eroded(mask):
    p = np.pad(mask, 1)
    out = np.ones_like(mask)
    for s in itertools.product(range(3), repeat=3):
        out &= p[s[0] : s[0] + mask.shape[0], s[1] : s[1] + mask.shape[1], s[2] : s[2] + mask.shape[2]]
    return out


def test_growing_and_closing(spark, masks):
    cells, box = frame(spark, masks), box_of(spark, masks)
    grown, closed = G.grown(cells, box, BY), G.closed(cells, box, BY)
    for part, mask in masks.items():
        assert (array(grown, mask.shape, part) == plain_dilated(mask)).all()
        assert (array(closed, mask.shape, part) == plain_eroded(plain_dilated(mask))).all()


def test_cheapest_paths_cross_blocks_and_equal_a_plain_search(spark):
    tube = np.zeros((6, 40, 45), bool)  # a bent tube through several blocks
    tube[1:5, 2:7, 2:40] = True
    tube[1:5, 2:38, 34:40] = True
    tube[1:5, 32:38, 5:40] = True
    tube &= blobs(4, tube.shape, 0.97)
    small = blobs(5, (3, 3, 9), 0.95)
    small[1, 1] = True
    apart = np.ones((3, 3, 9), bool)
    apart[:, :, 4] = False
    masks = {"tube": tube, "small": small, "apart": apart}
    ends = {"tube": ((2, 4, 2), (3, 35, 6)), "small": ((1, 1, 0), (1, 1, 8)), "apart": ((1, 1, 0), (1, 1, 8))}
    tube[2, 4, 2] = tube[3, 35, 6] = True
    table = spark.createDataFrame([(k, *a, *b) for k, (a, b) in ends.items()], "part string, start_z long, start_y long, start_x long, end_z long, end_y long, end_x long")
    deep = G.depth(frame(spark, masks), None, BY)
    got = {}
    for r in sorted(G.least_paths(deep, table, BY).collect(), key=lambda r: r.node_idx):
        got.setdefault(r.part, []).append((r.z, r.y, r.x))
    assert set(got) == {"tube", "small"}
    for part, path in got.items():
        mask, (a, b) = masks[part], ends[part]
        want = P.central_cells(mask, a, b)
        deep_of = kernel_depth(mask)
        cost = lambda p: sum(1 / (1e-3 + min(deep_of[u], deep_of[v])) for u, v in zip(p, p[1:]))  # noqa: B023, E731
        assert path[0] == a and path[-1] == b and all(sum(abs(i - j) for i, j in zip(u, v)) == 1 for u, v in zip(path, path[1:]))
        assert cost(path) == pytest.approx(cost(want), abs=1e-9)


def test_costs_of_all_cells(spark):
    mask = blobs(8, (20, 20, 20), 0.6)
    mask[0, 0, 0] = True
    deep = kernel_depth(mask)
    rows = spark.createDataFrame([("a", *c, d) for c, d in deep.items()], "part string, z long, y long, x long, depth double")
    start = spark.createDataFrame([("a", 0, 0, 0)], "part string, z long, y long, x long")
    cells = sorted(deep)
    number = {c: k for k, c in enumerate(cells)}
    step = lambda c, d: tuple(i + j for i, j in zip(c, d))
    moves = [m for m in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, m)) == 1]
    far, _ = P.shortest([[(number[e], 1 / (1e-3 + min(deep[c], deep[e]))) for m in moves if (e := step(c, m)) in number] for c in cells], number[0, 0, 0])
    got = {(r.z, r.y, r.x): r for r in G.spread(rows, start, BY).collect()}
    assert len(got) == len(cells) and all(got[c].cost == far[k] for c, k in number.items())
    for c, r in got.items():
        if np.isfinite(r.cost) and r.cost > 0:
            before = (r.before_z, r.before_y, r.before_x)
            assert got[before].cost + 1 / (1e-3 + min(deep[c], deep[before])) == r.cost


def plain_downhill(seeds, goal, rounds, offset):
    targets = np.argwhere(goal)
    edt = np.array([[[min(((np.array((z, y, x)) - t) ** 2).sum() for t in targets) ** 0.5 for x in range(seeds.shape[2])] for y in range(seeds.shape[1])] for z in range(seeds.shape[0])])
    inside = seeds.copy()
    for _ in range(rounds):
        new = inside.copy()
        for c in map(tuple, np.argwhere(~inside)):
            near = [edt[e] for a in range(3) for s in (-1, 1) if 0 <= (e := tuple(v + s * (k == a) for k, v in enumerate(c)))[a] < seeds.shape[a] and inside[e]]
            new[c] = bool(near) and edt[c] < min(near) - offset
        if (new == inside).all():
            break
        inside = new
    return inside


def test_guided_growth(spark):
    seeds, goal = blobs(11, (6, 18, 30), 0.004), blobs(12, (6, 18, 30), 0.004)
    seeds[:, :, 15:] = False
    goal[:, :, :14] = False
    both = {"a": seeds, "lonely": seeds[:2, :5]}
    grown = G.downhill(frame(spark, both), frame(spark, {"a": goal}), box_of(spark, both), BY, 20, 0.4)
    assert (array(grown, seeds.shape, "a") == plain_downhill(seeds, goal, 20, 0.4)).all()
    assert (array(grown, (2, 5, 30), "lonely") == seeds[:2, :5]).all()


def test_ends_along_the_axis(spark):
    mask = np.zeros((4, 30, 9), bool)
    mask[1:3, 3:28, 4:6] = True
    r = G.axis_end_cells(frame(spark, {"a": mask}), BY).first()
    assert {r.start_y, r.end_y} == {3, 27}
