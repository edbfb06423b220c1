"""Runs along the larger cell type and masks of the organ, against plain numpy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import canal as C
from orbweave.operators import paths as P
from tests.test_grids import plain_depth, plain_dilated, plain_downhill, plain_eroded

KIND = "label_id long, dataset long, component_labels long, anchor_x double, anchor_y double, anchor_z double"


def tube(angles, radius=300.0, n=14, seed=0, centre=(400.0, 350.0, 60.0)):
    """Points around an arc."""
    rng = np.random.default_rng(seed)
    out = []
    for a in angles:
        for _ in range(n):
            r, z = radius + rng.uniform(-22, 22), rng.uniform(-22, 22)
            out.append((centre[0] + r * math.cos(a), centre[1] + r * math.sin(a), centre[2] + z))
    return np.array(out)


def rows_of(parts, dataset=1, start=0):
    labelled = [(label, *map(float, p)) for label, points in parts.items() for p in points]
    return [(start + k, dataset, *row) for k, row in enumerate(labelled, 1)]


def plain_path(points, scale):
    """Coarse mask, closing, ends, depth, cheapest path and smoothing of one component on whole arrays."""
    cells = np.unique(np.floor(points / scale).astype(int), axis=0)
    mask = np.zeros(cells.max(0) + 1, bool)
    mask[tuple(cells.T)] = True
    mask = plain_eroded(plain_dilated(plain_dilated(mask)))
    where = np.argwhere(mask)
    axis = np.linalg.eigh(np.cov(where.T))[1][:, -1]
    along = where @ (axis * np.sign(axis[np.abs(axis).argmax()]))
    a, b = tuple(where[along.argmin()]), tuple(where[along.argmax()])
    deep = np.zeros(mask.shape)
    for c, d in plain_depth(mask).items():
        deep[c] = d
    names = [tuple(map(int, c[::-1])) for c in where]  # z, y, x
    number = {c: k for k, c in enumerate(names)}
    of = lambda c: deep[c[::-1]]
    steps = ((-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0))
    graph = [[(number[e], 1 / (1e-3 + min(of(c), of(e)))) for s in steps if (e := tuple(i + j for i, j in zip(c, s))) in number] for c in names]
    far, _ = P.shortest(graph, number[tuple(map(int, a[::-1]))])
    k = number[tuple(map(int, b[::-1]))]
    if not np.isfinite(far[k]):
        return None
    path = [k]
    while far[path[-1]] > 0:
        path.append(min((j for j, w in graph[path[-1]] if far[j] + w == far[path[-1]]), key=lambda j: names[j]))
    cells = np.array([names[k][::-1] for k in path[::-1]]) * scale
    padded = np.pad(cells, ((3, 3), (0, 0)), "edge")
    return np.stack([padded[k : k + len(cells)] for k in range(7)]).sum(0) // 7


@pytest.fixture(scope="module")
def arcs():
    angle = np.linspace(0.15, 2.9, 90)
    near = {1: tube(angle[:30]), 2: tube(angle[33:60], seed=1), 3: tube(angle[63:], seed=2)}
    gap = {1: np.concatenate([tube(angle[:14], seed=3), tube(angle[16:30], seed=4)]), 2: tube(angle[40:60], seed=5)}
    return near, gap


def test_central_paths_equal_plain_ones(spark, arcs):
    near, gap = arcs
    rows = rows_of(near, 1) + rows_of(gap, 2, 10_000) + [(99_999, None, 1, 5.0, 5.0, 5.0), (99_998, 3, 9, 5.0, 5.0, 5.0)]
    got = {}
    for r in sorted(C.central_paths(spark.createDataFrame(rows, KIND), (1, 2, 3)).collect(), key=lambda r: r.node_idx):
        got.setdefault((r.dataset, r.component_labels), []).append((r.x, r.y, r.z))
    want = {}
    for dataset, parts in ((1, near), (2, gap)):
        scale = 10
        for label, points in parts.items():
            while (path := plain_path(points, scale)) is None:
                scale *= 2
            want[dataset, label] = path
    assert got.keys() == want.keys()
    for k, path in want.items():
        assert np.array_equal(np.array(got[k]), path), k


def test_runs_follow_the_arc_and_skip_gaps(spark, arcs):
    near, _ = arcs
    objects = spark.createDataFrame(rows_of(near) + [(9_999, 1, 8, 0.0, 0.0, 0.0)], KIND)
    run = C.measure_run_length(objects, (1, 2, 3)).toPandas().sort_values("node_idx")
    assert run.node_idx.tolist() == list(range(len(run))) and run.length_fraction.iloc[0] == 0 and run.length_fraction.iloc[-1] == 1
    assert run.y.iloc[0] > run.y.iloc[-1] or len(set(run.component_labels.iloc[[0, -1]])) == 2
    steps = np.linalg.norm(np.diff(run[["x", "y", "z"]].to_numpy(), axis=0), axis=1)
    same = run.component_labels.to_numpy()[1:] == run.component_labels.to_numpy()[:-1]
    assert run.length.iloc[-1] == pytest.approx(steps[same].sum()) and (np.diff(run.length_fraction) >= 0).all()
    angle = np.arctan2(run.y - 350, run.x - 400).to_numpy()
    turn = np.diff(angle) * np.sign(angle[-1] - angle[0])
    assert (~same).sum() == 2 and turn[~same].min() > 0 and (turn > -0.2).all()
    whole = C.measure_run_length(objects, (1, 2, 3), include_gap=True).toPandas()
    assert whole.length.max() == pytest.approx(steps.sum())
    found = C.mapped(objects, C.measure_run_length(objects, (1, 2, 3)), (1, 2, 3)).toPandas().set_index("label_id")
    places = objects.toPandas().set_index("label_id")
    for k, r in list(found.iterrows())[::97]:
        far = np.linalg.norm(run[["x", "y", "z"]].to_numpy() - places.loc[k, ["anchor_x", "anchor_y", "anchor_z"]].to_numpy(float), axis=1)
        assert r.offset == pytest.approx(far.min()) and r.length_fraction == run.length_fraction.iloc[far.argmin()]
    assert found.loc[9_999].offset == -1 and found.loc[9_999].frequency == 0


def end(at, out):
    return {"at": at, "out": out}


def path(a, b, out_a=(0, 0, 0), out_b=(0, 0, 0), length=100.0):
    return {"start": end(a, out_a), "end": end(b, out_b), "length": length}


def test_turning_of_paths():
    # the near ends meet, and the end with the higher y comes first
    one, two = path((0, 10, 0), (0, 6, 0)), path((0, 1, 0), (0, 5, 0))
    assert C.turned([one, two], 200, 600, True) == [(0, False), (1, True)]
    assert C.turned([one, two], 200, 600, False) == [(1, False), (0, True)]
    assert C.turned([path((0, 1, 0), (0, 2, 0))], 200, 600, True) == [(0, True)]
    # three in a row: the second is turned by the first, the third by the second
    three = [path((0, 30, 0), (0, 21, 0)), path((0, 11, 0), (0, 20, 0)), path((0, 1, 0), (0, 10, 0))]
    assert C.turned(three, 200, 600, True) == [(0, False), (1, True), (2, True)]
    # long paths whose gaps hardly differ: the straighter gap wins over the nearest
    a = path((0, 900, 0), (0, 100, 0), (0, 0, 0), (0, -1, 0), 800.0)
    b = path((60, 90, 0), (0, 0, 0), (0, 1, 0), (0, 1, 0), 800.0)
    assert C.turned([a, b], 200, 600, True)[1] == (1, True) and C.turned([a, b], 0, 600, True)[1] == (1, False)


@pytest.mark.parametrize("method", ["individual", "combined", "none"])
def test_masks_of_the_organ(spark, method):
    rng = np.random.default_rng(3)
    larger = {1: np.stack([rng.uniform(0, 120, 25), rng.uniform(0, 40, 25), rng.uniform(0, 30, 25)], 1)}
    smaller = {1: np.stack([rng.uniform(0, 120, 9), rng.uniform(70, 110, 9), rng.uniform(0, 30, 9)], 1)}
    edge, rounds, padding = (9.0, 8.0, 10.0), 2, 25.0
    got = C.organ_mask(spark.createDataFrame(rows_of(larger), KIND), spark.createDataFrame(rows_of(smaller), KIND), scale=edge, rounds=rounds, padding=padding, method=method)
    top = np.maximum(larger[1].max(0), smaller[1].max(0)) + padding
    shape = tuple((top // np.array(edge) + 1).astype(int))

    def mask(points):
        out = np.zeros(shape, bool)
        out[tuple((points / np.array(edge)).astype(int).T)] = True
        return out

    def often(m, n):
        for _ in range(n):
            m = plain_dilated(m)
        return m

    a, b = mask(larger[1]), mask(smaller[1])
    between = plain_downhill(b, a, 20, 0.4)
    want = {"individual": often(between | often(b, rounds) | often(a, rounds), 1), "combined": often(between | a | b, rounds), "none": between | a | b}[method]
    assert {(r.x, r.y, r.z) for r in got.collect()} == set(map(tuple, np.argwhere(want).tolist()))


def test_masks_of_one_type(spark):
    points = np.random.default_rng(5).uniform(0, 60, (12, 3))
    rows = spark.createDataFrame(rows_of({1: points}), KIND)
    shape = tuple(((points.max(0) + 20) // 10 + 1).astype(int))
    cells = np.zeros(shape, bool)
    cells[tuple((points / 10).astype(int).T)] = True
    for rounds in (-1, 0, 2):
        want = cells
        for _ in range(max(rounds, 0)):
            want = plain_dilated(want)
        want = plain_eroded(plain_dilated(want)) if rounds >= 0 else want
        got = C.type_mask(rows, scale=(10.0,) * 3, rounds=rounds, padding=20.0)
        assert {(r.x, r.y, r.z) for r in got.collect()} == set(map(tuple, np.argwhere(want).tolist()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert C.measure_run_length(none, (1, 2)).count() == 0 and C.organ_mask(none, none).count() == 0
    assert C.mapped(none, C.measure_run_length(none, (1,)), (1,)).select(F.count("*")).first()[0] == 0
