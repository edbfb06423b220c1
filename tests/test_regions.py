"""Regions, openings and inserted nodes against numpy and small worked cases."""

import numpy as np
import pytest

from orbweave.operators import regions as R

VOXEL = "z int, y int, x int, label long, value double"


def test_features_agree_with_numpy(spark):
    draw = np.random.default_rng(3)
    rows = []
    for label in (1, 2, 3):
        at = np.unique(draw.integers(0, 9, (60, 3)), axis=0)
        rows += [(int(z), int(y), int(x), label, float(draw.integers(0, 50))) for z, y, x in at]
    rows += [(0, 0, k, 4, 2.0) for k in range(5)] + [(7, 7, 7, 5, 1.0), (8, 8, 8, 0, 9.0)]
    got = {r.label: r for r in R.region_features(spark.createDataFrame(rows, VOXEL)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for label, r in got.items():
        at = np.array([p[:3] for p in rows if p[3] == label], float)
        mu = at - at.mean(0)
        cov = mu.T @ mu / len(at)
        ev = np.sort(np.linalg.eigvalsh(np.trace(cov) * np.eye(3) - cov))[::-1].clip(0)
        assert [r.ev0, r.ev1, r.ev2] == pytest.approx(list(ev), abs=1e-6)
        assert r.axis_major == pytest.approx(np.sqrt(max(0, 10 * (ev[0] + ev[1] - ev[2]))), abs=1e-3)
        assert r.extent == pytest.approx(len(at) / np.prod(np.ptp(at, axis=0) + 1))
        assert r.intensity_std == pytest.approx(np.std([p[4] for p in rows if p[3] == label]))


def test_otsu_of_groups(spark):
    rows = [(1, 0.0)] * 5 + [(1, 10.0)] * 5 + [(2, 4.0)] * 3 + [(3, None), (3, 1.0), (3, 2.0), (None, 1.0)]
    got = {r.g: r.threshold for r in R.otsu_by(spark.createDataFrame(rows, "g int, v double"), "g", "v").collect()}
    assert set(got) == {1, 3}
    assert got[1] == pytest.approx(10 / 512) and got[3] == pytest.approx(1 + 1 / 512)


def test_opening_and_growth(spark):
    block = np.zeros((7, 7, 7), bool)
    block[1:6, 1:6, 1:6] = True
    block[3, 3, 6] = True
    cells = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(block)], "z int, y int, x int")

    def near(a, what):
        p = np.pad(a, 1)
        return what.reduce([p[1:-1, 1:-1, 1:-1], p[:-2, 1:-1, 1:-1], p[2:, 1:-1, 1:-1], p[1:-1, :-2, 1:-1], p[1:-1, 2:, 1:-1], p[1:-1, 1:-1, :-2], p[1:-1, 1:-1, 2:]])

    for rounds in (1, 2):
        want = block
        for what in [np.logical_and] * rounds + [np.logical_or] * rounds:
            want = near(want, what)
        got = {tuple(r) for r in R.opened(cells, rounds).collect()}
        assert got == {tuple(map(int, p)) for p in np.argwhere(want)}
    seeds = [(0, 0, 0, 7, 1.0), (0, 0, 4, 3, 1.0), (0, 0, 9, 0, 1.0)]
    got = {tuple(r)[:3]: r.label for r in R.extended_labels(spark.createDataFrame(seeds, VOXEL), 2.5, (1, 3, 12)).collect()}
    want = {}
    for y in range(3):
        for x in range(12):
            d = sorted((y * y + (x - sx) ** 2, label) for sx, label in ((0, 7), (4, 3)))[0]
            if d[0] < 6.25:
                want[0, y, x] = d[1]
    assert got == want


def test_nodes_at_ends_between_and_beyond(spark):
    path = spark.createDataFrame([(p, k, k, float(k), 0.0, 0.0, 10.0 * k) for p in "abcde" for k in range(3)], "dataset string, node_idx long, spot_id long, x double, y double, z double, w double")
    points = spark.createDataFrame([("a", 0, -1.0, 0.0, 0.0), ("b", 3, 5.0, 0.0, 0.0), ("c", 1, 0.5, 0.0, 0.0), ("d", 9, 0.0, 0.0, 0.0), ("none", 0, 0.0, 0.0, 0.0)], "dataset string, place long, x double, y double, z double")
    got = {}
    for r in sorted(R.inserted_nodes(path, points, ("w",)).collect(), key=lambda r: (r.dataset, r.node_idx)):
        got.setdefault(r.dataset, []).append((r.node_idx, r.spot_id, r.x, r.w))
    plain = [(0, 0, 0.0, 0.0), (1, 1, 1.0, 10.0), (2, 2, 2.0, 20.0)]
    assert got["d"] == got["e"] == plain and "none" not in got
    assert got["a"] == [(0, 3, -1.0, None), (1, 0, 0.0, 0.0), (2, 1, 1.0, 10.0), (3, 2, 2.0, 20.0)]
    assert got["b"] == [*plain, (3, 3, 5.0, None)]
    # 0.5 from the first node and 1.5 from the last one: weights 1/4 and 3/4
    assert got["c"] == [(0, 0, 0.0, 0.0), (1, 3, 0.5, 15.0), (2, 1, 1.0, 10.0), (3, 2, 2.0, 20.0)]


def test_empty_tables_shares_and_sets(spark):
    none = spark.createDataFrame([], VOXEL)
    for f in (R.region_features, R.dark_voxels, R.opened, lambda v: R.extended_labels(v, 2, (3, 3, 3))):
        assert f(none).collect() == []
    kinds = spark.createDataFrame([("a", "u"), ("a", "v"), ("a", "u"), ("b", None), (None, "v")], "d string, kind string")
    assert {tuple(r) for r in R.share_table(kinds, "d", "kind", ["u", "v"]).collect()} == {("a", 3, 2 / 3, 1 / 3), (None, 1, 0.0, 1.0)}
    objects = spark.createDataFrame([(1, 5.0, 0), (2, 4.0, 0), (3, None, 0), (4, 9.0, 7)], "label_id int, v double, band int")
    sets = spark.createDataFrame([("s", 0, 5.0)], "set string, band int, threshold double")
    assert {(r.label_id, r.marker) for r in R.labels_by_sets(objects, sets, "v", "band").collect()} == {(1, 1), (2, 2), (3, 0), (4, 0)}
