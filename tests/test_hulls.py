"""Hulls against planes through all triples of points."""

from itertools import combinations

import numpy as np
import pytest

from orbweave.operators import hulls as H
from orbweave.operators.geometry import hull_volume
from orbweave.operators.spatial import local_ripleys_k

SCHEMA = "g long, anchor_x double, anchor_y double, anchor_z double"


def plain(points):
    """Corners and volume: a triple is a face if all points lie on one side; volumes of the cones from the middle."""
    p = np.unique(points, axis=0)
    middle, corners, volume = p.mean(0), set(), 0.0
    for t in combinations(range(len(p)), 3):
        a, b, c = p[list(t)]
        n = np.cross(b - a, c - a)
        side = (p - a) @ n
        if (side <= 1e-12).all() or (side >= -1e-12).all():
            corners |= set(t)
            volume += abs((middle - a) @ n) / 6
    return len(corners), volume


def rows(groups):
    return [(g, *map(float, p)) for g, ps in groups.items() for p in ps]


def test_hulls_of_random_clouds_and_spheres(spark):
    rng = np.random.default_rng(7)
    groups = {k: rng.normal(size=(40, 3)) * (1, 5, 20) for k in range(4)}
    ball = rng.normal(size=(36, 3))
    groups[9] = ball / np.linalg.norm(ball, axis=1)[:, None]
    groups[10] = np.repeat(rng.random((12, 3)), 5, axis=0)
    got = {r.g: (r.n_corners, r.volume) for r in H.convex_hulls(spark.createDataFrame(rows(groups) + [(1, None, 0.0, 0.0)], SCHEMA), ("g",)).collect()}
    for g, ps in groups.items():
        n, volume = plain(ps)
        assert got[g] == (n, pytest.approx(volume, rel=1e-9)) and hull_volume(ps) == pytest.approx(volume, rel=1e-9)


def test_cubes_flat_groups_and_empty(spark):
    cube = [(x, y, z) for x in (0, 1, 2) for y in (0, 1, 2) for z in (0, 1, 2)]
    groups = {1: cube, 2: [(x, y, 0) for x in range(3) for y in range(3)], 3: [(1, 1, 1)]}
    df = spark.createDataFrame(rows(groups), SCHEMA)
    got = {r.g: r.volume for r in H.convex_hulls(df, ("g",)).collect()}
    assert got == {1: pytest.approx(8.0, rel=1e-12), 2: 0.0, 3: 0.0}
    assert H.convex_hulls(df.limit(0), ("g",)).collect() == H.convex_hulls(df.limit(0), ()).collect() == []


def test_points_inside_and_default_volume(spark):
    rng = np.random.default_rng(8)
    cloud = rng.normal(size=(60, 3))
    hull = H.convex_hulls(spark.createDataFrame(rows({0: cloud}), SCHEMA), ())
    asked = [(k, *map(float, p)) for k, p in enumerate(rng.normal(size=(80, 3)) * 1.5)] + [(99, *map(float, cloud[0]))]
    got = {r.g for r in H.inside_hulls(spark.createDataFrame(asked, SCHEMA), hull, ()).collect()}
    whole = hull_volume(cloud)
    assert got == {k for k, *p in asked if hull_volume(np.vstack([cloud, [p]])) <= whole * (1 + 1e-9)}
    table = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(cloud)], "label_id long, anchor_x double, anchor_y double, anchor_z double")
    near = np.linalg.norm(cloud[:, None] - cloud[None], axis=2) <= 1.0
    for r in local_ripleys_k(table, 1.0).collect():
        assert r.ripley == pytest.approx((near[r.label_id].sum() - 1) / (60 / whole), rel=1e-9)
