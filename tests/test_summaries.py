"""Operators on crops, junctions and guided dilation against plain versions."""

import math

import numpy as np
import pytest

from orbweave.operators import summaries as S


def plain_dilation(inside, edt, rounds, offset):
    """Voxel by voxel."""
    shape = inside.shape
    for _ in range(rounds):
        new = inside.copy()
        for at in np.ndindex(shape):
            if inside[at]:
                continue
            near, grows = math.inf, False
            for axis in range(3):
                for s in (-1, 1):
                    to = list(at)
                    to[axis] += s
                    within = 0 <= to[axis] < shape[axis]
                    to[axis] %= shape[axis]
                    if inside[tuple(to)]:
                        near, grows = min(near, edt[tuple(to)]), grows or within
            new[at] = grows and edt[at] < near - offset
        if (new == inside).all():
            break
        inside = new
    return inside


@pytest.mark.parametrize("seed", [1, 2])
def test_dilation_follows_the_plain_one(spark, seed):
    draw = np.random.default_rng(seed)
    shape = (3, 5, 6)
    inside, edt = draw.random(shape) < 0.1, draw.integers(0, 8, shape).astype(float)
    rows = [(*map(int, at), bool(inside[at]), float(edt[at])) for at in np.ndindex(shape)]
    df = spark.createDataFrame(rows, "z long, y long, x long, inside boolean, edt double")
    for rounds in (1, 6):
        want = plain_dilation(inside, edt, rounds, 0.4)
        got = {(r.z, r.y, r.x) for r in S.dilated_downhill(df, shape, rounds).where("inside").collect()}
        assert got == {tuple(map(int, at)) for at in np.argwhere(want)}


def test_dilation_of_nothing(spark):
    empty = spark.createDataFrame([], "z long, y long, x long, inside boolean, edt double")
    assert S.dilated_downhill(empty, (2, 2, 2)).count() == 0


def test_straight_gap_scores_by_its_ends(spark):
    # two straight paths on one line, and one of a single node
    rows = [("a", k, 10.0 * k, 0.0, 0.0) for k in range(10)] + [("b", k, 200.0 + 10.0 * k, 0.0, 0.0) for k in range(10)] + [("c", 0, 500.0, 0.0, 0.0)]
    nodes = spark.createDataFrame(rows, "path string, node_idx long, x double, y double, z double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    got = {(r.a, r.b, r.a_side, r.b_side): r for r in S.junction_scores(S.outer_ends(nodes, "path"), pairs, "path").collect()}
    near = got["a", "b", "end", "start"]
    assert near.distance == 110.0 and near.flow == pytest.approx(-2.0) and near.score == pytest.approx(-2.0)
    far = got["a", "b", "start", "end"]
    assert far.distance == 290.0 and far.flow == pytest.approx(2.0) and far.score == pytest.approx(2.0 * 110 / 290)
    assert got["a", "c", "end", "end"].flow == pytest.approx(-1.0)


def test_blocks_skip_empty_results_and_prefer_the_argument(spark):
    schema = "position string, " + ", ".join(f"center_{c} double, bb_min_{c} double, bb_max_{c} double" for c in "xyz") + ", axis string, slice_thickness double"
    full = ("mid", 2.5, 0.0, 10.0, 3.5, 0.0, 20.0, 4.4, 0.0, 1.0, "z", 10.0)
    df = spark.createDataFrame([full, ("apex", None, None, None, None, None, None, None, None, None, "z", 10.0)], schema)
    (auto,) = S.block_entries(df, (1.0, 1.0, 1.0)).collect()
    assert tuple(auto) == ("mid", 2, 4, 4, 5, 10, 5)
    (given,) = S.block_entries(df, halo=(1, 2, 3)).collect()
    assert (given.halo_x, given.halo_y, given.halo_z) == (1, 2, 3)


def test_crops_of_background_and_nothing(spark):
    v = spark.createDataFrame([("a", 0)] * 3 + [("b", 1)] * 2 + [("b", 2)], "crop string, label long")
    got = {r.crop: tuple(r)[1:] for r in S.crop_measures(v, "crop", 2).collect()}
    assert got == {"a": (0, 0.0, 0, 0, 0, 0), "b": (2, 2.0, 2, 2, 1, 1)}
    none = spark.createDataFrame([], "tp long, fp long, fn long")
    assert S.pooled_scores(none).first().f1 is None
