import numpy as np
from pyspark.sql import functions as F

from orbweave.operators import matching as M
from orbweave.operators import spatial as P

KIND = "label_id long, anchor_x double, anchor_y double, anchor_z double"


def clumped(seed, n, first=0):
    """Points in clumps of very different density, some of them at one place, and a far one."""
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, 0.05, (n // 2, 3)), rng.normal(0, 12, (n // 2 - 12, 3)), np.full((11, 3), 3.0), [[90.0, 0, 0]]])
    return np.arange(first, first + len(p)), p


def rows_of(spark, keys, p):
    return spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(keys, p, strict=True)], KIND)


def met(spark, run):
    """What run() returns, and how many rows the largest join of points of its rounds made."""
    seen = []
    real = P.radius_join

    def counted(*a, **k):
        out = real(*a, **k)
        seen.append(out.count())
        return out

    P.radius_join = M.radius_join = counted
    try:
        return run(), max(seen)
    finally:
        P.radius_join = M.radius_join = real


def test_nearest_of_clumps_meets_few_pairs(spark):
    (a, p), (b, q) = clumped(1, 400), clumped(2, 400, 1000)
    far = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    there = {int(k): int(b[d.argmin()]) for k, d in zip(a, far, strict=True) if d.min() <= 20}
    back = {int(k): int(a[d.argmin()]) for k, d in zip(b, far.T, strict=True) if d.min() <= 20}
    want = {(k, j) for k, j in there.items() if back.get(j) == k}
    got, most = met(spark, lambda: {(r.a, r.b) for r in P.mutual_nearest(rows_of(spark, a, p), rows_of(spark, b, q), 20.0).collect()})
    assert got == want
    assert most < (far <= 20).sum() / 4


def test_neighbours_of_clumps_meet_few_pairs(spark):
    keys, p = clumped(3, 400)
    far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = {int(k): round(float(np.sort(np.delete(d, i))[:5].mean()), 9) for i, (k, d) in enumerate(zip(keys, far, strict=True))}
    got, most = met(spark, lambda: {r.label_id: round(r.distance_nn5, 9) for r in P.nearest_neighbors(rows_of(spark, keys, p), 5, 15.0).collect()})
    assert got == want
    assert most < (far <= 15).sum() / 4


def test_k_nearest_within_radius(spark):
    (a, p), (b, q) = clumped(4, 60), clumped(5, 60, 100)
    far = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    want = {(int(a[i]), int(b[j])) for i, d in enumerate(far) for j in sorted(np.flatnonzero(d <= 10), key=lambda j, d=d: (d[j], b[j]))[:4]}
    assert {(r.a, r.b) for r in P.k_nearest(rows_of(spark, a, p), rows_of(spark, b, q), 4, 10.0).collect()} == want
    none = rows_of(spark, a, p).where(F.lit(False))
    assert P.k_nearest(none, none, 2, 5.0).count() == 0 and P.nearest_neighbors(none, 2, 5.0).count() == 0


def test_isolated_objects_of_clumps_meet_few_pairs(spark):
    from orbweave.operators import graph as G

    keys, p = clumped(6, 400)
    far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    mean = np.array([np.sort(np.delete(d, i))[:5].mean() for i, d in enumerate(far)])
    rows = rows_of(spark, keys, p).withColumn("n_pixels", F.lit(1000))
    got, most = met(spark, lambda: {(r.label_id, r.new_label) for r in G.filter_by_statistic(rows, P.nearest_neighbors(rows, 5, 10.0), "distance_nn5", 8.0, 900).collect()})
    assert got == {(int(k), i + 1) for i, k in enumerate(keys[mean <= 8])} and 0 < len(got) < len(keys)
    assert most < (far <= 10).sum() / 4


def test_naive_matching_of_clumps_meets_few_pairs(spark):
    (a, p), (b, q) = clumped(7, 400), clumped(8, 400, 1000)
    far = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    best = {}
    for k, d in zip(b, far.T, strict=True):
        if d.min() <= 10:
            best.setdefault(int(a[d.argmin()]), []).append((float(d.min()), int(k)))
    got, most = met(spark, lambda: {(r.point, r.object) for r in M.naive_matching(rows_of(spark, a, p), rows_of(spark, b, q), 10.0).collect()})
    assert got == {(min(v)[1], k) for k, v in best.items()}
    assert most < (far <= 10).sum() / 4


def test_closest_pairs_of_clumps_write_few_rows(spark, monkeypatch):
    """Two components in each clump and one of its own: pairs of components that are far apart come in later rounds, and no join of points makes all pairs."""
    from orbweave.operators import cohort as C

    keys, p = clumped(9, 300)
    label = np.where(np.arange(len(p)) < 150, keys % 2, 2 + keys % 3)
    label[-1] = 9
    far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = {}
    for i, j in np.argwhere((label[:, None] < label[None]) & (far <= 80)):
        pair, found = (int(label[i]), int(label[j])), (float(far[i, j]), int(keys[i]), int(keys[j]))
        want[pair] = min(want.get(pair, found), found)
    rows = spark.createDataFrame([(int(k), int(c), *map(float, x)) for k, c, x in zip(keys, label, p, strict=True)], "label_id long, component_labels long, anchor_x double, anchor_y double, anchor_z double")
    monkeypatch.setattr(C, "radius_join", None)
    assert {(r.c1, r.c2): (r.a, r.b) for r in C.closest_pairs(rows, 80.0).collect()} == {k: v[1:] for k, v in want.items()}
    none = rows.where("label_id < 0")
    assert C.closest_pairs(none, 80.0).count() == 0


def test_radius_components_of_clumps_need_few_edges(spark):
    from orbweave.operators import graph as G

    keys, p = clumped(10, 400)
    keys = np.random.default_rng(1).permutation(keys)
    for distance in (2.0, 4.0, 7.0):
        near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= distance
        part = keys.copy()
        while (new := np.array([part[row].min() for row in near])).tolist() != part.tolist():
            part = new
        rows = rows_of(spark, keys, p)
        edges = G.radius_edges(rows, distance)
        assert edges.count() < near.sum() / 8
        found = {r.node: r.component for r in G.components(edges).collect()}
        assert [found.get(int(k), int(k)) for k in keys] == part.tolist()
