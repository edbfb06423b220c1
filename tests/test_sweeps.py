import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import canal as C
from orbweave.operators import paths as P
from orbweave.operators import sweeps as W
from orbweave.operators.ranges import written

KIND = "label_id long, dataset long, component_labels long, anchor_x double, anchor_y double, anchor_z double"


def plain(parts, apex_higher=True, include_gap=False):
    """Keys, length and fraction of the run of parts [(keys, points)], with all pairs and a Dijkstra from every node."""
    keys, p = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts])
    place = np.repeat(range(len(parts)), [len(k) for k, _ in parts])
    order = np.argsort(keys)
    keys, p, place = keys[order], p[order], place[order]
    radius = float(round(max(P.longest_tree_edge(x) for _, x in parts) + 0.5))
    graph = P.radius_graph(p, radius)
    piece = place.copy()
    while True:
        old = piece.copy()
        for k, row in enumerate(graph):
            for j, _ in row:
                piece[piece == piece[j]] = min(piece[k], piece[j])
        if (old == piece).all():
            break
    d = P.distances(p)
    turns = sorted(set(piece))
    for s, t in zip(turns, turns[1:], strict=False):
        a, b = np.flatnonzero(piece == s), np.flatnonzero(piece == t)
        i, j = np.unravel_index(d[np.ix_(a, b)].argmin(), (len(a), len(b)))
        graph[a[i]].append((int(b[j]), d[a[i], b[j]]))
        graph[b[j]].append((int(a[i]), d[a[i], b[j]]))
    a, b = sorted(P.most_distant(graph))
    if (p[a, 1] > p[b, 1]) != apex_higher:
        a, b = b, a
    way = P.fewest_hops(graph, a, b)
    step = np.linalg.norm(np.diff(p[way], axis=0), axis=1)
    length = np.concatenate([[0], np.cumsum(step if include_gap else np.where(step <= radius, step, 0))])
    fraction = length / length[-1] if length[-1] else length * 0
    fraction[-1] = 1
    return keys[way].tolist(), length, fraction


def arc(low, high, n, seed, width=6.0):
    rng = np.random.default_rng(seed)
    angle = np.linspace(low, high, n)
    return np.stack([400 + 300 * np.cos(angle), 350 + 250 * np.sin(angle), 40 * angle], 1) + rng.normal(0, width, (n, 3))


def rows_of(dataset, parts):
    return [(int(k), dataset, c, *map(float, x)) for c, (keys, points) in parts.items() for k, x in zip(keys, points, strict=True)]


@pytest.fixture(scope="module")
def sets():
    cloud = np.random.default_rng(9).uniform(0, 60, (90, 3))
    return {
        1: {1: (np.arange(80) * 7 % 80, arc(0.2, 1.7, 80, 1)), 2: (np.arange(100, 140), arc(2.0, 2.9, 40, 2))},
        2: {1: (np.arange(200, 290), cloud)},
        3: {2: (np.arange(300, 330), arc(0.1, 0.9, 30, 3)), 1: (np.arange(330, 390), arc(1.9, 2.9, 60, 4)), 4: (np.arange(390, 420), arc(1.2, 1.6, 30, 5))},
    }


def test_runs_equal_plain_ones(spark, sets):
    rows = [r for k, parts in sets.items() for r in rows_of(k, parts)]
    rows += [(900, None, 1, 1.0, 1.0, 1.0), (901, 1, 9, 1.0, 1.0, 1.0), (902, 1, 1, None, 1.0, 1.0), rows[0]]
    rows += [(903, 4, 1, 1.0, 1.0, 1.0), (904, 5, 1, 5.0, 5.0, 5.0), (905, 5, 1, 5.0, 5.0, 5.0)]  # a lone object, and two at one place
    components = (2, 1, 4)
    found = W.smaller_run(spark.createDataFrame(rows, KIND), components, block=4).collect()
    assert {r.dataset for r in found} == {*sets, 5}
    for k, parts in sets.items():
        keys, length, fraction = plain([parts[c] for c in components if c in parts])
        got = sorted((r for r in found if r.dataset == k), key=lambda r: r.node_idx)
        assert [r.label_id for r in got] == keys
        assert [r.length for r in got] == pytest.approx(length) and [r.length_fraction for r in got] == pytest.approx(fraction)
        assert all(r.label_id in parts[r.component_labels][0] for r in got)
    assert [(r.label_id, r.node_idx, r.length, r.length_fraction) for r in found if r.dataset == 5] == [(904, 0, 0.0, 1.0)]


def test_direction_gaps_and_nearest_nodes(spark, sets):
    rows = spark.createDataFrame(rows_of(1, sets[1]) + [(950, 1, 9, 0.0, 0.0, 0.0)], KIND)
    run = written(W.smaller_run(rows, (1, 2), apex_higher=False, include_gap=True))
    nodes = run.orderBy("node_idx").toPandas()
    parts = [sets[1][1], sets[1][2]]
    keys, length, _ = plain(parts, False, True)
    assert nodes.label_id.tolist() == keys and nodes.length.tolist() == pytest.approx(length) and length[-1] > plain(parts)[1][-1]
    found = C.mapped(rows, run, (1, 2)).toPandas().set_index("label_id")
    assert found.loc[950].offset == -1 and found.loc[950].frequency == 0 and len(found) == 121
    for keys, points in sets[1].values():
        far = np.linalg.norm(points[:, None] - nodes[["x", "y", "z"]].to_numpy()[None], axis=2)
        assert found.loc[keys].offset.tolist() == pytest.approx(far.min(1))
        assert found.loc[keys].length_fraction.tolist() == pytest.approx(nodes.length_fraction.to_numpy()[far.argmin(1)])


def test_sweeps_equal_dijkstra_from_every_node(spark):
    p = np.random.default_rng(3).uniform(0, 40, (120, 3))
    plain_ = P.radius_graph(p, 14.0)
    rows = spark.createDataFrame([("s", k, *map(float, x), 14.0, k % 7) for k, x in enumerate(p)], "dataset string, node long, x double, y double, z double, radius double, block long")
    graph = W.links(rows, "dataset")
    got = {(r.source, r.node): r.far for r in W.sweep(graph, rows.where("node < 3").select("dataset", "block", F.col("node").alias("source")), "dataset").collect()}
    for s in range(3):
        want = P.shortest(plain_, s)[0]
        assert {k: d for (t, k), d in got.items() if t == s} == pytest.approx({k: d for k, d in enumerate(want) if np.isfinite(d)})


def test_empty_table(spark):
    assert W.smaller_run(spark.createDataFrame([], KIND), (1,)).count() == 0
