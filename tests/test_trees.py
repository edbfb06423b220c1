import numpy as np
import pytest

from orbweave.operators.paths import longest_tree_edge
from orbweave.operators.trees import longest_edge, tree_edges

KIND = "label_id long, dataset string, anchor_x double, anchor_y double, anchor_z double"


def plain_tree(p):
    """Edges in order of (distance, a, b), each kept if it joins two parts."""
    part = list(range(len(p)))
    out = []
    for d, a, b in sorted((float(np.sqrt(((p[a] - p[b]) ** 2).sum())), a, b) for a in range(len(p)) for b in range(a + 1, len(p))):
        if part[a] != part[b]:
            out.append((a, b, d))
            part = [part[a] if x == part[b] else x for x in part]
    return out


def test_trees_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    groups = {"cloud": rng.uniform(0, 300, (70, 3)), "ties": rng.integers(0, 4, (40, 3)).astype(float), "one": rng.uniform(0, 9, (1, 3)), "line": np.array([[k * 7.0, 0, 0] for k in range(30)])}
    groups["outlier"] = np.concatenate([rng.uniform(0, 5, (40, 3)), [[5000.0, 0, 0]]])
    rows = [(k, name, *map(float, p)) for name, points in groups.items() for k, p in enumerate(points)]
    df = spark.createDataFrame([*rows, (1, None, 0.0, 0.0, 0.0), (77, "cloud", None, 1.0, 1.0), (78, "cloud", float("nan"), 1.0, 1.0)], KIND)
    got = {}
    for r in tree_edges(df, "dataset").collect():
        got.setdefault(r.dataset, []).append((r.a, r.b, r.distance))
    for name, points in groups.items():
        want = plain_tree(points)
        assert sorted((a, b) for a, b, _ in got.get(name, [])) == sorted((a, b) for a, b, _ in want), name
        assert sorted(d for *_, d in got.get(name, [])) == pytest.approx(sorted(d for *_, d in want))
    longest = {r.dataset: r.longest for r in longest_edge(df, "dataset").collect()}
    assert longest == {name: pytest.approx(longest_tree_edge(points)) for name, points in groups.items()}


def test_no_points(spark):
    none = spark.createDataFrame([], KIND)
    assert tree_edges(none, "dataset").count() == 0 and longest_edge(none, "dataset").count() == 0


def test_dense_tree_meets_few_pairs(spark, monkeypatch):
    """A crowded group and sparse points around it, far more of them within 30 than the tree needs."""
    from orbweave.operators import trees as T

    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 0.4, (150, 3)), rng.normal(0, 15, (50, 3))])
    rows = spark.createDataFrame([(k, "s", *map(float, x)) for k, x in enumerate(p)], KIND)
    most, real = [], T.written
    monkeypatch.setattr(T, "written", lambda df: (most.append(df.count()) if "e" in df.columns else None, real(df))[1])
    assert sorted((r.a, r.b) for r in tree_edges(rows, "dataset").collect()) == sorted((a, b) for a, b, _ in plain_tree(p))
    within = (np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= 30).sum()
    assert max(most) < within / 4
