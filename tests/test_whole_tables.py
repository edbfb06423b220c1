"""No query of the library thins its tables, and rows without a place do not stop the spatial joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators.ranges import numbered
from orbweave.operators.reports import average_curve, registered, split_counts, zipped
from orbweave.operators.spatial import nearest_neighbors, nearest_node
from orbweave.operators.tables import nearest_rows
from orbweave.plans import catalog


def test_no_subsets_of_ids():
    for name, sql in catalog.oracle_sql().items():
        assert "user_id < 5" not in sql and "component_labels < 5" not in sql and "label_id % 25" not in sql, name
    assert {n.removesuffix("_all") for n in catalog.queries() if n.endswith("_all")} <= set(catalog.oracle_sql())


POINTS = [(k, float(k * k % 37), float(k * 7 % 11), float(k % 5)) for k in range(40)] + [(90, None, 1.0, 1.0), (91, float("nan"), 1.0, 1.0), (92, 5000.0, 0.0, 0.0)]


def points(spark):
    return spark.createDataFrame(POINTS, "label_id long, anchor_x double, anchor_y double, anchor_z double")


def placed():
    return [p for p in POINTS if p[1] is not None and p[1] == p[1]]


def test_neighbors_with_missing_and_far_places(spark):
    got = {r.label_id: r.distance_nn3 for r in nearest_neighbors(points(spark), 3, 2.0).collect()}
    want = {}
    for p in placed():
        d = sorted(np.linalg.norm(np.subtract(p[1:], q[1:])) for q in placed() if q[0] != p[0])
        want[p[0]] = np.mean(d[:3])
    assert got == pytest.approx(want)
    assert nearest_neighbors(points(spark).limit(1), 3, 2.0).count() == 0


@pytest.mark.parametrize("most", [500, 0])
def test_nearest_node_with_missing_places(spark, most):
    nodes = spark.createDataFrame([(k, float(k), float(k % 3), 0.0) for k in range(30)] + [(99, None, 0.0, 0.0)], "node_idx long, x double, y double, z double")
    got = {r.label_id: (r.node, r.node_distance) for r in nearest_node(points(spark), nodes, most=most).collect()}
    assert len(got) == len(POINTS) and got[90] == got[91] == (None, None)
    for p in placed():
        d = [(np.linalg.norm(np.subtract(p[1:], (k, k % 3, 0))), k) for k in range(30)]
        assert got[p[0]][0] == min(d)[1] and got[p[0]][1] == pytest.approx(min(d)[0])
    none = nearest_node(points(spark), nodes.limit(0), most=most).collect()
    assert len(none) == len(POINTS) and all(r.node is None for r in none)


def test_nearest_rows_of_many_values(spark):
    table = spark.createDataFrame([(k, (k * 13 % 101) / 7.0) for k in range(60)] + [(70, None)], "label_id long, v double")
    values = spark.createDataFrame([(k / 3.0 - 5,) for k in range(80)] + [(None,)], "value double")
    got = {r.value: r.label_id for r in nearest_rows(table, values, "v").collect()}
    for k in range(80):
        v = k / 3.0 - 5
        best = min(abs((i * 13 % 101) / 7.0 - v) for i in range(60))
        assert abs(((got[v] * 13) % 101) / 7.0 - v) == pytest.approx(best)
    assert len(got) == 80 and nearest_rows(table.limit(0), values, "v").count() == 0


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(k * 17 % 500, "x") for k in range(500)], "k long, _part string").repartition(7)
    assert [(r.k, r.n, r._part) for r in numbered(rows, ["k"], "n").orderBy("n").collect()] == [(k, k + 1, "x") for k in range(500)]
    assert numbered(rows.limit(0), ["k"], "n").count() == 0


def test_average_curve_equals_numpy(spark):
    rng = np.random.default_rng(1)
    curves = {c: (np.sort(rng.random(n) * 5), rng.normal(1, 1, n)) for c, n in (("a", 9), ("b", 30), ("c", 2))}
    weights = {"a": 1.0, "b": 2.5, "c": 4.0}
    rows = [(c, float(x), float(y)) for c, (xs, ys) in curves.items() for x, y in zip(xs, ys)]
    got = average_curve(spark.createDataFrame(rows, "curve string, x double, density double"), spark.createDataFrame(list(weights.items()), "curve string, weight double"), 200).orderBy("bin").collect()
    grid = np.linspace(min(xs[0] for xs, _ in curves.values()), max(xs[-1] for xs, _ in curves.values()), 200)
    mean = sum(weights[c] * np.clip(np.interp(grid, *curves[c], left=0.0, right=0.0), 0, None) for c in curves) / sum(weights.values())
    mean /= np.trapezoid(mean, grid)
    assert [r.x for r in got] == pytest.approx(grid.tolist()) and [r.density for r in got] == pytest.approx(mean.tolist(), abs=1e-9)


def test_reports_refuse_what_would_mislead(spark):
    crops = spark.createDataFrame([("mouse", "train", 3), ("mouse", "test", None)], "species string, split string, n_samples long")
    assert split_counts(crops).count() == 0 and split_counts(crops.where(F.col("n_samples").isNotNull())).count() == 2
    objects = spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, component_labels long")
    with pytest.raises(KeyError):
        registered(objects, spark.createDataFrame([("a", "A", [1])], "dataset string, alias string, component_labels array<long>"), "dataset")
    one, two = spark.range(3).withColumnRenamed("id", "label_id"), spark.range(4).withColumnRenamed("id", "label_id")
    with pytest.raises(Exception, match="different keys"):
        zipped(one, two).collect()
