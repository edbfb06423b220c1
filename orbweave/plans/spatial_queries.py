"""Queries on places: radius, nearest, grids, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import graph as G
from orbweave.operators import spatial as P
from orbweave.plans.adapters import OBJECTS, PATH, objects, path, with_

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _d(a: str, b: str, right=("anchor_x", "anchor_y", "anchor_z")) -> str:
    return "sqrt(" + " + ".join(f"({a}.{p} - {b}.{q}) * ({a}.{p} - {b}.{q})" for p, q in zip(P.XYZ, right, strict=True)) + ")"


_D = _d("a", "b")


@query("neighbors_in_radius", with_(OBJECTS) + f"SELECT a.label_id, count(*) AS neighbors FROM objects a, objects b WHERE {_D} < 15 GROUP BY 1")
def _(s, d):
    return P.neighbors_in_radius(objects(s, d), 15.0)


@query("local_ripleys_k", with_(OBJECTS) + f"SELECT a.label_id, (count(*) - 1) / ((SELECT count(*)::DOUBLE FROM objects) / 100000.0::DOUBLE) AS ripley FROM objects a, objects b WHERE {_D} <= 15 GROUP BY 1")
def _(s, d):
    return P.local_ripleys_k(objects(s, d), 15.0, 100000.0)


@query(
    "nearest_neighbor_distance",
    with_(OBJECTS) + f"SELECT label_id, round_even(avg(d), 6) AS distance_nn10 FROM (SELECT a.label_id, {_D} AS d, row_number() OVER (PARTITION BY a.label_id ORDER BY {_D}, b.label_id) AS k FROM objects a, objects b WHERE a.label_id != b.label_id) WHERE k <= 10 GROUP BY 1",
)
def _(s, d):
    return P.nearest_neighbors(objects(s, d), 10, 15.0).select("label_id", F.bround("distance_nn10", 6).alias("distance_nn10"))


@query(
    "nearest_path_node",
    with_(OBJECTS, PATH) + f"SELECT label_id, node_idx AS node, round_even(d, 6) AS node_distance FROM (SELECT a.label_id, b.node_idx, {_d('a', 'b', 'xyz')} AS d, row_number() OVER (PARTITION BY a.label_id ORDER BY {_d('a', 'b', 'xyz')}, b.node_idx) AS k FROM objects a, path b WHERE b.dataset = 0) WHERE k = 1",
)
def _(s, d):
    return P.nearest_node(objects(s, d), path(s, d).where("dataset = 0")).select("label_id", "node", F.bround("node_distance", 6).alias("node_distance"))


@query(
    "path_deviation_filter",
    with_(OBJECTS, PATH) + f"SELECT a.label_id, CASE WHEN min({_d('a', 'b', 'xyz')}) > 40 THEN 0 ELSE any_value(a.component_labels) END AS component_labels FROM objects a, path b WHERE b.dataset = 0 GROUP BY 1",
)
def _(s, d):
    near = P.nearest_node(objects(s, d), path(s, d).where("dataset = 0"))
    return near.select("label_id", F.when(F.col("node_distance") > 40, 0).otherwise(F.col("component_labels")).alias("component_labels"))


_HALVES = "l AS (SELECT * FROM objects WHERE label_id % 2 = 0), r AS (SELECT * FROM objects WHERE label_id % 2 = 1)"
_LR = f"lr AS (SELECT a.label_id AS a, b.label_id AS b, {_D} AS distance FROM l a, r b WHERE {_D} <= 20)"


@query("radius_pairs", with_(OBJECTS, _HALVES, _LR) + "SELECT a, b, round_even(distance, 6) AS distance FROM lr")
def _(s, d):
    o = objects(s, d)
    return P.radius_join(o.where("label_id % 2 = 0"), o.where("label_id % 2 = 1"), 20.0).select("a", "b", F.bround("distance", 6).alias("distance"))


@query(
    "mutual_nearest",
    with_(OBJECTS, _HALVES, _LR) + "SELECT a, b, round_even(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS i, row_number() OVER (PARTITION BY b ORDER BY distance, a) AS j FROM lr) WHERE i = 1 AND j = 1",
)
def _(s, d):
    o = objects(s, d)
    return P.mutual_nearest(o.where("label_id % 2 = 0"), o.where("label_id % 2 = 1"), 20.0).select("a", "b", F.bround("distance", 6).alias("distance"))


for _mode, _value in (("accumulated", "count(*)"), ("capped", "1::BIGINT"), ("components", "max_by(component_labels, label_id)::BIGINT")):

    @query(f"centroid_grid_{_mode}", with_(OBJECTS) + f"SELECT floor(anchor_z / 4.0::DOUBLE)::BIGINT AS cz, floor(anchor_y / 10.0::DOUBLE)::BIGINT AS cy, floor(anchor_x / 20.0::DOUBLE)::BIGINT AS cx, {_value} AS value FROM objects GROUP BY 1, 2, 3")
    def _(s, d, mode=_mode):
        return P.centroid_grid(objects(s, d), (4.0, 10.0, 20.0), mode)


@query("affine_points", with_(OBJECTS) + "SELECT label_id, (anchor_x - -50.0::DOUBLE) / 0.5::DOUBLE AS index_x, (anchor_y - -40.0::DOUBLE) / 0.5::DOUBLE AS index_y, (anchor_z - -30.0::DOUBLE) / 2.0::DOUBLE AS index_z FROM objects")
def _(s, d):
    return P.affine(objects(s, d), (-50.0, -40.0, -30.0), (0.5, 0.5, 2.0))


@query("axis_ends", with_(OBJECTS) + "SELECT arg_min(label_id, 0.6::DOUBLE * anchor_x + 0.8::DOUBLE * anchor_y) AS first_id, arg_max(label_id, 0.6::DOUBLE * anchor_x + 0.8::DOUBLE * anchor_y) AS last_id FROM objects")
def _(s, d):
    return P.axis_ends(objects(s, d), [0.6, 0.8, 0.0])


@query("principal_axis_ends", None)
def _(s, d):
    o = objects(s, d)
    return P.axis_ends(o, P.principal_axis(o))


def _components_sql(distance: float, min_size: int, least: int) -> str:
    kept = f"kept AS (SELECT * FROM objects WHERE n_pixels >= {min_size})"
    walk = f"walk AS (SELECT label_id AS node, label_id AS root FROM kept UNION SELECT b.label_id, w.root FROM walk w JOIN kept a ON a.label_id = w.node JOIN kept b ON {_D} <= {distance} WHERE w.root < b.label_id)"
    ranked = f"named AS (SELECT node, min(root) AS component FROM walk GROUP BY 1), sized AS (SELECT component, count(*) AS n FROM named GROUP BY 1 HAVING count(*) >= {least}), ranked AS (SELECT component, row_number() OVER (ORDER BY n DESC, component) AS rank FROM sized)"
    return f"WITH RECURSIVE {OBJECTS}, {kept}, {walk}, {ranked} SELECT o.label_id, coalesce(r.rank, 0) AS component_labels FROM objects o LEFT JOIN named USING (label_id) LEFT JOIN ranked r USING (component)".replace("named USING (label_id)", "named ON named.node = o.label_id")


@query("label_components", _components_sql(4.0, 850, 3))
def _(s, d):
    return G.label_components(objects(s, d), 850, 4.0, 3).select("label_id", "component_labels")


@query("label_custom_components", None)
def _(s, d):
    runs = [{"min_size": 850, "distance": 4.0, "least": 3, "components": [1, 2]}, {"min_size": 1000, "distance": 6.0, "least": 5, "components": [1]}]
    return G.label_custom(objects(s, d), runs, 900, [1, 2, 3]).select("label_id", "component_labels")


@query(
    "filter_isolated",
    with_(OBJECTS, f"st AS (SELECT label_id, avg(d) AS v FROM (SELECT a.label_id, {_D} AS d, row_number() OVER (PARTITION BY a.label_id ORDER BY {_D}, b.label_id) AS k FROM objects a, objects b WHERE a.label_id != b.label_id) WHERE k <= 5 GROUP BY 1)")
    + "SELECT label_id, row_number() OVER (ORDER BY label_id) AS new_label FROM objects WHERE n_pixels > 900 AND label_id NOT IN (SELECT label_id FROM st WHERE v > 8)",
)
def _(s, d):
    o = objects(s, d)
    return G.filter_by_statistic(o, P.nearest_neighbors(o, 5, 10.0), "distance_nn5", 8.0, 900).select("label_id", "new_label")


QUERIES, ORACLE_SQL = Q, SQL
