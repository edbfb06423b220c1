"""Queries on masks of objects, their depth, runs along the larger cell type and spanning trees: a data set for each component label."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import canal as C
from orbweave.operators import grids as G
from orbweave.operators import trees as T
from orbweave.plans.adapters import OBJECTS, objects, with_

Q, SQL = {}, {}
EDGE = 16.0


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _grouped(s, d):
    """Objects with their label as data set, in thirds."""
    return objects(s, d).select("label_id", F.col("component_labels").cast("long").alias("dataset"), (F.col("label_id") % 3).alias("component_labels"), "anchor_x", "anchor_y", "anchor_z")


_STEPS = "steps AS (SELECT z AS sz, y AS sy, x AS sx FROM range(-1, 2) a(z), range(-1, 2) b(y), range(-1, 2) c(x))"
_CELLS = "cells AS (SELECT DISTINCT component_labels::BIGINT AS dataset, " + ", ".join(f"floor(anchor_{c} / {EDGE}::DOUBLE)::BIGINT AS {c}" for c in "zyx") + " FROM objects)"
_BOX = "box AS (SELECT dataset, " + ", ".join(f"least(0, min({c})) AS lo_{c}, max({c}) AS hi_{c}" for c in "zyx") + " FROM cells GROUP BY dataset)"
_GROW = "SELECT DISTINCT g.dataset, g.z + sz AS z, g.y + sy AS y, g.x + sx AS x FROM {0} g, steps, box WHERE box.dataset = g.dataset AND g.z + sz BETWEEN lo_z AND hi_z AND g.y + sy BETWEEN lo_y AND hi_y AND g.x + sx BETWEEN lo_x AND hi_x"
_GROWN = "grown AS (" + _GROW.format("cells") + ")"
_AGAIN = "again AS (" + _GROW.format("grown") + ")"
_CLOSED = "closed AS (SELECT a.dataset, a.z + sz AS z, a.y + sy AS y, a.x + sx AS x FROM again a, steps GROUP BY 1, 2, 3, 4 HAVING count(*) = 27)"


@query("mask_grown", with_(OBJECTS, _CELLS, _BOX, _STEPS, _GROWN) + "SELECT * FROM grown")
def _(s, d):
    cells = G.coarse(_grouped(s, d), EDGE, ("dataset",))
    return G.grown(cells, G.boxes(cells, ("dataset",)), ("dataset",))


@query("mask_closed", with_(OBJECTS, _CELLS, _BOX, _STEPS, _GROWN, _AGAIN, _CLOSED) + "SELECT * FROM closed")
def _(s, d):
    cells = G.coarse(_grouped(s, d), EDGE, ("dataset",))
    box = G.boxes(cells, ("dataset",))
    return G.closed(G.grown(cells, box, ("dataset",)), box, ("dataset",))


@query(
    "mask_depth",
    with_(OBJECTS, _CELLS, _BOX, _STEPS, _GROWN, "near AS (SELECT DISTINCT g.dataset, g.z + sz AS z, g.y + sy AS y, g.x + sx AS x FROM grown g, steps WHERE abs(sz) + abs(sy) + abs(sx) = 1)", "gaps AS (SELECT * FROM near EXCEPT SELECT * FROM grown)")
    + "SELECT g.dataset, g.z, g.y, g.x, sqrt(min((g.z - e.z) * (g.z - e.z) + (g.y - e.y) * (g.y - e.y) + (g.x - e.x) * (g.x - e.x))) AS depth FROM grown g JOIN gaps e USING (dataset) GROUP BY ALL",
)
def _(s, d):
    cells = G.coarse(_grouped(s, d), EDGE, ("dataset",))
    return G.depth(G.grown(cells, G.boxes(cells, ("dataset",)), ("dataset",)), None, ("dataset",))


@query(
    "tree_longest_edge",
    "WITH RECURSIVE " + with_(OBJECTS)[5:]
    + """, p AS (SELECT component_labels::BIGINT AS g, label_id AS id, anchor_x AS x, anchor_y AS y, anchor_z AS z FROM objects),
    t AS (SELECT g, [min(id)] AS seen, 0.0::DOUBLE AS longest, count(*) AS n FROM p GROUP BY g
    UNION ALL
    SELECT g, list_append(seen, arg_min(id, d)), greatest(longest, min(d)), n FROM (
      SELECT t.g, t.seen, t.longest, t.n, b.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS d
      FROM t JOIN p a ON a.g = t.g JOIN p b ON b.g = t.g WHERE list_contains(t.seen, a.id) AND NOT list_contains(t.seen, b.id) GROUP BY ALL) GROUP BY g, seen, longest, n)
    SELECT g AS dataset, round_even(longest, 9) AS longest FROM t WHERE len(seen) = n""",
)
def _(s, d):
    return T.longest_edge(_grouped(s, d), "dataset").select("dataset", F.bround("longest", 9).alias("longest"))


@query("larger_type_run", None)
def _(s, d):
    return C.measure_run_length(_grouped(s, d), (0, 1, 2), scale=10)


@query("larger_type_mapping", None)
def _(s, d):
    o = _grouped(s, d)
    return C.mapped(o, C.measure_run_length(o, (0, 1, 2), scale=10), (0, 1, 2))


@query("organ_mask", None)
def _(s, d):
    o = _grouped(s, d)
    return C.organ_mask(o.where("component_labels = 0"), o.where("component_labels = 1"), scale=(EDGE,) * 3, rounds=1, padding=2 * EDGE)


QUERIES, ORACLE_SQL = Q, SQL
