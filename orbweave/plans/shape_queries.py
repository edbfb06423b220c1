"""Queries on slices, hulls and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import canal as C
from orbweave.operators import density as D
from orbweave.operators import sweeps as W
from orbweave.operators.ranges import written
from orbweave.plans.adapters import OBJECTS, objects, with_

Q, SQL = {}, {}
POSITIONS = {"base": 0.25, "middle": 0.5, "apex": 0.75}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_V = "pos AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {f}::DOUBLE)" for n, f in POSITIONS.items()) + ") v(position, fraction))"
_REF = "ref AS (SELECT position, fraction, label_id, anchor_z AS \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY abs(length_fraction - fraction), label_id) AS k FROM objects, pos) WHERE k = 1)"
_SL = "sl AS (SELECT position, fraction, \"at\" - 2.0::DOUBLE AS slice_min, \"at\" + 2.0::DOUBLE AS slice_max, o.* FROM ref, objects o WHERE bb_min_z <= \"at\" + 2.0 AND bb_max_z >= \"at\" - 2.0 AND abs(length_fraction - fraction) <= 0.2::DOUBLE)".replace("o.*", "o.label_id AS oid, o.anchor_x, o.anchor_y, o.bb_min_x, o.bb_max_x, o.bb_min_y, o.bb_max_y, o.bb_min_z, o.bb_max_z, o.length_fraction")


@query("density_reference", with_(OBJECTS, _V, _REF) + "SELECT position, fraction, label_id, \"at\" FROM ref")
def _(s, d):
    return D.reference_rows(objects(s, d), POSITIONS)


@query("density_slices", with_(OBJECTS, _V, _REF, _SL) + "SELECT position, oid AS label_id, slice_min, slice_max FROM sl")
def _(s, d):
    return D.slices(objects(s, d), POSITIONS, 4.0, 0.2).select("position", "label_id", "slice_min", "slice_max")


@query("density_counts", with_(OBJECTS, _V, _REF, _SL) + "SELECT position, count(*) AS n, list(oid ORDER BY oid) AS label_ids FROM sl GROUP BY 1")
def _(s, d):
    return D.profile(objects(s, d), POSITIONS, 4.0, 0.2).select("position", "n", "label_ids")


@query("density_profile", None)
def _(s, d):
    return D.profile(objects(s, d), POSITIONS, 4.0, 0.2)


@query("density_overlap", None)
def _(s, d):
    return D.position_overlap(D.profile(objects(s, d), POSITIONS, 4.0, 0.2))


_IDS = "ids AS (SELECT position, list(oid) AS ids, any_value(slice_min) AS lo, any_value(slice_max) AS hi FROM sl GROUP BY 1)"


@query("position_sharing", with_(OBJECTS, _V, _REF, _SL, _IDS) + "SELECT a.position AS a, b.position AS b, len(list_intersect(a.ids, b.ids))::INT AS n_shared, len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))) AS jaccard, len(list_intersect(a.ids, b.ids)) / least(len(a.ids), len(b.ids)) AS shared_fraction, greatest(0.0::DOUBLE, least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS slice_overlap FROM ids a, ids b WHERE a.position < b.position")
def _(s, d):
    return D.position_overlap(D.profile(objects(s, d), POSITIONS, 4.0, 0.2)).drop("hull_iou")


@query("roi_halo", with_(OBJECTS, _V, _REF, _SL) + "SELECT position, " + ", ".join(f"greatest(1, ceil((max(bb_max_{c}) - min(bb_min_{c})) / 2 / 0.38::DOUBLE))::BIGINT AS halo_{c}" for c in "xyz") + " FROM sl GROUP BY 1")
def _(s, d):
    return D.roi_halo(D.slices(objects(s, d), POSITIONS, 4.0, 0.2), 0.38)


@query("slice_cluster", None)
def _(s, d):
    part = D.slices(objects(s, d), {"middle": 0.5}, 20.0)
    return D.largest_cluster(part, 6.0, 5, 0.5).select("label_id", "component_labels")


def _three_sets(s, d):
    return objects(s, d).withColumn("dataset", (F.col("label_id") % 3).cast("long"))


@query("smaller_type_run", None)
def _(s, d):
    """Nodes of the run of each data set; tests/test_sweeps.py holds them against all pairs and a Dijkstra from every node."""
    return W.smaller_run(_three_sets(s, d), (1, 2))


@query("tonotopic_mapping", None)
def _(s, d):
    """All objects by the nearest node of that run."""
    o = _three_sets(s, d)
    return C.mapped(o, written(W.smaller_run(o, (1, 2))), (1, 2))


QUERIES, ORACLE_SQL = Q, SQL
