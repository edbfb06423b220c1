"""Queries over several data sets, and the remaining volume filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orbweave.operators import cohort as C
from orbweave.plans.adapters import CELLS, OBJECTS, VOXELS, cells, objects, table, voxels, with_

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_SIZES = "sizes AS (SELECT label AS label_id, count(*) AS n_pixels FROM voxels WHERE label != 0 GROUP BY 1)"


@query("slab_overlap_filter", with_(VOXELS, _SIZES) + "SELECT label_id, count(*) AS inside FROM voxels JOIN sizes ON label = label_id WHERE z >= 1 AND z < 3 GROUP BY label_id, n_pixels HAVING count(*) / n_pixels >= 0.5")
def _(s, d):
    v = voxels(s, d)
    sizes = v.where("label != 0").groupBy(F.col("label").alias("label_id")).agg(F.count("*").alias("n_pixels"))
    return C.inside_slab(v, sizes, 1, 3, least_share=0.5).select("label_id", "inside")


_STEPS = [(a, t) for a in "zyx" for t in (-1, 1)]
_FULL = " AND ".join("EXISTS (SELECT 1 FROM voxels n WHERE n.label = v.label AND " + " AND ".join(f"n.{c} = v.{c} + {t if c == a else 0}" for c in "zyx") + ")" for a, t in _STEPS)
_SPOTS = "spots AS (SELECT row_number() OVER (ORDER BY z, y, x) AS spot_id, z, y, x FROM (SELECT DISTINCT z, y, x FROM voxels WHERE value > 49))"
_VD = "sqrt((s.z - e.z) * (s.z - e.z) + (s.y - e.y) * (s.y - e.y) + (s.x - e.x) * (s.x - e.x))"


@query(
    "spot_to_surface",
    with_(VOXELS, _SPOTS, f"edge AS (SELECT * FROM voxels v WHERE label != 0 AND NOT ({_FULL}))", f"p AS (SELECT spot_id, e.label, {_VD} AS distance FROM spots s, edge e WHERE {_VD} <= 3 UNION ALL SELECT spot_id, label, 0.0 FROM spots JOIN voxels USING (z, y, x) WHERE label != 0)")
    + "SELECT spot_id, label AS matched, round_even(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY distance, label) AS k FROM p) WHERE k = 1",
)
def _(s, d):
    from orbweave.operators.volumes import numbered

    v = voxels(s, d)
    spots = numbered(v.where("value > 49").select("z", "y", "x").distinct(), ["z", "y", "x"])
    return C.nearest_surface(spots, v, 3.0).select("spot_id", "matched", F.bround("distance", 6).alias("distance"))


_D = "sqrt(" + " + ".join(f"(a.anchor_{c} - b.anchor_{c}) * (a.anchor_{c} - b.anchor_{c})" for c in "xyz") + ")"


@query("closest_component_pairs", with_(OBJECTS) + f"SELECT c1, c2, a, b, round_even(d, 6) AS distance FROM (SELECT a.component_labels AS c1, b.component_labels AS c2, a.label_id AS a, b.label_id AS b, {_D} AS d, row_number() OVER (PARTITION BY a.component_labels, b.component_labels ORDER BY {_D}, a.label_id, b.label_id) AS k FROM objects a, objects b WHERE a.component_labels < b.component_labels AND {_D} <= 15) WHERE k = 1")
def _(s, d):
    return C.closest_pairs(objects(s, d), 15.0).withColumn("distance", F.bround("distance", 6))


@query("paired_files", "SELECT 'c' || c_custkey AS stem, 'c' || c_custkey || '.tif' AS left_name, 'c' || c_custkey || '_label.tif' AS right_name FROM customer WHERE c_custkey % 3 = 0")
def _(s, d):
    k = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    c = table(s, d, "customer")
    files = c.select(F.concat(k, F.lit(".tif")).alias("name")).unionByName(c.where("c_custkey % 3 = 0").select(F.concat(k, F.lit("_label.tif")).alias("name")))
    return C.paired_files(files.where(~F.col("name").endswith("_label.tif")).unionByName(files.where(F.col("name").endswith("_label.tif"))), ".tif", "_label.tif").where(~F.col("stem").contains("_label"))


@query("region_means", with_(CELLS, "r AS (SELECT CASE WHEN length_fraction BETWEEN 0 AND 0.3 THEN 'apex' WHEN length_fraction BETWEEN 0.3 AND 0.7 THEN 'middle' WHEN length_fraction BETWEEN 0.7 AND 1 THEN 'base' END AS region, dataset, avg(value) AS m FROM cells GROUP BY 1, 2)") + "SELECT region, round_even(avg(m), 6) AS mean, round_even(stddev_pop(m), 6) AS deviation, count(*) AS datasets FROM r WHERE region IS NOT NULL GROUP BY 1")
def _(s, d):
    r = C.region_means(cells(s, d), {"apex": (0.0, 0.3), "middle": (0.3, 0.7), "base": (0.7, 1.0)}, "value")
    return r.select("region", F.bround("mean", 6).alias("mean"), F.bround("deviation", 6).alias("deviation"), "datasets")


@query("left_and_right", 'SELECT c_mktsegment AS animal, round_even(avg(c_acctbal) FILTER (c_custkey % 2 = 0), 6) AS "L", round_even(avg(c_acctbal) FILTER (c_custkey % 2 = 1), 6) AS "R" FROM customer GROUP BY 1')
def _(s, d):
    c = table(s, d, "customer").select(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "L").otherwise("R")).alias("name"), "c_acctbal")
    return C.by_side(c, "name", "c_acctbal").select("animal", F.bround("L", 6).alias("L"), F.bround("R", 6).alias("R"))


@query("trend_parameters", with_(CELLS) + "SELECT dataset, marker, round_even(avg(value), 6) AS mean, round_even(stddev_pop(value), 6) AS deviation FROM cells GROUP BY 1, 2")
def _(s, d):
    return C.trend(cells(s, d), ["dataset", "marker"], "value").select("dataset", "marker", F.bround("mean", 6).alias("mean"), F.bround("deviation", 6).alias("deviation"))


@query("average_tonotopy", with_(CELLS) + "SELECT length_fraction, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value), 6) AS deviation, count(DISTINCT dataset) AS datasets FROM cells GROUP BY 1")
def _(s, d):
    a = C.average_curve(cells(s, d), "length_fraction", "value", "dataset")
    return a.select("length_fraction", F.bround("mean", 6).alias("mean"), F.bround("deviation", 6).alias("deviation"), "datasets")


_W = [math.exp(-k * k / 8) for k in range(-8, 9)]


@query(
    "smoothed_density",
    with_(CELLS, "h AS (SELECT b AS bin, count(label_id) AS n FROM range(64) t(b) LEFT JOIN cells ON least(63, floor(length_fraction * 64)::INT) = b GROUP BY 1)", "w AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {w / sum(_W)!r}::DOUBLE)" for k, w in zip(range(-8, 9), _W, strict=True)) + ") v(k, w))")
    + "SELECT t.b::INT AS bin, round_even(sum(w * n), 6) AS density FROM range(64) t(b), w JOIN h ON h.bin = greatest(0, least(63, t.b + k)) GROUP BY 1",
)
def _(s, d):
    return C.smoothed_histogram(cells(s, d), "length_fraction", 64, 2.0).withColumn("density", F.bround("density", 6))


@query("crop_centers", None)
def _(s, d):
    return C.crop_centers(objects(s, d), 3.0)


@query("hull_mask", with_(VOXELS) + "SELECT z, y, x FROM voxels WHERE 10 * (y - 2) - 5 * (x - 2) >= 0 AND -4 * (y - 7) - 20 * (x - 12) >= 0 AND -6 * (y - 27) + 25 * (x - 8) >= 0")
def _(s, d):
    return C.inside_polygon(voxels(s, d), [(2, 2), (12, 7), (8, 27)]).select("z", "y", "x")


@query("coarse_mask_filter", with_(VOXELS, "mk AS (SELECT DISTINCT z // 2 AS z, y // 4 AS y, x // 4 AS x FROM voxels WHERE value > 49.5)") + "SELECT v.z, v.y, v.x, CASE WHEN mk.z IS NULL THEN 0 ELSE label END AS label FROM voxels v LEFT JOIN mk ON mk.z = v.z // 2 AND mk.y = v.y // 4 AND mk.x = v.x // 4")
def _(s, d):
    v = voxels(s, d)
    mask = v.where("value > 49.5").select(*[F.floor(F.col(c) / f).cast("long").alias(c) for c, f in zip("zyx", (2, 4, 4), strict=True)])
    return C.in_coarse_mask(v, mask, (2, 4, 4)).select("z", "y", "x", "label")


@query("ids_in_between", with_(CELLS) + "SELECT label_id FROM cells WHERE marker = 1 INTERSECT SELECT label_id FROM cells WHERE marker_b = 1")
def _(s, d):
    c = cells(s, d)
    return C.inbetween_ids(c.where("marker = 1"), c.where("marker_b = 1"))


_KEY = "z * 4398046511104 + y * 2097152 + x"
_THIN = f"thin AS (SELECT label, {_KEY} AS v, z, y, x FROM voxels WHERE label != 0 AND value > 45)"


@query(
    "split_parts",
    f"WITH RECURSIVE {VOXELS}, {_THIN}, walk AS (SELECT label, v AS root, v FROM thin UNION SELECT w.label, w.root, t.v FROM walk w JOIN thin a ON a.v = w.v JOIN thin t ON t.label = w.label AND abs(t.z - a.z) + abs(t.y - a.y) + abs(t.x - a.x) = 1 WHERE w.root < t.v), n AS (SELECT label, v, min(root) AS part FROM walk GROUP BY 1, 2) SELECT label, part, count(*) AS n FROM n GROUP BY 1, 2 HAVING count(*) >= 2",
)
def _(s, d):
    return C.split_parts(voxels(s, d).where("value > 45"), 2)


@query("subtype_overview", with_(CELLS) + "SELECT marker, count(*) AS n, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM cells GROUP BY 1")
def _(s, d):
    return C.percent_by_label(cells(s, d), "marker")


@query("random_forest", None)
def _(s, d):
    c = cells(s, d).withColumn("mark", (F.col("value") > 950).cast("int"))
    model = C.train_forest(c, ["value", "frequency"], "mark")
    return C.predict_forest(model, c.select("label_id", "value", "frequency"), ["value", "frequency"]).select("label_id", "prediction", "probabilities")


QUERIES, ORACLE_SQL = Q, SQL
