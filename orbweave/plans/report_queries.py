"""Queries on tables that the drivers of an analysis put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import reports as R
from orbweave.plans.adapters import CELLS, OBJECTS, VOXELS, cells, objects, table, voxels, with_

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_SETS = "sets AS (SELECT *, 'set' || label_id % 3 AS dataset FROM objects)"


def _sets(s, d):
    return objects(s, d).withColumn("dataset", F.concat(F.lit("set"), (F.col("label_id") % 3).cast("string")))


@query("component_overview", with_(OBJECTS, _SETS, "n AS (SELECT dataset, component_labels, count(*) AS n FROM sets WHERE component_labels != 0 GROUP BY 1, 2)") + "SELECT dataset, sum(n)::BIGINT AS n_objects, count(*) AS n_components, max(n) AS largest FROM n GROUP BY 1")
def _(s, d):
    return R.component_overview(_sets(s, d), "dataset")


_REGISTRY = "registry AS (SELECT * FROM (VALUES ('set0', 'A', [1, 2]), ('set1', 'B', [3]), ('set2', 'C', [0, 5, 7])) AS t(dataset, alias, components))"


@query("cohort_counts", with_(OBJECTS, _SETS, _REGISTRY) + "SELECT alias, count(*) AS n FROM sets JOIN registry USING (dataset) WHERE list_contains(components, component_labels) GROUP BY 1")
def _(s, d):
    registry = s.createDataFrame([("set0", "A", [1, 2]), ("set1", "B", [3]), ("set2", "C", [0, 5, 7])], "dataset string, alias string, component_labels array<bigint>")
    return R.registered(_sets(s, d), registry, "dataset").groupBy("alias").agg(F.count("*").alias("n"))


_CROPS = """crops AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'mouse' WHEN 1 THEN 'gerbil' ELSE 'other' END AS species,
  CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'val' WHEN o_orderkey % 3 = 0 THEN 'test' END AS split, o_custkey % 50 AS n_samples FROM orders)"""
_INST = lambda x: f"coalesce(sum(n_samples) FILTER (split = '{x}'), 0)::BIGINT"
_NCROP = lambda x: f"count(*) FILTER (split = '{x}')"


@query(
    "split_counts",
    with_(_CROPS)
    + f"SELECT species, {_NCROP('train')} + {_NCROP('val')} AS n_crops, {_NCROP('train')} AS n_crops_train, {_NCROP('val')} AS n_crops_val, {_INST('train')} + {_INST('val')} AS n_instances, {_INST('train')} AS n_instances_train, {_INST('val')} AS n_instances_val, nullif({_NCROP('test')}, 0) AS n_crops_test, CASE WHEN {_NCROP('test')} > 0 THEN {_INST('test')} END AS n_instances_test FROM crops GROUP BY GROUPING SETS ((species), ())",
)
def _(s, d):
    k, st = F.col("o_orderkey") % 3, F.col("o_orderstatus")
    crops = table(s, d, "orders").select(
        F.when(k == 0, "mouse").when(k == 1, "gerbil").otherwise("other").alias("species"), F.when(st == "F", "train").when(st == "O", "val").when(k == 0, "test").alias("split"), (F.col("o_custkey") % 50).alias("n_samples")
    )
    return R.split_counts(crops)


@query("positive_count_statistics", "WITH c AS (SELECT o_custkey % 7 AS dataset, o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1, 2) SELECT dataset, count(*) AS n_cells, sum(n)::BIGINT AS total, round_even(avg(n), 6) AS mean, round_even(stddev_pop(n), 6) AS stdev FROM c WHERE n >= 1 GROUP BY 1")
def _(s, d):
    c = table(s, d, "orders").groupBy((F.col("o_custkey") % 7).alias("dataset"), "o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return R.positive_count_statistics(c, "dataset", "n").select("dataset", "n_cells", "total", F.bround("mean", 6).alias("mean"), F.bround("stdev", 6).alias("stdev"))


@query("variance_records", "WITH c AS (SELECT o_orderpriority AS dataset, o_orderstatus AS scenario, o_custkey % 3 AS class, count(*) AS value FROM orders GROUP BY 1, 2, 3), n AS (SELECT o_orderpriority AS dataset, count(DISTINCT o_custkey % 11) AS n_crops FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT dataset, scenario, 'class' || class AS class, value FROM c JOIN n USING (dataset) WHERE n_crops >= 5")
def _(s, d):
    o = table(s, d, "orders")
    classes = o.groupBy(F.col("o_orderpriority").alias("dataset"), "o_orderstatus", (F.col("o_custkey") % 3).alias("class")).agg(F.count("*").alias("value"))
    maps = classes.groupBy("dataset", "o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("class"), F.col("class").cast("string")), "value"))).alias("m"))
    summary = maps.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "m"))).alias("scenarios"))
    n = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.countDistinct(F.col("o_custkey") % 11).alias("n_crops"))
    return R.variance_records(summary.join(n, "dataset"))


@query("tonotopic_assembly", with_(OBJECTS) + "SELECT label_id, length_fraction, coalesce(n, 0) AS n_spots FROM objects LEFT JOIN (SELECT o_custkey AS label_id, count(*) AS n FROM orders GROUP BY 1) USING (label_id) WHERE component_labels IN (1, 2)")
def _(s, d):
    counts = table(s, d, "orders").groupBy(F.col("o_custkey").alias("label_id")).agg(F.count("*").alias("n_spots"))
    return R.counted_cells(objects(s, d), counts, [1, 2], "n_spots").select("label_id", "length_fraction", "n_spots")


@query("subtype_assembly", with_(CELLS) + "SELECT label_id, length_fraction, CASE WHEN marker = 1 AND marker_b = 2 THEN 'Ia' WHEN marker = 1 AND marker_b = 1 THEN 'Ib' WHEN marker = 2 AND marker_b = 1 THEN 'Ic' ELSE 'unknown' END AS type FROM cells WHERE marker IN (1, 2) AND marker_b IN (1, 2)")
def _(s, d):
    return R.marked_cells(cells(s, d), ["marker", "marker_b"], {(1, 2): "Ia", (1, 1): "Ib", (2, 1): "Ic"}).select("label_id", "length_fraction", "type")


@query("undefined_removal", with_(VOXELS) + "SELECT z, y, x, CASE WHEN (x + y) % 5 = 0 THEN 0 ELSE label END AS label FROM voxels")
def _(s, d):
    v = voxels(s, d)
    return R.without_undefined(v, v.select("z", "y", "x", F.when((F.col("x") + F.col("y")) % 5 == 0, 1).otherwise(0).alias("confidence")))


_BALL = "ball AS (SELECT a, b, c FROM range(-2, 3) p(a), range(-2, 3) q(b), range(-2, 3) r(c) WHERE a * a + b * b + c * c <= 4)"


@query("ball_stamps", with_(VOXELS, _BALL, "spots AS (SELECT y * 40 + x AS spot_id, z, y, x FROM voxels WHERE value > 49)") + "SELECT z + a AS z, y + b AS y, x + c AS x, max(spot_id) AS label FROM spots, ball WHERE z + a BETWEEN 0 AND 3 AND y + b BETWEEN 0 AND 39 AND x + c BETWEEN 0 AND 39 GROUP BY 1, 2, 3")
def _(s, d):
    spots = voxels(s, d).where("value > 49").select((F.col("y") * 40 + F.col("x")).alias("spot_id"), "z", "y", "x")
    return R.stamped(spots, 2, (4, 40, 40))


@query("ball_mask", with_(VOXELS) + "SELECT z, y, x FROM voxels WHERE (z - 2) * (z - 2) + (y - 20) * (y - 20) + (x - 20) * (x - 20) <= 72.25")
def _(s, d):
    return voxels(s, d).where(R.inside_ball((2, 20, 20), 8.5)).select("z", "y", "x")


_EDGE = lambda n, c: f"round_even((bb_{n}_{c} / 0.38::DOUBLE)::FLOAT::DOUBLE, 0)::INT"
_SHAPE = {"z": 40, "y": 60, "x": 80}


@query("voxel_boxes", with_(OBJECTS) + "SELECT label_id, " + ", ".join(f"greatest({_EDGE('min', c)} - 5, 0) AS low_{c}, least({_EDGE('max', c)} + 5, {n}) AS high_{c}, trunc(anchor_{c} / 0.38::DOUBLE)::INT AS center_{c}" for c, n in _SHAPE.items()) + " FROM objects")
def _(s, d):
    return R.voxel_boxes(objects(s, d), (0.38, 0.38, 0.38), (40, 60, 80), 4)


@query("crop_regions", with_(OBJECTS) + "SELECT label_id AS crop, " + ", ".join(f"CASE WHEN label_id % 90 < 80 THEN least(greatest(round_even(anchor_{c} / 0.5::DOUBLE, 0)::INT - (label_id % 90) // 2, 0), {n} - label_id % 90) END AS start_{c}, CASE WHEN label_id % 90 < 80 THEN least(greatest(round_even(anchor_{c} / 0.5::DOUBLE, 0)::INT - (label_id % 90) // 2, 0), {n} - label_id % 90) + label_id % 90 END AS stop_{c}" for c, n in {"z": 79, "y": 120, "x": 160}.items()) + " FROM objects")
def _(s, d):
    crops = objects(s, d).select(F.col("label_id").alias("crop"), *[F.col(f"anchor_{c}").alias(f"center_{c}") for c in "xyz"], *[(F.col("label_id") % 90).alias(f"size_{c}") for c in "xyz"])
    return R.crop_regions(crops, (0.5, 0.5, 0.5), (79, 120, 160))


@query("zip_join", with_(OBJECTS) + "SELECT label_id, component_labels, n_pixels / 2.0 AS half FROM objects")
def _(s, d):
    o = objects(s, d)
    return R.zipped(o.select("label_id", "component_labels"), o.select("label_id", (F.col("n_pixels") / 2.0).alias("half")))


@query("id_lookup", with_(OBJECTS) + "SELECT c_custkey AS label_id, n_pixels, n_pixels IS NOT NULL AS found FROM customer LEFT JOIN objects ON c_custkey = label_id")
def _(s, d):
    return R.looked_up(table(s, d, "customer").select(F.col("c_custkey").alias("label_id")), objects(s, d), "n_pixels")


@query("main_component_measures", with_(CELLS, "n AS (SELECT dataset, marker, count(*) AS n FROM cells WHERE marker != 0 GROUP BY 1, 2)", "top AS (SELECT dataset, marker FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, marker) AS k FROM n) WHERE k = 1)") + "SELECT label_id, dataset, value FROM cells SEMI JOIN top USING (dataset, marker)")
def _(s, d):
    c = cells(s, d)
    n = c.where("marker != 0").groupBy("dataset", "marker").agg(F.count("*").alias("n"))
    top = n.groupBy("dataset").agg(F.min(F.struct((-F.col("n")).alias("m"), "marker")).alias("t")).select("dataset", F.col("t.marker").alias("marker"))
    return c.join(top, ["dataset", "marker"], "left_semi").select("label_id", "dataset", "value")


_NAMES = "('MLR226L' || '_x_z' || (p_partkey % 700) || '_annotated.tif')"


@query("annotation_names", "SELECT p_partkey AS label_id, 'M_LR_000226_L' AS dataset, (p_partkey % 700)::INT AS slice_id, CASE p_partkey % 3 WHEN 0 THEN 'bg-mask' WHEN 1 THEN 'plain' END AS kind FROM part")
def _(s, d):
    p = table(s, d, "part")
    parts = R.annotation_parts(F.concat(F.lit("/data/MLR226L_x_z"), (F.col("p_partkey") % 700).cast("string"), F.lit("_annotated.tif")))
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, "GFP_object-measures_bg-mask.tsv").when(k == 1, "GFP_object-measures.tsv").otherwise("GFP.tsv")
    return p.select(F.col("p_partkey").alias("label_id"), parts["dataset"].alias("dataset"), parts["slice_id"].alias("slice_id"), R.table_kind(name).alias("kind"))


_CURVES = "curves AS (SELECT dataset AS curve, length_fraction AS x, avg(value) - 1000 AS density FROM cells GROUP BY 1, 2)"


@query("average_curve", None)
def _(s, d):
    """The mean density curve of the data sets' values along the length; tests hold it against numpy."""
    c = cells(s, d).groupBy(F.col("dataset").alias("curve"), F.col("length_fraction").alias("x")).agg((F.avg("value") - 1000).alias("density"))
    w = cells(s, d).groupBy(F.col("dataset").alias("curve")).agg(F.count("*").cast("double").alias("weight"))
    return R.average_curve(c, w)


QUERIES, ORACLE_SQL = Q, SQL
