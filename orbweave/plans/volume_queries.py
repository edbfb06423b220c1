"""Queries on voxel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import volumes as V
from orbweave.plans.adapters import CELLS, VOXELS, cells, table, voxels, with_

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


@query(
    "object_table",
    with_(VOXELS) + "SELECT label AS label_id, count(*) AS n_pixels, " + ", ".join(f"round_even(avg({c}) * 0.5::DOUBLE, 6) AS anchor_{c}, min({c}) * 0.5::DOUBLE AS bb_min_{c}, (max({c}) + 1) * 0.5::DOUBLE AS bb_max_{c}" for c in "zyx") + " FROM voxels WHERE label != 0 GROUP BY 1",
)
def _(s, d):
    return V.object_table(voxels(s, d), (0.5, 0.5, 0.5)).withColumns({f"anchor_{c}": F.bround(f"anchor_{c}", 6) for c in "zyx"})


@query("cut_out", with_(VOXELS) + "SELECT z - 1 AS z, y - 5 AS y, x - 7 AS x, value, label FROM voxels WHERE z >= 1 AND z < 3 AND y >= 5 AND y < 30 AND x >= 7 AND x < 20")
def _(s, d):
    return V.cut_out(voxels(s, d), (1, 5, 7), (3, 30, 20)).select("z", "y", "x", "value", "label")


@query("downsample_mean", with_(VOXELS) + "SELECT z // 2 AS z, y // 4 AS y, x // 4 AS x, round_even(avg(value), 9) AS value FROM voxels GROUP BY 1, 2, 3")
def _(s, d):
    return V.downsample(voxels(s, d), (2, 4, 4)).withColumn("value", F.bround("value", 9))


@query("keep_labels", with_(VOXELS) + "SELECT z, y, x, CASE WHEN label IN (SELECT p_size FROM part WHERE p_size < 12) THEN label ELSE 0 END AS label FROM voxels")
def _(s, d):
    return V.keep_labels(voxels(s, d), table(s, d, "part").where("p_size < 12").select("p_size")).select("z", "y", "x", "label")


@query("frequency_volume", with_(VOXELS, CELLS) + "SELECT z, y, x, coalesce(frequency, 0) AS frequency FROM voxels LEFT JOIN cells ON label = label_id")
def _(s, d):
    return V.lookup(voxels(s, d), cells(s, d), "frequency").select("z", "y", "x", "frequency")


_MASK = "mask AS (SELECT DISTINCT z, y, x FROM voxels WHERE value > 48)"


@query("dilation", with_(VOXELS, _MASK) + "SELECT DISTINCT m.z + a AS z, m.y + b AS y, m.x + c AS x FROM mask m, range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) v(c)")
def _(s, d):
    return V.dilated(voxels(s, d).where("value > 48"), 1)


_DIL = "dil AS (SELECT DISTINCT m.z + a AS z, m.y + b AS y, m.x + c AS x FROM mask m, range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) v(c))"


@query("closing", with_(VOXELS, _MASK, _DIL) + "SELECT m.z + a AS z, m.y + b AS y, m.x + c AS x FROM dil m, range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) v(c) GROUP BY 1, 2, 3 HAVING count(*) = 27")
def _(s, d):
    return V.closed(voxels(s, d).where("value > 48"))


_OV = """na AS (SELECT label AS a, count(*) AS na FROM voxels WHERE label != 0 GROUP BY 1), nb AS (SELECT other AS b, count(*) AS nb FROM voxels WHERE other != 0 GROUP BY 1),
ov AS (SELECT label AS a, other AS b, count(*) AS n FROM voxels WHERE label != 0 AND other != 0 GROUP BY 1, 2)"""


@query("label_overlap", with_(VOXELS, _OV) + "SELECT a, b, n, n / na AS fraction_a, n / nb AS fraction_b, n / (na + nb - n) AS iou FROM ov JOIN na USING (a) JOIN nb USING (b)")
def _(s, d):
    return V.overlap_fractions(voxels(s, d))


@query("merge_segmentations", with_(VOXELS) + "SELECT z, y, x, CASE WHEN label = 0 AND other IN (SELECT p_size FROM part) THEN other + 100 ELSE label END AS label FROM voxels")
def _(s, d):
    return V.merge_segmentations(voxels(s, d), table(s, d, "part").select("p_size"), 100).select("z", "y", "x", "label")


@query(
    "split_overcounted",
    with_(VOXELS, _OV, "ins AS (SELECT a, b FROM ov JOIN nb USING (b) WHERE n / nb >= 0.3)", "sev AS (SELECT a FROM ins GROUP BY 1 HAVING count(*) > 1)")
    + "SELECT z, y, x, CASE WHEN label IN (SELECT a FROM sev) THEN CASE WHEN (label, other) IN (SELECT (a, b) FROM ins) THEN (SELECT max(label) FROM voxels) + other ELSE 0 END ELSE label END AS label FROM voxels",
)
def _(s, d):
    return V.split_overcounted(voxels(s, d), 0.3).select("z", "y", "x", "label")


@query("local_maxima", with_(VOXELS, "hi AS (SELECT * FROM voxels WHERE value > 40)") + "SELECT h.z, h.y, h.x, h.value FROM hi h JOIN hi g ON abs(h.z - g.z) <= 2 AND abs(h.y - g.y) <= 2 AND abs(h.x - g.x) <= 2 GROUP BY 1, 2, 3, 4 HAVING max(g.value) = h.value")
def _(s, d):
    return V.local_maxima(voxels(s, d), 2, 40.0)


@query("flow_correction", with_(VOXELS) + "SELECT z + 2.0::DOUBLE * (value / 100) / (1 + value / 50 + 1e-8::DOUBLE) AS z, y + 2.0::DOUBLE * (value / 200) / (1 + value / 50 + 1e-8::DOUBLE) AS y, x + 2.0::DOUBLE * (value / 400) / (1 + value / 50 + 1e-8::DOUBLE) AS x FROM voxels WHERE value > 45")
def _(s, d):
    v = voxels(s, d)
    flow = v.select("z", "y", "x", (F.col("value") / 50).alias("f0"), (F.col("value") / 100).alias("f1"), (F.col("value") / 200).alias("f2"), (F.col("value") / 400).alias("f3"))
    return V.flow_corrected(v.where("value > 45"), flow, 2.0)


@query("synapses_per_cell", with_(CELLS) + "SELECT label_id, count(l_partkey) AS n FROM cells LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity <= 10) ON l_partkey = label_id GROUP BY 1")
def _(s, d):
    spots = table(s, d, "lineitem").select(F.col("l_partkey").alias("matched"), F.col("l_quantity").alias("distance"))
    return V.spots_per_cell(spots, cells(s, d), 10.0)


_BLOCKS = "blocks AS (SELECT z // 2 AS bz, y // 8 AS by, x // 8 AS bx, round_even(quantile_cont(value, 0.95), 6) AS p95, round_even(quantile_cont(value, 0.99), 6) AS p99 FROM voxels GROUP BY 1, 2, 3)"


def _blocks(s, d):
    return V.block_percentiles(voxels(s, d), (2, 8, 8), (95, 99)).withColumns({c: F.bround(c, 6) for c in ("p95", "p99")})


@query("block_percentiles", with_(VOXELS, _BLOCKS) + "SELECT * FROM blocks")
def _(s, d):
    return _blocks(s, d)


@query("mask_threshold_sweep", with_(VOXELS, _BLOCKS) + "SELECT t AS threshold, avg((p95 > t)::INT::DOUBLE) AS share FROM blocks, (VALUES (30.0::DOUBLE), (45.0::DOUBLE), (49.5::DOUBLE)) v(t) GROUP BY 1")
def _(s, d):
    return V.mask_sweep(_blocks(s, d), "p95", [30.0, 45.0, 49.5])


@query(
    "background_mask",
    with_(VOXELS, "co AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(value) AS value FROM voxels GROUP BY 1, 2, 3)", "ob AS (SELECT DISTINCT z // 2 + a AS z, y // 2 + b AS y, x // 2 + c AS x FROM voxels, range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) v(c) WHERE label != 0)")
    + "SELECT z, y, x FROM co WHERE value <= (SELECT quantile_cont(value, 0.35) FROM co) AND (z, y, x) NOT IN (SELECT (z, y, x) FROM ob)",
)
def _(s, d):
    return V.background_mask(voxels(s, d), (2, 2, 2))


@query("background_normalised", with_(CELLS) + "SELECT label_id, value - frequency AS value, frequency AS stdev FROM cells")
def _(s, d):
    c = cells(s, d)
    return V.normalised(c.select("label_id", "value", F.col("frequency").alias("stdev")), c.select("label_id", F.col("frequency").alias("background")), ["value", "stdev"])


@query("global_mean_std", with_(VOXELS) + "SELECT round_even(avg(value), 6) AS mean, round_even(stddev_pop(value), 6) AS stdev FROM voxels WHERE label != 0")
def _(s, d):
    return V.global_mean_std(voxels(s, d), F.col("label") != 0).select(F.bround("mean", 6).alias("mean"), F.bround("stdev", 6).alias("stdev"))


_NEAR = " + ".join(f"CASE WHEN n{k}.label IS NULL THEN 1 ELSE 0 END" for k in range(6))
_NJ = " ".join(f"LEFT JOIN voxels n{k} ON n{k}.label = v.label AND " + " AND ".join(f"n{k}.{c} = v.{c} + {st if c == ax else 0}" for c in "zyx") for k, (ax, st) in enumerate((a, t) for a in "zyx" for t in (-1, 1)))


@query("surface_faces", with_(VOXELS) + f"SELECT v.label AS label_id, count(*) AS volume, sum({_NEAR})::BIGINT AS surface FROM voxels v {_NJ} WHERE v.label != 0 GROUP BY 1")
def _(s, d):
    return V.surface_faces(voxels(s, d))


@query("last_painted", "SELECT z, y, x, label FROM (SELECT (l_linenumber % 4)::BIGINT AS z, l_partkey % 40 AS y, l_suppkey % 40 AS x, l_orderkey AS label, row_number() OVER (PARTITION BY l_linenumber % 4, l_partkey % 40, l_suppkey % 40 ORDER BY l_orderkey DESC) AS k FROM lineitem) WHERE k = 1")
def _(s, d):
    li = table(s, d, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("z"), (F.col("l_partkey") % 40).alias("y"), (F.col("l_suppkey") % 40).alias("x"), F.col("l_orderkey").alias("label"))
    return V.priority_label(li.withColumn("order", F.col("label")), "order")


@query(
    "nearest_marker",
    with_(VOXELS, "mk AS (SELECT row_number() OVER (ORDER BY z, y, x) AS id, z, y, x FROM (SELECT DISTINCT z, y, x FROM voxels WHERE value > 49.9))", "dd AS (SELECT v.z, v.y, v.x, mk.id, (v.z - mk.z) * (v.z - mk.z) + (v.y - mk.y) * (v.y - mk.y) + (v.x - mk.x) * (v.x - mk.x) AS d FROM voxels v, mk)")
    + "SELECT z, y, x, id AS marker FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY d, id) AS k FROM dd WHERE d < 9) WHERE k = 1",
)
def _(s, d):
    v = voxels(s, d)
    marks = V.numbered(v.where("value > 49.9").select("z", "y", "x").distinct(), ["z", "y", "x"], "id")
    return V.nearest_marker(v, marks, 3)


QUERIES, ORACLE_SQL = Q, SQL
