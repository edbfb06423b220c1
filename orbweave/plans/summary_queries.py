"""Queries on measures of crops and matches, crop blocks, junctions of paths and guided dilation."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import summaries as S
from orbweave.plans.adapters import CELLS, OBJECTS, PATH, SCORES, cells, every_path, objects, scores, table, voxels, with_

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_SIZES = "n AS (SELECT l_suppkey % 20 AS crop, l_partkey % 12 AS label, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query(
    "crop_measures",
    with_(_SIZES)
    + "SELECT crop, count(*) FILTER (label != 0) AS n_samples, coalesce(round_even(avg(n) FILTER (label != 0 AND n >= 25), 1), 0) AS mean_vol, coalesce(min(n) FILTER (label != 0 AND n >= 25), 0) AS min_vol, coalesce(max(n) FILTER (label != 0 AND n >= 25), 0) AS max_vol, count(*) FILTER (label != 0 AND n >= 25) AS n_large, count(*) FILTER (label != 0 AND n < 25) AS n_small FROM n GROUP BY 1",
)
def _(s, d):
    li = table(s, d, "lineitem").select((F.col("l_suppkey") % 20).alias("crop"), (F.col("l_partkey") % 12).alias("label"))
    return S.crop_measures(li, "crop", 25)


_BOXES = "boxes AS (SELECT component_labels AS position, " + ", ".join(f"min(bb_min_{c}) AS bb_min_{c}, max(bb_max_{c}) AS bb_max_{c}" for c in "xyz") + " FROM objects WHERE component_labels > 0 GROUP BY 1)"
_HALF = lambda c, k: f"CASE WHEN position % 5 = 0 THEN {k + 7} WHEN position % 3 = {k} AND position % 4 != 0 THEN greatest(1, ceil(10.0::DOUBLE / 2 / 0.38::DOUBLE)) ELSE greatest(1, ceil((bb_max_{c} - bb_min_{c}) / 2 / 0.38::DOUBLE)) END::BIGINT AS halo_{c}"


@query("block_entries", with_(OBJECTS, _BOXES) + "SELECT position, " + ", ".join(f"round_even((bb_min_{c} + bb_max_{c}) / 2, 0)::BIGINT AS center_{c}, {_HALF(c, k)}" for k, c in enumerate("xyz")) + " FROM boxes")
def _(s, d):
    box = [f(f"bb_{n}_{c}").alias(f"bb_{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    b = objects(s, d).where("component_labels > 0").groupBy(F.col("component_labels").alias("position")).agg(*box)
    k = F.col("position") % 3
    b = b.withColumns({f"center_{c}": (F.col(f"bb_min_{c}") + F.col(f"bb_max_{c}")) / 2 for c in "xyz"})
    b = b.withColumns({"axis": F.when(k == 0, "x").when(k == 1, "y").otherwise("z"), "slice_thickness": F.when(F.col("position") % 4 != 0, 10.0), "stored": F.when(F.col("position") % 5 == 0, F.array(F.lit(7), F.lit(8), F.lit(9)))})
    return S.block_entries(b, stored="stored")


@query(
    "crop_values_or_names",
    """WITH t AS (SELECT p_partkey AS label_id, CASE WHEN p_partkey % 3 != 0 THEN p_retailprice::DOUBLE END AS value,
    CASE WHEN p_partkey % 5 != 0 THEN (p_partkey % 200)::DOUBLE END AS a, CASE WHEN p_partkey % 7 != 0 THEN p_partkey % 300 + 0.5::DOUBLE END AS b FROM part)
    SELECT label_id, coalesce(value, (a + b) / 2, a, b) AS value, CASE WHEN value IS NOT NULL THEN 'annotations' WHEN coalesce(a, b) IS NOT NULL THEN 'filename' END AS value_source FROM t""",
)
def _(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey")
    number = lambda x: x.cast("string")
    crops = p.select(
        k.alias("label_id"), F.when(k % 3 != 0, F.col("p_retailprice").cast("double")).alias("value"),
        F.when(k % 5 != 0, F.concat(F.lit("crop_allNegativeExcluded_thr"), number(k % 200), F.lit(".tif"))).alias("negative"),
        F.when(k % 7 != 0, F.concat(F.lit("crop_allPositiveIncluded_"), number(k % 300), F.lit(".5.tif"))).otherwise("crop_none.tif").alias("positive"),
    )
    return S.with_name_threshold(crops, "value", "negative", "positive").select("label_id", "value", "value_source")


@query("match_voxels", with_(OBJECTS) + "SELECT " + ", ".join(f"round_even(anchor_{c} / 3.0::DOUBLE, 0)::BIGINT AS {c}" for c in "zyx") + ", max(label_id % 3 + 1) AS class FROM objects GROUP BY ALL")
def _(s, d):
    return S.match_voxels(objects(s, d).select(*[F.col(f"anchor_{c}").alias(c) for c in "zyx"], (F.col("label_id") % 3 + 1).alias("class")), 3.0)


@query(
    "pooled_scores",
    with_(SCORES, "t AS (SELECT sum(tps)::BIGINT AS tp, sum(fps)::BIGINT AS fp, sum(fns)::BIGINT AS fn FROM scores)", "r AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS q FROM t)")
    + "SELECT tp, fp, fn, round_even(p, 3) AS precision, round_even(q, 3) AS recall, round_even(2 * p * q / (p + q), 3) AS f1 FROM r",
)
def _(s, d):
    return S.pooled_scores(scores(s, d).select(F.col("tps").alias("tp"), F.col("fps").alias("fp"), F.col("fns").alias("fn")))


@query("consensus_rounds", "SELECT o_orderkey AS id, o_custkey % 3 AS round FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 3 = 2 UNION ALL SELECT o_orderkey, o_custkey % 3 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 3 = 1")
def _(s, d):
    o = table(s, d, "orders")
    points = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("round"), F.when(F.col("o_orderpriority") == "1-URGENT", "consensus").otherwise(F.col("o_orderpriority")).alias("annotator"))
    kept = S.consensus_points_only(points).select("id", "round")
    return S.next_round(kept.where("round = 2"), kept.where("round = 1"))


def _side(side: str, order: str) -> list[str]:
    at = ", ".join(f"arg_min({c}, k) AS u{c}, coalesce(arg_min({c}, k) FILTER (k > 0 AND arc >= 50), arg_max({c}, k)) AS v{c}, arg_max({c}, k) AS {c}" for c in "xyz")
    step = " + ".join(f"({c} - lag({c}) OVER w) * ({c} - lag({c}) OVER w)" for c in "xyz")
    return [
        f"s_{side} AS (SELECT dataset, x, y, z, row_number() OVER w - 1 AS k, coalesce(sqrt({step}), 0) AS step FROM path WINDOW w AS (PARTITION BY dataset ORDER BY node_idx {order}))",
        f"c_{side} AS (SELECT *, sum(step) OVER (PARTITION BY dataset ORDER BY k ROWS UNBOUNDED PRECEDING) AS arc FROM s_{side})",
        f"e_{side} AS (SELECT dataset, '{side}' AS side, {at} FROM c_{side} GROUP BY dataset)",
    ]


_ENDS = [
    *_side("end", "ASC"), *_side("start", "DESC"),
    "t AS (SELECT *, sqrt(" + " + ".join(f"(u{c} - v{c}) * (u{c} - v{c})" for c in "xyz") + ") AS norm FROM (SELECT * FROM e_end UNION ALL SELECT * FROM e_start))",
    "ends AS (SELECT dataset, side, x, y, z, " + ", ".join(f"coalesce((u{c} - v{c}) / nullif(norm, 0), 0) AS t{c}" for c in "xyz") + " FROM t)",
    "g AS (SELECT p.dataset AS a, q.dataset AS b, p.side AS a_side, q.side AS b_side, sqrt(" + " + ".join(f"(q.{c} - p.{c}) * (q.{c} - p.{c})" for c in "xyz") + ") AS distance, " + " + ".join(f"(p.t{c} - q.t{c}) * (q.{c} - p.{c})" for c in "xyz") + " AS along FROM ends p JOIN ends q ON q.dataset = p.dataset + 1)",
    "f AS (SELECT *, coalesce(along / nullif(distance, 0), 0) AS flow, min(distance) OVER (PARTITION BY a, b) AS least FROM g)",
]


@query("junction_scores", with_(PATH, *_ENDS) + "SELECT a, b, a_side, b_side, round_even(distance, 6) + 0.0 AS distance, round_even(flow, 6) + 0.0 AS flow, round_even(coalesce(flow * (least / nullif(distance, 0)), flow), 6) + 0.0 AS score FROM f")
def _(s, d):
    """Both ends of each path against both ends of the path with the next number."""
    nodes = every_path(s, d)
    users = nodes.select(F.col("dataset").alias("a")).distinct()
    pairs = users.select("a", (F.col("a") + 1).alias("b"))
    found = S.junction_scores(S.outer_ends(nodes, "dataset"), pairs, "dataset")
    return found.select("a", "b", "a_side", "b_side", *[F.bround(c, 6).alias(c) for c in ("distance", "flow", "score")])


_QUARTILES = ", ".join(f"round_even(quantile_cont(value, {k / 4}), 6) AS q{k}" for k in range(5))


@query("sizes_below", with_(CELLS) + f"SELECT dataset, count(*) AS n, {_QUARTILES} FROM (SELECT dataset, value::DOUBLE AS value FROM cells) WHERE value < 1400 GROUP BY 1")
def _(s, d):
    return S.sizes_below(cells(s, d).withColumn("value", F.col("value").cast("double")), "dataset", "value", 1400.0).select("dataset", "n", *[F.bround(f"q{k}", 6).alias(f"q{k}") for k in range(5)])


@query("dilated_downhill", None)
def _(s, d):
    """Voxels of high values grown towards lower ones; tests hold the operator against numpy."""
    v = voxels(s, d)
    return S.dilated_downhill(v.select("z", "y", "x", (F.col("value") > 49).alias("inside"), F.col("value").alias("edt")), (4, 40, 40))


QUERIES, ORACLE_SQL = Q, SQL
