"""Queries on scores, matchings, thresholds and markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import annotate as A
from orbweave.operators import matching as M
from orbweave.operators import ordered as O
from orbweave.plans.adapters import CELLS, OBJECTS, SCORES, VOXELS, cells, objects, scores, table, voxels, with_

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_P, _R = "(CASE WHEN tps + fps = 0 THEN NULL ELSE tps::DOUBLE / (tps + fps) END)", "(CASE WHEN tps + fns = 0 THEN NULL ELSE tps::DOUBLE / (tps + fns) END)"
_F1 = f"(CASE WHEN {_P} + {_R} = 0 THEN NULL ELSE 2 * {_P} * {_R} / ({_P} + {_R}) END)"
_THREE = f"round_even({_P}, 3) AS precision, round_even({_R}, 3) AS recall, round_even({_F1}, 3) AS f1_score"


@query("crop_scores", with_(SCORES) + f"SELECT annotator, file_name, {_THREE} FROM scores")
def _(s, d):
    return M.with_scores(scores(s, d)).select("annotator", "file_name", "precision", "recall", "f1_score")


@query("consensus_scores", with_(SCORES, "r AS (SELECT coalesce(annotator, 'all') AS annotator, sum(tps)::BIGINT AS tps, sum(fps)::BIGINT AS fps, sum(fns)::BIGINT AS fns FROM scores GROUP BY ROLLUP (annotator))") + f"SELECT annotator, tps, fps, fns, {_THREE} FROM r")
def _(s, d):
    return M.consensus_scores(scores(s, d))


@query("macro_scores", with_(SCORES, f"r AS (SELECT {_THREE} FROM scores)") + "SELECT round_even(round_even(avg(precision), 9), 3) AS precision, round_even(round_even(avg(recall), 9), 3) AS recall, round_even(round_even(avg(f1_score), 9), 3) AS f1_score FROM r")
def _(s, d):
    return M.macro_scores(scores(s, d))


@query("segmentation_accuracy", with_(SCORES) + f"SELECT round_even(avg(coalesce(round_even({_P}, 12), 0)), 3) AS precision, round_even(avg(coalesce(round_even({_R}, 12), 0)), 3) AS recall, round_even(avg(coalesce(round_even({_F1}, 12), 0)), 3) AS f1_score, round_even(avg(tps * 1.5), 3) AS runtime, round_even(stddev_pop(tps * 1.5), 3) AS runtime_std FROM scores")
def _(s, d):
    return M.compute_accuracy(scores(s, d).withColumn("runtime", F.col("tps") * 1.5))


@query("grid_search", with_(SCORES) + f"SELECT annotator, round_even(avg(coalesce({_F1}, 0)), 9) AS score FROM scores GROUP BY 1")
def _(s, d):
    rows = M.with_scores(scores(s, d), digits=12).withColumn("f", F.coalesce("f1_score", F.lit(0.0)))
    return M.grid_search(rows, ["annotator"], "f").select("annotator", F.bround("score", 9).alias("score"))


_D = "sqrt(" + " + ".join(f"(p.anchor_{c} - o.anchor_{c}) * (p.anchor_{c} - o.anchor_{c})" for c in "xyz") + ")"


@query(
    "naive_matching",
    with_(OBJECTS, f"n AS (SELECT p.label_id AS point, o.label_id AS object, {_D} AS distance, row_number() OVER (PARTITION BY p.label_id ORDER BY {_D}, o.label_id) AS k FROM objects p, objects o WHERE p.label_id % 2 = 0 AND o.label_id % 2 = 1 AND {_D} <= 10)")
    + "SELECT point, object, round_even(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY distance, point) AS j FROM n WHERE k = 1) WHERE j = 1",
)
def _(s, d):
    o = objects(s, d)
    return M.naive_matching(o.where("label_id % 2 = 1"), o.where("label_id % 2 = 0"), 10.0).select("point", "object", F.bround("distance", 6).alias("distance"))


@query("optimal_matching", None)
def _(s, d):
    o = objects(s, d)
    return M.match_detections(o.where("label_id % 2 = 0"), o.where("label_id % 2 = 1"), 6.0)


def _annotated(s, d):
    return objects(s, d).withColumn("annotator", F.element_at(F.array(F.lit("AMD"), F.lit("EK"), F.lit("LR")), (F.col("label_id") % 3 + 1).cast("int")))


@query("consensus_points", None)
def _(s, d):
    return M.consensus(_annotated(s, d), ["AMD", "EK", "LR"], 8.0, 2)


@query("pairwise_agreement", None)
def _(s, d):
    return M.pairwise_agreement(_annotated(s, d), ["AMD", "EK", "LR"], 6.0)


@query(
    "best_overlap_match",
    with_(VOXELS, "n AS (SELECT label AS a, other AS b, count(*) AS n FROM voxels WHERE label > 0 AND other > 0 GROUP BY 1, 2)")
    + "SELECT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS i, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS j FROM n) WHERE i = 1 AND j = 1",
)
def _(s, d):
    return M.best_overlap(voxels(s, d).select(F.col("label").alias("a"), F.col("other").alias("b")))


_ANN = "ann AS (SELECT event_type || (user_id % 7) AS crop, CASE event_id % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' WHEN 2 THEN CASE WHEN user_id % 7 < 3 THEN 'between' ELSE 'pos' END ELSE 'neg' END AS sign, value AS intensity FROM events WHERE user_id % 7 != 5 OR event_id % 4 = 1)"


def _annotations(s, d):
    e = table(s, d, "events").where("user_id % 7 != 5 or event_id % 4 = 1")
    k = F.col("event_id") % 4
    sign = F.when(k == 0, "pos").when(k == 1, "neg").when((k == 2) & (F.col("user_id") % 7 < 3), "between").when(k == 2, "pos").otherwise("neg")
    return e.select(F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("crop"), sign.alias("sign"), F.col("value").alias("intensity"))


_TH = """th AS (SELECT crop, coalesce(quantile_cont(CASE WHEN sign = 'between' THEN intensity END, 0.5), CASE WHEN max(intensity) FILTER (sign = 'neg') IS NULL AND min(intensity) FILTER (sign = 'pos') IS NOT NULL THEN 0.0
  WHEN min(intensity) FILTER (sign = 'pos') IS NULL THEN 1.5 * max(intensity) FILTER (sign = 'neg') ELSE (min(intensity) FILTER (sign = 'pos') + max(intensity) FILTER (sign = 'neg')) / 2 END) AS threshold FROM ann GROUP BY 1)"""


@query("crop_thresholds", with_(_ANN, _TH) + "SELECT crop, round_even(threshold, 6) AS threshold FROM th")
def _(s, d):
    return A.crop_thresholds(_annotations(s, d)).select("crop", F.bround("threshold", 6).alias("threshold"))


@query("annotator_thresholds", with_(_ANN, _TH) + "SELECT substr(crop, 1, 3) AS crop, round_even(avg(threshold), 6) AS threshold, count(threshold) AS success, count(*) FILTER (threshold IS NULL) AS missing FROM th GROUP BY 1")
def _(s, d):
    rows = A.crop_thresholds(_annotations(s, d)).withColumn("crop", F.substring("crop", 1, 3))
    return A.mean_threshold(rows).select("crop", F.bround("threshold", 6).alias("threshold"), "success", "missing")


_BANDS = """crops AS (SELECT dataset, round_even(avg(length_fraction), 6) AS fraction, round_even(avg(value), 6) AS threshold FROM cells GROUP BY 1),
bands AS (SELECT coalesce((fraction + lag(fraction) OVER w) / 2, 0.0::DOUBLE) AS lo, coalesce((fraction + lead(fraction) OVER w) / 2, 1.0::DOUBLE) AS hi, threshold FROM crops WINDOW w AS (ORDER BY fraction)),
lab AS (SELECT c.*, CASE WHEN value >= threshold THEN 1 WHEN value < threshold THEN 2 ELSE 0 END AS label FROM cells c LEFT JOIN bands b ON length_fraction > lo AND length_fraction < hi)"""


def _labelled(s, d):
    c = cells(s, d)
    crops = c.groupBy("dataset").agg(F.bround(F.avg("length_fraction"), 6).alias("fraction"), F.bround(F.avg("value"), 6).alias("threshold"))
    return A.band_labels(c, O.fraction_limits(crops).select("lo", "hi", "threshold"), "value")


@query("band_labels", with_(CELLS, _BANDS) + "SELECT label_id, label FROM lab")
def _(s, d):
    return _labelled(s, d).select("label_id", "label")


@query(
    "marker_counts",
    with_(CELLS, _BANDS) + "SELECT dataset, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 2) AS negative, " + ", ".join(f"CASE WHEN count(*) FILTER (label > 0) > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (label = {k}) / count(*) FILTER (label > 0), 4) ELSE 0.0 END AS {n}_percent" for k, n in ((1, "positive"), (2, "negative"))) + " FROM lab GROUP BY 1",
)
def _(s, d):
    return A.count_labels(_labelled(s, d), "dataset")


@query("subtypes", with_(CELLS) + "SELECT label_id, CASE WHEN marker = 1 AND marker_b = 2 THEN 'Type Ia' WHEN marker = 1 AND marker_b = 1 THEN 'Type Ib' WHEN marker = 2 AND marker_b = 1 THEN 'Type Ic' END AS subtype FROM cells")
def _(s, d):
    return cells(s, d).select("label_id", A.subtype({"CR": F.col("marker"), "Ntng1": F.col("marker_b")}).alias("subtype"))


@query(
    "subtype_shares",
    with_(CELLS, "t AS (SELECT dataset, CASE WHEN marker = 1 AND marker_b = 2 THEN 'Type Ia' WHEN marker = 1 AND marker_b = 1 THEN 'Type Ib' WHEN marker = 2 AND marker_b = 1 THEN 'Type Ic' END AS subtype FROM cells)")
    + "SELECT dataset, subtype, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY dataset), 9) AS share FROM t WHERE subtype IS NOT NULL GROUP BY 1, 2",
)
def _(s, d):
    t = cells(s, d).withColumn("subtype", A.subtype({"CR": F.col("marker"), "Ntng1": F.col("marker_b")}))
    return A.shares(t, ["dataset"], "subtype").withColumn("share", F.bround("share", 9))


_PCT = "pct AS (SELECT file_name AS crop, annotator, 100.0::DOUBLE * tps / (tps + fps + fns) AS percent FROM scores WHERE tps + fps + fns > 0)"


def _percents(s, d):
    n = F.col("tps") + F.col("fps") + F.col("fns")
    return scores(s, d).where(n > 0).select(F.col("file_name").alias("crop"), "annotator", (100.0 * F.col("tps") / n).alias("percent"))


@query("annotator_variance", with_(SCORES, _PCT) + "SELECT crop, round_even(avg(percent), 6) AS mean, round_even(var_pop(percent), 6) AS variance, round_even(stddev_pop(percent), 6) AS deviation, round_even(max(percent) - min(percent), 6) AS spread FROM pct GROUP BY 1")
def _(s, d):
    v = A.annotator_variance(_percents(s, d))
    return v.select("crop", *[F.bround(c, 6).alias(c) for c in ("mean", "variance", "deviation", "spread")])


@query("annotator_offset", with_(SCORES, _PCT) + "SELECT crop, annotator, round_even(percent - max(CASE WHEN annotator LIKE '1%' THEN percent END) OVER (PARTITION BY crop), 6) AS \"offset\" FROM pct")
def _(s, d):
    return A.annotator_offset(_percents(s, d), "crop", "percent", F.col("annotator").startswith("1")).select("crop", "annotator", F.bround("offset", 6).alias("offset"))


@query("annotation_pairs", "WITH f AS (SELECT user_id % 2000 AS crop, count(*) FILTER (event_type = 'click') AS p, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1) SELECT crop, CASE WHEN p > 1 OR n > 1 THEN 'ambiguous' WHEN p = 1 AND n = 1 THEN 'both' WHEN p = 1 THEN 'positive' WHEN n = 1 THEN 'negative' ELSE 'none' END AS pairing FROM f")
def _(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 2000).alias("crop"), F.when(F.col("event_type") == "click", "pos").when(F.col("event_type") == "error", "neg").alias("sign"))
    return A.find_annotations(e)


_CROPC = "cr AS (SELECT label_id AS crop, anchor_x AS center_x, anchor_y AS center_y, anchor_z AS center_z FROM objects)"
_OFF = "greatest(" + ", ".join(f"abs(o.anchor_{c} - cr.center_{c})" for c in "xyz") + ")"


@query("crop_fractions", with_(OBJECTS, _CROPC) + f"SELECT crop, round_even(coalesce(avg(length_fraction) FILTER ({_OFF} < 2), avg(length_fraction) FILTER ({_OFF} < 4), avg(length_fraction) FILTER ({_OFF} < 8)), 6) AS fraction, 2.0::DOUBLE AS halo FROM cr, objects o WHERE {_OFF} < 8 GROUP BY 1")
def _(s, d):
    return _fractions(objects(s, d), F.lit(True))


@query("crop_fractions_all", SQL["crop_fractions"])
def _(s, d):
    return _fractions(objects(s, d), F.lit(True))


def _fractions(o, is_crop):
    crops = o.where(is_crop).select(F.col("label_id").alias("crop"), *[F.col(f"anchor_{c}").alias(f"center_{c}") for c in "xyz"])
    return A.crop_fraction(o, crops, (2.0, 4.0, 8.0)).select("crop", F.bround("fraction", 6).alias("fraction"), "halo")


QUERIES, ORACLE_SQL = Q, SQL
