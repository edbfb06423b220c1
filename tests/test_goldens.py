"""Small cases with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from orbweave.functions import scalar as S
from orbweave.operators import annotate as A
from orbweave.operators import density as D
from orbweave.operators import graph as G
from orbweave.operators import matching as M
from orbweave.operators import measures as E
from orbweave.operators import spatial as P
from orbweave.operators import tables as T
from orbweave.operators import volumes as V


def test_scores(spark):
    rows = spark.createDataFrame([("a", 8, 2, 0), ("b", 0, 0, 5), ("c", 0, 0, 0), ("d", 5, 5, 5)], "annotator string, tps long, fps long, fns long")
    got = {r.annotator: (r.precision, r.recall, r.f1_score) for r in M.with_scores(rows).collect()}
    assert got == {"a": (0.8, 1.0, 0.889), "b": (None, 0.0, None), "c": (None, None, None), "d": (0.5, 0.5, 0.5)}
    macro = M.macro_scores(rows.where("annotator in ('a', 'd')")).first()
    # 0.6945 goes to the even digit
    assert tuple(macro) == (0.65, 0.75, 0.694)


def test_consensus_of_annotators(spark):
    rows = [("AMD", "c1", 8, 2, 2), ("AMD", "c2", 12, 3, 3), ("EK", "c1", 9, 1, 1), ("EK", "c2", 11, 4, 4)]
    got = {r.annotator: (r.precision, r.recall, r.f1_score) for r in M.consensus_scores(spark.createDataFrame(rows, "annotator string, file_name string, tps long, fps long, fns long")).collect()}
    assert got["AMD"] == got["all"] == (0.8, 0.8, 0.8)


def test_nearest_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 80.0), (2, 0.25, 40.0), (3, 0.5, 20.0), (4, 0.75, 10.0), (5, 1.0, 5.0)], "label_id long, length_fraction double, frequency double")
    near = lambda column, *values: {r.value: r.label_id for r in T.nearest_rows(rows, spark.createDataFrame([(v,) for v in values], "value double"), column).collect()}
    assert near("length_fraction", 0.5, 0.6) == {0.5: 3, 0.6: 3} and near("frequency", 12.0) == {12.0: 4}


def test_thresholds(spark):
    rows = [("n", "neg", v) for v in (1.0, 5.0, 20.0)] + [("p", "pos", v) for v in (1.0, 5.0)] + [("m", "pos", 9.0), ("m", "neg", 4.0), ("b", "between", 2.0), ("b", "between", 4.0), ("b", "pos", 9.0)]
    got = {r.crop: r.threshold for r in A.crop_thresholds(spark.createDataFrame(rows, "crop string, sign string, intensity double")).collect()}
    assert got == {"n": 30.0, "p": 0.0, "m": 6.5, "b": 3.0}
    names = spark.createDataFrame([("a_46.tif",), ("a_thr39.tif",), ("a_66tif.tif",), ("a_46.5.tif",), ("a_x.tif",)], "n string")
    assert [r[0] for r in names.select(S.threshold_from_name(F.col("n"))).collect()] == [46.0, 39.0, 66.0, 46.5, None]


def test_band_limits_are_open(spark):
    cells = spark.createDataFrame([(1, 0.0, 9.0), (2, 0.2, 9.0), (3, 0.4, 9.0), (4, 0.7, 1.0), (5, 1.0, 9.0), (6, 0.3, float("nan")), (7, 0.3, None)], "label_id long, length_fraction double, v double")
    bands = spark.createDataFrame([(0.0, 0.4, 5.0), (0.4, 1.0, 5.0)], "lo double, hi double, threshold double")
    assert {r.label_id: r.label for r in A.band_labels(cells, bands, "v").collect()} == {1: 0, 2: 1, 3: 0, 4: 2, 5: 0, 6: 0, 7: 0}


def test_radius_rules(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 3.0, 0.0, 0.0), (3, 50.0, 0.0, 0.0), (4, -3.0, 0.0, 0.0)], "label_id long, anchor_x double, anchor_y double, anchor_z double")
    assert {r.label_id: r.neighbors for r in P.neighbors_in_radius(pts, 3.0).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert {r.label_id: r.ripley for r in P.local_ripleys_k(pts, 3.0, 4.0).collect()} == {1: 2.0, 2: 1.0, 3: 0.0, 4: 1.0}
    assert {r.label_id: round(r.distance_nn2, 6) for r in P.nearest_neighbors(pts, 2, 1.0).collect()} == {1: 3.0, 2: 4.5, 3: 48.5, 4: 4.5}
    assert P.nearest_neighbors(pts.limit(1), 2, 1.0).count() == 0


def test_components_rank_by_size_then_id(spark):
    xs = [0, 1, 2, 10, 11, 20, 21, 40]
    pts = spark.createDataFrame([(k + 1, float(x), 0.0, 0.0, 100) for k, x in enumerate(xs)], "label_id long, anchor_x double, anchor_y double, anchor_z double, n_pixels long")
    assert {r.label_id: r.component_labels for r in G.label_components(pts, 1, 1.0, 2).collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 0}


def test_a_brighter_background_shifts_measures(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in range(250)] + [(1, None), (0, 5.0), (None, 7.0)], "label long, value double")
    a, b = E.object_measures(rows).first(), E.object_measures(rows.withColumn("value", F.col("value") + 100)).first()
    assert a.n == 250 and a.stdev == pytest.approx(b.stdev) and all(b[c] == pytest.approx(a[c] + 100) for c in ("median", "mean", "min", "max", "percentile_5", "percentile_95"))
    shifted = V.normalised(E.object_measures(rows), spark.createDataFrame([(1, 10.0)], "label_id long, background double"), ["median", "stdev"]).first()
    assert shifted.median == a.median - 10 and shifted.stdev == a.stdev


def test_overlap_of_positions(spark):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    rows = [("a", [1, 2, 3, 4], square, 0.0, 10.0), ("b", [3, 4, 5, 6], [[x + 0.5, y + 0.5] for x, y in square], 5.0, 15.0), ("c", [9], None, 40.0, 50.0)]
    got = {(r.a, r.b): r for r in D.position_overlap(spark.createDataFrame(rows, "position string, label_ids array<long>, hull array<array<double>>, slice_min double, slice_max double")).collect()}
    r = got["a", "b"]
    assert (r.n_shared, r.jaccard, r.shared_fraction, r.slice_overlap) == (2, pytest.approx(1 / 3), 0.5, 5.0) and r.hull_iou == pytest.approx(1 / 7)
    assert got["a", "c"].hull_iou is None and got["a", "c"].n_shared == 0 and got["a", "c"].slice_overlap == 0


def test_best_matching_beats_the_greedy_one(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0)], "label_id long, anchor_x double, anchor_y double, anchor_z double")
    b = spark.createDataFrame([(1, 1.1, 0.0, 0.0), (2, 5.0, 0.0, 0.0), (3, 90.0, 0.0, 0.0)], "label_id long, anchor_x double, anchor_y double, anchor_z double")
    assert {(r.a, r.b) for r in M.match_detections(a, b, 3.0).collect()} == {(1, 1), (2, 2)}


def test_names(spark):
    row = spark.createDataFrame([("MLR226L", "x_t002_V0_R0003_I1_D0_C2_.tif", "12-7-x")], "a string, b string, c string").select(S.standard_name(F.col("a")).alias("a"), *[c.alias(n) for n, c in S.capture_parts(F.col("b")).items()], S.coordinates(F.col("c")).alias("c")).first()
    assert row.a == "M_LR_000226_L" and (row.timepoint, row.channel, row.tile, row.illumination, row.detection, row.setup) == (2, 2, 3, 1, 0, "c2-t3-i1-d0") and row.c == [12, 7, None]
    with pytest.raises(ValueError):
        S.greenwood(F.lit(0.5), "cat")


def test_cubes(spark):
    cube = [(z, y, x, 1) for z in range(2, 5) for y in range(3) for x in range(3)]
    v = spark.createDataFrame(cube, "z long, y long, x long, label long")
    row = V.object_table(v, (0.5, 1.0, 1.0)).first()
    assert (row.n_pixels, row.anchor_z, row.bb_min_z, row.bb_max_z, row.bb_max_x) == (27, 1.5, 1.0, 2.5, 3.0)
    assert tuple(V.surface_faces(v).select("volume", "surface").first()) == (27, 54)
    assert V.dilated(v).count() == 125 and V.eroded(v).count() == 1 and V.closed(v).count() == 27
