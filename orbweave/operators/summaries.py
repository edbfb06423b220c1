"""Measures of crops and matches, crop blocks of density results, scores of path junctions, guided dilation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.scalar import threshold_from_name
from orbweave.operators.ranges import checkpointed

XYZ, ZYX = ("x", "y", "z"), ("z", "y", "x")


def crop_measures(voxels: DataFrame, crop: str, least: int = 1000) -> DataFrame:
    """crop, n_samples, mean_vol, min_vol, max_vol (of objects of at least so many voxels, else 0), n_large, n_small.

    Two aggregates: voxels by object, objects by crop. A crop with background only has no samples.
    """
    sizes = voxels.groupBy(crop, "label").agg(F.count("*").alias("n"))
    kept = F.when((F.col("label") != 0) & (F.col("n") >= least), F.col("n"))
    large = F.count(kept)
    return sizes.groupBy(crop).agg(
        F.count_if(F.col("label") != 0).alias("n_samples"), F.coalesce(F.bround(F.avg(kept), 1), F.lit(0.0)).alias("mean_vol"), F.coalesce(F.min(kept), F.lit(0)).alias("min_vol"),
        F.coalesce(F.max(kept), F.lit(0)).alias("max_vol"), large.alias("n_large"), (F.count_if(F.col("label") != 0) - large).alias("n_small"),
    )


def is_measured(n_samples: Column, n_large: Column, n_small: Column) -> Column:
    """Whether a row of crop measures is complete and adds up, so that it need not be measured again."""
    return F.coalesce(n_samples == n_large + n_small, F.lit(False))


def block_entries(results: DataFrame, voxel: tuple[float, float, float] = (0.38, 0.38, 0.38), halo: tuple[int, int, int] | None = None, stored: str | None = None) -> DataFrame:
    """position, center_x..z (whole numbers), halo_x..z for each density result that has a center.

    results: position, center_x..z, bb_min_x..z, bb_max_x..z, axis, slice_thickness. The halo is the argument, else the
    array column stored, else half the thickness along the axis and half the box across it, in voxels, 1 at least;
    a result without a box takes 128, 128, 64.
    """
    default = dict(zip(XYZ, (128, 128, 64), strict=True))
    boxless = F.lit(False)
    for c in XYZ:
        boxless = boxless | F.col(f"bb_min_{c}").isNull() | F.col(f"bb_max_{c}").isNull()
    out = []
    for k, (c, size) in enumerate(zip(XYZ, voxel, strict=True)):
        extent = F.when((F.col("axis") == c) & F.col("slice_thickness").isNotNull(), F.col("slice_thickness")).otherwise(F.col(f"bb_max_{c}") - F.col(f"bb_min_{c}"))
        auto = F.when(boxless, F.lit(default[c])).otherwise(F.greatest(F.lit(1), F.ceil(extent / 2 / size)))
        given = F.lit(None) if halo is None else F.lit(halo[k])
        out.append(F.coalesce(given, F.get(stored, F.lit(k)) if stored else F.lit(None), auto).cast("long").alias(f"halo_{c}"))
    centers = [F.rint(f"center_{c}").cast("long").alias(f"center_{c}") for c in XYZ]
    return results.dropna(subset=[f"center_{c}" for c in XYZ]).select("position", *centers, *out)


def with_name_threshold(crops: DataFrame, value: str, *names: str) -> DataFrame:
    """value, where it is null the mean of the thresholds in the file names (null names count as none), and its source."""
    found = F.array_compact(F.array(*[threshold_from_name(F.col(n)) for n in names]))
    mean = F.try_divide(F.aggregate(found, F.lit(0.0), lambda a, b: a + b), F.size(found))
    source = F.when(F.col(value).isNotNull(), "annotations").when(mean.isNotNull(), "filename")
    return crops.withColumns({value: F.coalesce(F.col(value), mean), f"{value}_source": source})


def match_voxels(points: DataFrame, size: float) -> DataFrame:
    """z, y, x, class of matched (1), false (2) and missed (3) points; where several share a voxel, the largest class."""
    place = [F.rint(F.col(c) / size).cast("long").alias(c) for c in ZYX]
    return points.select(*place, "class").groupBy(*ZYX).agg(F.max("class").alias("class"))


def pooled_scores(matches: DataFrame) -> DataFrame:
    """tp, fp, fn over all crops with precision, recall and f1 of the sums, to three places; null where nothing is there."""
    t = matches.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select("tp", "fp", "fn", F.bround(p, 3).alias("precision"), F.bround(r, 3).alias("recall"), F.bround(F.try_divide(2 * p * r, p + r), 3).alias("f1"))


def consensus_points_only(points: DataFrame, annotator: str = "annotator") -> DataFrame:
    """Rows of the consensus, without the unmatched ones of single annotators that stand beside them."""
    return points.where(F.col(annotator) == "consensus")


def next_round(consensus: DataFrame, previous: DataFrame) -> DataFrame:
    """Consensus of a round and all rows of the previous one; equal rows stay."""
    return consensus.unionByName(previous)


def outer_ends(nodes: DataFrame, path: str, lookback: float = 50.0) -> DataFrame:
    """path, side, x, y, z (the end), tangent_x..z for both ends of each path of nodes (node_idx, x, y, z).

    The tangent of side 'end' runs from the node a lookback along the path to the first node, and that of side 'start' is the same on
    the reversed path: the sides' names follow the scores that the engine has to match. A path of one node has a tangent of zeros.
    """
    forward, back = Window.partitionBy(path).orderBy("node_idx"), Window.partitionBy(path).orderBy(F.desc("node_idx"))
    so_far = lambda w: F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    sides = []
    for side, w in (("end", forward), ("start", back)):
        gap = [F.col(c) - F.lag(c).over(w) for c in XYZ]
        n = nodes.withColumn("step", F.coalesce(F.sqrt(sum((g * g for g in gap), F.lit(0.0))), F.lit(0.0))).withColumns({"k": F.row_number().over(w) - 1, "arc": so_far(w)})
        at = F.struct("k", *XYZ)
        reached = F.min(F.when((F.col("k") > 0) & (F.col("arc") >= lookback), at))
        ends = n.groupBy(path).agg(F.min(at).alias("a"), F.coalesce(reached, F.max(at)).alias("b"), F.max(at).alias("last"))
        v = {c: F.col(f"a.{c}") - F.col(f"b.{c}") for c in XYZ}
        norm = F.sqrt(sum((x * x for x in v.values()), F.lit(0.0)))
        # what is the first node here is the last one of the other side
        sides.append(ends.select(path, F.lit(side).alias("side"), *[F.col(f"last.{c}").alias(c) for c in XYZ], *[F.coalesce(F.try_divide(x, norm), F.lit(0.0)).alias(f"tangent_{c}") for c, x in v.items()]))
    return sides[0].unionByName(sides[1])


def junction_scores(ends: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """a, b, a_side, b_side, distance, flow, score for the pairs (a, b) of paths: how well a gap from one end to another goes straight on.

    flow is the sum of both tangents along the gap (0 without a gap); score is flow times the least distance of the pair over this one.
    """
    side = lambda p: ends.select(F.col(path).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ends.columns if c != path])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    gap = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in XYZ}
    along = sum(((F.col(f"a_tangent_{c}") - F.col(f"b_tangent_{c}")) * g for c, g in gap.items()), F.lit(0.0))
    scored = joined.withColumn("distance", F.sqrt(sum((g * g for g in gap.values()), F.lit(0.0))))
    scored = scored.withColumn("flow", F.coalesce(F.try_divide(along, F.col("distance")), F.lit(0.0))).withColumn("least", F.min("distance").over(Window.partitionBy("a", "b")))
    return scored.select("a", "b", "a_side", "b_side", "distance", "flow", F.coalesce(F.col("flow") * F.try_divide("least", "distance"), F.col("flow")).alias("score"))


def sizes_below(volumes: DataFrame, by: str, volume: str, limit: float) -> DataFrame:
    """by, n, q0 ... q4 (least, quartiles, largest) of the volumes that are there and below the limit."""
    kept = volumes.where(F.col(volume).isNotNull() & ~F.isnan(volume) & (F.col(volume) < limit))
    quartile = F.percentile(volume, F.array(*[F.lit(k / 4) for k in range(5)]))
    g = kept.groupBy(by).agg(F.count("*").alias("n"), quartile.alias("q"))
    return g.select(by, "n", *[F.get("q", F.lit(k)).alias(f"q{k}") for k in range(5)])


def dilated_downhill(voxels: DataFrame, shape: tuple[int, int, int], rounds: int = 15, offset: float = 0.4) -> DataFrame:
    """z, y, x, inside: the set (voxels z, y, x, inside, edt) grown along faces, towards smaller edt only.

    A voxel comes in if a face neighbour inside has an edt larger than its own by more than the offset, seen from the nearest
    of those neighbours; at the borders the opposite face counts as a neighbour for the edt, but does not grow. A round is
    one shuffle: each voxel inside sends its edt to its neighbours. It ends when a round adds nothing.
    """
    state = checkpointed(voxels.select(*ZYX, F.col("inside").cast("boolean").alias("inside"), F.col("edt").cast("double").alias("edt")))
    extent = dict(zip(ZYX, shape, strict=True))
    moves = F.array(*[F.struct(*[F.lit(s if c == axis else 0).alias(c) for c in ZYX]) for axis in ZYX for s in (-1, 1)])
    count = state.where("inside").count()
    for _ in range(rounds):
        sent = state.where("inside").select(*ZYX, "edt", F.explode(moves).alias("m"))
        moved = {c: F.col(c) + F.col(f"m.{c}") for c in ZYX}
        within = F.lit(True)
        for c in ZYX:
            within = within & moved[c].between(0, extent[c] - 1)
        sent = sent.select(*[F.pmod(moved[c], F.lit(extent[c])).alias(c) for c in ZYX], F.col("edt").alias("source"), within.alias("grows"))
        met = state.select(*ZYX, "inside", "edt", F.lit(None).cast("double").alias("source"), F.lit(False).alias("grows")).unionByName(sent, allowMissingColumns=True)
        g = met.groupBy(*ZYX).agg(F.max("inside").alias("inside"), F.max("edt").alias("edt"), F.min("source").alias("least"), F.max("grows").alias("grows")).where("inside is not null")
        comes = F.col("grows") & (F.col("edt") < F.col("least") - offset)
        state = checkpointed(g.select(*ZYX, F.coalesce(F.col("inside") | comes, F.col("inside")).alias("inside"), "edt"))
        before, count = count, state.where("inside").count()
        if count == before:
            break
    return state.select(*ZYX, "inside")
