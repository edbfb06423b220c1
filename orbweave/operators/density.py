"""Density of objects in a slice across a curved structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.geometry import hull_corners, hull_iou, shoelace
from orbweave.operators.graph import radius_components


def reference_rows(objects: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """position, fraction, label_id, anchor_z: the object nearest to each position's fraction (the smaller id first).

    One aggregate for each of the few positions, in one scan.
    """
    near = [F.min(F.struct(F.abs(F.col("length_fraction") - f).alias("gap"), "label_id", F.col("anchor_z").alias("at"))).alias(f"p{k}") for k, f in enumerate(fractions.values())]
    one = objects.agg(*near)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("position"), F.lit(float(f)).alias("fraction"), F.col(f"p{k}.label_id").alias("label_id"), F.col(f"p{k}.at").alias("at")) for k, (n, f) in enumerate(fractions.items())])).alias("x")).select("x.*")


def slices(objects: DataFrame, fractions: dict[str, float], thickness: float, tolerance: float | None = None) -> DataFrame:
    """Objects that meet the slice of each position, with position, slice_min and slice_max.

    The positions travel as one array; an object becomes one row for each slice that it meets.
    """
    refs = reference_rows(objects, fractions).agg(F.collect_list(F.struct("position", "fraction", (F.col("at") - thickness / 2).alias("slice_min"), (F.col("at") + thickness / 2).alias("slice_max")))).scalar()
    rows = objects.withColumn("_r", refs)
    test = lambda r: (F.col("bb_min_z") <= r["slice_max"]) & (F.col("bb_max_z") >= r["slice_min"]) & (F.lit(True) if tolerance is None else F.abs(F.col("length_fraction") - r["fraction"]) <= tolerance)
    return rows.withColumn("_r", F.explode(F.filter("_r", test))).select("_r.*", *objects.columns)


def largest_cluster(part: DataFrame, distance: float, least: int, reference: float) -> DataFrame:
    """The single-linkage cluster of at least so many objects whose median fraction is nearest the reference, else the largest."""
    named = part.drop("component_labels").join(radius_components(part, distance), "label_id")
    stats = named.groupBy("component_labels").agg(F.count("*").alias("n"), F.percentile("length_fraction", F.lit(0.5)).alias("m"))
    best = stats.agg(F.min(F.struct((F.col("n") < least).alias("small"), F.when(F.col("n") >= least, F.abs(F.col("m") - reference)).otherwise(-F.col("n").cast("double")).alias("far"), "component_labels")).alias("b")).select("b.component_labels")
    return named.join(best, "component_labels", "left_semi")


def profile(objects: DataFrame, fractions: dict[str, float], thickness: float, tolerance: float | None = None) -> DataFrame:
    """position, n, slice_min, slice_max, area, density, label_ids, hull for each position.

    area: that of the hull of the places across the slice (x, y), else of their boxes' extent. A slice is gathered
    into one array, as its hull needs all of it; slices are thin.
    """
    g = slices(objects, fractions, thickness, tolerance).groupBy("position", "fraction", "slice_min", "slice_max").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("label_id")).alias("label_ids"), F.collect_list(F.array("anchor_x", "anchor_y")).alias("_p"),
        ((F.max("bb_max_x") - F.min("bb_min_x")) * (F.max("bb_max_y") - F.min("bb_min_y"))).alias("_box"),
    )
    g = g.withColumn("hull", hull_corners("_p")).withColumn("area", F.coalesce(F.nullif(shoelace(F.col("hull")), F.lit(0.0)), F.col("_box")))
    return g.withColumn("hull", F.when(F.size("hull") >= 3, F.col("hull"))).withColumn("density", F.try_divide("n", "area")).drop("_p", "_box")


def position_overlap(densities: DataFrame) -> DataFrame:
    """Each pair of positions: n_shared, jaccard, shared_fraction, hull_iou, slice_overlap. A row for each of few positions."""
    pick = lambda p: densities.select(*[F.col(c).alias(f"{p}_{c}") for c in ("position", "label_ids", "hull", "slice_min", "slice_max")])
    pairs = pick("a").join(pick("b"), F.col("a_position") < F.col("b_position"))
    both, either = F.size(F.array_intersect("a_label_ids", "b_label_ids")), F.size(F.array_union("a_label_ids", "b_label_ids"))
    least: Column = F.least(F.size("a_label_ids"), F.size("b_label_ids"))
    return pairs.select(
        F.col("a_position").alias("a"), F.col("b_position").alias("b"), both.alias("n_shared"), F.try_divide(both, either).alias("jaccard"), F.try_divide(both, least).alias("shared_fraction"),
        hull_iou("a_hull", "b_hull").alias("hull_iou"), F.greatest(F.lit(0.0), F.least("a_slice_max", "b_slice_max") - F.greatest("a_slice_min", "b_slice_min")).alias("slice_overlap"),
    )


def roi_halo(table: DataFrame, size: float, default: tuple[int, int, int] = (128, 128, 64)) -> DataFrame:
    """Half extents of each position's objects in voxels, rounded up, 1 at least; the default where there are none."""
    half = lambda c: F.ceil((F.max(f"bb_max_{c}") - F.min(f"bb_min_{c}")) / 2 / size)
    return table.groupBy("position").agg(*[F.coalesce(F.greatest(F.lit(1), half(c)), F.lit(d)).cast("long").alias(f"halo_{c}") for c, d in zip("xyz", default, strict=True)])
