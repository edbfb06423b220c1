"""Tables that the drivers of an analysis put together: counts of cohorts, splits, variance records, curves, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZYX = ("z", "y", "x")


def component_overview(objects: DataFrame, by: str) -> DataFrame:
    """by, n_objects (in a component), n_components, largest (objects of the largest component); null components count as none."""
    sizes = objects.where("component_labels != 0").groupBy(by, "component_labels").agg(F.count("*").alias("n"))
    return sizes.groupBy(by).agg(F.sum("n").alias("n_objects"), F.count("*").alias("n_components"), F.max("n").alias("largest"))


def registered(objects: DataFrame, registry: DataFrame, by: str) -> DataFrame:
    """Objects of the components that a registry (by, alias, component_labels: array) lists for their data set, with the alias.

    A data set without an entry raises: a component list is never a default. The missing ones are found by an anti
    join and at most one of them is read.
    """
    missing = objects.select(by).distinct().join(registry.select(by), by, "left_anti").limit(1).collect()
    if missing:
        raise KeyError(f"no components registered for {missing[0][0]}")
    listed = registry.select(by, "alias", F.explode("component_labels").alias("component_labels"))
    return objects.join(listed, [by, "component_labels"])


def split_counts(crops: DataFrame, species: str = "species", split: str = "split", count: str = "n_samples") -> DataFrame:
    """species (null for all), n_crops, n_crops_train, n_crops_val, n_instances, n_instances_train, n_instances_val, n_crops_test, n_instances_test.

    One aggregate over grouping sets. The totals leave the test split out, whose columns are null where it is empty.
    A table with a crop without a count has no rows, as its totals would be too small.
    """
    of = lambda s: F.col(split) == s
    crop = lambda s: F.count_if(of(s))
    inst = lambda s: F.coalesce(F.sum(F.when(of(s), F.col(count))), F.lit(0)).cast("long")
    whole = crops.groupingSets([[species], []], species).agg(
        (crop("train") + crop("val")).alias("n_crops"), crop("train").alias("n_crops_train"), crop("val").alias("n_crops_val"),
        (inst("train") + inst("val")).alias("n_instances"), inst("train").alias("n_instances_train"), inst("val").alias("n_instances_val"),
        F.nullif(crop("test"), F.lit(0)).alias("n_crops_test"), F.when(crop("test") > 0, inst("test")).alias("n_instances_test"),
    )
    unmeasured = crops.agg(F.count_if(F.col(count).isNull())).scalar()
    return whole.where(unmeasured == 0)


def positive_count_statistics(counts: DataFrame, by: str, count: str) -> DataFrame:
    """by, n_cells, total, mean, stdev (population) over cells with a count of 1 or more."""
    return counts.where(F.col(count) >= 1).groupBy(by).agg(F.count("*").alias("n_cells"), F.sum(count).alias("total"), F.avg(count).alias("mean"), F.stddev_pop(count).alias("stdev"))


def variance_records(summary: DataFrame, least: int = 5) -> DataFrame:
    """From (dataset, n_crops, scenarios: map of scenario to map of class to value): dataset, scenario, class, value, with enough crops."""
    kept = summary.where(F.col("n_crops") >= least)
    return kept.select("dataset", F.explode("scenarios").alias("scenario", "classes")).select("dataset", "scenario", F.explode("classes").alias("class", "value"))


def counted_cells(objects: DataFrame, counts: DataFrame, components: list[int], count: str) -> DataFrame:
    """Objects of the components with a count by id, 0 where there is none."""
    return objects.where(F.col("component_labels").isin(*components)).join(counts.select("label_id", count), "label_id", "left").fillna(0, [count])


def marked_cells(cells: DataFrame, markers: list[str], types: dict[tuple[int, ...], str]) -> DataFrame:
    """Cells that all markers call positive (1) or negative (2), with the type of their combination; 'unknown' for others."""
    known = F.lit(True)
    for m in markers:
        known = known & F.col(m).isin(1, 2)
    name = F.lit("unknown")
    for key, value in types.items():
        test = F.lit(True)
        for m, k in zip(markers, key, strict=True):
            test = test & (F.col(m) == k)
        name = F.when(test, value).otherwise(name)
    return cells.where(known).withColumn("type", name)


def without_undefined(voxels: DataFrame, confidence: DataFrame) -> DataFrame:
    """z, y, x, label, which is 0 where the confidence is 1."""
    undefined = confidence.where("confidence = 1").select(*ZYX).distinct().withColumn("_undefined", F.lit(True))
    return voxels.join(undefined, list(ZYX), "left").select(*ZYX, F.when(F.col("_undefined"), 0).otherwise(F.col("label")).alias("label"))


def stamped(spots: DataFrame, radius: int, shape: tuple[int, int, int]) -> DataFrame:
    """z, y, x, label of the balls of voxels around spots (spot_id, z, y, x) inside the volume; the larger id wins."""
    reach = range(-radius, radius + 1)
    ball = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in reach for b in reach for c in reach if a * a + b * b + c * c <= radius * radius])
    moved = spots.select("spot_id", *ZYX, F.explode(ball).alias("s")).select("spot_id", *[(F.col(c) + F.col(f"s.{k}")).alias(c) for c, k in zip(ZYX, "abc", strict=True)])
    inside = F.lit(True)
    for c, n in zip(ZYX, shape, strict=True):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < n)
    return moved.where(inside).groupBy(*ZYX).agg(F.max("spot_id").alias("label"))


def inside_ball(center: tuple[int, int, int], radius: float) -> Column:
    """Whether a voxel (z, y, x) is within the radius of a center, borders included."""
    return sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(ZYX, center, strict=True)), F.lit(0)) <= radius * radius


def voxel_boxes(objects: DataFrame, voxel: tuple[float, float, float], shape: tuple[int, int, int], dilation: int | None = None) -> DataFrame:
    """label_id, low_z ... high_x and center_z ... center_x: the box in voxels, wider by dilation + 1 (2 without one) and inside the volume.

    voxel is (x, y, z), shape is (z, y, x). Borders round half-even in single precision; the center is cut.
    """
    more = dilation + 1 if dilation else 2
    size, extent = dict(zip("xyz", voxel, strict=True)), dict(zip(ZYX, shape, strict=True))
    whole = lambda n, c: F.rint((F.col(f"bb_{n}_{c}") / size[c]).cast("float")).cast("int")
    low = [F.greatest(whole("min", c) - more, F.lit(0)).alias(f"low_{c}") for c in ZYX]
    high = [F.least(whole("max", c) + more, F.lit(extent[c])).alias(f"high_{c}") for c in ZYX]
    return objects.select("label_id", *low, *high, *[(F.col(f"anchor_{c}") / size[c]).cast("int").alias(f"center_{c}") for c in ZYX])


def crop_regions(crops: DataFrame, voxel: tuple[float, float, float], shape: tuple[int, int, int]) -> DataFrame:
    """start_z ... stop_x of the crops (crop, center_x, center_y, center_z, size_z, size_y, size_x): where a crop of that size was cut.

    A crop that does not fit the volume has nulls.
    """
    size, extent = dict(zip("xyz", voxel, strict=True)), dict(zip(ZYX, shape, strict=True))
    fits = F.lit(True)
    for c in ZYX:
        fits = fits & (F.col(f"size_{c}") <= extent[c])
    start = {c: F.least(F.greatest(F.rint(F.col(f"center_{c}") / size[c]).cast("int") - F.floor(F.col(f"size_{c}") / 2), F.lit(0)), extent[c] - F.col(f"size_{c}")) for c in ZYX}
    return crops.select("crop", *[F.when(fits, start[c]).cast("long").alias(f"start_{c}") for c in ZYX], *[F.when(fits, start[c] + F.col(f"size_{c}")).cast("long").alias(f"stop_{c}") for c in ZYX])


def average_curve(points: DataFrame, weights: DataFrame, nbins: int = 512) -> DataFrame:
    """bin, x, density: the weighted mean of curves (curve, x, density) on a common grid, as a density (trapezoids add up to 1).

    Each curve is linear between its points and 0 outside of them and where it is below 0; curves without a weight are
    left out. A segment between two points deals its values to the grid places that it covers.
    """
    ends = points.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    step = (ends.agg(F.max((F.col("high") - F.col("low")) / (nbins - 1)))).scalar()
    low = ends.agg(F.max("low")).scalar()
    order = Window.partitionBy("curve").orderBy("x")
    segments = points.select("curve", F.col("x").alias("x0"), F.col("density").alias("y0"), F.lead("x").over(order).alias("x1"), F.lead("density").over(order).alias("y1"), F.row_number().over(order).alias("k"))
    segments = segments.where("x1 is not null").withColumns({"low": low, "step": step})
    # a place on two segments belongs to the left one
    first = F.when(F.col("k") == 1, F.ceil((F.col("x0") - F.col("low")) / F.col("step") - 1e-9)).otherwise(F.floor((F.col("x0") - F.col("low")) / F.col("step") + 1e-9) + 1)
    last = F.least(F.floor((F.col("x1") - F.col("low")) / F.col("step") + 1e-9), F.lit(nbins - 1))
    at = F.col("low") + F.col("bin") * F.col("step")
    value = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.col("y1"))
    dealt = segments.where(first <= last).withColumn("bin", F.explode(F.sequence(first.cast("long"), last.cast("long")))).select("curve", "bin", at.alias("x"), F.greatest(value, F.lit(0.0)).alias("density"))
    total = weights.agg(F.sum("weight")).scalar()
    mean = dealt.join(weights, "curve").groupBy("bin").agg(F.first("x").alias("x"), (F.sum(F.col("weight") * F.col("density"))).alias("density"))
    grid = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nbins - 1).cast("long"))).alias("bin"), "low", "high")
    full = grid.join(mean, "bin", "left").select("bin", (F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / (nbins - 1)).alias("x"), (F.coalesce("density", F.lit(0.0)) / total).alias("density"), (F.when(F.col("bin").isin(0, nbins - 1), 0.5).otherwise(1.0) * (F.col("high") - F.col("low")) / (nbins - 1)).alias("width"))
    area = full.agg(F.sum(F.col("density") * F.col("width"))).scalar()
    return full.withColumn("_area", area).select("bin", "x", F.when(F.col("_area") > 0, F.col("density") / F.col("_area")).otherwise(F.col("density")).alias("density"))


def zipped(a: DataFrame, b: DataFrame, key: str = "label_id") -> DataFrame:
    """Inner join by key of two tables that must have the same keys, each once; a table that differs fails the job."""
    one, two = a.groupBy(key).agg(F.count("*").alias("n_a")), b.groupBy(key).agg(F.count("*").alias("n_b"))
    odd = one.join(two, key, "full").agg(F.count_if((F.coalesce("n_a", F.lit(0)) != 1) | (F.coalesce("n_b", F.lit(0)) != 1)).alias("odd")).scalar()
    checked = F.when(odd == 0, True).otherwise(F.raise_error(F.lit("the tables have different keys")).cast("boolean"))
    return a.join(b, key).where(checked)


def looked_up(ids: DataFrame, table: DataFrame, column: str, key: str = "label_id") -> DataFrame:
    """key, column and found for each id: false where the table has no such row."""
    return ids.select(key).distinct().join(table.select(key, column, F.lit(True).alias("found")), key, "left").fillna(False, ["found"])


def annotation_parts(name: Column) -> dict[str, Column]:
    """Data set and slice number out of a file name 'dataset_x_z123_...'."""
    from orbweave.functions.scalar import standard_name

    parts = F.split(F.element_at(F.split(name, "/"), -1), "_")
    return {"dataset": standard_name(F.get(parts, F.lit(0))), "slice_id": F.substring(F.get(parts, F.lit(2)), 2, 20).try_cast("int")}


def table_kind(name: Column) -> Column:
    """Kind of a measurement table by its file name: with a background mask, or plain; others are null."""
    return F.when(name.rlike(r"object-measures_bg-mask\.tsv$"), "bg-mask").when(name.rlike(r"object-measures\.tsv$"), "plain")
