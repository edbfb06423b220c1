"""Operators over several data sets: regions, sides, curves, crops, and the remaining volume filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.graph import components
from orbweave.operators.ranges import written
from orbweave.operators.spatial import XYZ, _placed, distance, first_radius, radius_join

ZYX = ("z", "y", "x")


def inside_slab(voxels: DataFrame, objects: DataFrame, low: int, high: int, least_share: float | None = None, least_count: int | None = None) -> DataFrame:
    """Objects with at least the share of their pixels, or the number of voxels, in the slab z in [low, high)."""
    if (least_share is None) == (least_count is None):
        raise ValueError("give either least_share or least_count")
    inside = voxels.where((F.col("z") >= low) & (F.col("z") < high) & (F.col("label") != 0)).groupBy(F.col("label").alias("label_id")).agg(F.count("*").alias("inside"))
    joined = objects.join(inside, "label_id")
    return joined.where(F.col("inside") / F.col("n_pixels") >= least_share if least_share is not None else F.col("inside") >= least_count)


def boundary(voxels: DataFrame) -> DataFrame:
    """Voxels of objects with a neighbour (of six) of another label."""
    near = voxels.where("label != 0").select("label", *ZYX)
    steps = [F.struct(*[F.lit(s if c == k else 0).alias(f"s{c}") for c in ZYX]) for k in ZYX for s in (-1, 1)]
    moved = near.withColumn("_s", F.explode(F.array(*steps))).select("label", *[(F.col(c) + F.col(f"_s.s{c}")).alias(c) for c in ZYX])
    full = moved.groupBy("label", *ZYX).agg(F.count("*").alias("n")).where("n = 6")
    return near.join(full, ["label", *ZYX], "left_anti")


def nearest_surface(spots: DataFrame, voxels: DataFrame, farthest: float) -> DataFrame:
    """spot_id, matched, distance: the object whose nearest boundary voxel is closest, within the distance (0 inside an object)."""
    edge = boundary(voxels).withColumn("voxel", F.struct("label", *ZYX))
    pairs = radius_join(spots, edge, farthest, "spot_id", "voxel", ZYX).select(F.col("a").alias("spot_id"), "distance", F.col("b.label").alias("label"))
    inside = spots.join(voxels.where("label != 0"), list(ZYX)).select("spot_id", F.lit(0.0).alias("distance"), "label")
    best = pairs.unionByName(inside).groupBy("spot_id").agg(F.min(F.struct("distance", "label")).alias("m"))
    return best.select("spot_id", F.col("m.label").alias("matched"), F.col("m.distance").alias("distance"))


def closest_pairs(objects: DataFrame, radius: float) -> DataFrame:
    """For each two components with objects within the radius: the closest pair of objects (the smaller ids among equals).

    The search begins at a radius at which cells hold few objects, and doubles it for the pairs of components that have none yet: only
    cells of such two components that are neighbours meet. A component's objects at one place are searched for once.
    """
    spots = written(objects.where(_placed(objects, XYZ) & F.col("component_labels").isNotNull()).groupBy("component_labels", *XYZ).agg(F.min("label_id").alias("label_id")))
    number = spots.select("component_labels").distinct().count()
    reach, found = first_radius(spots, radius, 2.0), None
    while True:
        cells = spots.withColumns({f"g{k}": F.floor(F.col(c) / reach) for k, c in enumerate(XYZ)})
        one = written(cells.select(F.col("component_labels").alias("c2"), "g0", "g1", "g2").distinct())
        around = one.withColumnRenamed("c2", "c1").select("c1", *[F.col(f"g{k}").alias(f"h{k}") for k in range(3)], *[F.col(f"g{k}") for k in range(3)])
        for k in range(3):
            around = around.withColumn(f"g{k}", F.explode(F.array(*[F.col(f"g{k}") + s for s in (-1, 0, 1)])))
        work = around.join(one, ["g0", "g1", "g2"]).where("c1 < c2")
        if found is not None:
            work = work.join(found.select("c1", "c2"), ["c1", "c2"], "left_anti")
        a = cells.select(F.col("component_labels").alias("c1"), F.col("label_id").alias("a"), *[F.col(c).alias(f"a{k}") for k, c in enumerate(XYZ)], *[F.col(f"g{k}").alias(f"h{k}") for k in range(3)])
        b = cells.select(F.col("component_labels").alias("c2"), F.col("label_id").alias("b"), *[F.col(c).alias(f"b{k}") for k, c in enumerate(XYZ)], "g0", "g1", "g2")
        gap = distance([F.col(f"a{k}") for k in range(3)], [F.col(f"b{k}") for k in range(3)])
        pairs = work.join(a, ["c1", "h0", "h1", "h2"]).join(b, ["c2", "g0", "g1", "g2"]).withColumn("distance", gap).where(F.col("distance") <= reach)
        best = written(pairs.groupBy("c1", "c2").agg(F.min(F.struct("distance", "a", "b")).alias("m")).select("c1", "c2", "m.a", "m.b", "m.distance"))
        found = best if found is None else written(found.unionByName(best))
        if reach >= radius or found.count() == number * (number - 1) // 2:
            return found
        reach *= 2


def paired_files(files: DataFrame, left: str, right: str) -> DataFrame:
    """stem, left, right: files of two endings with the same stem."""
    stem = lambda end: files.where(F.col("name").endswith(end)).select(F.expr(f"left(name, length(name) - {len(end)})").alias("stem"), F.col("name"))
    return stem(left).withColumnRenamed("name", "left_name").join(stem(right).withColumnRenamed("name", "right_name"), "stem")


def region_means(table: DataFrame, regions: dict[str, tuple[float, float]], value: str, fraction: str = "length_fraction", by: str = "dataset") -> DataFrame:
    """region, mean over the data sets of their own means; borders belong to the region, the first one that fits wins."""
    region = F.lit(None).cast("string")
    for name, (low, high) in reversed(list(regions.items())):
        region = F.when(F.col(fraction).between(low, high), name).otherwise(region)
    own = table.withColumn("region", region).where("region is not null").groupBy("region", by).agg(F.avg(value).alias("m"))
    return own.groupBy("region").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("deviation"), F.count("*").alias("datasets"))


def by_side(table: DataFrame, name: str, value: str) -> DataFrame:
    """animal, L, R: mean of each side, the side being a name's last letter."""
    side, animal = F.expr(f"right({name}, 1)"), F.expr(f"left({name}, length({name}) - 1)")
    return table.select(animal.alias("animal"), side.alias("side"), value).groupBy("animal").pivot("side", ["L", "R"]).agg(F.avg(value))


def trend(table: DataFrame, by: list[str], value: str) -> DataFrame:
    return table.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def average_curve(table: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """x, mean, deviation (sample) over data sets at each place."""
    return table.groupBy(x).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("deviation"), F.count_distinct(by).alias("datasets"))


def smoothed_histogram(table: DataFrame, value: str, bins: int, sigma: float) -> DataFrame:
    """bin, density over [0, 1]: counts smoothed by a Gaussian of sigma bins, cut at four sigma; the end bins repeat beyond the ends."""
    counted = table.where(F.col(value).between(0, 1)).groupBy(F.least(F.lit(bins - 1), F.floor(F.col(value) * bins).cast("int")).alias("bin")).agg(F.count("*").alias("n"))
    grid = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    reach = int(4 * sigma + 0.5)
    import math

    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(weights)
    counts = grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"])).scalar()
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in zip(range(-reach, reach + 1), weights, strict=True)])
    rows = grid.select("bin").withColumn("_c", counts)
    value_at = lambda b: F.get("_c", F.greatest(F.lit(0), F.least(F.lit(bins - 1), b)))
    return rows.select("bin", F.aggregate(steps, F.lit(0.0), lambda a, s: a + s["w"] * value_at(F.col("bin") + s["k"])).alias("density"))


def crop_centers(objects: DataFrame, halo: float, most: int = 10, fraction: str = "length_fraction") -> DataFrame:
    """number, target, label_id: the largest number of equal parts (up to `most`) whose middle objects' boxes do not overlap.

    Each number's targets are aggregates of one scan; the tests run on these few rows.
    """
    targets = [(n, (2 * k + 1) / (2 * n)) for n in range(1, most + 1) for k in range(n)]
    best = [F.min(F.struct(F.abs(F.col(fraction) - t).alias("gap"), "label_id", *[f"anchor_{c}" for c in "xyz"])).alias(f"t{k}") for k, (_, t) in enumerate(targets)]
    rows = objects.agg(*best).select(F.explode(F.array(*[F.struct(F.lit(n).alias("number"), F.lit(t).alias("target"), F.col(f"t{k}").alias("o")) for k, (n, t) in enumerate(targets)])).alias("x")).select("x.number", "x.target", "x.o.label_id", *[F.col(f"x.o.anchor_{c}").alias(c) for c in "xyz"])
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.number") == F.col("b.number")) & (F.col("a.target") < F.col("b.target")))
    meets = F.lit(True)
    for c in "xyz":
        meets = meets & (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) < 2 * halo)
    bad = pairs.where(meets).select(F.col("a.number").alias("number")).distinct()
    good = rows.join(bad, "number", "left_anti")
    return good.join(good.agg(F.max("number").alias("number")), "number").select("number", "target", "label_id")


def inside_polygon(points: DataFrame, corners: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Points in a convex polygon (counter-clockwise), border included."""
    test = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        test = test & ((bx - ax) * (F.col(y) - ay) - (by - ay) * (F.col(x) - ax) >= 0)
    return points.where(test)


def in_coarse_mask(voxels: DataFrame, mask: DataFrame, factor: tuple[int, int, int]) -> DataFrame:
    """Voxels whose coarse cell is in the mask; others get label 0."""
    cells = voxels.withColumns({f"m{c}": F.floor(F.col(c) / f).cast("long") for c, f in zip(ZYX, factor, strict=True)})
    joined = cells.join(mask.select(*[F.col(c).alias(f"m{c}") for c in ZYX]).distinct().withColumn("_in", F.lit(True)), [f"m{c}" for c in ZYX], "left")
    return joined.withColumn("label", F.when(F.col("_in"), F.col("label")).otherwise(0)).drop("_in", *[f"m{c}" for c in ZYX])


def inbetween_ids(positive: DataFrame, negative: DataFrame, key: str = "label_id") -> DataFrame:
    """Ids that both annotations touch."""
    return positive.select(key).intersect(negative.select(key))


def split_parts(voxels: DataFrame, least: int) -> DataFrame:
    """label, part, n: the connected parts (six neighbours) of each label with at least so many voxels; part is its smallest voxel."""
    key = F.col("z").cast("long") * (1 << 42) + F.col("y").cast("long") * (1 << 21) + F.col("x").cast("long")
    own = voxels.where("label != 0").select("label", key.alias("v"))
    edges = None
    for s in (1 << 42, 1 << 21, 1):
        part = own.join(own.select("label", (F.col("v") - s).alias("v")), ["label", "v"]).select(F.col("v").alias("a"), (F.col("v") + s).alias("b"))
        edges = part if edges is None else edges.unionByName(part)
    found = components(edges)
    named = own.join(found, own["v"] == found["node"], "left").select("label", F.coalesce("component", "v").alias("part"))
    return named.groupBy("label", "part").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def percent_by_label(table: DataFrame, label: str) -> DataFrame:
    """label, n, percent of the rows with a label."""
    counted = table.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.bround(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def train_forest(rows: DataFrame, features: list[str], label: str, trees: int = 20, seed: int = 0):
    """A random forest on measures; predict_forest applies it."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=features, outputCol="features").transform(rows.select(*features, F.col(label).cast("double").alias("label")))
    return RandomForestClassifier(numTrees=trees, seed=seed).fit(table)


def predict_forest(model, rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    return out.withColumn("probabilities", vector_to_array("probability")).drop("features", "rawPrediction", "probability")


def histogram_of(column: Column, edges: list[float]) -> Column:
    """Number of the interval between edges, left-closed; null outside."""
    out = F.lit(None).cast("int")
    for k, low in enumerate(edges[:-1]):
        out = F.when(column >= low, k).otherwise(out)
    return F.when(column < edges[-1], out)
