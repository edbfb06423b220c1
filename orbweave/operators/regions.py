"""Regions of labelled voxels: shape features out of sums, thresholds by object, opening and growth; nodes put into paths."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZYX = ("z", "y", "x")


def eigenvalues(a: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Of a symmetric 3 x 3 matrix (zz, yy, xx, zy, zx, yx), the largest first, in closed form; not below 0."""
    q = (a["zz"] + a["yy"] + a["xx"]) / 3
    d, e, f = a["zz"] - q, a["yy"] - q, a["xx"] - q
    p = F.sqrt((d * d + e * e + f * f + 2 * (a["zy"] * a["zy"] + a["zx"] * a["zx"] + a["yx"] * a["yx"])) / 6)
    det = d * (e * f - a["yx"] * a["yx"]) - a["zy"] * (a["zy"] * f - a["yx"] * a["zx"]) + a["zx"] * (a["zy"] * a["yx"] - e * a["zx"])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))))) / 3
    first, last = q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + 2 * pi / 3)
    return tuple(F.greatest(F.lit(0.0), x) for x in (first, 3 * q - first - last, last))


def region_features(voxels: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """label, area, extent (of its box), equivalent_diameter, intensity_max/mean/min/std, ev0..ev2 of the inertia tensor, axis_major and axis_minor.

    One aggregate of sums; label 0 is background. The axes are those of an ellipsoid with the same moments.
    """
    box = F.lit(1)
    for c in ZYX:
        box = box * (F.max(c) - F.min(c) + 1)
    var = {c: F.var_pop(c).alias(f"v{c}") for c in ZYX}
    co = {x + y: F.covar_pop(x, y).alias(f"v{x}{y}") for x, y in (("z", "y"), ("z", "x"), ("y", "x"))}
    v = F.col(value)
    s = voxels.where(F.col(label) != 0).groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("area"), (F.count("*") / box).alias("extent"), F.max(v).alias("intensity_max"), F.avg(v).alias("intensity_mean"), F.min(v).alias("intensity_min"), F.stddev_pop(v).alias("intensity_std"), *var.values(), *co.values()
    )
    tensor = {"zz": F.col("vy") + F.col("vx"), "yy": F.col("vz") + F.col("vx"), "xx": F.col("vz") + F.col("vy")} | {k: -F.col(f"v{k}") for k in co}
    s = s.withColumns(dict(zip(("ev0", "ev1", "ev2"), eigenvalues(tensor), strict=True)))
    axis = lambda sign: F.sqrt(F.greatest(F.lit(0.0), 10 * (F.col("ev1") + sign * (F.col("ev0") - F.col("ev2")))))
    diameter = F.pow(6 * F.col("area") / pi, F.lit(1 / 3))
    return s.select("label", "area", "extent", diameter.alias("equivalent_diameter"), "intensity_max", "intensity_mean", "intensity_min", "intensity_std", "ev0", "ev1", "ev2", axis(1).alias("axis_major"), axis(-1).alias("axis_minor"))


def otsu_by(table: DataFrame, by: str, value: str, bins: int = 256) -> DataFrame:
    """by, threshold: the bin centre that parts a group's histogram best, the first among equals.

    A histogram has at most `bins` rows, so a hot group shrinks before it is ordered. The variance is taken from whole
    numbers (bin numbers and counts). A group of one value has no row.
    """
    v = F.col(value).cast("double")
    span = table.where(v.isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")).where("_hi > _lo")
    rows = table.join(span, F.col(by) == F.col("_by"))
    bin_ = F.least(F.lit(bins - 1), F.floor((v - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)).cast("int"))
    hist = rows.where(v.isNotNull()).groupBy("_by", "_lo", "_hi", bin_.alias("bin")).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy("_by")
    up = all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("n") * (2 * F.col("bin") + 1)
    h = hist.select("_by", "_lo", "_hi", "bin", F.sum("n").over(up).alias("w1"), F.sum(mass).over(up).alias("s1"), F.sum("n").over(all_).alias("w"), F.sum(mass).over(all_).alias("s")).where("w > w1")
    gap = (F.col("s1") * (F.col("w") - F.col("w1")) - (F.col("s") - F.col("s1")) * F.col("w1")).cast("double")
    best = h.groupBy("_by", "_lo", "_hi").agg(F.max(F.struct((gap * gap / (F.col("w1") * (F.col("w") - F.col("w1"))).cast("double")).alias("between"), (-F.col("bin")).alias("b"))).alias("x"))
    return best.select(F.col("_by").alias(by), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) / bins * (0.5 - F.col("x.b"))).alias("threshold"))


def dark_voxels(voxels: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """z, y, x, label of the voxels below their own object's threshold."""
    limit = otsu_by(voxels.where(F.col(label) != 0), label, value)
    return voxels.join(limit, label).where(F.col(value) < F.col("threshold")).select(*ZYX, label)


def face_neighbours(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each cell at its own place and at those of its six face neighbours."""
    steps = F.array(*[F.struct(*[F.lit(s * (c == k)).alias(c) for c in ZYX]) for k in ZYX for s in (-1, 1)], F.struct(*[F.lit(0).alias(c) for c in ZYX]))
    return cells.withColumn("_s", F.explode(steps)).select(*by, *[(F.col(c) + F.col(f"_s.{c}")).alias(c) for c in ZYX])


def opened(cells: DataFrame, rounds: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """by, z, y, x of the opening along faces: eroded, then dilated, so many times each; outside of the cells is background."""
    out = cells.select(*by, *ZYX).distinct()
    for _ in range(rounds):
        out = face_neighbours(out, by).groupBy(*by, *ZYX).agg(F.count("*").alias("_n")).where("_n = 7").drop("_n")
    for _ in range(rounds):
        out = face_neighbours(out, by).distinct()
    return out


def extended_labels(voxels: DataFrame, distance: float, shape: tuple[int, int, int], label: str = "label") -> DataFrame:
    """z, y, x, label: objects grown to all voxels of the volume nearer than the distance; the nearest object wins, then the smaller label.

    Labelled voxels go to the places of a ball, and each place keeps its least (distance, label), map side first.
    """
    r = int(distance)
    ball = [(a, b, c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c < distance * distance]
    steps = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip((*o, sum(k * k for k in o)), (*ZYX, "d"), strict=True)]) for o in ball])
    near = voxels.where(F.col(label) != 0).withColumn("_s", F.explode(steps)).select(*[(F.col(c) + F.col(f"_s.{c}")).alias(c) for c in ZYX], F.struct(F.col("_s.d"), F.col(label).alias("l")).alias("_p"))
    inside = [F.col(c).between(0, n - 1) for c, n in zip(ZYX, shape, strict=True)]
    return near.where(inside[0] & inside[1] & inside[2]).groupBy(*ZYX).agg(F.min("_p").alias("_p")).select(*ZYX, F.col("_p.l").alias(label))


def inserted_nodes(path: DataFrame, points: DataFrame, more: tuple[str, ...] = (), by: str = "dataset", idx: str = "node_idx") -> DataFrame:
    """path (by, idx, spot_id, x, y, z, more) with a point (by, place, x, y, z) put into each path at its place; nodes behind it move on by one.

    The point's spot_id is the number of nodes. Its further columns are weighted by the distances to the nodes at place - 1 and
    place + 1 (the last node where there is none behind): each weighs as its own distance over both, so the farther one
    counts more. At both ends of a path they are null. Paths without a point stay as they are; a place beyond the path's
    end, or on no path, adds nothing.
    """
    xyz = ("x", "y", "z")
    at = points.select(F.col(by).alias("_by"), F.col("place").alias("_place"), *[F.col(c).cast("double").alias(f"_{c}") for c in xyz])
    rows = path.join(at, F.col(by) == F.col("_by"), "left")
    node = F.struct(*xyz, *more)
    ends = rows.where("_by is not null").groupBy("_by", "_place", *[f"_{c}" for c in xyz]).agg(
        F.count("*").alias("_n"), F.max(F.when(F.col(idx) == F.col("_place") - 1, node)).alias("_a"), F.max(F.when(F.col(idx) == F.col("_place") + 1, node)).alias("_b"), F.max_by(node, idx).alias("_last")
    ).where("_place between 0 and _n").withColumn("_b", F.coalesce("_b", "_last"))
    gap = {p: F.sqrt(sum(((F.col(f"{p}.{c}") - F.col(f"_{c}")) * (F.col(f"{p}.{c}") - F.col(f"_{c}")) for c in xyz), F.lit(0.0))) for p in ("_a", "_b")}
    inner = F.col("_place").between(1, F.col("_n") - 1)
    put = {c: F.when(inner, F.try_divide(gap["_a"] * F.col(f"_a.{c}") + gap["_b"] * F.col(f"_b.{c}"), gap["_a"] + gap["_b"])).alias(c) for c in more}
    new = ends.select(F.col("_by").alias(by), F.col("_place").cast("long").alias(idx), F.col("_n").alias("spot_id"), *[F.col(f"_{c}").alias(c) for c in xyz], *put.values())
    moved = path.join(ends.select("_by", "_place"), F.col(by) == F.col("_by"), "left").withColumn(idx, (F.col(idx) + F.coalesce((F.col(idx) >= F.col("_place")).cast("int"), F.lit(0))).cast("long"))
    return moved.select(by, idx, "spot_id", *xyz, *more).unionByName(new)


def share_table(rows: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """by, n and a share for each of the kinds: one row for a data set; a kind it lacks is 0. Rows without a kind are left out."""
    counted = rows.where(F.col(kind).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col(kind) == k).alias(f"_{i}") for i, k in enumerate(kinds)])
    return counted.select(by, "n", *[(F.col(f"_{i}") / F.col("n")).alias(k) for i, k in enumerate(kinds)])


def labels_by_sets(objects: DataFrame, thresholds: DataFrame, value: str, band: str) -> DataFrame:
    """set, label_id, marker: 1 from the threshold of the object's band on, 2 below it, 0 where the set has no threshold there.

    thresholds: (set, band, threshold), each band once in a set. Every set labels every object; sets are few, and travel as one
    array.
    """
    few = thresholds.groupBy("set").agg(F.map_from_entries(F.collect_list(F.struct("band", "threshold"))).alias("t")).agg(F.collect_list(F.struct("set", "t")).alias("sets"))
    each = objects.select("label_id", F.col(value).alias("_v"), F.col(band).alias("_band"), F.explode(few.select("sets").scalar()).alias("_s"))
    t = F.try_element_at(F.col("_s.t"), F.col("_band"))
    return each.select(F.col("_s.set").alias("set"), "label_id", F.when(t.isNull() | F.col("_v").isNull(), 0).when(F.col("_v") >= t, 1).otherwise(2).alias("marker"))
