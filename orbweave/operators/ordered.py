"""Operators on ordered nodes: arc length, smoothing, densifying, interpolation, insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = ("x", "y", "z")


def _order(by: str, idx: str) -> Window:
    return Window.partitionBy(by).orderBy(idx)


def step_length(by: str = "dataset", idx: str = "node_idx") -> Column:
    """Distance from the node before; 0 at the first."""
    w = _order(by, idx)
    return F.coalesce(F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in PLACES), F.lit(0.0))), F.lit(0.0))


def arc_length(path: DataFrame, max_edge: float | None = None, by: str = "dataset", idx: str = "node_idx") -> DataFrame:
    """path with length and length_fraction; steps over max_edge count 0; the last node has fraction 1."""
    step = F.col("_step") if max_edge is None else F.when(F.col("_step") <= max_edge, F.col("_step")).otherwise(0.0)
    w = _order(by, idx)
    up, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    rows = path.withColumn("_step", step_length(by, idx)).withColumn("length", F.sum(step).over(up))
    return rows.withColumn("length_fraction", F.when(F.col(idx) == F.max(idx).over(all_), 1.0).otherwise(F.coalesce(F.try_divide(F.col("length"), F.max("length").over(all_)), F.lit(0.0)))).drop("_step")


def path_length(path: DataFrame, by: str = "dataset", idx: str = "node_idx") -> DataFrame:
    return path.withColumn("_step", step_length(by, idx)).groupBy(by).agg(F.sum("_step").alias("length"))


def moving_average(path: DataFrame, half: int, by: str = "dataset", idx: str = "node_idx", integer: bool = False) -> DataFrame:
    """Centred mean over 2 half + 1 nodes, the end nodes repeated beyond the ends.

    A frame at an end is shorter by some nodes; each of them counts as the end node. integer: cut to whole numbers.
    """
    w = _order(by, idx)
    frame, all_ = w.rowsBetween(-half, half), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(by))
    under, over = F.greatest(F.lit(0), half - place), F.greatest(F.lit(0), place + half - (n - 1))
    out = {c: (F.sum(c).over(frame) + under * F.first(c).over(all_) + over * F.last(c).over(all_)) / (2 * half + 1) for c in PLACES}
    return path.withColumns({c: (e.cast("long") if integer else e) for c, e in out.items()})


def extend_path(path: DataFrame, longest: float, by: str = "dataset", idx: str = "node_idx") -> DataFrame:
    """Evenly spaced nodes put into steps longer than `longest`: by, idx, part, x, y, z."""
    w = _order(by, idx)
    rows = path.withColumns({f"_{c}": F.lead(c).over(w) for c in PLACES})
    gap = F.sqrt(sum(((F.col(f"_{c}") - F.col(c)) * (F.col(f"_{c}") - F.col(c)) for c in PLACES), F.lit(0.0)))
    parts = F.coalesce(F.greatest(F.lit(1), F.ceil(gap / longest).cast("int")), F.lit(1))
    rows = rows.withColumn("_parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return rows.select(by, idx, "part", *[F.when(F.col("part") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("part") / F.col("_parts")).alias(c) for c in PLACES])


def targets(n: int, inner: bool = True) -> list[float]:
    """n places in [0, 1]: the middles of n equal parts, or from 0 to 1."""
    return [(2 * k + 1) / (2 * n) for k in range(n)] if inner else [k / (n - 1) for k in range(n)]


def centers(path: DataFrame, fractions: list[float], by: str = "dataset", idx: str = "node_idx") -> DataFrame:
    """by, target, x, y, z: places at fractions of the length, interpolated between nodes.

    Each step between nodes takes the targets that fall into it; the few targets travel as an array.
    """
    rows = arc_length(path, by=by, idx=idx)
    w = _order(by, idx)
    rows = rows.withColumns({f"_{c}": F.lead(c).over(w) for c in (*PLACES, "length_fraction")}).where("_length_fraction is not null")
    wanted = F.filter(F.array(*[F.lit(f) for f in fractions]), lambda t: (t >= F.col("length_fraction")) & ((t < F.col("_length_fraction")) | ((t == 1.0) & (F.col("_length_fraction") == 1.0))))
    rows = rows.withColumn("target", F.explode(wanted))
    t = F.coalesce(F.try_divide(F.col("target") - F.col("length_fraction"), F.col("_length_fraction") - F.col("length_fraction")), F.lit(0.0))
    return rows.select(by, "target", *[(F.col(c) + (F.col(f"_{c}") - F.col(c)) * t).alias(c) for c in PLACES])


def nearest_fraction(path: DataFrame, fractions: list[float], by: str = "dataset", idx: str = "node_idx") -> DataFrame:
    """by, target, node: the node whose fraction is nearest to each target, the first among equals."""
    rows = arc_length(path, by=by, idx=idx)
    best = [F.min(F.struct(F.abs(F.col("length_fraction") - t).alias("gap"), F.col(idx).alias("node"))).alias(f"t{k}") for k, t in enumerate(fractions)]
    wide = rows.groupBy(by).agg(*best)
    return wide.select(by, F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"t{k}.node").alias("node")) for k, t in enumerate(fractions)])).alias("x")).select(by, "x.*")


def fraction_limits(crops: DataFrame, fraction: str = "fraction", by: str | None = None) -> DataFrame:
    """lo and hi of each crop's band: the middles to its neighbours, 0 and 1 at the ends."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(fraction)
    f = F.col(fraction)
    return crops.withColumns({"lo": F.coalesce((f + F.lag(f).over(w)) / 2, F.lit(0.0)), "hi": F.coalesce((f + F.lead(f).over(w)) / 2, F.lit(1.0))})


def insertion_place(path: DataFrame, point: tuple[float, float, float], by: str = "dataset", idx: str = "node_idx") -> DataFrame:
    """by, after, cost: the node after which a point adds the least length (-1: before the first)."""
    w = _order(by, idx)
    far = lambda cols: F.sqrt(sum(((a - p) * (a - p) for a, p in zip(cols, point, strict=True)), F.lit(0.0)))
    here, there = far([F.col(c) for c in PLACES]), far([F.lead(c).over(w) for c in PLACES])
    step = F.sqrt(sum(((F.lead(c).over(w) - F.col(c)) * (F.lead(c).over(w) - F.col(c)) for c in PLACES), F.lit(0.0)))
    rows = path.select(by, idx, here.alias("here"), (here + there - step).alias("cost"), F.row_number().over(w).alias("k"))
    first = rows.where("k = 1").select(by, F.lit(-1).cast("long").alias(idx), F.col("here").alias("cost"))
    inner = rows.select(by, idx, F.coalesce("cost", "here").alias("cost"))
    return inner.unionByName(first).groupBy(by).agg(F.min(F.struct("cost", idx)).alias("x")).select(by, F.col(f"x.{idx}").alias("after"), F.col("x.cost").alias("cost"))


def central_path_table(path: DataFrame) -> DataFrame:
    """Places rounded half-even to whole numbers."""
    return path.withColumns({c: F.bround(c).cast("int") for c in PLACES})
