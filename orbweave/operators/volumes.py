"""Operators on voxel tables (z, y, x, value or label): objects, cut-outs, coarser grids, dilation, overlap, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators import ranges

ZYX = ("z", "y", "x")


def object_table(voxels: DataFrame, size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """label_id, anchor (mean place), box (its upper end open) in units of size (z, y, x), n_pixels; 0 is background."""
    aggs = [F.count("*").alias("n_pixels")]
    for c, s in zip(ZYX, size, strict=True):
        aggs += [(F.avg(c) * s).alias(f"anchor_{c}"), (F.min(c) * s).alias(f"bb_min_{c}"), ((F.max(c) + 1) * s).alias(f"bb_max_{c}")]
    return voxels.where("label != 0").groupBy(F.col("label").alias("label_id")).agg(*aggs)


def cut_out(voxels: DataFrame, start: tuple[int, int, int], stop: tuple[int, int, int]) -> DataFrame:
    """Voxels of a box, its upper end open, with places counted from its start."""
    test = F.lit(True)
    for c, a, b in zip(ZYX, start, stop, strict=True):
        test = test & (F.col(c) >= a) & (F.col(c) < b)
    return voxels.where(test).withColumns({c: F.col(c) - a for c, a in zip(ZYX, start, strict=True)})


def downsample(voxels: DataFrame, factor: tuple[int, int, int], value: str = "value") -> DataFrame:
    """Means of coarse cells."""
    return voxels.groupBy(*[F.floor(F.col(c) / f).cast("long").alias(c) for c, f in zip(ZYX, factor, strict=True)]).agg(F.avg(value).alias(value))


def keep_labels(voxels: DataFrame, ids: DataFrame, label: str = "label") -> DataFrame:
    """Other labels become 0."""
    marked = voxels.join(ids.select(F.col(ids.columns[0]).alias(label)).distinct().withColumn("_in", F.lit(True)), label, "left")
    return marked.withColumn(label, F.when(F.col("_in"), F.col(label)).otherwise(0)).drop("_in")


def lookup(voxels: DataFrame, table: DataFrame, column: str, default: float = 0.0, label: str = "label") -> DataFrame:
    """A column of the objects' table at each voxel of the object."""
    return voxels.join(table.select(F.col("label_id").alias(label), F.col(column)), label, "left").fillna(default, [column])


def dilated(cells: DataFrame, rounds: int = 1) -> DataFrame:
    """Cells (z, y, x) and all within so many steps of a 3 x 3 x 3 element."""
    span = F.sequence(F.lit(-rounds), F.lit(rounds))
    out = cells.select(*ZYX)
    for c in ZYX:
        # one axis at a time: 3 explodes of 2 r + 1 in place of one of (2 r + 1) ** 3
        out = out.withColumn("_s", F.explode(span)).withColumn(c, F.col(c) + F.col("_s")).drop("_s").distinct()
    return out


def eroded(cells: DataFrame) -> DataFrame:
    """Cells all of whose 27 neighbours (itself included) are cells."""
    near = cells.select(*ZYX)
    for c in ZYX:
        near = near.withColumn("_s", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn(c, F.col(c) + F.col("_s")).drop("_s").groupBy(*ZYX).agg(F.count("*").alias("_n")).where("_n = 3").drop("_n")
    return near


def closed(cells: DataFrame) -> DataFrame:
    return eroded(dilated(cells))


def overlap_fractions(voxels: DataFrame, a: str = "label", b: str = "other") -> DataFrame:
    """a, b, n, fraction_a (of a's voxels), fraction_b, iou."""
    both = voxels.where(f"{a} != 0 and {b} != 0").groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    na = voxels.where(f"{a} != 0").groupBy(F.col(a).alias("a")).agg(F.count("*").alias("_a"))
    nb = voxels.where(f"{b} != 0").groupBy(F.col(b).alias("b")).agg(F.count("*").alias("_b"))
    return both.join(na, "a").join(nb, "b").select("a", "b", "n", (F.col("n") / F.col("_a")).alias("fraction_a"), (F.col("n") / F.col("_b")).alias("fraction_b"), (F.col("n") / (F.col("_a") + F.col("_b") - F.col("n"))).alias("iou"))


def merge_segmentations(voxels: DataFrame, ids: DataFrame, offset: int) -> DataFrame:
    """label, where it is background filled by other + offset for the ids."""
    marked = voxels.join(ids.select(F.col(ids.columns[0]).alias("other")).distinct().withColumn("_in", F.lit(True)), "other", "left")
    return marked.withColumn("label", F.when((F.col("label") == 0) & F.col("_in"), F.col("other") + offset).otherwise(F.col("label"))).drop("_in")


def split_overcounted(voxels: DataFrame, least: float = 0.5) -> DataFrame:
    """Objects with two or more others that lie in them by the fraction or more take those labels (over the largest own one)."""
    inside = overlap_fractions(voxels).where(F.col("fraction_b") >= least)
    several = inside.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select(F.col("a").alias("label"))
    top = voxels.agg(F.max("label")).scalar()
    pairs = inside.select(F.col("a").alias("label"), F.col("b").alias("other")).withColumn("_in", F.lit(True)).join(several, "label", "left_semi")
    joined = voxels.join(pairs, ["label", "other"], "left").join(several.withColumn("_split", F.lit(True)), "label", "left").withColumn("_top", top)
    new = F.when(F.col("_in"), F.col("_top") + F.col("other")).when(F.col("_split"), F.lit(0)).otherwise(F.col("label"))
    return joined.withColumn("label", new.cast("long")).drop("_in", "_split", "_top")


def local_maxima(voxels: DataFrame, reach: int, threshold: float, value: str = "value") -> DataFrame:
    """Voxels over the threshold that no voxel within reach (on every axis) exceeds. Only those over it are compared."""
    high = voxels.where(F.col(value) > threshold).select(*ZYX, value)
    near = high.select(*ZYX, F.col(value).alias("v"))
    for c in ZYX:
        near = near.withColumn("_s", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(c, F.col(c) + F.col("_s")).drop("_s").groupBy(*ZYX).agg(F.max("v").alias("v"))
    return high.join(near, list(ZYX)).where(F.col(value) == F.col("v")).drop("v")


def flow_corrected(peaks: DataFrame, flow: DataFrame, sigma: float) -> DataFrame:
    """Peaks moved by sigma * f[1:] / (1 + f[0] + 1e-8); flow: (z, y, x, f0, f1, f2, f3)."""
    j = peaks.join(flow, list(ZYX))
    return j.select(*[(F.col(c) + sigma * F.col(f"f{k}") / (1 + F.col("f0") + 1e-8)).alias(c) for k, c in enumerate(ZYX, 1)])


def spots_per_cell(spots: DataFrame, cells: DataFrame, farthest: float) -> DataFrame:
    """label_id, n: spots (matched, distance) within the distance of each cell; 0 for cells without."""
    n = spots.where(F.col("distance") <= farthest).groupBy(F.col("matched").alias("label_id")).agg(F.count("*").alias("n"))
    return cells.select("label_id").join(n, "label_id", "left").fillna(0, ["n"])


def block_percentiles(voxels: DataFrame, block: tuple[int, int, int], percentiles: tuple[float, ...], value: str = "value") -> DataFrame:
    return voxels.groupBy(*[F.floor(F.col(c) / b).cast("long").alias(f"b{c}") for c, b in zip(ZYX, block, strict=True)]).agg(*[F.percentile(value, F.lit(p / 100)).alias(f"p{p:g}".replace(".", "_")) for p in percentiles])


def mask_sweep(blocks: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """threshold, share: part of the blocks whose percentile is over each threshold, in one pass."""
    one = blocks.agg(*[F.avg((F.col(column) > t).cast("double")).alias(f"t{k}") for k, t in enumerate(thresholds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("share")) for k, t in enumerate(thresholds)])).alias("x")).select("x.*")


def background_mask(voxels: DataFrame, factor: tuple[int, int, int], percentile: float = 35.0, rounds: int = 1) -> DataFrame:
    """Coarse cells under the percentile of their means that no dilated object touches."""
    coarse = downsample(voxels, factor)
    limit = coarse.agg(F.percentile("value", F.lit(percentile / 100))).scalar()
    objects = voxels.where("label != 0").select(*[F.floor(F.col(c) / f).cast("long").alias(c) for c, f in zip(ZYX, factor, strict=True)]).distinct()
    return coarse.withColumn("_limit", limit).where(F.col("value") <= F.col("_limit")).select(*ZYX).join(dilated(objects, rounds), list(ZYX), "left_anti")


def normalised(measures: DataFrame, background: DataFrame, columns: list[str], how: str = "subtract") -> DataFrame:
    """Measures less (or over) the background of each object; the deviation stays as it is."""
    change = (lambda c: F.col(c) - F.col("background")) if how == "subtract" else (lambda c: F.try_divide(F.col(c), F.col("background")))
    return measures.join(background, "label_id", "left").withColumns({c: change(c) for c in columns if c != "stdev"}).drop("background")


def global_mean_std(voxels: DataFrame, mask: Column | None = None, value: str = "value") -> DataFrame:
    rows = voxels if mask is None else voxels.where(mask)
    return rows.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))


def surface_faces(voxels: DataFrame) -> DataFrame:
    """label_id, volume, surface: voxels, and faces between a voxel and another label (a stand-in for a mesh's area)."""
    near = voxels.where("label != 0").select("label", *ZYX)
    faces = near
    steps = [F.struct(*[F.lit(s if c == k else 0).alias(f"s{c}") for c in ZYX]) for k in ZYX for s in (-1, 1)]
    faces = faces.withColumn("_s", F.explode(F.array(*steps))).select("label", *[(F.col(c) + F.col(f"_s.s{c}")).alias(c) for c in ZYX])
    inside = faces.join(near.withColumn("_in", F.lit(True)), ["label", *ZYX], "left").groupBy(F.col("label").alias("label_id")).agg(F.count_if(F.col("_in").isNull()).alias("surface"))
    return near.groupBy(F.col("label").alias("label_id")).agg(F.count("*").alias("volume")).join(inside, "label_id")


def priority_label(rows: DataFrame, order: str, label: str = "label") -> DataFrame:
    """Of several labels painted on a voxel, the last one."""
    return rows.groupBy(*ZYX).agg(F.max(F.struct(order, label)).alias("_top")).select(*ZYX, F.col(f"_top.{label}").alias(label))


def nearest_marker(voxels: DataFrame, markers: DataFrame, reach: int) -> DataFrame:
    """z, y, x, marker of voxels within reach of a marker: the nearest one, the smaller id among equals."""
    spread = markers.select(F.col("id").alias("marker"), *[F.col(c).alias(f"m{c}") for c in ZYX], *ZYX)
    for c in ZYX:
        spread = spread.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
    d = sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in ZYX), F.lit(0))
    near = spread.withColumn("d", d).where(F.col("d") < reach * reach).groupBy(*ZYX).agg(F.min(F.struct("d", "marker")).alias("_top")).select(*ZYX, F.col("_top.marker").alias("marker"))
    return voxels.select(*ZYX).join(near, list(ZYX))


def numbered(rows: DataFrame, order: list[str], name: str = "spot_id") -> DataFrame:
    """1..n in an order of a table of spots."""
    return ranges.numbered(rows, order, name)
