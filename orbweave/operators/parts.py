"""Connected parts of voxels block by block, Euler numbers, and the background around objects.

Voxels are rows (z, y, x) with whole numbers from 0 on; a group (by) is one label or volume. Rows with a null place are left out.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.graph import components
from orbweave.operators.grids import BLOCK, cell_id
from orbweave.operators.ranges import written
from orbweave.operators.regions import dark_voxels, face_neighbours, opened
from orbweave.operators.volumes import downsample

ZYX = ("z", "y", "x")


def _steps(corners: bool) -> list[tuple[int, int, int]]:
    """One of each pair of opposite steps to a neighbour over faces, or over edges and corners as well."""
    return [s for s in product((-1, 0, 1), repeat=3) if s > (0, 0, 0) and (corners or sum(map(abs, s)) == 1)]


def _in_block(edge: int, steps: list[tuple[int, int, int]]):
    """Names the parts within one block by their smallest cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", ignore_index=True)
        wide = edge + 2
        flat = np.ravel_multi_index(tuple(pdf[c].to_numpy() % edge + 1 for c in ZYX), (wide,) * 3)
        number = np.full(wide**3, -1)
        number[flat] = np.arange(len(pdf))
        ends = [(np.arange(len(pdf)), number[flat + (a * wide + b) * wide + c]) for a, b, c in steps]
        a, b = (np.concatenate(e) for e in zip(*[(p[q >= 0], q[q >= 0]) for p, q in ends], strict=True))
        part, old = np.arange(len(pdf)), None
        while old is None or (part != old).any():
            old = part.copy()
            low = np.minimum(part[a], part[b])
            np.minimum.at(part, a, low)
            np.minimum.at(part, b, low)
            part = part[part]
        return pdf.assign(part=pdf["cell"].to_numpy()[part])

    return run


def connected_parts(cells: DataFrame, by: tuple[str, ...] = ("label",), corners: bool = False, edge: int = BLOCK) -> DataFrame:
    """by, z, y, x, part: parts of face neighbours (corners: of all 26) in each group, named by the id of their smallest cell.

    Blocks of `edge` cells a side are labelled by themselves, so a task holds edge^3 cells of a group at a time. Only cells at the
    faces of blocks meet those of other blocks, and only the pairs of parts that they link go through rounds of components: a
    volume of a million blocks sends its surfaces, not its voxels. Repeated cells count once; an empty table gives no rows.
    """
    steps = _steps(corners)
    blocks = [f"b{c}" for c in ZYX]
    kept = F.lit(True)
    for c in ZYX:
        kept = kept & F.col(c).isNotNull()
    rows = cells.where(kept).select(*by, *[F.col(c).cast("long").alias(c) for c in ZYX]).distinct().withColumns({b: F.floor(F.col(c) / edge) for b, c in zip(blocks, ZYX, strict=True)} | {"cell": cell_id()})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    inner = written(rows.groupBy(*by, *blocks).applyInPandas(_in_block(edge, steps), f"{kinds}, part long"))
    node = F.struct(*by, "part")
    rim = F.lit(False)
    for c in ZYX:
        rim = rim | F.pmod(c, F.lit(edge)).isin(0, edge - 1)
    border = inner.where(rim).select(*by, *ZYX, *blocks, node.alias("a"))
    moves = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(ZYX, s, strict=True)]) for s in steps])
    sent = border.withColumn("_s", F.explode(moves)).select(*by, *[(F.col(c) + F.col(f"_s.{c}")).alias(c) for c in ZYX], *[F.col(b).alias(f"_{b}") for b in blocks], "a")
    leaves = F.lit(False)
    for b, c in zip(blocks, ZYX, strict=True):
        leaves = leaves | (F.floor(F.col(c) / edge) != F.col(f"_{b}"))
    links = sent.where(leaves).select(*by, *ZYX, "a").join(border.select(*by, *ZYX, F.col("a").alias("b")), [*by, *ZYX]).select("a", "b").distinct()
    found = components(links).select(*[F.col(f"node.{c}").alias(c) for c in (*by, "part")], F.col("component.part").alias("_root"))
    return inner.join(found, [*by, "part"], "left").select(*by, *ZYX, F.coalesce("_root", "part").alias("part"))


def part_sizes(parts: DataFrame, by: tuple[str, ...] = ("label",), least: int = 1) -> DataFrame:
    """by, part, n of the parts with at least so many voxels."""
    return parts.groupBy(*by, "part").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def largest_parts(cells: DataFrame, by: tuple[str, ...] = ("label",), corners: bool = False, edge: int = BLOCK) -> DataFrame:
    """by, z, y, x of each group's largest part; among equals the one with the smallest cell."""
    parts = written(connected_parts(cells, by, corners, edge))
    top = part_sizes(parts, by).groupBy(*by).agg(F.max(F.struct("n", (-F.col("part")).alias("first"))).alias("_top"))
    return parts.join(top.select(*by, (-F.col("_top.first")).alias("part")), [*by, "part"], "left_semi").select(*by, *ZYX)


def nuclei(voxels: DataFrame, rounds: int = 2, edge: int = BLOCK) -> DataFrame:
    """label, z, y, x: the largest part of each object's dark voxels (by its own threshold) after an opening."""
    return largest_parts(opened(dark_voxels(voxels), rounds, ("label",)), ("label",), edge=edge)


def _euler_of_corner(config: int) -> float:
    """What the place between 2 x 2 x 2 voxels adds: itself, half of the edges, a quarter of the faces and an eighth of the cubes around."""
    full = [o for k, o in enumerate(product((0, 1), repeat=3)) if config >> k & 1]
    if not full:
        return 0.0
    edges = {(axis, o[axis]) for o in full for axis in range(3)}
    faces = {(axis, *(v for k, v in enumerate(o) if k != axis), axis) for o in full for axis in range(3)}
    return 1 - len(edges) / 2 + len(faces) / 4 - len(full) / 8


def octants(voxels: DataFrame, label: str = "label") -> DataFrame:
    """label, z, y, x, config of each place between 2 x 2 x 2 voxels, the last of which has its numbers: bit k is set where octant k has the label.

    Every voxel tells the eight places at its corners which of their octants it fills; they are united map side first.
    """
    corners = list(enumerate(product((0, 1), repeat=3)))
    sent = F.array(*[F.struct(*[F.lit(1 - v).alias(c) for c, v in zip(ZYX, o, strict=True)], F.lit(1 << k).alias("bit")) for k, o in corners])
    return voxels.where(F.col(label) != 0).withColumn("_s", F.explode(sent)).groupBy(label, *[(F.col(c) + F.col(f"_s.{c}")).alias(c) for c in ZYX]).agg(F.bit_or(F.col("_s.bit")).alias("config"))


def euler_numbers(voxels: DataFrame, label: str = "label") -> DataFrame:
    """label, euler: parts less tunnels plus hollows of each object, whose voxels meet over corners as well. Each of the 256 cases of a place adds a fixed share."""
    shares = F.array(*[F.lit(_euler_of_corner(k)) for k in range(256)])
    return octants(voxels, label).groupBy(label, "config").agg(F.count("*").alias("n")).groupBy(label).agg(F.round(F.sum(F.col("n") * F.get(shares, F.col("config")))).cast("long").alias("euler"))


def adaptive_background(voxels: DataFrame, factor: tuple[int, int, int] = (16, 16, 16), chunk: tuple[int, int, int] = (8, 32, 32), percentile: float = 35.0) -> DataFrame:
    """z, y, x of coarse cells brighter than the percentile of their own chunk of cells and not at an object: background within the tissue.

    A coarse cell is at an object if one of its voxels, or of its face neighbours', has a label; objects count over the borders of chunks.
    """
    coarse = downsample(voxels, factor)
    where = [F.floor(F.col(c) / n).alias(f"k{c}") for c, n in zip(ZYX, chunk, strict=True)]
    limits = coarse.groupBy(*where).agg(F.percentile("value", F.lit(percentile / 100)).alias("_limit"))
    objects = voxels.where("label != 0").select(*[F.floor(F.col(c) / f).cast("long").alias(c) for c, f in zip(ZYX, factor, strict=True)]).distinct()
    bright = coarse.select("*", *where).join(limits, [f"k{c}" for c in ZYX]).where(F.col("value") > F.col("_limit"))
    return bright.select(*ZYX).join(face_neighbours(objects, ()).distinct(), list(ZYX), "left_anti")


def masked(voxels: DataFrame, mask: DataFrame, factor: tuple[int, int, int]) -> DataFrame:
    """The voxels whose coarse cell is in the mask."""
    cell = [F.floor(F.col(c) / f).cast("long").alias(f"_m{c}") for c, f in zip(ZYX, factor, strict=True)]
    keys = mask.select(*[F.col(c).alias(f"_m{c}") for c in ZYX])
    return voxels.select("*", *cell).join(keys, [f"_m{c}" for c in ZYX], "left_semi").drop(*[f"_m{c}" for c in ZYX])


def _square(columns: list[Column]) -> Column:
    return sum((c * c for c in columns), F.lit(0))


def local_background(objects: DataFrame, voxels: DataFrame, radius: float, shape: tuple[int, int, int], edge: int = 8, key: str = "label_id", value: str = "value") -> DataFrame:
    """key, background: the median of the voxels in the ball around each object (key, z, y, x); null where there are none.

    The ball lies in the object's box, its place less and plus the radius cut to the volume, around the middle of that box. Cells of
    `edge` voxels a side are told apart: one wholly in the ball sends its histogram, which is taken once for all objects, and
    only cells at the surface send voxels. Values are counted before they are ordered, so an object keeps one row for each value of
    the image. Everything meets in equi-joins on the cell.
    """
    box = {}
    for c, n in zip(ZYX, shape, strict=True):
        box |= {f"lo_{c}": F.greatest(F.lit(0), (F.col(c) - radius).cast("long")), f"hi_{c}": F.least(F.lit(n), (F.col(c) + radius).cast("long"))}
    balls = objects.select(key, *ZYX).withColumns(box)
    for c in ZYX:
        balls = balls.where(F.col(f"hi_{c}") > F.col(f"lo_{c}")).withColumn(f"mid_{c}", F.col(f"lo_{c}") + F.floor((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 2))
    for c in ZYX:
        balls = balls.withColumn(f"b{c}", F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / edge), F.floor((F.col(f"hi_{c}") - 1) / edge))))
    near, far, whole = [], [], F.lit(True)
    for c, n in zip(ZYX, shape, strict=True):
        first, end, mid = F.col(f"b{c}") * edge, (F.col(f"b{c}") + 1) * edge, F.col(f"mid_{c}")
        low, high = F.greatest(first, F.col(f"lo_{c}")), F.least(end, F.col(f"hi_{c}")) - 1
        near.append(F.greatest(F.lit(0), low - mid, mid - high))
        far.append(F.greatest(F.abs(low - mid), F.abs(high - mid)))
        whole = whole & (first >= F.col(f"lo_{c}")) & ((end <= F.col(f"hi_{c}")) | (F.col(f"hi_{c}") == n))
    at, limit = [f"b{c}" for c in ZYX], radius * radius
    met = balls.where(_square(near) <= limit).withColumn("_whole", whole & (_square(far) <= limit))
    rows = voxels.where(F.col(value).isNotNull()).select(*ZYX, F.col(value).alias("_v"), *[F.floor(F.col(c) / edge).alias(f"b{c}") for c in ZYX])
    # the planner's guess leaves out that rows are exploded: without the hint it broadcasts them all, through the driver
    inner = met.where("_whole").select(key, *at).hint("merge").join(rows.groupBy(*at, "_v").agg(F.count("*").alias("_n")), at).select(key, "_v", "_n")
    surface = met.where("not _whole").drop(*ZYX).hint("merge").join(rows, at)
    inside = _square([F.col(c) - F.col(f"mid_{c}") for c in ZYX]) <= limit
    for c in ZYX:
        inside = inside & (F.col(c) >= F.col(f"lo_{c}")) & (F.col(c) < F.col(f"hi_{c}"))
    counted = inner.unionByName(surface.where(inside).select(key, "_v", F.lit(1).cast("long").alias("_n"))).groupBy(key, "_v").agg(F.sum("_n").alias("_n"))
    found = counted.groupBy(key).agg(F.percentile("_v", F.lit(0.5), F.col("_n")).alias("background"))
    return objects.select(key).join(found, key, "left")
