"""Spanning trees of points in groups, by rounds in which every part but the largest takes its shortest way out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.graph import components
from orbweave.operators.ranges import written
from orbweave.operators.spatial import XYZ, distance, first_radius

#: Points of its group in a point's cell, on average, at the radius that a tree begins with.
CROWD = 4.0


def tree_edges(points: DataFrame, by: str, key: str = "label_id", radius: float = 30.0, places: tuple[str, ...] = XYZ) -> DataFrame:
    """by, a, b (a before b), distance: the edges of each group's minimum spanning tree; the smaller (a, b) among equals. A key names one point of a group.

    Points meet in cells as wide as a radius that begins at one (the given one, halved) at which cells hold few points. Only points
    outside of their group's largest part look around, so a far outlier makes itself look far and not its whole group; what they see is written once for a radius.
    Each part's shortest edge to another one belongs to the tree; the parts that they join go on as one. When no edge is left within the radius, it doubles.
    """
    test = F.col(by).isNotNull()
    for c in places:
        test = test & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    parts = written(points.where(test).select(by, key, *places).withColumn("part", F.col(key)))
    found, radius = None, first_radius(parts, radius, CROWD, places, by)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "part"))
    while True:
        sizes = parts.groupBy(by, "part").agg(F.count("*").alias("n"))
        small = written(parts.join(sizes.withColumn("rank", rank).where("rank > 1").select(by, "part"), [by, "part"]))
        if small.isEmpty():
            break
        cells = lambda rows: [F.floor(F.col(c) / radius).alias(f"g{k}") for k, c in enumerate(places)]  # noqa: B023, E731
        a = small.select(by, F.col(key).alias("a"), "part", *[F.col(c).alias(f"a{k}") for k, c in enumerate(places)], *cells(small))
        for k in range(len(places)):
            a = a.withColumn(f"g{k}", F.explode(F.array(*[F.col(f"g{k}") + s for s in (-1, 0, 1)])))
        b = parts.join(small.select(by).distinct(), by, "left_semi").select(by, F.col(key).alias("b"), F.col("part").alias("other"), *[F.col(c).alias(f"b{k}") for k, c in enumerate(places)], *cells(parts))
        gap = distance([F.col(f"a{k}") for k in range(len(places))], [F.col(f"b{k}") for k in range(len(places))])
        seen = a.join(b, [by, *[f"g{k}" for k in range(len(places))]]).where("part != other").withColumn("distance", gap).where(F.col("distance") <= radius)
        # of two parts only the shortest edge can be taken; the largest part has its edges from the others, which all look
        edge = F.struct("distance", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        seen = seen.groupBy(by, "part", "other").agg(F.min(edge).alias("e"))
        seen = written(seen.select(by, "part", "other", "e", F.explode(F.array(F.lit(False), F.lit(True))).alias("turned")).select(by, F.when(F.col("turned"), F.col("other")).otherwise(F.col("part")).alias("part"), F.when(F.col("turned"), F.col("part")).otherwise(F.col("other")).alias("other"), "e").groupBy(by, "part", "other").agg(F.min("e").alias("e")))
        whole = None
        while True:
            best = written(seen.groupBy(by, "part").agg(F.min(F.struct("e", "other")).alias("m")).select(by, "part", "m.e.*", "m.other"))
            if best.isEmpty():
                break
            new = best.select(by, "a", "b", "distance").distinct()
            found = new if found is None else found.unionByName(new)
            joined = components(best.select(F.struct(F.col(by).alias("by"), "part").alias("a"), F.struct(F.col(by).alias("by"), F.col("other").alias("part")).alias("b")))
            joined = joined.select(F.col("node.by").alias(by), F.col("node.part").alias("part"), F.col("component.part").alias("whole"))
            whole = joined if whole is None else written(whole.join(joined.select(by, F.col("part").alias("whole"), F.col("whole").alias("_next")), [by, "whole"], "left").select(by, "part", F.coalesce("_next", "whole").alias("whole")).unionByName(joined.join(whole.select(by, "part"), [by, "part"], "left_anti")))
            here, there = (joined.select(by, F.col("part").alias(c), F.col("whole").alias(f"_{c}")) for c in ("part", "other"))
            moved = seen.join(here, [by, "part"], "left").join(there, [by, "other"], "left").select(by, F.coalesce("_part", "part").alias("part"), F.coalesce("_other", "other").alias("other"), "e")
            seen = written(moved.where("part != other").groupBy(by, "part", "other").agg(F.min("e").alias("e")))
        if whole is not None:
            parts = written(parts.join(whole, [by, "part"], "left").select(by, key, *places, F.coalesce("whole", "part").alias("part")))
        radius *= 2
    return found if found is not None else parts.select(by, F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("distance")).limit(0)


def longest_edge(points: DataFrame, by: str, key: str = "label_id", radius: float = 30.0, places: tuple[str, ...] = XYZ) -> DataFrame:
    """by, longest: the least distance at which each group's points hang together; 0 for a single point."""
    most = tree_edges(points, by, key, radius, places).groupBy(by).agg(F.max("distance").alias("longest"))
    return points.where(F.col(by).isNotNull()).select(by).distinct().join(most, by, "left").select(by, F.coalesce("longest", F.lit(0.0)).alias("longest"))
