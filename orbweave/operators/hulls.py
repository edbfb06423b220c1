"""Convex hulls of groups of points in space, and the points inside of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.geometry import faces_volume, hull_faces
from orbweave.operators.ranges import written
from orbweave.operators.spatial import XYZ, _placed

#: A point counts as outside beyond this part of the group's extent.
TOLERANCE = 1e-11


def _solve(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hull of each row's corners: planes (outward, of unit length), volume, corners and tolerance."""
    for pdf in stream:
        planes, volumes, counts, slack = [], [], [], []
        for corners in pdf.pop("corners"):
            p = np.array([list(c.values()) for c in corners], float)
            faces = hull_faces(p)
            normal = np.cross(faces[:, 1] - faces[:, 0], faces[:, 2] - faces[:, 0])
            long = np.linalg.norm(normal, axis=1)
            normal, faces = normal[long > 0] / long[long > 0, None], faces[long > 0]
            planes.append([(*map(float, n), float(n @ f)) for n, f in zip(normal, faces[:, 0], strict=True)])
            volumes.append(faces_volume(faces))
            counts.append(len(np.unique(faces.reshape(-1, 3), axis=0)))
            slack.append(TOLERANCE * float(np.ptp(p, axis=0).max()))
        yield pdf.assign(planes=planes, volume=volumes, n_corners=counts, slack=slack)


def _beyond(places: tuple[str, ...]) -> Column:
    """(distance, number) of the plane that a point lies furthest beyond."""
    at = lambda f: f["a"] * F.col(places[0]) + f["b"] * F.col(places[1]) + f["c"] * F.col(places[2]) - f["d"]
    return F.array_max(F.transform("planes", lambda f, k: F.struct(at(f).alias("far"), k.alias("plane"))))


def convex_hulls(points: DataFrame, by: tuple[str, ...], places: tuple[str, ...] = XYZ) -> DataFrame:
    """by, planes, volume, n_corners, slack: the convex hull of each group; a volume of 0 and no planes where it is flat.

    The furthest points along 26 directions come from one aggregate, and their hull leaves only the points outside of it.
    Each round adds the furthest point beyond every plane and drops what is inside by now, until nothing is left: points
    stay where they are, and what is gathered of a group are its corners. Points without a place don't count, nor do groups of none (by is not null).
    """
    keys = list(by) or ["_all"]
    rows = points.where(_placed(points, places)).withColumn("_all", F.lit(0)).select(*keys, *[F.col(c).cast("double").alias(c) for c in places])
    ways = [w for w in product((-1, 0, 1), repeat=3) if any(w)]
    top = [F.max(F.struct(sum((F.col(c) * v for c, v in zip(places, w, strict=True)), F.lit(0.0)).alias("d"), *places)).alias(f"_{k}") for k, w in enumerate(ways)]
    pick = [F.struct(*[F.col(f"_{k}.{c}").alias(c) for c in places]) for k in range(len(ways))]
    corners = written(rows.groupBy(*keys).agg(*top).select(*keys, F.array_distinct(F.array(*pick)).alias("corners")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corners.select(*keys).schema)
    left = rows
    while True:
        hulls = written(corners.mapInPandas(_solve, f"{kinds}, planes array<struct<a:double,b:double,c:double,d:double>>, volume double, n_corners long, slack double"))
        met = left.join(hulls.select(*keys, "planes", "slack"), keys).withColumn("_b", _beyond(places))
        left = written(met.where(F.col("_b.far") > F.col("slack")).select(*keys, *places, "_b"))
        if left.isEmpty():
            return hulls.drop("_all")
        new = written(left.groupBy(*keys, "_b.plane").agg(F.max(F.struct("_b.far", *places)).alias("_t")).select(*keys, F.struct(*[F.col(f"_t.{c}").alias(c) for c in places]).alias("corner")).distinct())
        more = new.groupBy(*keys).agg(F.collect_list("corner").alias("_more"))
        corners = written(corners.join(more, keys, "left").select(*keys, F.when(F.col("_more").isNull(), F.col("corners")).otherwise(F.array_union("corners", "_more")).alias("corners")))
        left = left.select(*keys, *places).join(new.select(*keys, *[F.col(f"corner.{c}").alias(c) for c in places]), [*keys, *places], "left_anti")


def inside_hulls(points: DataFrame, hulls: DataFrame, by: tuple[str, ...], places: tuple[str, ...] = XYZ) -> DataFrame:
    """The points within the hull of their group, its surface included; none in a flat one."""
    side = hulls.select(*by, "planes", "slack")
    met = points.join(side, list(by)) if by else points.join(F.broadcast(side))  # one row: the hull of all
    return met.where((F.size("planes") > 0) & (_beyond(places)["far"] <= F.col("slack"))).select(*[F.col(f"`{c}`") for c in points.columns])
