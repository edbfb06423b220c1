"""Hulls and polygons: small numpy kernels, and the Column functions around them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in the plane, counter-clockwise from the lowest x; fewer than 3 if it has no area."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(q - out[-2], 0))[2] <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def polygon_area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = np.asarray(corners, float).T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a convex polygon inside another one, both counter-clockwise."""
    out = list(np.asarray(subject, float))
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        edge, given, out = b - a, out, []
        side = [edge[0] * (p[1] - a[1]) - edge[1] * (p[0] - a[0]) for p in given]
        for k, p in enumerate(given):
            q, s, t = given[k - 1], side[k], side[k - 1]
            if (s >= 0) != (t >= 0):
                out.append(q + (p - q) * (t / (t - s)))
            if s >= 0:
                out.append(p)
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def intersection_over_union(a: np.ndarray, b: np.ndarray) -> float | None:
    """Of two polygons, by their hulls; None where one has no area."""
    p, q = hull(a), hull(b)
    if len(p) < 3 or len(q) < 3:
        return None
    both = polygon_area(clip(p, q))
    return both / (polygon_area(p) + polygon_area(q) - both)


def hull_faces(points: np.ndarray) -> np.ndarray:
    """Triangles (m, 3, 3) of the convex hull in space, seen counter-clockwise from outside; none if the points lie in a plane.

    Points are added one at a time; the faces that see a new one give way to those from their rim to it.
    """
    p = np.unique(np.asarray(points, float).reshape(-1, 3), axis=0)
    if len(p) < 4:
        return np.empty((0, 3, 3))
    a = 0
    b = np.linalg.norm(p - p[a], axis=1).argmax()
    c = np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1).argmax()
    off = np.abs((p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a]))
    d, scale = off.argmax(), np.ptp(p, axis=0).max() or 1.0
    if off[d] <= 1e-9 * scale**3:
        return np.empty((0, 3, 3))
    inner = p[[a, b, c, d]].mean(0)

    def turned(faces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = p[faces]
        normal = np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0])
        back = ((x[:, 0] - inner) * normal).sum(1) < 0
        faces, normal = np.where(back[:, None], faces[:, [0, 2, 1]], faces), np.where(back[:, None], -normal, normal)
        return faces, normal, (normal * x[:, 0]).sum(1)

    faces, normal, off = turned(np.array([(a, b, c), (a, b, d), (a, c, d), (b, c, d)]))
    for k, q in enumerate(p):
        seen = normal @ q - off > 1e-10 * scale**3
        if not seen.any():
            continue
        edges = faces[seen][:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2)
        codes, back = edges[:, 0] * len(p) + edges[:, 1], edges[:, 1] * len(p) + edges[:, 0]
        rim = edges[~np.isin(codes, back)]
        new = turned(np.column_stack([rim, np.full(len(rim), k)]))
        faces, normal, off = (np.concatenate([old[~seen], more]) for old, more in zip((faces, normal, off), new, strict=True))
    return p[faces]


def faces_volume(faces: np.ndarray) -> float:
    if not len(faces):
        return 0.0
    x = faces - faces.reshape(-1, 3).mean(0)
    return float(abs((x[:, 0] * np.cross(x[:, 1], x[:, 2])).sum()) / 6)


def hull_volume(points: np.ndarray) -> float:
    """Volume of the convex hull in space; 0 if the points lie in a plane."""
    return faces_volume(hull_faces(points))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def hull_corners(points: pd.Series) -> pd.Series:
    return points.map(lambda p: None if p is None else hull(np.array([list(x) for x in p])).tolist())


@F.pandas_udf(T.DoubleType())
def hull_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    as_array = lambda p: np.array([list(x) for x in p])
    return pd.Series([None if p is None or q is None or len(p) < 3 or len(q) < 3 else intersection_over_union(as_array(p), as_array(q)) for p, q in zip(a, b, strict=True)], dtype="float64")


def shoelace(corners: Column) -> Column:
    """Area of array<array<double>> corners; null under three."""
    nxt = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    terms = F.zip_with(corners, nxt, lambda p, q: F.get(p, F.lit(0)) * F.get(q, F.lit(1)) - F.get(q, F.lit(0)) * F.get(p, F.lit(1)))
    return F.when(F.size(corners) >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2)


def crop_box(center: dict[str, float], halo: dict[str, float], size: dict[str, float], shape: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Start and stop in voxels on each axis, within the volume."""
    out = {}
    for c in center:
        mid, half = round(center[c] / size[c]), round(halo[c] / size[c])
        out[c] = (max(0, mid - half), min(shape[c], mid + half))
    return out


def downscale_factors(cell: float, size: tuple[float, float, float]) -> tuple[int, ...]:
    return tuple(max(1, round(cell / s)) for s in size)
