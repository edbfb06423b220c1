"""Plain kernels on one component: what the tests hold `trees`, `grids` and `sweeps` against."""

from __future__ import annotations

import heapq

import numpy as np


def distances(p: np.ndarray) -> np.ndarray:
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))


def longest_tree_edge(p: np.ndarray) -> float:
    """The longest edge of the minimum spanning tree."""
    if len(p) < 2:
        return 0.0
    far, inside, most = np.full(len(p), np.inf), np.zeros(len(p), bool), 0.0
    far[0] = 0
    for _ in range(len(p)):
        k = int(np.where(inside, np.inf, far).argmin())
        most, inside[k] = max(most, far[k]), True
        far = np.minimum(far, np.sqrt(((p - p[k]) ** 2).sum(1)))
    return float(most)


def shortest(neighbors: list[list[tuple[int, float]]], start: int) -> tuple[np.ndarray, list[int]]:
    """Distances from a node and the node before each one."""
    far, before, heap = np.full(len(neighbors), np.inf), [-1] * len(neighbors), [(0.0, start)]
    far[start] = 0
    while heap:
        d, k = heapq.heappop(heap)
        if d > far[k]:
            continue
        for j, w in neighbors[k]:
            if d + w < far[j]:
                far[j], before[j] = d + w, k
                heapq.heappush(heap, (d + w, j))
    return far, before


def radius_graph(p: np.ndarray, radius: float) -> list[list[tuple[int, float]]]:
    d = distances(p)
    return [[(int(j), float(d[k, j])) for j in np.flatnonzero(d[k] <= radius) if j != k] for k in range(len(p))]


def most_distant(graph: list[list[tuple[int, float]]]) -> tuple[int, int]:
    """The pair of nodes that are furthest apart along the graph, the first among equals."""
    best = (-1.0, 0, 0)
    for k in range(len(graph)):
        far = shortest(graph, k)[0]
        far[~np.isfinite(far)] = -1
        j = int(far.argmax())
        if far[j] > best[0]:
            best = (float(far[j]), k, j)
    return best[1], best[2]


def fewest_hops(graph: list[list[tuple[int, float]]], a: int, b: int) -> list[int]:
    before = shortest([[(j, 1.0) for j, _ in row] for row in graph], a)[1]
    out = [b]
    while out[-1] != a:
        if before[out[-1]] < 0:
            return []
        out.append(before[out[-1]])
    return out[::-1]


def smooth(p: np.ndarray, half: int) -> np.ndarray:
    padded = np.pad(p.astype(float), ((half, half), (0, 0)), "edge")
    return np.stack([np.convolve(padded[:, k], np.ones(2 * half + 1) / (2 * half + 1), "valid") for k in range(p.shape[1])], 1)


def distance_to_background(mask: np.ndarray) -> np.ndarray:
    """Exact distance of each cell to the nearest empty one, an axis at a time by lower envelopes."""
    big = float(sum(s * s for s in mask.shape)) + 1
    d = np.where(mask, big, 0.0)
    for axis in range(mask.ndim):
        n = mask.shape[axis]
        rows = np.moveaxis(d, axis, -1)
        gap = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2
        d = np.moveaxis((rows[..., None, :] + gap).min(-1), -1, axis)
    return np.sqrt(d)


def central_cells(mask: np.ndarray, a: tuple, b: tuple) -> list[tuple]:
    """The path between two cells of a mask that keeps to its middle: steps cost 1 / (0.001 + depth)."""
    depth = distance_to_background(np.pad(mask, 1))[tuple(slice(1, -1) for _ in mask.shape)]
    cells = [tuple(map(int, c)) for c in np.argwhere(mask)]
    number = {c: k for k, c in enumerate(cells)}
    graph: list[list[tuple[int, float]]] = []
    for c in cells:
        row = []
        for axis in range(mask.ndim):
            for s in (-1, 1):
                e = tuple(x + s * (k == axis) for k, x in enumerate(c))
                if e in number:
                    row.append((number[e], 1 / (1e-3 + min(depth[c], depth[e]))))
        graph.append(row)
    before = shortest(graph, number[a])[1]
    out = [number[b]]
    while out[-1] != number[a]:
        if before[out[-1]] < 0:
            return []
        out.append(before[out[-1]])
    return [cells[k] for k in out[::-1]]
