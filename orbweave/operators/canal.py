"""The run along the larger cell type: central paths through coarse masks, chained over components, and objects mapped to them.

A component's objects become a coarse mask; its path keeps to the mask's middle. Paths of components are then turned and put behind each
other. What a task sees of a path when paths are chained is its two ends; voxels, nodes and objects stay in tables.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.scalar import GREENWOOD
from orbweave.operators import grids
from orbweave.operators.ordered import moving_average, path_length
from orbweave.operators.ranges import written
from orbweave.operators.summaries import outer_ends

XYZ = ("x", "y", "z")
#: Coarse cells start with this edge; it doubles up to MOST where a mask has no path.
SCALE, MOST = 10, 100
HALF_WINDOW = 3


def mask_paths(objects: DataFrame, scales: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, scale, node_idx, z, y, x (cells) of the central path of each group's mask; groups whose mask has none are missing."""
    cells = written(grids.coarse(objects.join(scales, list(by)), F.col("scale"), by))
    box = written(grids.boxes(cells, by))
    mask = written(grids.closed(grids.grown(cells, box, by), box, by))
    ends = written(grids.axis_end_cells(mask, by))
    return grids.least_paths(grids.depth(mask, box, by), ends, by).join(scales, list(by))


def central_paths(objects: DataFrame, components: tuple, by: str = "dataset", component: str = "component_labels", scale: int = SCALE) -> DataFrame:
    """by, component, place (of the component in the list, from 0), node_idx, x, y, z: smoothed central paths, in micrometres.

    The coarse edge starts at `scale` and doubles for a component whose mask is not one piece between its ends; components
    behind it in the list take at least the same edge. Components that have no path at MOST are left out.
    """
    group = (by, component)
    order = F.coalesce(*[F.when(F.col(component) == c, k) for k, c in enumerate(components)])
    chosen = objects.where(F.col(component).isin(*components) & F.col(by).isNotNull()).select(*group, *[f"anchor_{c}" for c in XYZ])
    todo = written(chosen.select(*group).distinct().select(*group, order.cast("int").alias("place"), F.lit(scale).alias("scale")))
    done = None
    while True:
        found = written(mask_paths(chosen, todo.select(*group, "scale"), group))
        stale = todo.select(*group)
        done = found if done is None else written(done.join(stale, list(group), "left_anti").unionByName(found))
        reached = done.select(*group, "scale").distinct().withColumn("again", F.lit(False))
        failed = todo.join(reached, list(group), "left_anti").select(*group, (F.col("scale") * 2).alias("scale"), F.lit(True).alias("again")).where(F.col("scale") <= MOST)
        # a coarser edge holds for all components behind
        state = reached.unionByName(failed).withColumn("place", order.cast("int"))
        least = F.max("scale").over(Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        todo = written(state.withColumn("least", least).where(F.col("again") | (F.col("least") > F.col("scale"))).select(*group, "place", F.col("least").alias("scale")))
        if todo.isEmpty():
            break
    nodes = done.select(*group, F.struct(*group).alias("path"), "node_idx", *[(F.col(c) * F.col("scale")).alias(c) for c in XYZ])
    smooth = moving_average(nodes, HALF_WINDOW, "path", "node_idx", integer=True)
    return smooth.select(*group, order.cast("int").alias("place"), "node_idx", *[F.col(c).cast("double").alias(c) for c in XYZ])


def _gap(a: dict, b: dict) -> float:
    return math.dist(a["at"], b["at"])


def _straightness(a: dict, b: dict, nearest: float) -> float:
    """How well a gap goes straight on from both ends, discounted by how much longer it is than the nearest one."""
    gap = _gap(a, b)
    if not gap:
        return 0.0
    flow = sum((t - u) * (q - p) / gap for p, q, t, u in zip(a["at"], b["at"], a["out"], b["out"], strict=True))
    return flow * nearest / gap


def _better(pairs: list[tuple[dict, dict]], unclear: float, long_enough: bool) -> int:
    """Which pair of ends to join: the nearest, or the straighter of the nearest two where their gaps hardly differ."""
    gaps = [_gap(a, b) for a, b in pairs]
    one, two = sorted(range(len(pairs)), key=gaps.__getitem__)[:2]
    if long_enough and gaps[two] - gaps[one] < unclear:
        score = lambda k: _straightness(*pairs[k], gaps[one])
        return one if score(one) >= score(two) else two
    return one


def turned(paths: list[dict], unclear: float, least_length: float, apex_higher: bool) -> list[tuple[int, bool]]:
    """(index, backwards) of the paths in their order along the whole run, out of each path's ends and length.

    paths: {"start": end, "end": end, "length"}; an end is {"at": place, "out": tangent}.
    """
    back = [False] * len(paths)
    side = lambda k, name: paths[k][name if not back[k] else {"start": "end", "end": "start"}[name]]
    long_enough = lambda k: min(paths[k]["length"], paths[k + 1]["length"]) >= least_length
    if len(paths) > 1:
        ends = [(a, b) for a in ("start", "end") for b in ("start", "end")]
        back[0] = ends[_better([(paths[0][a], paths[1][b]) for a, b in ends], unclear, long_enough(0))][0] == "start"
    for k in range(len(paths) - 1):
        back[k + 1] = _better([(side(k, "end"), paths[k + 1][b]) for b in ("start", "end")], unclear, long_enough(k)) == 1
    order = list(enumerate(back))
    falls = side(0, "start")["at"][1] > side(len(paths) - 1, "end")["at"][1]
    if falls != apex_higher:
        order = [(k, not b) for k, b in reversed(order)]
    return order


def chained(nodes: DataFrame, by: str = "dataset", component: str = "component_labels", unclear: float = 200.0, least_length: float = 600.0, apex_higher: bool = True, include_gap: bool = False) -> DataFrame:
    """by, node_idx, component, x, y, z, length, length_fraction of the whole run; the end with the higher y comes first.

    nodes are central_paths. Steps between components count 0 unless include_gap. A group that is turned in a task has two
    rows for each component.
    """
    paths = nodes.withColumn("path", F.struct(by, "place"))
    lengths = path_length(paths, "path", "node_idx")
    ends = outer_ends(paths.select("path", "node_idx", *XYZ), "path").join(lengths, "path").select(f"path.{by}", "path.place", "side", *XYZ, *[f"tangent_{c}" for c in XYZ], "length")
    kind = nodes.schema[by].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = []
        for _, rows in pdf.sort_values("place").groupby("place"):
            path = {r.side: {"at": (r.x, r.y, r.z), "out": (r.tangent_x, r.tangent_y, r.tangent_z)} for r in rows.itertuples()}
            listed.append(path | {"length": float(rows.length.iloc[0]), "place": int(rows.place.iloc[0])})
        order = turned(listed, unclear, least_length, apex_higher)
        return pd.DataFrame({by: pdf[by].iloc[0], "place": [listed[k]["place"] for k, _ in order], "turn": range(len(order)), "back": [b for _, b in order]})

    turns = ends.groupBy(by).applyInPandas(solve, f"`{by}` {kind}, place int, turn int, back boolean")
    rows = nodes.join(turns, [by, "place"]).withColumn("at", F.when(F.col("back"), -F.col("node_idx")).otherwise(F.col("node_idx")))
    order = Window.partitionBy(by).orderBy("turn", "at")
    before = {c: F.lag(c).over(order) for c in XYZ}
    step = F.sqrt(sum(((F.col(c) - before[c]) * (F.col(c) - before[c]) for c in XYZ), F.lit(0.0)))
    counted = F.lit(True) if include_gap else F.col("turn") == F.lag("turn").over(order)
    rows = rows.withColumns({"node": (F.row_number().over(order) - 1).cast("long"), "step": F.coalesce(F.when(counted, step), F.lit(0.0))})
    whole = Window.partitionBy(by)
    rows = rows.withColumn("length", F.sum("step").over(Window.partitionBy(by).orderBy("node").rowsBetween(Window.unboundedPreceding, 0)))
    fraction = F.when(F.col("node") == F.max("node").over(whole), 1.0).otherwise(F.coalesce(F.try_divide("length", F.max("length").over(whole)), F.lit(0.0)))
    return rows.select(by, F.col("node").alias("node_idx"), component, *XYZ, "length", fraction.alias("length_fraction"))


def nearest_by(objects: DataFrame, nodes: DataFrame, by: str = "dataset", key: str = "label_id", radius: float = 50.0) -> DataFrame:
    """by, key, node_idx, offset: each object's nearest node of its own group, the first among equals; groups without nodes are left out.

    Both meet in cells as wide as the radius, which doubles for objects that have no node in the cells around.
    """
    placed = nodes.select(by, "node_idx", *XYZ)
    todo = written(objects.join(placed.select(by).distinct(), by, "left_semi").select(by, key, *[f"anchor_{c}" for c in XYZ]).distinct())
    for c in XYZ:
        todo = todo.where(F.col(f"anchor_{c}").isNotNull() & ~F.isnan(f"anchor_{c}"))
    out = None
    while True:
        cell = lambda c: F.floor(F.col(c) / radius)  # noqa: B023, E731
        a = todo.select("*", *[cell(f"anchor_{c}").alias(f"g{c}") for c in XYZ])
        b = placed.select("*", *[cell(c).alias(f"g{c}") for c in XYZ])
        for c in XYZ:
            b = b.withColumn(f"g{c}", F.explode(F.array(*[F.col(f"g{c}") + s for s in (-1, 0, 1)])))
        gap = F.sqrt(sum(((F.col(f"anchor_{c}") - F.col(c)) * (F.col(f"anchor_{c}") - F.col(c)) for c in XYZ), F.lit(0.0)))
        near = a.join(b, [by, *[f"g{c}" for c in XYZ]]).groupBy(by, key).agg(F.min(F.struct(gap.alias("offset"), "node_idx")).alias("n")).where(F.col("n.offset") <= radius)
        near = written(near.select(by, key, "n.node_idx", "n.offset"))
        out = near if out is None else out.unionByName(near)
        todo = written(todo.join(near.select(by, key), [by, key], "left_anti"))
        if todo.isEmpty():
            return out
        radius *= 2


def frequency(fraction: Column, animal: str = "mouse") -> Column:
    scale, slope, shift = GREENWOOD[animal]
    return scale * (F.pow(F.lit(10.0), slope * fraction) - shift)


def mapped(objects: DataFrame, run: DataFrame, components: tuple, by: str = "dataset", component: str = "component_labels", key: str = "label_id", animal: str = "mouse") -> DataFrame:
    """key, by, offset, length_fraction, length, frequency of each object by its nearest node of the run; -1 and 0 for other components."""
    total = run.groupBy(by).agg(F.max("length").alias("total"))
    near = nearest_by(objects.where(F.col(component).isin(*components)), run, by, key).join(run.select(by, "node_idx", "length_fraction"), [by, "node_idx"]).join(total, by)
    found = near.select(by, key, "offset", "length_fraction", (F.col("length_fraction") * F.col("total")).alias("length"), frequency(F.col("length_fraction"), animal).alias("frequency"))
    return objects.select(key, by).join(found, [by, key], "left").select(key, by, F.coalesce("offset", F.lit(-1.0)).alias("offset"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("length_fraction", "length", "frequency")])


def measure_run_length(objects: DataFrame, components: tuple, by: str = "dataset", component: str = "component_labels", scale: int = SCALE, **options) -> DataFrame:
    """central_paths and chained together: the run of the larger cell type of each data set."""
    return chained(written(central_paths(objects, components, by, component, scale)), by, component, **options)


def organ_mask(larger: DataFrame, smaller: DataFrame, by: str = "dataset", scale: tuple[float, float, float] = (18.24, 18.24, 18.24), rounds: int = 12, padding: float = 456.0, method: str = "individual", guided_rounds: int = 20, offset: float = 0.4) -> DataFrame:
    """by, z, y, x: coarse cells of both cell types and of what lies between them.

    scale: edge of a cell in the units of the anchors, for x, y, z. The smaller type grows towards the larger one; then both, and what has grown, are
    dilated: each by `rounds` and all by one more ('individual'), all together by `rounds` ('combined'), or not at all (any other).
    The volume ends `padding` behind the last object.
    """
    edge = dict(zip(XYZ, scale, strict=True))
    group = (by,)
    cells = lambda t: t.where(F.col(by).isNotNull()).select(by, *[F.floor(F.col(f"anchor_{c}") / edge[c]).cast("long").alias(c) for c in grids.ZYX]).distinct()
    both = larger.select(by, *[f"anchor_{c}" for c in XYZ]).unionByName(smaller.select(by, *[f"anchor_{c}" for c in XYZ]))
    lows = [F.least(F.lit(0), F.min(F.floor(F.col(f"anchor_{c}") / edge[c]))).cast("long").alias(f"lo_{c}") for c in grids.ZYX]
    box = written(both.where(F.col(by).isNotNull()).groupBy(by).agg(*lows, *[F.floor((F.max(f"anchor_{c}") + padding) / edge[c]).cast("long").alias(f"hi_{c}") for c in grids.ZYX]))
    a, b = written(cells(larger)), written(cells(smaller))
    between = written(grids.downhill(b, a, box, group, guided_rounds, offset))
    if method == "individual":
        parts = between.unionByName(grids.grown(b, box, group, rounds)).unionByName(grids.grown(a, box, group, rounds)).distinct()
        return grids.grown(parts, box, group, 1)
    parts = between.unionByName(a).unionByName(b).distinct()
    return grids.grown(parts, box, group, rounds) if method == "combined" else parts


def type_mask(objects: DataFrame, by: str = "dataset", scale: tuple[float, float, float] = (18.24, 18.24, 18.24), rounds: int = 12, padding: float = 456.0) -> DataFrame:
    """by, z, y, x: coarse cells of one cell type, dilated by so many rounds and closed; 0 closes only, less leaves them as they are."""
    edge = dict(zip(XYZ, scale, strict=True))
    rows = objects.where(F.col(by).isNotNull())
    cells = written(rows.select(by, *[F.floor(F.col(f"anchor_{c}") / edge[c]).cast("long").alias(c) for c in grids.ZYX]).distinct())
    lows = [F.least(F.lit(0), F.min(F.floor(F.col(f"anchor_{c}") / edge[c]))).cast("long").alias(f"lo_{c}") for c in grids.ZYX]
    box = written(rows.groupBy(by).agg(*lows, *[F.floor((F.max(f"anchor_{c}") + padding) / edge[c]).cast("long").alias(f"hi_{c}") for c in grids.ZYX]))
    if rounds < 0:
        return cells
    return grids.closed(grids.grown(cells, box, (by,), rounds) if rounds else cells, box, (by,))
