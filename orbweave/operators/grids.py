"""Sets of grid cells (z, y, x) in groups: growing, closing, exact depth, and least-cost paths through them.

A group (by columns, which are not null where groups meet) is one volume. A volume may have a box: lowest and highest cell (lo_z ... hi_x); cells outside of
it do not exist, neither as cells nor as background. No volume is ever gathered: axes are walked line by line, and paths spread
block by block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.ranges import written

ZYX = ("z", "y", "x")
#: Edge of the blocks that a path spreads through in one round.
BLOCK = 16
#: A cell at the border of a set costs 1 / (FLOOR + 1) to step on.
FLOOR = 1e-3
_HALF = 1 << 20


def boxes(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, lo_z ... hi_x: from 0, or the lowest cell where that is less, to the highest cell of each group."""
    return cells.groupBy(*by).agg(*[F.least(F.lit(0), F.min(c)).cast("long").alias(f"lo_{c}") for c in ZYX], *[F.max(c).cast("long").alias(f"hi_{c}") for c in ZYX])


def _inside() -> Column:
    test = F.lit(True)
    for c in ZYX:
        test = test & F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return test


def within(cells: DataFrame, box: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return cells.join(box, list(by)).where(_inside()).select(*by, *ZYX)


def grown(cells: DataFrame, box: DataFrame, by: tuple[str, ...], rounds: int = 1) -> DataFrame:
    """by, z, y, x: cells within so many steps of a 3 x 3 x 3 element, an axis at a time, cut to the box."""
    out = cells.select(*by, *ZYX)
    for c in ZYX:
        out = out.withColumn("_s", F.explode(F.sequence(F.lit(-rounds), F.lit(rounds)))).withColumn(c, (F.col(c) + F.col("_s")).cast("long")).drop("_s").distinct()
    return within(out, box, by)


def shrunk(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Cells all of whose 27 neighbours, itself included, are cells; beyond a box there are none."""
    out = cells.select(*by, *ZYX)
    for c in ZYX:
        out = out.withColumn("_s", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn(c, (F.col(c) + F.col("_s")).cast("long")).groupBy(*by, *ZYX).agg(F.count("*").alias("_n")).where("_n = 3").drop("_n")
    return out


def closed(cells: DataFrame, box: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Grown and shrunk once; like every array closing it loses what touches the box."""
    return shrunk(grown(cells, box, by), by)


def _lines(stream: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole lines out of sorted batches; the last line of a batch waits for the next one."""
    rest = None
    for batch in stream:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        begin = np.flatnonzero(_starts(table, keys))
        if begin[-1]:
            yield table.slice(0, int(begin[-1]))
        rest = table.slice(int(begin[-1]))
    if rest is not None:
        yield rest


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def envelope(line: np.ndarray, at: np.ndarray, cost: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For cells sorted by line and place: the least cost[j] + (at[j] - at[i])^2 over their own line, gaps within the box costing 0.

    A gap lies nearer than all behind it, so only a cell's own run counts. The runs are searched outward from all cells
    at once, and only from those that a further cell could still lower.
    """
    new = np.ones(len(at), bool)
    new[1:] = (line[1:] != line[:-1]) | (at[1:] != at[:-1] + 1)
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    index = np.arange(len(at))
    left, right = at - at[first][run] + 1.0, at[last][run] - at + 1.0
    left[at[first][run] == low] = np.inf  # no gap but the box on this side
    right[at[last][run] == high] = np.inf
    out = np.minimum(cost, np.minimum(left, right) ** 2)
    todo, step = index, 1
    while len(todo):
        todo = todo[(out[todo] > step * step) & ((todo - step >= first[run[todo]]) | (todo + step <= last[run[todo]]))]
        for shift in (-step, step):
            ok = todo[(todo + shift >= first[run[todo]]) & (todo + shift <= last[run[todo]])]
            out[ok] = np.minimum(out[ok], cost[ok + shift] + float(step * step))
        step += 1
    return out


def _axis(by: tuple[str, ...], axis: str):
    """mapInArrow function on sorted cells: the same rows, their cost lowered along one axis."""
    keys = [*by, *[c for c in ZYX if c != axis]]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lines(stream, keys):
            at, cost, low, high = (table.column(c).to_numpy() for c in (axis, "cost", f"lo_{axis}", f"hi_{axis}"))
            cost = envelope(np.cumsum(_starts(table, keys)), at, cost, low, high)
            yield from table.set_column(table.schema.get_field_index("cost"), "cost", pa.array(cost)).combine_chunks().to_batches()

    return run


def depth(cells: DataFrame, box: DataFrame | None, by: tuple[str, ...]) -> DataFrame:
    """by, z, y, x, depth: the exact distance of each cell to the nearest place of its box that is no cell; infinite without one.

    Squared distances along x, then the least sums along y and z: three shuffles by line, each line walked in order. Without a
    box all space around the cells is empty.
    """
    far = {f"{s}_{c}": F.lit(v).cast("long") for s, v in (("lo", -(1 << 40)), ("hi", 1 << 40)) for c in ZYX}
    rows = cells.select(*by, *[F.col(c).cast("long").alias(c) for c in ZYX]).distinct()
    rows = rows.join(box, list(by)) if box is not None else rows.withColumns(far)
    rows = rows.withColumn("cost", F.lit(float("inf")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    for axis in reversed(ZYX):
        others = [c for c in ZYX if c != axis]
        rows = rows.repartition(*by, *others).sortWithinPartitions(*by, *others, axis).mapInArrow(_axis(by, axis), kinds)
    return rows.select(*by, *ZYX, F.sqrt("cost").alias("depth"))


def cell_id() -> Column:
    """One number for a cell, in the order of z, y, x."""
    return sum(((F.col(c) + _HALF) * (1 << 21 * k) for k, c in enumerate(reversed(ZYX))), F.lit(0)).cast("long")


def _block(c: str) -> Column:
    return F.floor(F.col(c) / BLOCK)


def _around(pdf: pd.DataFrame) -> tuple[list[list[int]], list[float]]:
    """The face neighbours of each row, smallest first, and the depths."""
    places = list(zip(pdf.z.tolist(), pdf.y.tolist(), pdf.x.tolist(), strict=True))
    number = {p: k for k, p in enumerate(places)}
    steps = ((-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0))
    return [[j for a, b, c in steps if (j := number.get((z + a, y + b, x + c))) is not None] for z, y, x in places], pdf.depth.tolist()


def _falling(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: costs fall along faces as far as they can; ghosts are the neighbours' cells that fell. A block that nobody told anything stays."""
    own = ~pdf.ghost.to_numpy()
    out = pdf[own].drop(columns=["ghost"])
    ghosts = pdf[~own]
    if ghosts.empty and not (pdf.fell & (pdf.cost == 0)).any():
        return out.assign(fell=False)
    around, deep = _around(pdf)
    cost, ghost = pdf.cost.tolist(), pdf.ghost.tolist()
    heap = [(c, k) for k, c in enumerate(cost) if c == 0 or (ghost[k] and np.isfinite(c))]
    heapq.heapify(heap)
    while heap:
        c, k = heapq.heappop(heap)
        if c > cost[k]:
            continue
        for j in around[k]:
            if not ghost[j] and (n := c + 1.0 / (FLOOR + min(deep[k], deep[j]))) < cost[j]:
                cost[j] = n
                heapq.heappush(heap, (n, j))
    new = np.array(cost)[own]
    return out.assign(fell=new < out.cost.to_numpy(), cost=new)


def _traced(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block and all ghosts around it: who comes before each cell, the smallest among equals."""
    around, deep = _around(pdf)
    cost, own = pdf.cost.tolist(), ~pdf.ghost.to_numpy()
    first = lambda k: next((j for j in around[k] if cost[j] + 1.0 / (FLOOR + min(deep[k], deep[j])) == cost[k]), -1) if 0 < cost[k] < np.inf else -1
    back = np.array([first(k) for k in np.flatnonzero(own)])
    out = pdf[own].drop(columns=["ghost", "fell"])
    for c in ZYX:
        out[f"before_{c}"] = pd.array([pdf[c].iat[j] if j >= 0 else None for j in back], "Int64")
    return out


def spread(cells: DataFrame, starts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, z, y, x, depth, cost, before_z, before_y, before_x: least costs from each group's start, and the cell before.

    A step between face neighbours costs 1 / (FLOOR + the lesser depth). Costs spread within blocks of BLOCK cells
    an edge; then blocks whose border fell tell their neighbours, round after round, until nothing falls. A task holds blocks one by one,
    and the rounds grow with the number of blocks that a path crosses. Among equal ways the cell before is the
    smallest one. Cells that can't be reached have an infinite cost.
    """
    at = starts.select(*by, *ZYX, F.lit(0.0).alias("_zero"))
    blocks = [f"b{c}" for c in ZYX]
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = cells.join(at, [*by, *ZYX], "left").select(*by, *ZYX, F.col("depth").cast("double").alias("depth"), F.coalesce("_zero", F.lit(float("inf"))).alias("cost"), F.col("_zero").isNotNull().alias("fell"), *[_block(c).alias(f"b{c}") for c in ZYX])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name != "fell")
    state = written(state)
    moves = F.array(*[F.struct(*[F.lit(s if c == axis else 0).alias(c) for c in ZYX]) for axis in ZYX for s in (-1, 1)])

    def met(told: Column) -> DataFrame:
        sent = state.where(told).withColumn("_m", F.explode(moves))
        sent = sent.select(*by, *ZYX, "depth", "cost", *[F.floor((F.col(c) + F.col(f"_m.{c}")) / BLOCK).alias(f"b{c}") for c in ZYX], *[F.col(b).alias(f"_{b}") for b in blocks])
        apart = F.lit(False)
        for b in blocks:
            apart = apart | (F.col(b) != F.col(f"_{b}"))
        ghosts = sent.where(apart).select(*by, *ZYX, "depth", "cost", *blocks, F.lit(True).alias("ghost"))
        return state.select(*by, *ZYX, "depth", "cost", *blocks, F.lit(False).alias("ghost"), "fell").unionByName(ghosts.withColumn("fell", F.lit(True))).coalesce(tasks)

    while True:
        walked = met(F.col("fell")).groupBy(*by, *blocks).applyInPandas(_falling, kinds + ", fell boolean")
        state = written(walked)
        if state.where("fell").isEmpty():
            break
    traced = met(F.lit(True)).groupBy(*by, *blocks).applyInPandas(_traced, kinds + ", " + ", ".join(f"before_{c} long" for c in ZYX))
    return written(traced.select(*by, *ZYX, "depth", "cost", *[f"before_{c}" for c in ZYX]))


def least_paths(cells: DataFrame, ends: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, node_idx, z, y, x of the cheapest path from each group's start (ends: by, start_z ... end_x) to its end; no rows without a path.

    cells: by, z, y, x, depth. The path is read back by doubling: each round adds, for all cells found, those as many steps before.
    """
    side = lambda s: ends.select(*by, *[F.col(f"{s}_{c}").alias(c) for c in ZYX])
    costs = spread(cells, side("start"), by)
    back = {c: F.col(f"before_{c}") for c in ZYX}
    named = costs.where("cost < double('infinity')").withColumns({"id": cell_id(), "before": sum(((back[c] + _HALF) * (1 << 21 * k) for k, c in enumerate(reversed(ZYX))), F.lit(0)).cast("long")})
    named = written(named.select(*by, *ZYX, "cost", "id", "before"))
    found = written(side("end").withColumn("id", cell_id()).join(named.select(*by, "id"), [*by, "id"], "left_semi").select(*by, "id"))
    jump = named.where("before is not null").select(*by, "id", "before")
    while True:
        more = found.join(jump, [*by, "id"]).select(*by, F.col("before").alias("id"))
        both = written(found.unionByName(more).distinct())
        if both.count() == found.count():
            break
        found = both
        far = jump.select(*by, F.col("id").alias("before"), F.col("before").alias("far"))
        jump = written(jump.join(far, [*by, "before"]).select(*by, "id", F.col("far").alias("before")))
    order = Window.partitionBy(*by).orderBy("cost", "id")
    return named.join(found, [*by, "id"], "left_semi").select(*by, (F.row_number().over(order) - 1).cast("long").alias("node_idx"), *ZYX)


def axis_end_cells(cells: DataFrame, by: tuple[str, ...], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """by, start_z ... end_x: the cells furthest along each group's axis of largest spread, the first in the order of x, y, z among equals.

    Six covariances of a group are all that a task sees of it.
    """
    pairs = [(p, q) for i, p in enumerate(axes) for q in axes[i:]]
    moments = cells.groupBy(*by).agg(*[F.coalesce(F.covar_samp(p, q), F.lit(0.0)).alias(f"{p}{q}") for p, q in pairs])

    def solve(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in stream:
            m = np.zeros((len(pdf), 3, 3))
            for p, q in pairs:
                i, j = axes.index(p), axes.index(q)
                m[:, i, j] = m[:, j, i] = pdf[f"{p}{q}"]
            axis = np.linalg.eigh(m)[1][:, :, -1]
            big = np.take_along_axis(axis, np.abs(axis).argmax(1)[:, None], 1)
            axis = axis * np.where(big < 0, -1, 1)
            yield pdf[list(by)].assign(**{f"along_{c}": axis[:, k] for k, c in enumerate(axes)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.select(*by).schema)
    axis = moments.mapInPandas(solve, f"{kinds}, " + ", ".join(f"along_{c} double" for c in axes))
    along = sum((F.col(c) * F.col(f"along_{c}") for c in axes), F.lit(0.0))
    low = F.min(F.struct(along.alias("p"), *axes)).alias("low")
    high = F.min(F.struct((-along).alias("p"), *axes)).alias("high")
    ends = cells.join(axis, list(by)).groupBy(*by).agg(low, high)
    return ends.select(*by, *[F.col(f"low.{c}").alias(f"start_{c}") for c in ZYX], *[F.col(f"high.{c}").alias(f"end_{c}") for c in ZYX])


def coarse(objects: DataFrame, scale: Column | float, by: tuple[str, ...]) -> DataFrame:
    """by, z, y, x: cells of the given edge that hold an object."""
    edge = scale if isinstance(scale, Column) else F.lit(float(scale))
    return objects.select(*by, *[F.floor(F.col(f"anchor_{c}") / edge).cast("long").alias(c) for c in ZYX]).distinct()


def all_cells(box: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, z, y, x: every cell of the boxes."""
    out = box
    for c in ZYX:
        out = out.withColumn(c, F.explode(F.sequence(f"lo_{c}", f"hi_{c}")))
    return out.select(*by, *ZYX)


def gaps(targets: DataFrame, box: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, z, y, x, depth: the distance of every cell of the box to the nearest target; infinite in a group without any."""
    goal = targets.select(*by, *ZYX).distinct()
    free = depth(all_cells(box, by).join(goal, [*by, *ZYX], "left_anti"), box, by)
    return free.unionByName(within(goal, box, by).withColumn("depth", F.lit(0.0)))


def downhill(seeds: DataFrame, targets: DataFrame, box: DataFrame, by: tuple[str, ...], rounds: int = 20, offset: float = 0.4) -> DataFrame:
    """by, z, y, x: the seeds grown along faces towards the targets only, at most so many rounds, and until a round adds nothing.

    A cell comes in if it is closer to the nearest target, by more than the offset, than each of the face neighbours it may grow from.
    Only the frontier travels. A cell is asked once: later rounds can only add neighbours that are closer still, so a cell that was
    refused stays out. Seeds of a group without targets stay as they are.
    """
    tasks = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gap = written(gaps(targets, box, by))
    moves = F.array(*[F.struct(*[F.lit(s if c == axis else 0).alias(c) for c in ZYX]) for axis in ZYX for s in (-1, 1)])
    seen = written(seeds.select(*by, *ZYX).distinct().join(gap, [*by, *ZYX]).withColumn("inside", F.lit(True)))
    front = seen
    for _ in range(rounds):
        sent = front.withColumn("_m", F.explode(moves)).select(*by, *[(F.col(c) + F.col(f"_m.{c}")).cast("long").alias(c) for c in ZYX], F.col("depth").alias("source"))
        asked = sent.groupBy(*by, *ZYX).agg(F.min("source").alias("source")).join(gap, [*by, *ZYX]).join(seen.select(*by, *ZYX), [*by, *ZYX], "left_anti")
        asked = written(asked.select(*by, *ZYX, "depth", (F.col("depth") < F.col("source") - offset).alias("inside")))
        front = asked.where("inside")
        seen = seen.unionByName(asked).coalesce(tasks)
        if front.isEmpty():
            break
    return seen.where("inside").select(*by, *ZYX)
