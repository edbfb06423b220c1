"""Distances along graphs of objects, their most distant nodes, and the run of the smaller cell type.

A graph is a table of links (by, block, a, b, w, to), one for each direction: block is the cell of space that a lies in, to
that of b. Keys are whole numbers.
"""

from __future__ import annotations

import heapq
from functools import reduce
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.graph import components as joined_parts
from orbweave.operators.ranges import written
from orbweave.operators.spatial import distance
from orbweave.operators.trees import longest_edge

XYZ = ("x", "y", "z")
#: Edge of a block, in radii of the graph.
BLOCK = 16
#: Nodes of a group from which distances start at a time, for each of the two choices.
PICKS = 4
#: Sums of the same steps in another order differ by less.
SLACK = 1 + 1e-12


def _cell(width: Column, names: str = "g") -> dict[str, Column]:
    return {f"{names}{c}": F.floor(F.col(c) / width) for c in XYZ}


def _around(rows: DataFrame) -> DataFrame:
    for c in XYZ:
        rows = rows.withColumn(f"g{c}", F.explode(F.array(*[F.col(f"g{c}") + s for s in (-1, 0, 1)])))
    return rows


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a and b (node, x, y, z and g-cells) of neighbouring cells: keys, a, b, w and what else a and b have, b's as to_."""
    other = b.select(*keys, *[f"g{c}" for c in XYZ], *[F.col(c).alias(f"to_{c}") for c in ("node", *XYZ, "block") if c in b.columns])
    gap = distance([F.col(c) for c in XYZ], [F.col(f"to_{c}") for c in XYZ])
    return _around(a).join(other, [*keys, *[f"g{c}" for c in XYZ]]).withColumn("w", gap)


def links(nodes: DataFrame, by: str) -> DataFrame:
    """The graph of nodes (by, node, x, y, z, radius, block) no further apart than their group's radius."""
    rows = nodes.withColumns(_cell(F.greatest(F.col("radius"), F.lit(1.0))))
    near = _met(rows, rows, [by]).where((F.col("node") != F.col("to_node")) & (F.col("w") <= F.col("radius")))
    return near.select(by, "block", F.col("node").alias("a"), F.col("to_node").alias("b"), "w", F.col("to_block").alias("to"))


def bridges(nodes: DataFrame, by: str) -> DataFrame:
    """by, a, b, w: the closest pair of nodes of each turn (1, 2, ...) and the next one, the smaller ids among equals.

    A node of one piece that is near the other one's box bounds the gap from above; only nodes no further than that
    from the other's box can be of the pair, and meet in cells of that width.
    """
    box = written(nodes.groupBy(by, "turn").agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]))

    def beside(step: int) -> DataFrame:
        other = box.withColumn("turn", F.col("turn") - step)
        outside = [F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0)) for c in XYZ]
        gap = F.sqrt(sum((d * d for d in outside), F.lit(0.0)))
        return written(nodes.join(other, [by, "turn"]).select(by, F.least("turn", F.col("turn") + step).alias("pair"), "node", *XYZ, gap.alias("gap")))

    a, b = beside(1), beside(-1)
    first = a.groupBy(by, "pair").agg(F.min(F.struct("gap", "node", *XYZ)).alias("s"))
    reach = b.join(first, [by, "pair"]).groupBy(by, "pair").agg((F.min(distance([F.col(c) for c in XYZ], [F.col(f"s.{c}") for c in XYZ])) * SLACK).alias("reach"))
    near = lambda t: t.join(reach, [by, "pair"]).where("gap <= reach").withColumns(_cell(F.greatest(F.col("reach"), F.lit(1.0))))
    best = _met(near(a), near(b), [by, "pair"]).groupBy(by, "pair").agg(F.min(F.struct("w", F.col("node").alias("a"), F.col("to_node").alias("b"))).alias("e"))
    return best.select(by, "e.a", "e.b", "e.w")


def _walked(by: str):
    """Least distances within one block, from values that fell; out go those that fall, and what other blocks are told."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group, here = pdf[by].iloc[0], int(pdf.block.iloc[0])
        edges, known, told = (pdf[pdf.kind == k] for k in (0, 1, 2))
        near: dict[int, list] = {}
        for a, b, w, to in zip(edges.a, edges.b, edges.w, edges.to, strict=True):
            near.setdefault(a, []).append((b, w, to))
        far: dict[int, dict[int, float]] = {}
        for s, k, d in zip(known.source, known.a, known.w, strict=True):
            far.setdefault(s, {})[k] = d
        out = []
        for source, rows in told.groupby("source"):
            least, fell, sent = far.get(source, {}), {}, {}
            heap = list(zip(rows.w, rows.a, strict=True))
            heapq.heapify(heap)
            while heap:
                d, k = heapq.heappop(heap)
                if d >= least.get(k, inf):
                    continue
                least[k] = fell[k] = d
                for b, w, to in near.get(k, ()):
                    if to != here:
                        sent[to, b] = min(d + w, sent.get((to, b), inf))
                    elif d + w < least.get(b, inf):
                        heapq.heappush(heap, (d + w, b))
            out += [(group, here, source, k, d, True) for k, d in fell.items()]
            out += [(group, to, source, b, d, False) for (to, b), d in sent.items()]
        return pd.DataFrame(out, columns=[by, "block", "source", "node", "far", "own"])

    return run


def sweep(graph: DataFrame, starts: DataFrame, by: str) -> DataFrame:
    """by, block, source, node, far: least distance from each start (by, block, source) to every node that it reaches.

    Distances spread within a block; blocks tell the ones that their links lead to, round after round, until nothing
    falls. Only blocks that are told something new are walked, so rounds grow with the number of blocks that a way crosses, and a task holds a block.
    """
    kind = graph.schema[by].dataType.simpleString()
    out = f"`{by}` {kind}, block long, source long, node long, far double, own boolean"
    told = written(starts.select(by, "block", "source", F.col("source").alias("node"), F.lit(0.0).alias("far")).distinct())
    state = told.limit(0)
    value = lambda t, k: t.select(by, "block", F.lit(k).alias("kind"), "source", F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), F.col("far").alias("w"), F.lit(0).cast("long").alias("to"))
    while not told.isEmpty():
        touched = told.select(by, "block").distinct()
        edges = graph.join(touched, [by, "block"], "left_semi").select(by, "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("source"), "a", "b", "w", "to")
        rows = edges.unionByName(value(state.join(touched, [by, "block"], "left_semi"), 1)).unionByName(value(told, 2))
        walked = written(rows.groupBy(by, "block").applyInPandas(_walked(by), out))
        at = [by, "block", "source", "node"]
        state = written(state.unionByName(walked.where("own").drop("own")).groupBy(*at).agg(F.min("far").alias("far")))
        sent = walked.where("not own").groupBy(*at).agg(F.min("far").alias("sent"))
        told = written(sent.join(state, at, "left").where("far is null or sent < far").select(*at, F.col("sent").alias("far")))
    return state


def most_distant(graph: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """by, a, b, far: the two nodes of each group (connected; by, node, x, y, z, block) that are furthest apart along the graph, a before b.

    A sweep gives the largest distance from its start, and with it bounds of that of every other node: it is no less
    than max(d, e - d) and no more than e + d. Sweeps start at the outermost nodes, then at nodes with the largest upper
    and the least lower bounds, until no node's upper bound is over the largest distance found. So it is exact, and nodes are not all
    started from: of a long graph a few are.
    """
    ends = [f(F.struct(c, "node", "block")).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    pick = lambda rows, *tops: rows.select(by, F.explode(F.array(*[F.struct(F.col(f"{t}.node").alias("source"), F.col(f"{t}.block").alias("block")) for t in tops])).alias("p")).select(by, "p.*").distinct()
    starts = pick(nodes.groupBy(by).agg(*ends), *[n + c for c in XYZ for n in ("lo", "hi")])
    bounds = written(nodes.select(by, "node", "block", F.lit(0.0).alias("lower"), F.lit(inf).alias("upper")))
    best = None
    while True:
        found = sweep(graph, written(starts), by)
        most = written(found.groupBy(by, "source").agg(F.min(F.struct((-F.col("far")).alias("less"), "node")).alias("m")).select(by, "source", (-F.col("m.less")).alias("ecc"), F.col("m.node").alias("end")))
        pairs = most.select(by, F.struct((-F.col("ecc")).alias("less"), F.least("source", "end").alias("a"), F.greatest("source", "end").alias("b")).alias("p"))
        both = pairs if best is None else pairs.unionByName(best)
        best = written(both.groupBy(by).agg(F.min("p").alias("p")))
        each = found.join(most.select(by, "source", "ecc"), [by, "source"]).groupBy(by, "node").agg(F.max(F.greatest("far", F.col("ecc") - F.col("far"))).alias("low"), F.min(F.col("ecc") + F.col("far")).alias("high"))
        bounds = bounds.join(each, [by, "node"]).join(best, by).where(F.least("upper", "high") > -F.col("p.less") * SLACK)
        bounds = written(bounds.select(by, "node", "block", F.greatest("lower", "low").alias("lower"), F.least("upper", "high").alias("upper")))
        if bounds.isEmpty():
            return best.select(by, "p.a", "p.b", (-F.col("p.less")).alias("far"))
        high, low = F.max(F.struct("upper", "node", "block")).alias("high"), F.min(F.struct("lower", "node", "block")).alias("low")
        starts = pick(bounds.groupBy(by, F.pmod(F.xxhash64("node"), F.lit(PICKS))).agg(high, low), "high", "low")


def fewest_hops(graph: DataFrame, ends: DataFrame, by: str) -> DataFrame:
    """by, node_idx, node: a way of the fewest links from each group's start to its end (by, start, block, end).

    Before a node comes its smallest neighbour that is one link nearer to the start. The way is read back by doubling.
    """
    hops = sweep(graph.withColumn("w", F.lit(1.0)), ends.select(by, F.col("start").alias("source"), "block"), by)
    hops = written(hops.select(by, "node", F.col("far").cast("long").alias("hop")))
    far = hops.select(by, F.col("node").alias("b"), F.col("hop").alias("hop_b"))
    jump = written(graph.join(hops.withColumnRenamed("node", "a"), [by, "a"]).join(far, [by, "b"]).where("hop_b = hop - 1").groupBy(by, F.col("a").alias("node")).agg(F.min("b").alias("before")))
    found = written(ends.select(by, F.col("end").alias("node")))
    while not jump.isEmpty():
        more = found.join(jump, [by, "node"]).select(by, F.col("before").alias("node"))
        both = written(found.unionByName(more).distinct())
        if both.count() == found.count():
            break
        found = both
        next_ = jump.select(by, F.col("node").alias("before"), F.col("before").alias("far"))
        jump = written(jump.join(next_, [by, "before"]).select(by, "node", F.col("far").alias("before")))
    return hops.join(found, [by, "node"], "left_semi").select(by, F.col("hop").alias("node_idx"), "node")


def smaller_run(objects: DataFrame, components: tuple[int, ...], by: str = "dataset", component: str = "component_labels", key: str = "label_id", apex_higher: bool = True, include_gap: bool = False, block: int = BLOCK) -> DataFrame:
    """by, node_idx, label_id, component, x, y, z, length, length_fraction: the run of the smaller cell type of each data set.

    Objects of the components are linked up to a radius: the longest edge of the components' spanning trees plus a half, rounded (half
    to even). Pieces that stay apart are joined, each to the next in the order of the list, by their closest objects. The run is a
    way of the fewest links between the two most distant nodes, and begins at the one with the higher y. Steps over the radius count 0 unless include_gap.

    Objects without a data set or a place are left out; so are data sets with fewer than two others. A repeated key is one object. Where all objects lie at one place the run is the one with the smallest key.
    """
    place = F.coalesce(*[F.when(F.col(component) == c, k) for k, c in enumerate(components)])
    test = reduce(lambda t, c: t & F.col(f"anchor_{c}").isNotNull() & ~F.isnan(F.col(f"anchor_{c}").cast("double")), XYZ, F.col(by).isNotNull() & F.col(key).isNotNull() & place.isNotNull())
    spots = F.struct(place.cast("long").alias("place"), *[F.col(f"anchor_{c}").cast("double").alias(c) for c in XYZ])
    chosen = objects.where(test).groupBy(by, F.col(key).cast("long").alias("node")).agg(F.min(spots).alias("s")).select(by, "node", "s.*")
    chosen = written(chosen.withColumn("group", F.struct(by, "place")))
    longest = longest_edge(chosen, "group", "node", places=XYZ)
    radii = written(longest.groupBy(F.col(f"group.{by}").alias(by)).agg(F.bround(F.max("longest") + 0.5, 0).alias("radius")))
    nodes = chosen.drop("group").join(radii, by)
    cell = [F.floor(F.col(c) / (F.greatest(F.col("radius"), F.lit(1.0)) * block)) for c in XYZ]
    nodes = written(nodes.withColumn("block", F.xxhash64(*cell)))
    graph = written(links(nodes, by))
    # each component hangs together within the radius, so pieces are components that a link joins
    at = lambda name: nodes.select(by, F.col("node").alias(name), F.col("place").alias(f"place_{name}"), F.col("block").alias(f"block_{name}"))
    across = graph.join(at("a"), [by, "a"]).join(at("b"), [by, "b"]).where("place_a < place_b").select(by, "place_a", "place_b").distinct()
    merged = joined_parts(across.select(F.struct(by, F.col("place_a").alias("place")).alias("a"), F.struct(by, F.col("place_b").alias("place")).alias("b")))
    merged = merged.select(F.col(f"node.{by}").alias(by), F.col("node.place").alias("place"), F.col("component.place").alias("piece"))
    pieces = nodes.select(by, "place").distinct().join(merged, [by, "place"], "left").withColumn("piece", F.coalesce("piece", "place"))
    turns = pieces.withColumn("turn", F.dense_rank().over(Window.partitionBy(by).orderBy("piece"))).select(by, "place", "turn")
    joint = written(bridges(written(nodes.join(turns, [by, "place"])), by)).join(at("a"), [by, "a"]).join(at("b"), [by, "b"])
    one = joint.select(by, F.col("block_a").alias("block"), "a", "b", "w", F.col("block_b").alias("to"))
    back = joint.select(by, F.col("block_b").alias("block"), F.col("b").alias("a"), F.col("a").alias("b"), "w", F.col("block_a").alias("to"))
    graph = written(graph.unionByName(one).unionByName(back))
    linked = nodes.join(graph.select(by).distinct(), by, "left_semi")
    ends = most_distant(graph, linked, by)
    spot = lambda name: nodes.select(by, F.col("node").alias(name), F.col("y").alias(f"y_{name}"), F.col("block").alias(f"block_{name}"))
    first = (F.col("y_a") > F.col("y_b")) == F.lit(apex_higher)
    ends = ends.join(spot("a"), [by, "a"]).join(spot("b"), [by, "b"])
    ends = written(ends.select(by, F.when(first, F.col("a")).otherwise(F.col("b")).alias("start"), F.when(first, F.col("block_a")).otherwise(F.col("block_b")).alias("block"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("end")))
    way = fewest_hops(graph, ends, by).join(nodes, [by, "node"])
    order = Window.partitionBy(by).orderBy("node_idx")
    step = distance([F.col(c) for c in XYZ], [F.lag(c).over(order) for c in XYZ])
    counted = F.coalesce(step, F.lit(0.0)) if include_gap else F.coalesce(F.when(step <= F.col("radius"), step), F.lit(0.0))
    whole = Window.partitionBy(by)
    rows = way.withColumn("step", counted).withColumn("length", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fraction = F.when(F.col("node_idx") == F.max("node_idx").over(whole), 1.0).otherwise(F.coalesce(F.try_divide("length", F.max("length").over(whole)), F.lit(0.0)))
    label = F.element_at(F.array(*[F.lit(c).cast("long") for c in components]), (F.col("place") + 1).cast("int"))
    return rows.select(by, "node_idx", F.col("node").alias(key), label.alias(component), *XYZ, "length", fraction.alias("length_fraction"))
