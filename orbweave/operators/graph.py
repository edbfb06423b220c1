"""Connected components of tables of objects, ranked by size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.ranges import numbered, written
from orbweave.operators.spatial import XYZ, _placed


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): node, component (its smallest node).

    Labels fall to the smallest one around, then to that one's own label (pointer jumping), so chains of objects close
    in a number of rounds that grows with the logarithm of their length. Rounds are checkpointed.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("component").alias("far"))
        moved = written(near.join(jump, "m", "left").select("node", "old", F.least("m", F.coalesce("far", "m")).alias("component")))
        labels = moved.select("node", "component")
        if moved.where("old != component").isEmpty():
            return labels


def radius_edges(objects: DataFrame, distance: float, key: str = "label_id", places: tuple[str, ...] = XYZ) -> DataFrame:
    """Edges (a, b) of keys whose components are those of all objects within the distance; far fewer than there are such pairs.

    Cells are so small that the objects of one hang together. Of neighbouring cells first only their outermost objects meet; all
    objects of two cells meet where the cells are not in one component after that.
    """
    edge = distance / math.sqrt(len(places)) * (1 - 1e-9)
    axes = range(len(places))
    rows = objects.where(_placed(objects, places)).select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"p{k}") for k, c in enumerate(places)], *[F.floor(F.col(c) / edge).alias(f"g{k}") for k, c in enumerate(places)])
    rows = written(rows)
    at = [f"g{k}" for k in axes]
    one = F.struct("key", *[f"p{k}" for k in axes])
    cells = written(rows.groupBy(*at).agg(F.min("key").alias("cell"), F.array_distinct(F.array(*[F.expr(f"{f}(struct(p{k}, struct(key, {', '.join(f'p{j}' for j in axes)}) AS o)).o") for k in axes for f in ("min", "max")])).alias("ends")))
    reach = math.floor(distance / edge) + 1
    other = cells.select(*at, F.col("cell").alias("to"), F.col("ends").alias("to_ends"))
    around = cells
    for k in axes:
        around = around.withColumn(f"g{k}", F.explode(F.array(*[F.col(f"g{k}") + s for s in range(-reach, reach + 1)])))
    near = lambda p, q: F.sqrt(sum(((p[f"p{k}"] - q[f"p{k}"]) * (p[f"p{k}"] - q[f"p{k}"]) for k in axes), F.lit(0.0))) <= distance
    met = written(around.join(other, at).where("cell < to").select("cell", "to", F.exists("ends", lambda p: F.exists("to_ends", lambda q: near(p, q))).alias("linked")))
    links = met.where("linked").select(F.col("cell").alias("a"), F.col("to").alias("b"))
    parts = components(links)
    name = lambda n: parts.select(F.col("node").alias(n), F.col("component").alias(f"part_{n}"))
    apart = met.where("not linked").join(name("cell"), "cell", "left").join(name("to"), "to", "left").where(F.coalesce("part_cell", "cell") != F.coalesce("part_to", "to")).select("cell", "to")
    own = written(rows.join(cells.select(*at, "cell"), at).select("cell", one.alias("o")))
    pairs = apart.join(own.withColumnRenamed("o", "p"), "cell").join(own.select(F.col("cell").alias("to"), F.col("o").alias("q")), "to").where(near(F.col("p"), F.col("q")))
    late = pairs.select(F.col("cell").alias("a"), F.col("to").alias("b")).distinct()
    inside = own.where(F.col("o.key") != F.col("cell")).select(F.col("cell").alias("a"), F.col("o.key").alias("b"))
    return links.unionByName(late).unionByName(inside)


def radius_components(objects: DataFrame, distance: float, least: int = 1, key: str = "label_id", places: tuple[str, ...] = XYZ) -> DataFrame:
    """key and component_labels: components of the graph of objects within the distance, 1 the largest, 0 the small ones.

    Ties in size go to the component with the smaller smallest id.
    """
    edges = radius_edges(objects, distance, key, places)
    found = components(edges)
    named = objects.select(key).join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranks = numbered(sizes.select("component", (-F.col("n")).alias("size")), ["size", "component"], "rank").select("component", "rank")
    return named.join(ranks, "component", "left").select(key, F.coalesce("rank", F.lit(0)).cast("long").alias("component_labels"))


def label_components(objects: DataFrame, min_size: int, distance: float, least: int) -> DataFrame:
    """objects with component_labels; those under min_size pixels are 0."""
    table = objects.drop("component_labels")
    found = radius_components(table.where(F.col("n_pixels") >= min_size), distance, least)
    return table.join(found, "label_id", "left").fillna(0, ["component_labels"])


def label_custom(objects: DataFrame, runs: list[dict], min_size: int, forced: list[int] = ()) -> DataFrame:
    """Several runs (min_size, distance, least, components); 1 for the chosen components of any, and for forced ids."""
    chosen = None
    for r in runs:
        part = label_components(objects, r["min_size"], r["distance"], r["least"]).where(F.col("component_labels").isin(*r["components"])).select("label_id")
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = objects.select("label_id").limit(0)
    table = objects.drop("component_labels").join(chosen.distinct().withColumn("_in", F.lit(True)), "label_id", "left")
    inside = (F.col("_in") & (F.col("n_pixels") >= min_size)) | F.col("label_id").isin(*forced)
    return table.withColumn("component_labels", F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0).cast("long")).drop("_in")


def filter_by_statistic(objects: DataFrame, statistic: DataFrame, column: str, threshold: float, min_size: int, key: str = "label_id") -> DataFrame:
    """Drops objects of min_size pixels or fewer, and those whose statistic is over the threshold; numbers the others anew."""
    kept = objects.where(F.col("n_pixels") > min_size).join(statistic.where(F.col(column) > threshold).select(key), key, "left_anti")
    return numbered(kept, [key], "new_label")
