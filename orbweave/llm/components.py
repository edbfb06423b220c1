"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.storage import checkpointed


#: Links of a partition, at least: a small table goes on in few files, a large one in as many as the shuffle has.
LINKS = 100_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")).coalesce(parts)
    return both.join(least, F.col("a") == F.col("u")).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
    moved = edges.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).coalesce(parts).distinct().coalesce(parts)


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b): node, component (its smallest node), for each node with a link to another one.

    Groups are reduced by minima and joined back, never collected; each round is checkpointed. The rounds grow with the
    logarithm of the number of nodes. Null ends, loops and repeated links have no effect.
    """
    edges = checkpointed(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] == 0 or tuple(state) == mark:
            break
        mark = tuple(state)
        parts = max(1, state[0] // LINKS)
        edges = checkpointed(_small_star(_large_star(edges.coalesce(parts), parts), parts))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
