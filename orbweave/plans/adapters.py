"""The library's own tables (objects, voxels, scores, crops) read out of the tables at hand, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation table: an object for each embedding, 100 times its first three values as place."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.get("embedding", F.lit(k)).cast("double") * 100).alias(c) for k, c in enumerate("xyz")])
    box = [(F.col(c) + s * 5.0).alias(f"bb_{n}_{c}") for n, s in (("min", -1), ("max", 1)) for c in "xyz"]
    return e.select(
        F.col("vec_id").alias("label_id"), *[F.col(c).alias(f"anchor_{c}") for c in "xyz"], *box,
        (F.col("vec_id") % 500 + 800).alias("n_pixels"), F.col("label").alias("component_labels"),
        ((F.col("vec_id") % 101) / 100.0).alias("length_fraction"), (F.col("vec_id") % 7).alias("offset"),
    )


OBJECTS = """objects AS (SELECT label_id, x AS anchor_x, y AS anchor_y, z AS anchor_z,
  x + -1 * 5.0::DOUBLE AS bb_min_x, y + -1 * 5.0::DOUBLE AS bb_min_y, z + -1 * 5.0::DOUBLE AS bb_min_z, x + 5.0::DOUBLE AS bb_max_x, y + 5.0::DOUBLE AS bb_max_y, z + 5.0::DOUBLE AS bb_max_z,
  label_id % 500 + 800 AS n_pixels, label AS component_labels, (label_id % 101) / 100.0::DOUBLE AS length_fraction, label_id % 7 AS "offset"
  FROM (SELECT vec_id AS label_id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings))"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label volumes and an image on a lattice: one voxel for each (part, supplier, line) residue."""
    li = table(spark, sf_dir, "lineitem")
    return (
        li.select((F.col("l_linenumber") % 4).cast("long").alias("z"), (F.col("l_partkey") % 40).alias("y"), (F.col("l_suppkey") % 40).alias("x"), "l_quantity")
        .groupBy("z", "y", "x")
        .agg(F.max("l_quantity").alias("value"), F.count("*").alias("n"))
        .select("z", "y", "x", "value", ((F.col("y").cast("long") / 8).cast("long") * 5 + (F.col("x") / 8).cast("long")).alias("label"), ((F.col("y") / 10).cast("long") * 4 + (F.col("x") / 10).cast("long")).alias("other"))
    )


VOXELS = """voxels AS (SELECT z, y, x, max(q) AS value, (y // 8) * 5 + x // 8 AS label, (y // 10) * 4 + x // 10 AS other
  FROM (SELECT (l_linenumber % 4)::BIGINT AS z, l_partkey % 40 AS y, l_suppkey % 40 AS x, l_quantity AS q FROM lineitem) GROUP BY z, y, x)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """annotator, file_name, tps, fps, fns out of the orders of each priority and month of the year."""
    o = table(spark, sf_dir, "orders")
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return o.groupBy(F.col("o_orderpriority").alias("annotator"), F.concat(F.lit("crop"), (F.col("o_orderkey") % 6).cast("string")).alias("file_name")).agg(n("F").alias("tps"), n("O").alias("fps"), n("P").alias("fns"))


SCORES = """scores AS (SELECT o_orderpriority AS annotator, 'crop' || (o_orderkey % 6) AS file_name, count(*) FILTER (o_orderstatus = 'F') AS tps,
  count(*) FILTER (o_orderstatus = 'O') AS fps, count(*) FILTER (o_orderstatus = 'P') AS fns FROM orders GROUP BY 1, 2)"""


def every_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (dataset, node_idx, x, y, z) of a path for each user's events, in order of time."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("dataset"), (F.row_number().over(order) - 1).cast("long").alias("node_idx"),
        (F.col("event_id") % 97).cast("double").alias("x"), F.col("value").alias("y"), (F.col("event_id") % 13).cast("double").alias("z"),
    )


path = every_path


PATH = """path AS (SELECT user_id AS dataset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS node_idx,
  (event_id % 97)::DOUBLE AS x, value AS y, (event_id % 13)::DOUBLE AS z FROM events)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_id, dataset, length_fraction, frequency, value, marker (0, 1, 2): a cell for each part."""
    p = table(spark, sf_dir, "part")
    f = (F.col("p_size") - 1) / 49.0
    return p.select(F.col("p_partkey").alias("label_id"), F.col("p_brand").alias("dataset"), f.alias("length_fraction"), F.bround(1.46 * (F.pow(F.lit(10.0), 1.77 * f)), 6).alias("frequency"), F.col("p_retailprice").alias("value"), (F.col("p_partkey") % 3).cast("int").alias("marker"), (F.col("p_partkey") % 2 + 1).cast("int").alias("marker_b"))


CELLS = """cells AS (SELECT p_partkey AS label_id, p_brand AS dataset, (p_size - 1) / 49.0::DOUBLE AS length_fraction, round_even(1.46::DOUBLE * pow(10.0::DOUBLE, 1.77::DOUBLE * ((p_size - 1) / 49.0::DOUBLE)), 6) AS frequency,
  p_retailprice AS value, (p_partkey % 3)::INT AS marker, (p_partkey % 2 + 1)::INT AS marker_b FROM part)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
