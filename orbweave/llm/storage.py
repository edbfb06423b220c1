"""Cutting lineage, bounding broadcasts and repeating rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if a count says that it has no more rows than this.
BROADCAST_ROWS = 50_000
#: A row is repeated at most so often by one task.
REPEATS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see, from spark.checkpoint.dir; a temporary one only where Spark is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="orbweave-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder; a lost executor loses none of it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A checkpointed table of short rows, which goes on in partitions of so many rows at least: where few rows are left,
    the shuffles behind it write a few files and not one for each pair of partitions."""
    df = checkpointed(df)
    return df.coalesce(max(1, df.count() // rows))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed table of short rows: broadcast where its count allows it, else shuffled by the join."""
    return F.broadcast(df) if df.count() <= rows else df


def repeated(df: DataFrame, times: Column, number: str) -> DataFrame:
    """Each row so often, with its number from 1 on. A row that many repeat is dealt to several tasks."""
    first, last = F.col(f"{number}_low"), F.least(F.col(f"{number}_low") + REPEATS - 1, F.col(f"{number}_times"))
    counted = df.withColumn(f"{number}_times", times.cast("long"))
    few = counted.where(F.col(f"{number}_times").between(1, REPEATS)).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), f"{number}_times")))
    many = counted.where(F.col(f"{number}_times") > REPEATS).withColumn(f"{number}_low", F.explode(F.sequence(F.lit(1).cast("long"), f"{number}_times", F.lit(REPEATS).cast("long"))))
    many = many.repartition(f"{number}_low").withColumn(number, F.explode(F.sequence(first, last))).drop(f"{number}_low")
    return few.unionByName(many).drop(f"{number}_times")
