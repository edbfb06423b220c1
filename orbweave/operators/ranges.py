"""Checkpoints, and row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder in spark.checkpoint.dir; a temporary one only where Spark is one process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orbweave-checkpoint-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder, for loops of joins.

    A checkpoint keeps the planner's guess of its size, and the guess for a join is the product of both sides: over the
    rounds of a loop it grows to numbers of thousands of digits, and planning takes longer than the work. A written table has its real
    size, so small sides are broadcast as well. The tables go with the folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        checkpointed(df.limit(0))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """1..n in the order of the columns, nulls first.

    Rows are dealt to ranges and sorted there; the driver sees one count for each task, and the counts of the ranges
    before are added to the places within a range.
    """
    full = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("full"))
    key = [F.col(f"full.`{c}`") for c in order]
    dealt = checkpointed(full.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted(dealt.groupBy(part.alias("part")).count().collect())
    before = list(zip([p for p, _ in sizes], accumulate([n for _, n in sizes], initial=0), strict=False))
    starts = rows.sparkSession.createDataFrame(before, "part long, before long")
    place = F.col("before") + (F.col("at") - F.shiftleft("part", 33)) + 1
    return dealt.withColumn("part", part).join(F.broadcast(starts), "part").select("full.*", place.cast("long").alias(name))
