"""Context-triggered piecewise hashing: fingerprints that change only where a text does.

A hash of the last seven bytes rolls over the text; where it hits a residue of the block size, a chunk ends. Each
chunk gives one character of a signature, from a hash of its bytes. A fingerprint holds the block size and the
signatures at that size and at twice it: `size:one:two`. The block size is the smallest power of two times LEAST_BLOCK
at which at most CHARS chunks are expected, halved while the text gives less than CHARS / 4 of them, and doubled while it
gives more than MOST_CHARS. A text of one repeated passage may jump from a few chunks to one for each repeat: the few
stand. So a signature is short because of the block size, and no chunk is left out. Two
fingerprints are comparable at a block size that both have; their likeness is 1 less the edit distance over the longer
length, the best of the sizes.

Hashes of all positions, and of all chunks, of a batch come from a few numpy expressions.

Defined results: a null text counts as empty; an empty text has the fingerprint of its size and two empty signatures;
two empty signatures are alike (1). Rows without an id come first in the order of ids; rows with equal ids are in the
order of their texts' hashes; ids of any type that has an order will do; an empty table gives no rows; extra columns
are ignored. A lone document is followed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm import batches
from orbweave.llm.expressions import let
from orbweave.llm.storage import checkpointed

WINDOW, CHARS, LEAST_BLOCK = 7, 64, 4
#: Chunks of a text at its block size, at most.
MOST_CHARS = 4 * CHARS
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Bytes of files for a task that pairs each document with the next one, about.
TASK_BYTES = 32_000_000


def _signatures(body: np.ndarray, at: np.ndarray, roll: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the signatures of all texts at their block sizes, and n + 1 places where each begins."""
    hit = (roll & np.repeat(block - 1, np.diff(at))) == 0
    last = at[1:][np.diff(at) > 0] - 1
    hit[last] = True  # the end of a text ends its last chunk
    ends = np.flatnonzero(hit) + 1
    begin = np.searchsorted(ends, at, "right")
    begin[0] = 0
    starts = np.concatenate([[0], ends[:-1]])
    starts[begin[:-1][np.diff(begin) > 0]] = at[:-1][np.diff(begin) > 0]
    return ALPHABET[(batches.span_hashes(body, starts, ends) & np.uint64(63)).astype(np.intp)], begin


def fingerprints(body: np.ndarray, at: np.ndarray) -> list[str]:
    sizes = np.diff(at)
    if not len(sizes):
        return []
    x = body.astype(np.uint64)
    roll = np.zeros(len(body), np.uint64)
    place = np.arange(len(body)) - np.repeat(at[:-1], sizes)
    for k in range(WINDOW):
        # bytes before the text's start count as none
        moved = np.zeros(len(body), np.uint64)
        moved[k:] = x[: max(0, len(body) - k)] + np.uint64(1)
        roll = roll * np.uint64(0x100000001B3) + np.where(place >= k, moved, 0).astype(np.uint64)
    roll = (batches.mixed(roll) >> np.uint64(11)).astype(np.int64)
    block = LEAST_BLOCK << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / (CHARS * LEAST_BLOCK)))).astype(np.int64)
    full = np.flatnonzero(sizes)

    def count(size):
        """Chunks of each text at its block size."""
        out = np.zeros(len(sizes), np.int64)
        if len(full):
            out[full] = np.add.reduceat((roll & np.repeat(size - 1, sizes)) == 0, at[:-1][full], dtype=np.int64) + 1
        return out

    number = count(block)
    while True:
        less = (number < CHARS // 4) & (block > LEAST_BLOCK)
        smaller = np.where(less, block // 2, block)
        after = count(smaller)
        less &= after <= MOST_CHARS  # a text that jumps from too few to too many stays at too few
        if not less.any():
            break
        block, number = np.where(less, smaller, block), np.where(less, after, number)
    while (number > MOST_CHARS).any():
        block = np.where(number > MOST_CHARS, 2 * block, block)
        number = count(block)
    chars, begin = _signatures(body, at, roll, block)
    more, next_ = _signatures(body, at, roll, 2 * block)
    one, two = chars.tobytes().decode(), more.tobytes().decode()
    return [f"{block[k]}:{one[begin[k] : begin[k + 1]]}:{two[next_[k] : next_[k + 1]]}" for k in range(len(sizes))]


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints; 0 where no block size is common."""

    def near(x, y):
        return 1 - F.levenshtein(x, y).cast("double") / F.greatest(F.length(x), F.length(y), F.lit(1))

    def best(p, q):
        m, n = F.element_at(p, 1).cast("bigint"), F.element_at(q, 1).cast("bigint")
        part = lambda v, k: F.element_at(v, k)
        return (
            F.when(m == n, F.greatest(near(part(p, 2), part(q, 2)), near(part(p, 3), part(q, 3))))
            .when(m == 2 * n, near(part(p, 2), part(q, 3)))
            .when(2 * m == n, near(part(p, 3), part(q, 2)))
            .otherwise(F.lit(0.0))
        )

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.split(a, ":"), lambda p: let(F.split(b, ":"), lambda q: best(p, q))))


def fingerprint_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and fingerprint."""
    read = docs.select(*keep) if text in keep else docs.select(*keep, text)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b in batches.pieces(batch, text):
                part = batch.slice(a, b - a)
                found = fingerprints(*batches.string_bytes(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], pa.array(found, pa.string())], names=[*keep, "fingerprint"])

    fields = docs.select(*keep).schema
    return read.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fingerprint string")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint of all rows, next being the next
    document by id (the first one after the last).

    Rows are dealt to ranges of (id, hash), so that equal ids are split as well, and sorted there; a task pairs each row
    with the one behind it. The first and the last row of each task come out with their texts and meet in a second, small
    step: there are two of them for each task.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = int(str(base._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(size, 1 << 50) // TASK_BYTES + 1)
    order = [F.col("doc_id").asc_nulls_first(), "h"]
    dealt = base.repartitionByRange(number, *order, F.rand(7)).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "text", F.spark_partition_id().alias("task"))

    def pair(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one
        for batch in stream:
            for a, b in batches.pieces(batch, "text", batches.PIECE // 2):
                part = batch.slice(a, b - a)
                if held is None:
                    yield _edge(part.slice(0, 1), True)
                else:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                held = part.slice(part.num_rows - 1)
                if part.num_rows > 1:
                    yield _found(part.column(0).slice(0, part.num_rows - 1), *_edited(part.column(1)))
        if held is not None:
            yield _edge(held, False)

    kinds = f"doc_id {kind}, {FOUND}"
    out = checkpointed(dealt.mapInArrow(pair, f"{kinds}, task int, first boolean, text string"))
    inner = out.where("task is null").drop("task", "first", "text")
    edges = out.where("task is not null")
    tasks = sorted(r[0] for r in edges.where("first").select("task").collect())
    if not tasks:
        return inner
    follow = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, next_task int")
    heads = edges.where("first").select(F.col("task").alias("next_task"), F.col("text").alias("next_text"))
    ends = edges.where("not first").join(follow, "task").join(heads, "next_task").select("doc_id", "text", "next_text")

    def close(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                two = pa.concat_arrays([batch.column(1).slice(k, 1), batch.column(2).slice(k, 1)])
                found = _found(batch.column(0).slice(k, 1), *_edited(two))
                yield found.select(range(6))

    return inner.unionByName(ends.mapInArrow(close, kinds))


FOUND = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "task", "first", "text"]


def _edited(texts: pa.Array) -> tuple[list[int], list[str], list[str], list[str], list[str]]:
    """The contract's values of each text but the last one, which is only the next of the one before."""
    rows = texts.to_pylist()
    changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(rows, rows[1:], strict=False)]
    own, new = fingerprints(*batches.string_bytes(texts)), fingerprints(*batches.string_bytes(pa.array(changed, pa.string())))
    return [len(t) for t in rows[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in changed], own[:-1], new, own[1:]


def _found(ids: pa.Array, *values: list) -> pa.RecordBatch:
    columns = [pa.array(v, pa.int64() if k == 0 else pa.string()) for k, v in enumerate(values)]
    none = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.bool_(), pa.string())]
    return pa.RecordBatch.from_arrays([ids, *columns, *none], names=_NAMES)


def _edge(row: pa.RecordBatch, first: bool) -> pa.RecordBatch:
    none = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 4]
    return pa.RecordBatch.from_arrays([row.column(0), *none, row.column(2), pa.array([first]), row.column(1)], names=_NAMES)


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_next(docs)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    )


QUERIES = {"op10_document_fingerprints": op10_document_fingerprints}
ORACLE_SQL: dict[str, str] = {}
