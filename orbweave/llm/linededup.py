"""Line dedup by pairwise alignment.

1. Each document becomes the list of its lines' hashes (outer spaces off) and word counts.
2. Documents overlap if they share a window: a shortest run of lines of BLOCK_WORDS words or more, from each line on
   and back from each line. Every line of a common block is in a common window, so no pair that matters is missed.
   Each holder of a window is paired with the first one; as long as a line of the window stays, also with the next
   one, the next two, the next four and so on, up to itself. The rounds grow with the logarithm of the largest group,
   and the result is that of all pairs.
3. Each pair is aligned by patience diff: lines that occur once on both sides, in longest increasing order, and what
   adjoins them, over and over between them. Lines that repeat on both sides have no such anchor, and moved blocks are out of order: windows
   that both documents have and the alignment left alone count as well, as often as the earlier document has them.
4. Common blocks of BLOCK_WORDS words or more go from the later document (the larger id). The first holder of a line
   keeps it, so one copy of everything stays.

Only hashes are paired; texts are joined once, with the lines to delete.

Defined results: a null text stays null and has no lines; a row with a null id stays as it is; rows with equal ids and
different texts are documents of their own in the order of the texts' hashes; repeated rows are one document; extra columns of any name are
kept, but for n_lines and n_removed, which are made anew; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.storage import checkpointed

BLOCK_WORDS = 20
WORD = r"[^\x20\x09-\x0D]+"


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two lists, in order."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        also: dict[int, int] = {}
        for j in range(b0, b1):
            also[b[j]] = -1 if b[j] in also else j
        both = [(once[x], j) for x, j in also.items() if j >= 0 and once.get(x, -1) >= 0]
        # longest increasing run of places in a, in the order of b
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(both):
            at = bisect_left(tops, i)
            tops[at : at + 1] = [i]
            ends[at : at + 1] = [k]
            back.append(ends[at - 1] if at else -1)
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        # between the anchors, and from each one on
        low = (a0, b0)
        for i, j in reversed(chain):
            if i > low[0] and j > low[1]:
                work.append((low[0], i, low[1], j))
            out.append((i, j))
            low = (i + 1, j + 1)
        if chain and low[0] < a1 and low[1] < b1:
            work.append((low[0], a1, low[1], b1))
    return sorted(out)


def common_blocks(aligned: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Places in the later list that belong to aligned runs of at least so many words."""
    out, run = [], []
    for i, j in [*aligned, (-9, -9)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[y] for _, y in run) >= least:
                out += [y for _, y in run]
            run = []
        run.append((i, j))
    return out


_BASE = 0x9E3779B97F4A7C15


def _spans(words: np.ndarray, begin: np.ndarray, live: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line behind, document) of the windows with a live line; begin has where each document starts, and the end."""
    n = len(words)
    total = lambda x: np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])
    count, alive = total(words), total(live)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.arange(n)
    low = np.concatenate([at, np.searchsorted(count, count[1:] - least, "right") - 1])
    high = np.concatenate([np.searchsorted(count, count[:-1] + least, "left"), at + 1])
    of = np.concatenate([doc, doc])
    ok = (low >= begin[of]) & (high <= begin[of + 1])
    low, high, of = low[ok], high[ok], of[ok]
    ok = alive[high] > alive[low]
    return low[ok], high[ok], of[ok]


def _values(lines: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A window is hashed as a polynomial in _BASE, which is odd and so has an inverse, by differences of running sums, and by its number of lines."""
    power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(lines), base, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.astype(np.uint64) * power(_BASE)[: len(lines)], dtype=np.uint64)])
    return (sums[high] - sums[low]) * power(pow(_BASE, -1, 1 << 64))[low] + (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def windows(lines: np.ndarray, words: np.ndarray, begin: np.ndarray, live: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the windows with a live line, each once."""
    low, high, of = _spans(words, begin, live, least)
    value = _values(lines, low, high)
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return of[new], value[new].view(np.int64)


def unaligned(first: list[int], first_words: list[int], lines: list[int], words: list[int], gone: list[int], least: int) -> list[int]:
    """Further places of the later list in windows that both lists have: repeated or moved blocks, which no alignment of lines
    that occur once can reach. A window counts as often as the first list has it, less the times that the alignment took it."""
    known, taken = set(first), set(gone)
    # a run of lines that the first list has, with a line that stays and words enough
    total, stays, some = 0, False, False
    for k, x in enumerate(lines):
        if x not in known:
            total, stays = 0, False
            continue
        total, stays = total + words[k], stays or k not in taken
        some = some or (stays and total >= least)
    if not some:
        return []
    every = lambda x: np.ones(len(x), bool)
    of_one = lambda x: np.array([0, len(x)])
    both = np.array(first + lines, np.int64)  # hashed together, so that equal windows have equal values
    held = _spans(np.array(first_words), of_one(first), every(first), least)
    mine = _spans(np.array(words), of_one(lines), every(lines), least)
    spans = lambda s: np.unique(np.stack(s[:2], 1), axis=0)  # noqa: E731  the same window from its start and from its end counts once
    held, mine = spans(held), spans(mine)
    value = _values(both, np.concatenate([held[:, 0], mine[:, 0] + len(first)]), np.concatenate([held[:, 1], mine[:, 1] + len(first)]))
    names, name = np.unique(value, return_inverse=True)
    left = np.bincount(name[: len(held)], minlength=len(names))
    mine_name = name[len(held) :]
    out = np.ones(len(lines) + 1, np.int64)
    out[gone] = 0
    live = np.concatenate([[0], np.cumsum(out[:-1])])
    open_ = live[mine[:, 1]] > live[mine[:, 0]]
    left -= np.bincount(mine_name[~open_], minlength=len(names))
    # the first ones of each window, in order
    mine, mine_name = mine[open_], mine_name[open_]
    order = np.argsort(mine_name, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.searchsorted(mine_name[order], mine_name[order])
    mine = mine[place < left[mine_name]]
    cover = np.zeros(len(lines) + 1, np.int64)
    np.add.at(cover, mine[:, 0], 1)
    np.subtract.at(cover, mine[:, 1], 1)
    return [int(k) for k in np.flatnonzero((np.cumsum(cover[:-1]) > 0) & (out[:-1] > 0))]


def pair_blocks(first: list[int], first_words: list[int], lines: list[int], words: list[int], least: int) -> list[int]:
    """Places of the later list that go: aligned blocks, then repeated or moved ones."""
    gone = common_blocks(patience(first, lines), words, least)
    return sorted(gone + unaligned(first, first_words, lines, words, gone, least))


def _windows(least: int):
    """mapInArrow function on (id, h, lines, words, gone): id, h, line (the hash of a window)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lines, words = part.column(2), part.column(3)
                begin = lines.offsets.to_numpy().astype(np.int64)
                begin -= begin[0]
                live = np.ones(begin[-1], bool)
                for k, gone in enumerate(part.column(4).to_pylist()):
                    if gone:
                        live[begin[k] + np.array(gone)] = False
                doc, value = windows(lines.flatten().to_numpy(zero_copy_only=False), words.flatten().to_numpy(zero_copy_only=False), begin, live, least)
                doc = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(value, pa.int64())], names=["id", "h", "line"])

    return run


def _align(least: int):
    """mapInArrow function on (id, h, first_lines, first_words, lines, words): id, h, gone (places of lines to delete)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                gone = [pair_blocks(*pair, least) for pair in zip(*[part.column(k).to_pylist() for k in (2, 3, 4, 5)], strict=True)]
                keep = [k for k, g in enumerate(gone) if g]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), part.column(1).take(pa.array(keep, pa.int64())), pa.array([gone[k] for k in keep], pa.list_(pa.int32()))], names=["id", "h", "gone"])

    return run


def _ranked(holders: DataFrame) -> DataFrame:
    """holders (line, id, h) with rank, from 0, by (id, h) in each line. A range deal orders them, so no line is gathered."""
    dealt = checkpointed(holders.repartitionByRange("line", "id", "h").sortWithinPartitions("line", "id", "h").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted(dealt.groupBy(part.alias("part")).count().collect())
    before = dict(zip([p for p, _ in sizes], accumulate([n for _, n in sizes], initial=0)))
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), part) if before else F.lit(0)
    placed = dealt.withColumn("at", start + F.col("at") - F.shiftleft(part, 33))
    first = placed.groupBy("line").agg(F.min("at").alias("first"))
    return checkpointed(placed.join(first, "line").select("line", "id", "h", (F.col("at") - F.col("first")).alias("rank")))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the text cut, and n_lines, n_removed."""
    kind = docs.select(F.col(doc_id).alias("id")).schema["id"].dataType.simpleString()
    lines = F.split(F.col(text), "\n")
    row = F.xxhash64(F.col(text))
    records = checkpointed(
        docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
        .select(F.col(doc_id).alias("id"), row.alias("h"), F.transform(lines, lambda x: F.xxhash64(F.trim(x))).alias("lines"), F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"))
        .dropDuplicates(["id", "h"])
    )
    early = records.select(F.col("id").alias("id0"), F.col("h").alias("h0"), F.col("lines").alias("first_lines"), F.col("words").alias("first_words"))

    def spread(rows: DataFrame) -> DataFrame:
        return rows.select("id", "h", "lines", "words", "gone").mapInArrow(_windows(block_words), f"id {kind}, h bigint, line bigint")

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(records, ["id", "h"]).join(early, ["id0", "h0"]).select("id", "h", "first_lines", "first_words", "lines", "words")
        return both.mapInArrow(_align(block_words), f"id {kind}, h bigint, gone array<int>")

    def merged(parts: DataFrame) -> DataFrame:
        return checkpointed(parts.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))

    key = F.struct("id", "h")
    seeds = spread(records.withColumn("gone", F.lit(None).cast("array<int>")))
    holders = checkpointed(seeds.groupBy("line").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1"))
    gone = merged(aligned(seeds.join(holders, "line").where(key != F.col("first")).select("id", "h", F.col("first.id").alias("id0"), F.col("first.h").alias("h0"))))
    # windows with a line that stays, of documents behind the second holder
    left = checkpointed(spread(records.join(gone, ["id", "h"], "left")).join(holders.where("n > 2"), "line").where(key > F.col("first")).select("line", "id", "h"))
    if not left.isEmpty():
        ranked = _ranked(seeds.join(left.select("line").distinct(), "line", "left_semi"))
        partners = ranked.select("line", F.col("rank").alias("at"), F.col("id").alias("id0"), F.col("h").alias("h0"))
        low = 1
        while True:
            todo = checkpointed(left.join(ranked, ["line", "id", "h"]).where(F.col("rank") > low))
            if todo.isEmpty():
                break
            tried = todo.withColumn("at", F.explode(F.sequence(F.lit(low).cast("bigint"), F.least(F.lit(2 * low), F.col("rank")) - 1)))
            gone = merged(gone.unionByName(aligned(tried.join(partners, ["line", "at"]).select("id", "h", "id0", "h0"))))
            left = spread(records.join(todo.select("id", "h").distinct(), ["id", "h"], "left_semi").join(gone, ["id", "h"], "left"))
            low *= 2
    of = lambda c: F.col(f"full.`{c}`")
    mine = F.split(of(text), "\n")
    found = docs.select(F.struct(*[c for c in docs.columns if c not in ("n_lines", "n_removed")]).alias("full")).join(gone, (of(doc_id) == F.col("id")) & (F.xxhash64(of(text)) == F.col("h")), "left")
    kept = F.array_join(F.filter(mine, lambda x, k: ~F.array_contains("gone", k)), "\n")
    cut = F.when(F.col("gone").isNull(), of(text)).otherwise(kept)
    columns = [(cut if c == text else of(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return found.select(*columns, F.coalesce(F.size(mine), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, of all documents."""
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE_SQL: dict[str, str] = {}
