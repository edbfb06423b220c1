"""Benchmark decontamination: a broadcast set of normalised test n-grams, a scan of all training token windows.

1. Benchmark texts become windows: WINDOW consecutive words, or all words of an item that has fewer. One row stands for a
   window and an item that has it.
2. The windows go to blocks by a hash, so many that each one has about BLOCK_BYTES; a block is what the driver
   sees and what is broadcast. A usual benchmark is one block. Documents are scanned once for each block.
3. A task maps the words of its documents to the block's vocabulary (exactly, by their bytes). Where all words of a window are known,
   its hash is looked up, and what is found is verified number by number. Nothing is shuffled, and no text is
   cut, sampled or skipped; with several blocks only the documents with hits meet again, by row.
4. decontaminate() then drops the documents, or cuts the spans out of their texts.

Defined results: a null text has no words and no hits; rows with null or equal ids are scanned each on their own; an item without
words has no windows; an item with a null id hits words but is not listed; items with one id are listed once; extra
columns are ignored, or kept where named, but for those named like a result; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm import batches
from orbweave.llm.licenses import folded
from orbweave.llm.licenses import words as text_words
from orbweave.llm.storage import checkpointed

WINDOW = 10
#: Bytes of the windows of one block.
BLOCK_BYTES = 32_000_000
RESULTS = ("n_words", "n_hit", "word_spans", "char_spans", "items")

#: Bytes outside of 0-9, A-Z, a-z and of letters beyond ASCII part words.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SPAN = pa.struct([(name, pa.int64()) for name in ("start", "end", "char_start", "char_end")])
SPANS = "array<struct<start:bigint,end:bigint,char_start:bigint,char_end:bigint>>"


def windows(bench: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """window (words with one space between), item: each pair once."""
    listed = bench.select(F.col(item_id).alias("item"), text_words(folded(F.col(text))).alias("words")).where(F.size("words") > 0)
    begin = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return listed.select("item", F.explode(F.transform(begin, lambda k: F.array_join(F.slice("words", k, F.lit(size)), " "))).alias("window")).distinct()


class Index:
    """The windows of a block: their words as numbers of a vocabulary, in order of a hash, and the items that have them."""

    def __init__(self, table: pa.Table):
        text = table.column("window").combine_chunks().dictionary_encode()
        body, at = batches.string_bytes(text.dictionary)
        starts, ends, first = batches.words(body, at, APART)
        found = batches.word_array(body, starts, ends).dictionary_encode()
        self.vocabulary, numbers = found.dictionary, found.indices.to_numpy()
        items = table.column("item").combine_chunks().dictionary_encode()
        self.items = items.dictionary
        listed = pc.fill_null(items.indices, -1).to_numpy(zero_copy_only=False)
        of = text.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        self.listed = listed[order]
        self.listed_from = np.searchsorted(of[order], np.arange(len(first)))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        width = np.diff(first)
        for size in np.unique(width):
            mine = np.flatnonzero(width == size)
            rows = numbers[first[mine][:, None] + np.arange(size)]
            value = window_hashes(rows.T)
            by_value = np.argsort(value, kind="stable")
            bits = np.zeros(1 << max(10, int(len(mine) * 16).bit_length()), bool)
            bits[value & np.uint64(len(bits) - 1)] = True
            self.tables[int(size)] = value[by_value], rows[by_value], mine[by_value], bits

    def find(self, numbers: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, windows) of what occurs; numbers are -1 for unknown words, left has the words to a text's end."""
        known = np.concatenate([[0], np.cumsum(numbers >= 0)])
        for size, (values, rows, names, bits) in self.tables.items():
            if len(numbers) < size:
                continue
            n = len(numbers) - size + 1
            at = np.flatnonzero((known[size:] - known[:n] == size) & (left[:n] >= size))
            value = window_hashes([numbers[at + k] for k in range(size)])
            there = bits[value & np.uint64(len(bits) - 1)]
            at, value = at[there], value[there]
            place = np.searchsorted(values, value)
            while len(at):  # a second round only for windows with one hash
                alike = (place < len(values)) & (values[np.minimum(place, len(values) - 1)] == value)
                at, value, place = at[alike], value[alike], place[alike]
                same = (numbers[at[:, None] + np.arange(size)] == rows[place]).all(1)
                yield size, at[same], names[place[same]]
                at, value, place = at[~same], value[~same], place[~same] + 1


def window_hashes(columns) -> np.ndarray:
    """A hash of the numbers in each row; columns are the first numbers, the second ones and so on."""
    out = np.uint64(0)
    for column in columns:
        out = batches.mixed(out * np.uint64(0x9DDFEA08EB382D69) + column.astype(np.uint64) + np.uint64(1))
    return out


def scan_piece(column: pa.Array, index: Index) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """n_words, n_hit, spans (in words and characters) and items of each text."""
    body, at = batches.string_bytes(column)
    starts, ends, first = batches.words(body, at, APART)
    texts, count = len(column), np.diff(first)
    coded = batches.word_array(body, starts, ends).dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, value_set=index.vocabulary), -1).to_numpy()
    numbers = known[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int32)
    of = np.repeat(np.arange(texts), count)
    left = first[1:][of] - np.arange(len(of))
    cover = np.zeros(len(of) + 1, np.int64)
    met = []
    for size, place, window in index.find(numbers, left):
        np.add.at(cover, place, 1)
        np.subtract.at(cover, place + size, 1)
        met.append(np.unique(np.stack([of[place], window], 1), axis=0))
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    # maximal runs of hit words within a text
    change = hit.copy()
    change[1:] &= ~hit[:-1] | (of[1:] != of[:-1])
    low = np.flatnonzero(change)
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | (of[1:] != of[:-1])
    high = np.flatnonzero(stop)
    begin = np.concatenate([[0], np.cumsum(np.bincount(of[low], minlength=texts))]) if len(low) else np.zeros(texts + 1, np.int64)
    spans = [low - first[of[low]], high + 1 - first[of[low]], low, low]
    if len(low):
        letters = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        before = letters[at[of[low]]]
        spans[2:] = letters[starts[low]] - before, letters[ends[high]] - before
    spans = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in spans], fields=list(SPAN)))
    pairs = np.concatenate(met) if met else np.zeros((0, 2), np.int64)
    size = index.listed_from[pairs[:, 1] + 1] - index.listed_from[pairs[:, 1]]
    lead = np.repeat(index.listed_from[pairs[:, 1]] - np.cumsum(size) + size, size) + np.arange(size.sum())
    pairs = np.stack([np.repeat(pairs[:, 0], size), index.listed[lead]], 1) if len(lead) else np.zeros((0, 2), np.int64)
    pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(texts + 1)).astype(np.int32)), index.items.take(pa.array(pairs[:, 1], pa.int64())))
    return count, total[first[1:]] - total[first[:-1]], spans, items


def _scan(index, keep: int, hits_only: bool):
    """mapInArrow function on rows whose last column is the text: the columns before it, n_words, n_hit, spans, items."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            name = batch.schema.names[-1]
            for a, b in batches.pieces(batch, name):
                part = batch.slice(a, b - a)
                n_words, n_hit, spans, items = scan_piece(part.column(keep), index.value)
                columns = [*part.columns[:keep], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), spans, items]
                out = pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:keep], "n_words", "n_hit", "spans", "items"])
                yield out.filter(pa.array(n_hit > 0)) if hits_only else out

    return run


def _united(spans: Column) -> Column:
    """Spans in order, with those that meet put together."""

    def put(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["char_start"].alias("char_start"), F.greatest(last["char_end"], s["char_end"]).alias("char_end"))
        meets = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"])
        return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), put)


def find_contamination(docs: DataFrame, bench: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", bench_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep columns, n_words, n_hit, word_spans and char_spans (array<struct<start, end>>, end exclusive), items (sorted ids)."""
    spark = docs.sparkSession
    listed = checkpointed(windows(bench, item_id, bench_text, size))
    total = listed.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep if c not in RESULTS]).alias("kept")
    key = F.xxhash64("item", "window")
    item = listed.schema["item"].dataType.simpleString()
    results = f"n_words bigint, n_hit bigint, spans {SPANS}, items array<{item}>"
    in_words = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("word_spans")
    in_chars = F.transform("spans", lambda s: F.struct(s["char_start"].alias("start"), s["char_end"].alias("end"))).alias("char_spans")

    def scanned(rows: DataFrame, k: int, hits_only: bool) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(listed.where(F.pmod(key, F.lit(blocks)) == k).select("window", "item").toArrow()))
        before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
        return rows.mapInArrow(_scan(index, len(rows.columns) - 1, hits_only), f"{before}, {results}")

    if blocks == 1:
        return scanned(docs.select(kept, F.col(text).alias("text")), 0, False).select("kept.*", "n_words", "n_hit", in_words, in_chars, F.array_sort("items").alias("items"))
    # rows alike in their text have the same hits, so the text's hash and length name what the blocks find
    rows = docs.select(kept, F.coalesce(F.col(text), F.lit("")).alias("text")).select("kept", F.xxhash64("text").alias("h"), F.md5("text").alias("h2"), "text")
    parts = reduce(DataFrame.unionByName, [scanned(rows.select("h", "h2", "text").dropDuplicates(["h", "h2"]), k, True) for k in range(blocks)])
    flat = lambda c: F.flatten(F.collect_list(c))
    found = parts.groupBy("h", "h2").agg(_united(flat("spans")).alias("spans"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
    joined = rows.select("kept", "h", "h2", F.size(text_words(folded(F.col("text")))).cast("long").alias("n_words")).join(found, ["h", "h2"], "left")
    joined = joined.withColumns({"spans": F.coalesce("spans", F.array().cast(SPANS)), "items": F.coalesce("items", F.array().cast(f"array<{item}>"))})
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return joined.select("kept.*", "n_words", hit.alias("n_hit"), in_words, in_chars, "items")


def _cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function on (full, text, char_spans), of texts with hits: full, cut."""
    for batch in stream:
        cut = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            edges = [0, *[x for s in spans for x in (s["start"], s["end"])], len(text)]
            cut.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], names=["full", "cut"])


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """docs without the contaminated ones (remove="documents"), or with the hit spans cut out of the texts ("spans")."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("full"), F.col(text).alias("text"))
    found = find_contamination(whole, bench, keep=("full", "text"), **options)
    if remove == "documents":
        return found.where("n_hit = 0").select("full.*")
    clean = found.where("n_hit = 0").select("full.*")
    cut = found.where("n_hit > 0").select("full", "text", "char_spans").mapInArrow(_cut, f"full {whole.schema['full'].dataType.simpleString()}, cut string")
    return clean.unionByName(cut.select(*[(F.col("cut") if c == text else F.col(f"full.`{c}`")).alias(c) for c in docs.columns]))


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's columns from find_contamination over all documents."""
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    found = find_contamination(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Every window of every document against every window of every item, as texts.
SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS gram FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(i) WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT row, i, size, array_to_string(ws[i:i + size - 1], ' ') AS gram FROM d, (SELECT DISTINCT size FROM g) s, unnest(range(1, len(ws) - size + 2)) AS r(i)),
m AS (SELECT row, i, p.size, item_id FROM p JOIN g USING (gram)),
h AS (SELECT row, count(DISTINCT k) AS n_hit FROM m, unnest(range(i, i + size)) AS r(k) GROUP BY row),
t AS (SELECT row, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS named FROM m GROUP BY row)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN t USING (row)"""

QUERIES = {"op11_decontamination": op11_decontamination}
ORACLE_SQL: dict[str, str] = {"op11_decontamination": SQL}
