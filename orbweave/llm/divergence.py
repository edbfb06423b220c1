"""Source divergence audit: which sources of a language use its terms unlike the others, by exact counts.

1. Each task counts the terms of its documents and sends one row for a (lang, term, source) and stretch of its documents,
   so a frequent term comes a few times from a task and not once from every document.
2. These partial rows are dealt by (lang, term) and sorted by (lang, term, source, document). A scan of the runs adds
   up counts and document frequencies and keeps the terms of at least LEAST_DOCS documents. It holds one run's sources at a time.
3. With the groups' sums, counts become smoothed shares p. A second scan of the same runs emits partial sums for pairs of
   sources that share a term. What a source's own terms give against a source without them follows
   from running totals in the order of p, so no pair is made for a term that only one of them has:
   with z the share at count 0, d = p - z, D = max(0, z_other - z), a term gives |z - z_other| + d - 2 min(d, D).
4. Ranks are made from the sums of the partial rows.

Defined results: null lang, source or text is ''; every row is a document of its own, whatever its id; a language without kept terms gives
pairs with 0; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm import batches
from orbweave.llm.storage import checkpointed

LEAST_DOCS = 30
#: Added to each count.
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Partial rows that a task holds before it sends them.
HELD_ROWS = 400_000

#: Bytes outside of A-Z, a-z and of letters beyond ASCII part terms.
APART = np.ones(256, bool)
APART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def count_piece(lang: pa.Array, source: pa.Array, column: pa.Array, first_document: int) -> pa.Table:
    """lang, term, source, document (the first that has it), docs, count."""
    body, at = batches.string_bytes(column)
    starts, ends, first = batches.words(body, at, APART)
    texts = len(column)
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    coded = batches.word_array(body, starts, ends).dictionary_encode()
    # one sort puts a term's groups, and in them its documents, side by side
    order = np.argsort(group, kind="stable")
    rank = np.empty(texts, np.int64)
    rank[order] = np.arange(texts)
    key, times = np.unique(coded.indices.to_numpy().astype(np.int64) * max(texts, 1) + np.repeat(rank, np.diff(first)), return_counts=True)
    term, document = key // max(texts, 1), order[key % max(texts, 1)]
    mine = group[document]
    new = np.ones(len(key), bool)
    new[1:] = (term[1:] != term[:-1]) | (mine[1:] != mine[:-1])
    begin = np.flatnonzero(new)
    docs = np.diff(np.append(begin, len(key)))
    count = np.add.reduceat(times, begin) if len(begin) else times[:0]
    mine = mine[begin]
    take = lambda values, which: values.take(pa.array(which, pa.int64()))
    return pa.table({
        "lang": take(lang.dictionary, mine // max(len(source.dictionary), 1)), "term": take(coded.dictionary.cast(pa.large_string()), term[begin]).cast(pa.string()), "source": take(source.dictionary, mine % max(len(source.dictionary), 1)),
        "document": pa.array(document[begin] + first_document, pa.int64()), "docs": pa.array(docs, pa.int64()), "count": pa.array(count, pa.int64()),
    })


def _merged(parts: list[pa.Table]) -> pa.Table:
    grouped = pa.concat_tables(parts).group_by(["lang", "term", "source"]).aggregate([("document", "min"), ("docs", "sum"), ("count", "sum")])
    return grouped.select(["lang", "term", "source", "document_min", "docs_sum", "count_sum"]).rename_columns(["lang", "term", "source", "document", "docs", "count"])


def _partial(held_rows: int):
    """mapInArrow function on (lang, source, text): the partial rows of a task's documents."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        seen = rows = 0
        for batch in stream:
            for a, b in batches.pieces(batch, "text"):
                part = batch.slice(a, b - a)
                parts.append(count_piece(part.column(0), part.column(1), part.column(2), seen))
                seen, rows = seen + b - a, rows + parts[-1].num_rows
                if rows > held_rows:
                    parts = [_merged(parts)]
                    rows = parts[0].num_rows
                    if rows > held_rows // 2:
                        yield from parts[0].to_batches(10_000)
                        parts, rows = [], 0
        if parts:
            yield from _merged(parts).to_batches(10_000)

    return run


def _changes(table: pa.Table, *names: str) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        new[1:] = False
        for name in names:
            column = table.column(name).combine_chunks()
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return new


def _runs(stream: Iterator[pa.RecordBatch], shrink=lambda t: t) -> Iterator[pa.Table]:
    """Tables of whole (lang, term) runs; the last run of a batch waits for the next one, made smaller by shrink."""
    rest = None
    for batch in stream:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if table.num_rows:
            last = int(np.flatnonzero(_changes(table, "lang", "term"))[-1])
            if last:
                yield table.slice(0, last)
            rest = shrink(table.slice(last))
    if rest is not None and rest.num_rows:
        yield rest


def _by_source(table: pa.Table) -> pa.Table:
    """One row for a source of a sorted table."""
    begin = np.flatnonzero(_changes(table, "lang", "term", "source"))
    out = table.take(pa.array(begin))
    for name in ("docs", "count"):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(np.add.reduceat(table.column(name).to_numpy(), begin), pa.int64()))
    return out


def _kept(least: int):
    """mapInArrow function on sorted partial rows: lang, term, source, count, total (of the lang), first (of its run) of kept terms."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(stream, _by_source):
            table = _by_source(table)
            new = _changes(table, "lang", "term")
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, table.num_rows))
            often = np.repeat(np.add.reduceat(table.column("docs").to_numpy(), begin) >= least, size)
            total = np.repeat(np.add.reduceat(table.column("count").to_numpy(), begin), size)
            out = table.select(["lang", "term", "source", "count"]).append_column("total", pa.array(total, pa.int64())).append_column("first", pa.array(new.astype(np.int64)))
            yield from out.filter(pa.array(often)).combine_chunks().to_batches()

    return run


def pair_sums(table: pa.Table) -> pa.Table:
    """lang, a, b (a before b), shared: sums over the runs of a sorted table (lang, term, source, p, z)."""
    lang, source = table.column("lang").combine_chunks().dictionary_encode(), table.column("source").combine_chunks().dictionary_encode()
    run = np.cumsum(_changes(table, "lang", "term"))
    width = len(source.dictionary)
    code, of = source.indices.to_numpy().astype(np.int64), lang.indices.to_numpy().astype(np.int64)
    p, z = table.column("p").to_numpy(), table.column("z").to_numpy()
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def added():
        key = np.concatenate([keys, *[k for k, _ in held]])
        value = np.concatenate([values, *[v for _, v in held]])
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[begin], np.add.reduceat(value, begin) if len(begin) else value

    step = 1
    i = np.arange(table.num_rows)
    while True:
        i = i[i + step < table.num_rows]
        i = i[run[i] == run[i + step]]
        if not len(i):
            break
        j = i + step
        value = np.abs(p[i] - p[j]) - np.abs(p[i] - z[j]) - np.abs(z[i] - p[j]) + np.abs(z[i] - z[j])
        held.append(((of[i] * width + code[i]) * width + code[j], value))
        if sum(len(k) for k, _ in held) > 1_000_000:
            keys, values = added()
            held = []
        step += 1
    keys, values = added()
    take = lambda x, which: x.dictionary.take(pa.array(which, pa.int64()))
    w = max(width, 1)
    return pa.table({"lang": take(lang, keys // (w * w)), "a": take(source, keys // w % w), "b": take(source, keys % w), "shared": pa.array(values, pa.int64())})


def _pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(stream):
        yield from pair_sums(table).combine_chunks().to_batches()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / total), exactly."""
    return 1 + F.call_function("div", (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def kept_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, held_rows: int = HELD_ROWS) -> DataFrame:
    """lang, term, source, count, total (in the lang), first (1 in one row of each term of a lang), in the shared folder."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(said(lang).alias("lang"), said(source).alias("source"), said(text).alias("text"))
    partial = rows.mapInArrow(_partial(held_rows), "lang string, term string, source string, document bigint, docs bigint, count bigint")
    runs = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return checkpointed(runs.mapInArrow(_kept(least), "lang string, term string, source string, count bigint, total bigint, first bigint"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = kept_terms(docs, lang, source, text, least)
    groups = docs.select(said(lang).alias("lang"), said(source).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("first").alias("firsts"))
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["n", "firsts"])
    whole = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("firsts").alias("v"))
    sized = groups.join(whole, "lang").select("lang", "source", "v", (F.col("n") + PRIOR * F.col("v")).alias("total"), (F.col("lang_n") + PRIOR * F.col("v")).alias("lang_total"))
    none = F.lit(0).cast("bigint")
    sized = checkpointed(sized.withColumn("z", F.when(F.col("v") > 0, _share(none, F.col("total"))).otherwise(none)))
    shares = kept.withColumnRenamed("total", "in_lang").join(sized, ["lang", "source"]).select("lang", "term", "source", _share(F.col("count"), F.col("total")).alias("p"), _share(F.col("in_lang"), F.col("lang_total")).alias("q"), "z")
    shares = checkpointed(shares)

    order = Window.partitionBy("lang", "source")
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    # what pairs share, from the runs
    runs = shares.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    shared = runs.mapInArrow(_pairs, "lang string, a string, b string, shared bigint").groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"))
    # the sum of min(d, D) over a source's terms, for each other source's D, by running totals in the order of d
    one, other = sized.select("lang", "v", F.col("source").alias("a"), F.col("z").alias("za")), sized.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    pairs = one.join(other, "lang").where("a != b")
    steps = shares.groupBy("lang", F.col("source").alias("a"), (F.col("p") - F.col("z")).alias("d")).agg(F.count("*").alias("times"))
    lines = steps.select("lang", "a", F.lit(None).cast("string").alias("b"), "d", "times").unionByName(pairs.select("lang", "a", "b", F.greatest(F.col("zb") - F.col("za"), F.lit(0)).alias("d"), none.alias("times")))
    upto = Window.partitionBy("lang", "a").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    all_of = Window.partitionBy("lang", "a")
    below = lambda c: F.sum(c).over(upto)
    own = F.sum(F.col("d") * F.col("times")).over(all_of) - 2 * (below(F.col("d") * F.col("times")) + F.col("d") * (F.sum("times").over(all_of) - below(F.col("times"))))
    own = lines.withColumn("own", own).where("b is not null").select("lang", "a", "b", "own")
    swapped = lambda df, c: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col(c).alias(f"{c}_back"))
    both = pairs.join(own, ["lang", "a", "b"]).join(swapped(own, "own"), ["lang", "a", "b"]).join(shared.unionByName(shared.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "shared")), ["lang", "a", "b"], "left")
    value = F.col("v") * F.abs(F.col("za") - F.col("zb")) + F.col("own") + F.col("own_back") + F.coalesce("shared", none)
    ranked = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.alias("value"))
    ranked = ranked.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "item")))
    put = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return put(ranked, "pair").unionByName(put(terms, "term"))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


#: Each kept term against each group and each pair of groups.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, s.source, term, coalesce(c.n, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v)::HUGEINT AS q
      FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
      UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE count > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLE_SQL: dict[str, str] = {"op12_source_divergence": SQL}
