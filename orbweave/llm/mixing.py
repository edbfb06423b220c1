"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same copy number target / source_size. Its whole part is certain; the fraction is
an inclusion probability. Pairs of documents fight over it: mass moves from one to the other, measured in words, in a
random direction whose odds keep both expectations, until one of the two is 0 or 1. So the words of a source stay as
they are in sum until one document with a fraction is left, which goes to the nearer side: at most half its size off.

The fights run as a reduction tree: a level deals the open documents of each source into groups of about GROUP by a
hash, folds each group in one expression, settles all but one document of it, and hands that one to the next level.
A source of any size is many groups, and each level holds about 1 / GROUP of the rows of the one before. Levels go
through checkpoint files. Everything is a DataFrame expression.

Defined results: a null text has size 0 and is taken 0 times; null sources are one source; each row has a decision of its
own, repeated rows and rows without an id too; an empty table gives no rows; extra columns, of any name, are kept by mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.expressions import let
from orbweave.llm.storage import checkpointed, repeated, small_side

#: Weights of the sources by code point, null last, over and over.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
GROUP = 32
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds target (words) to a table of one row for each source, with source and source_size.

    Targets share the total by weight; one over MOST_COPIES times its source is cut to that, and the excess is shared
    again by weight. The fixed point has a closed form: in the order of cap / weight the first sources are cut, the
    others get level * weight, and the level follows from running sums. The windows sort one row for each source.
    """
    name = F.col("source").asc_nulls_last()
    place = F.pmod(F.row_number().over(Window.orderBy(name)) - 1, F.lit(len(WEIGHTS))) + 1
    rows = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), place.cast("int"))).withColumn("_cap", MOST_COPIES * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), name)
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    left = F.sum("source_size").over(order.rowsBetween(first, last)) - F.coalesce(F.sum("_cap").over(order.rowsBetween(first, -1)), F.lit(0.0))
    level = left / F.sum("_w").over(order.rowsBetween(0, last))
    rows = rows.withColumn("_level", F.when(F.col("_cap") > level * F.col("_w"), level))
    # once a source is not cut, no later one is, and its level holds for all of them
    held = F.first("_level", ignorenulls=True).over(order.rowsBetween(first, 0))
    return rows.withColumn("target", F.coalesce(held * F.col("_w"), F.col("_cap"))).drop("_w", "_cap", "_level")


def _uniform(*cols: Column | str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def _fight(acc: Column, b: Column) -> Column:
    """The open unit of the fold against the next one; at least one of them comes out with 0 or 1."""
    a = acc["open"]
    can_rise, can_fall = F.least((1 - a["p"]) * a["words"], b["p"] * b["words"]), F.least(a["p"] * a["words"], (1 - b["p"]) * b["words"])
    whole = lambda p: F.when(p < _EPS, F.lit(0.0)).when(p > 1 - _EPS, F.lit(1.0)).otherwise(p)

    def settle(f):
        pa, pb = whole(a["p"] + f / a["words"]), whole(b["p"] - f / b["words"])
        is_open = lambda p: (p > 0) & (p < 1)
        won = lambda x, p: F.array(F.struct(x["row"].alias("row"), p.cast("long").alias("extra")))
        nobody = F.struct(F.lit(True).alias("none"), b["u"].alias("u"), b["row"].alias("row"), b["words"].alias("words"), b["p"].alias("p"))
        return (
            F.when(is_open(pa), F.struct(a.withField("p", pa).alias("open"), F.concat(acc["done"], won(b, pb)).alias("done")))
            .when(is_open(pb), F.struct(F.struct(F.lit(False).alias("none"), b["u"].alias("u"), b["row"].alias("row"), b["words"].alias("words"), pb.alias("p")).alias("open"), F.concat(acc["done"], won(a, pa)).alias("done")))
            .otherwise(F.struct(nobody.alias("open"), F.concat(acc["done"], won(a, pa), won(b, pb)).alias("done")))
        )

    return let(F.when(b["u"] * (can_rise + can_fall) < can_fall, can_rise).otherwise(-can_fall), settle)


def _fold(items: Column, row_type) -> Column:
    """array<struct<u, row, words, p>> -> struct<open: struct<none, u, row, words, p>, done: array<struct<row, extra>>>."""
    done = F.array().cast(f"array<struct<row:{row_type.simpleString()},extra:bigint>>")
    start = F.struct(F.struct(F.lit(True).alias("none"), F.lit(0.0).alias("u"), F.lit(None).cast(row_type).alias("row"), F.lit(0.0).alias("words"), F.lit(0.0).alias("p")).alias("open"), done.alias("done"))
    taken = lambda acc, x: F.struct(F.struct(F.lit(False).alias("none"), x["u"].alias("u"), x["row"].alias("row"), x["words"].alias("words"), x["p"].alias("p")).alias("open"), acc["done"].alias("done"))
    return F.aggregate(items, start, lambda acc, x: F.when(acc["open"]["none"], taken(acc, x)).otherwise(_fight(acc, x)))


def pivotal(units: DataFrame, seed: int = 0, group: int = GROUP) -> DataFrame:
    """Rounds units (source, row struct, words double > 0, p in (0, 1), n: units of the source) to row, extra in {0, 1}.

    The row struct names a unit; its hash is all the randomness, so reruns agree.
    """
    row_type = units.schema["row"].dataType
    most = units.agg(F.max("n")).first()[0] or 0
    open_, parts = units.withColumn("groups", F.ceil(F.col("n") / group)).drop("n"), []
    level = 0
    while most:
        item = F.struct(_uniform(F.lit(seed), F.lit(level), "row").alias("u"), "row", "words", "p")
        dealt = open_.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed), F.lit(~level), "row"), F.col("groups")))
        folded = dealt.groupBy("source", "_g").agg(F.max("groups").alias("groups"), F.array_sort(F.collect_list(item)).alias("_items"))
        folded = checkpointed(folded.select("source", "groups", _fold(F.col("_items"), row_type).alias("f")))
        parts.append(folded.select(F.explode("f.done").alias("d")).select("d.row", "d.extra"))
        left = folded.where(~F.col("f.open.none")).select("source", "groups", F.col("f.open.row").alias("row"), F.col("f.open.words").alias("words"), F.col("f.open.p").alias("p"))
        # a source that was one group has one unit left at most: to the nearer side
        parts.append(left.where("groups = 1").select("row", (F.col("p") >= 0.5).cast("long").alias("extra")))
        open_ = left.where("groups > 1").withColumn("groups", F.ceil(F.col("groups") / group))
        most, level = (0 if most <= group else -(-most // group)), level + 1
    out = units.select("row", F.lit(0).cast("long").alias("extra")).limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def _units(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """doc_id, source, size, h (hash of the text) and rows: how many rows are alike in all of these."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("h"))
    return checkpointed(sized.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("rows")))


def _decided(units: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, h, rows, source_size, target, copies: a row for each row of the documents."""
    by_source = targets(checkpointed(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))))
    wide = small_side(checkpointed(by_source.withColumnRenamed("source", "of_source")))
    share = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    each = repeated(units, F.col("rows"), "nth")
    rows = each.join(wide, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source").withColumn("share", F.coalesce(share, F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor(F.col("share") + _EPS)).withColumn("p", F.col("share") - F.col("whole"))
    unsettled = (F.col("p") > _EPS) & (F.col("size") > 0)
    row = F.struct("doc_id", "source", "size", "h", "nth", "rows", "source_size", "target", F.col("whole").alias("copies"))
    won = pivotal(rows.where(unsettled).select("source", row.alias("row"), F.col("size").cast("double").alias("words"), "p", "n"), seed)
    plain = rows.where(~unsettled).select(row.alias("row"), F.lit(0).cast("long").alias("extra"))
    return plain.unionByName(won).select("row.*", "extra").withColumn("copies", F.when(F.col("size") > 0, F.col("copies") + F.col("extra")).otherwise(0)).drop("extra", "nth")


def decide(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """For each row of docs: doc_id, source, size, h (hash of the text), rows (rows alike in these), source_size, target, copies."""
    return _decided(_units(docs, doc_id, source, text), seed)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. The decisions are short rows; texts are shuffled once.

    Of rows alike in id, source and text, which each have a decision, one stands for all.
    """
    copies = decide(docs, doc_id, source, text, seed).groupBy("doc_id", "source", "size", "h").agg(F.first("rows").alias("rows"), F.sum("copies").alias("copies")).where("copies > 0")
    of = lambda c: F.col(f"full.`{c}`")
    full = docs.select(F.struct(*docs.columns).alias("full"))
    keyed = full.select("full", of(doc_id).alias("own_id"), of(source).alias("own_source"), word_count(of(text)).alias("own_size"), F.xxhash64(of(text)).alias("own_h"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size")) & (F.col("own_h") == F.col("h"))
    one = keyed.join(copies.where("rows = 1"), same)
    more = keyed.join(copies.where("rows > 1"), same).dropDuplicates(["own_id", "own_source", "own_size", "own_h"])
    return repeated(one.unionByName(more).select("full", "copies"), F.col("copies"), "nth").select("full.*")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The contract's columns from decide over all documents."""
    found = decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op7_mix_sources": op7_mix_sources}
ORACLE_SQL: dict[str, str] = {}
