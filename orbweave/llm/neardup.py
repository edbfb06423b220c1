"""MinHash near-duplicates: universal hash minima, banding, signature check, full-set check, connected components.

1. One pass makes each document's record: size and 128-bit hash of its shingle set, BANDS keys of ROWS minima each,
   and a sketch of one bit for each of SKETCH further minima. Documents with equal sets become one class, whose
   name is its smallest id; only classes go on, so copies never meet in pairs.
2. Classes that share a band key are candidates. A bucket is never expanded into all its pairs: each member is tried
   against the bucket's leader only: the one that is in the fullest buckets over all bands, which is near the middle of a
   group of edited copies. Components formed from the links found so far then say which members of a bucket are still apart.
   For these an exact filter takes the place of pairs. Let R be any set; here it is the leader's set with every shingle
   changed in which more than half of its members differ from it, so that what they have in common says nothing. Let c(x)
   be what x and R share, and t be s / (1 + s) for a similarity of s; x and y are linked if they share t (|x| + |y|).
   They share |R| at most, less what either lacks, and what both add: c(x) + c(y) - |R|, and each difference to R that is
   the same in both. So (a) where t (|x| + |y|) <= c(x) + c(y) - |R|, they are linked, and both are linked with the member
   for which t |z| - c(z) is least: a star holds all of these. (b) Others share a difference. They share as well
   t (|x| + |y|) - min(c(x), c(y)) added shingles, so they meet on added ones; or, where that is not positive, perhaps only on
   lacking ones, of which they share what (a) leaves open. They meet on their rarest ones (prefix filter), and only where
   enough of both lists is left from there on for these two (positional filter).
3. Candidates with sizes and sketches (within six standard deviations) that allow the similarity are confirmed on
   their full shingle sets, made anew from the two texts.
4. Components by alternating large-star and small-star; every round goes through a checkpoint.

With 4 rows and 24 bands a pair at 0.85 is missed with probability 2e-8.

Defined results: a null text and one without words has an empty set and no links; a null id has no component and is
kept; rows with equal ids and different texts are documents of their own, each with its component; repeated rows are
copies; ids of any type that has an order will do; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm import batches
from orbweave.llm.components import connected_components
from orbweave.llm.storage import checkpointed, compact, small_side

BANDS, ROWS, SKETCH = 24, 4, 128
#: Words in a shingle and least similarity in hundredths, where nothing else is asked for.
SHINGLE, PERCENT = 5, 80
#: Ids are broadcast up to this count, to find their texts without a shuffle.
WANTED_ROWS = 200_000
#: What most members of groups differ in from their leaders is broadcast up to this count of numbers (8 MB).
USUAL_NUMBERS = 1_000_000
RECORD = "n_shingles bigint, h1 bigint, h2 bigint, keys array<bigint>, s1 bigint, s2 bigint"


def _coefficients(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed).integers(0, 1 << 64, (2, n), np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def minima(values: np.ndarray, begin: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """(n, texts) minima of multiply-add-shift hashes; 2**32 - 1 for an empty text."""
    a, b = _coefficients(seed, n)
    full = np.flatnonzero(np.diff(begin))
    out = np.full((n, len(begin) - 1), 0xFFFFFFFF, np.uint32)
    if len(full):
        x, at = values >> np.uint64(32), begin[full]
        for k in range(n):
            out[k, full] = np.minimum.reduceat(((x * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def records(width: int, text: str, keep: list[str]):
    """mapInArrow function: keep columns and RECORD."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b in batches.pieces(batch, text):
                part = batch.slice(a, b - a)
                body, at = batches.string_bytes(part.column(part.schema.get_field_index(text)))
                values, begin = batches.shingles(body, at, width)
                values, begin = batches.distinct(values, begin)
                number = np.diff(begin)
                low = minima(values, begin, BANDS * ROWS + SKETCH)
                keys = np.zeros((BANDS, len(number)), np.uint64)
                for k in range(BANDS):
                    h = np.full(len(number), k + 1, np.uint64)
                    for r in range(ROWS):
                        h = batches.mixed(h * np.uint64(0x9DDFEA08EB382D69) + low[k * ROWS + r])
                    keys[k] = h
                bits = (batches.mixed(low[BANDS * ROWS :].astype(np.uint64)) & np.uint64(1)).reshape(2, 64, -1)
                sketch = (bits << np.arange(64, dtype=np.uint64)[None, :, None]).sum(1, dtype=np.uint64)
                full = np.flatnonzero(number)
                sums = np.zeros((2, len(number)), np.uint64)
                if len(full):
                    # two sums over the set, of hashes that are mixed in different ways
                    for k in range(2):
                        sums[k, full] = np.add.reduceat(batches.mixed(values ^ np.uint64(0x2545F4914F6CDD1D * k)), begin[full])
                lists = batches.list_array(keys.T.reshape(-1).view(np.int64), np.arange(len(number) + 1) * BANDS, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], pa.array(number), _signed(sums[0]), _signed(sums[1]), lists, _signed(sketch[0]), _signed(sketch[1])], names=[*keep, "n_shingles", "h1", "h2", "keys", "s1", "s2"])

    return run


def packed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (id, text) to (id, z), the text compressed."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in stream:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress((x.as_py() or "").encode()) for x in batch.column(1)], pa.binary())], names=["id", "z"])


def similar(width: int, percent: int):
    """mapInArrow function on (a, b, z_a, z_b): the (a, b) whose full sets are similar enough."""
    import zstandard

    def sets(column):
        unpack = zstandard.ZstdDecompressor()
        body, at = batches.string_bytes(pa.array([unpack.decompress(x.as_py()) for x in column], pa.large_binary()))
        return batches.distinct(*batches.shingles(body, at, width))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi in batches.pieces(batch, "z_a", batches.PIECE // 4):
                part = batch.slice(lo, hi - lo)
                (x, bx), (y, by) = sets(part.column(2)), sets(part.column(3))
                for k in range(hi - lo):
                    p, q = x[bx[k] : bx[k + 1]], y[by[k] : by[k + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep[lo + k] = len(p) > 0 and 100 * both >= percent * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def differences(width: int):
    """mapInArrow function on (lead, id, z_a, z_b): lead, id, number of common shingles, those that only b has, those that only a has."""
    import zstandard

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in stream:
            for lo, hi in batches.pieces(batch, "z_b", batches.PIECE // 4):
                part = batch.slice(lo, hi - lo)
                (x, bx), (y, by) = [batches.distinct(*batches.shingles(*batches.string_bytes(pa.array([unpack.decompress(v.as_py()) for v in part.column(k)], pa.large_binary())), width)) for k in (2, 3)]
                pairs = [(x[bx[k] : bx[k + 1]], y[by[k] : by[k + 1]]) for k in range(hi - lo)]
                more, less = [[np.setdiff1d(p, q, assume_unique=True) for p, q in some] for some in ([(q, p) for p, q in pairs], pairs)]
                lists = [batches.list_array(np.concatenate(some).view(np.int64), np.concatenate([[0], np.cumsum([len(m) for m in some])]), pa.int64()) for some in (more, less)]
                common = np.diff(by) - np.array([len(m) for m in more])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(common), *lists], names=["lead", "id", "common", "added", "lacked"])

    return run


def _rest(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) among members of open buckets (see 2), and links with leaders that came out on the way."""
    plausible = _plausible(percent)
    kind = "bigint"
    lead = compact(open_.groupBy("band", "key").agg(F.min(F.struct((-F.col("mass")).alias("m"), "id", "n")).alias("l")))
    family = compact(open_.join(lead, ["band", "key"]).where("id != l.id").select(F.col("l.id").alias("lead"), F.col("l.n").alias("lead_n"), "id", "n", "comp", "s1", "s2").distinct())
    one, two = texts.select(F.col("id").alias("lead"), F.col("z").alias("z_a")), texts.select("id", F.col("z").alias("z_b"))
    delta = family.select("lead", "id").join(two, "id").join(one, "lead").select("lead", "id", "z_a", "z_b").mapInArrow(differences(width), f"lead {kind}, id {kind}, common bigint, added array<bigint>, lacked array<bigint>")
    t, slack = percent / (100 + percent), 1e-6
    n, common = F.col("n"), F.col("common")
    # what there is for each leader is broadcast where it is small, so that no task gets a large group whole
    per_lead = small_side(compact(family.groupBy("lead").agg(F.min("n").alias("least_n"), F.count("*").alias("members"))))
    both = family.join(delta, ["lead", "id"]).withColumn("linked", (100 + percent) * common >= percent * (n + F.col("lead_n")))
    family = compact(both.join(per_lead, "lead"))
    # from the leader's set to R, of r shingles: what most of its members add is in it, and what most of them lack is not
    for column in ("added", "lacked"):
        usual = family.select("lead", "members", F.explode(column).alias("item")).groupBy("lead", "members", "item").agg(F.count("*").alias("c")).where("2 * c > members")
        per_lead = per_lead.join(compact(usual.groupBy("lead").agg(F.collect_list("item").alias(f"all_{column}"))), "lead", "left").withColumn(f"all_{column}", F.coalesce(f"all_{column}", F.array().cast("array<bigint>")))
    usual = compact(per_lead.select("lead", "all_added", "all_lacked"))
    numbers = usual.agg(F.sum(1 + F.size("all_added") + F.size("all_lacked"))).first()[0] or 0
    family = family.join(F.broadcast(usual) if numbers <= USUAL_NUMBERS else usual, "lead")
    turned = lambda x, y: F.concat(F.array_except(f"all_{y}", y), F.array_except(x, f"all_{x}"))
    family = family.withColumns({"added": turned("added", "lacked"), "lacked": turned("lacked", "added"), "r": F.col("lead_n") + F.size("all_added") - F.size("all_lacked")})
    family = compact(family.drop("all_added", "all_lacked", "lead_n").withColumn("common", n - F.size("added")).withColumn("far", t * n - common))
    middle = small_side(compact(family.groupBy("lead").agg(F.min(F.struct("far", "id", "comp")).alias("z"))))
    family = family.join(middle, "lead")
    star = family.where((F.col("far") + F.col("z.far") <= slack - F.col("r")) & (F.col("comp") != F.col("z.comp"))).select(F.least("id", "z.id").alias("a"), F.greatest("id", "z.id").alias("b"))
    own = ["lead", "r", "id", "n", "comp", "s1", "s2", "common", "linked"]

    def rare(table: DataFrame, column: str, floor) -> DataFrame:
        """Each member's shared items, the rarest first, down to the last one that can be the first in common where floor
        are in common; with each the number that is left of the list, itself included."""
        items = table.select(*own, F.greatest(F.lit(1), F.ceil(floor - slack)).alias("floor"), F.explode(column).alias("item"))
        shared = compact(items.groupBy("lead", "item").agg(F.count("*").alias("c")).where("c > 1"))
        items = compact(items.join(shared, ["lead", "item"]))
        lists = items.groupBy(*own, "floor").agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("x")).where(F.size("x") >= F.col("floor"))
        first = F.slice("x.item", F.lit(1), (F.size("x") - F.col("floor") + 1).cast("int"))
        return compact(lists.select(*own, F.size("x").alias("size"), F.posexplode(first).alias("place", "item")).select(*own, "item", (F.col("size") - F.col("place")).alias("left")))

    def met(table: DataFrame, needed, where) -> DataFrame:
        """Pairs that have an item in common, after which both lists are long enough for what is needed; not both are linked with the leader."""
        sides = [table.select("lead", "item", *extra, *[F.col(c).alias(f"{p}{c}") for c in ("id", "n", "comp", "s1", "s2", "common", "linked", "left")]) for p, extra in (("m_", ["r"]), ("l_", []))]
        # a pair of open members meets once
        once = F.col("l_linked") | (F.col("m_id") < F.col("l_id"))
        long = F.least("m_left", "l_left") >= needed - slack
        pairs = sides[0].where("not m_linked").join(sides[1], ["lead", "item"]).where(once & (F.col("m_comp") != F.col("l_comp")) & plausible("m_", "l_") & long & where)
        return pairs.select(F.least("m_id", "l_id").alias("a"), F.greatest("m_id", "l_id").alias("b"))

    wanted, most = t * (F.col("m_n") + F.col("l_n")), F.least("m_common", "l_common")
    more = met(rare(family, "added", t * (n + F.greatest(F.col("least_n"), F.ceil(n * percent / 100))) - common), wanted - most, F.lit(True))
    # those that may be linked without any added shingle in common
    few = family.where(t * (n + F.greatest(F.col("least_n"), F.ceil(n * percent / 100))) <= common + slack)
    close = met(rare(few, "lacked", F.col("r") + F.col("far") + F.col("z.far")), wanted + F.col("r") - F.col("m_common") - F.col("l_common"), wanted <= most + slack)
    return star.unionByName(more).unionByName(close).distinct(), family.where("linked").select(F.col("lead").alias("a"), F.col("id").alias("b"))


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of class names that hold on full sets. Hot names, which many pairs share, are split by the joins."""
    one, two = texts.select(F.col("id").alias("b"), F.col("z").alias("z_b")), texts.select(F.col("id").alias("a"), F.col("z").alias("z_a"))
    wide = pairs.join(one, "b").join(two, "a").select("a", "b", "z_a", "z_b")
    return compact(wide.mapInArrow(similar(width, percent), pairs.select("a", "b").schema))


def _plausible(percent: int):
    """Whether sizes and sketches of two records allow the similarity."""
    rate = (1 + percent / 100) / 2
    least = int(SKETCH * rate - 6 * (SKETCH * rate * (1 - rate)) ** 0.5)

    def holds(x: str, y: str):
        n, m = F.col(f"{x}n"), F.col(f"{y}n")
        agree = SKETCH - F.bit_count(F.col(f"{x}s1").bitwiseXOR(F.col(f"{y}s1"))) - F.bit_count(F.col(f"{x}s2").bitwiseXOR(F.col(f"{y}s2")))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (agree >= least)

    return holds


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (the smallest id reachable, itself included), kept."""
    kind = docs.select(F.col(doc_id).alias("id")).schema["id"].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    all_ = checkpointed(base.mapInArrow(records(width, "text", ["id", "th"]), f"id {kind}, th bigint, {RECORD}"))
    named = all_.where("id is not null and n_shingles > 0")
    # equal sets: one class, which stands for its row with the smallest id and goes on by a number
    found = named.groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min(F.struct("id", "th", "keys", "s1", "s2")).alias("x"))
    named_classes = checkpointed(found.select("h1", "h2", "n", F.col("x.id").alias("name"), "x.th", "x.keys", "x.s1", "x.s2", F.monotonically_increasing_id().alias("id")))
    classes = named_classes.select("id", "n", "keys", "s1", "s2")
    banded = classes.select("id", "n", "s1", "s2", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    met = banded.join(compact(shared), ["band", "key"])
    mass = met.groupBy("id").agg(F.sum("members").alias("mass"))
    members = compact(met.drop("members").join(compact(mass), "id"))
    # the texts that any candidate can need, compressed, once for all rounds
    wanted = small_side(checkpointed(named_classes.select("id", "name", "th").join(members.select("id").distinct(), "id")).select(F.col("id").alias("number"), "name", F.col("th").alias("name_th")), WANTED_ROWS)
    named_texts = base.join(wanted, (F.col("id") == F.col("name")) & (F.col("th") == F.col("name_th"))).select(F.col("number").alias("id"), "text")
    texts = checkpointed(named_texts.mapInArrow(packed, "id bigint, z binary").groupBy("id").agg(F.first("z").alias("z")))
    plausible = _plausible(percent)

    def side(table: DataFrame, p: str) -> DataFrame:
        return table.select("band", "key", *[F.col(c).alias(f"{p}{c}") for c in table.columns if c not in ("band", "key")])

    lead = compact(members.groupBy("band", "key").agg(F.min(F.struct((-F.col("mass")).alias("m"), "id", "n", "s1", "s2")).alias("x")).select("band", "key", "x.*"))
    stars = side(members, "m_").join(side(lead, "l_"), ["band", "key"]).where((F.col("m_id") != F.col("l_id")) & plausible("m_", "l_"))
    links = _confirmed(stars.select(F.least("m_id", "l_id").alias("a"), F.greatest("m_id", "l_id").alias("b")).distinct(), texts, width, percent)
    comps = connected_components(links)
    placed = members.join(comps.withColumnRenamed("component", "comp"), members["id"] == comps["node"], "left").drop("node").withColumn("comp", F.coalesce("comp", "id"))
    apart = placed.groupBy("band", "key").agg((F.min("comp") != F.max("comp")).alias("apart")).where("apart").select("band", "key")
    open_ = compact(placed.join(compact(apart), ["band", "key"]))
    pairs, more = _rest(open_, texts, width, percent)
    more = compact(more.unionByName(_confirmed(checkpointed(pairs), texts, width, percent)))
    if not more.isEmpty():
        comps = connected_components(comps.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    linked = checkpointed(named_classes.select("h1", "h2", "n", "name", "id").join(comps, F.col("id") == F.col("node")).select("h1", "h2", F.col("n").alias("n_shingles"), "name", "component"))
    smallest = linked.groupBy("component").agg(F.min("name").alias("smallest"))
    alone = named_classes.select("h1", "h2", F.col("n").alias("n_shingles"), "name", "id").join(comps, F.col("id") == F.col("node"), "left_anti").select("h1", "h2", "n_shingles", F.col("name").alias("smallest"))
    by_class = linked.join(smallest, "component").select("h1", "h2", "n_shingles", "smallest").unionByName(alone)
    out = all_.select("id", "n_shingles", "h1", "h2").join(by_class, ["h1", "h2", "n_shingles"], "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id")))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: 3-word shingles, similarity of 0.85 or more, all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
