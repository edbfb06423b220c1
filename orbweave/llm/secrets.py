"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Everything is a DataFrame expression: a text never leaves its row, so no key can be hot, and the only shuffle is of
a histogram with a bounded number of cells.

The battery looks at each token of MIN_CHARS or more characters that mixes digits with letters or switches case
often. It infers the token's encoding (hex, base32, base36, base62, base64) and runs three tests on it:

* chi-squared distance from a uniform alphabet,
* runs of character classes (digit, lower, upper, other),
* serial correlation of neighbouring code values.

Each is put as an equivalence test: the null hypothesis is that the token is *structured* (a skewed alphabet, few
runs, correlated neighbours), so a small p says that it looks random, and a short token can't reach a small p. The
three are combined (Stouffer) and Benjamini-Hochberg runs within bands of length over all tokens of the corpus, on a
histogram of log p whose cells round p up.

Defined results: a null text counts as empty; a null id is kept; repeated rows are scanned each on their own; extra
columns are ignored; an empty table gives no rows. A text of one long token, or of a hundred thousand matches, takes a time
that grows with its length and the matches, not with pairs of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.expressions import let, running

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "random")

MIN_CHARS = 16
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_CHARS},}}+={{0,2}}"
ALPHABETS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 62: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: What structured tokens show at least: excess coincidences, part of the expected runs, correlation.
EXCESS, RUNS, CORRELATION = 1.0, 0.6, 0.5
BANDS = (24, 32, 48, 96)
CELLS_PER_DECADE, MOST_CELLS = 20, 400
FDR = 0.001


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of all matches, in code points; value is that of the group."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap).cast("bigint"))

    def placed(m):
        # a match ends where the gaps and matches up to it do; what follows the last match is no match
        sizes = F.transform(m, lambda x: F.length(x["all"]).cast("bigint"))
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), sizes, lambda gap, size: gap + size))
        return F.zip_with(ends, m, lambda end, x: F.struct((end - F.length(x["all"])).cast("bigint").alias("start"), end.alias("end"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(kind))


def untouched(found: Column, base: Column) -> Column:
    """The found spans that no base span overlaps (arrays of structs with start and end), in the order of start.

    Both are put in one order; a base span before overlaps if the largest end so far is over the start, one behind if
    the next start is under the end. So the steps grow with the number of spans, not with the pairs.
    """
    both = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"))), F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end")))))
    far = F.lit(1 << 60).cast("bigint")

    def kept(x):
        before = running(F.transform(x, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(F.lit(-1).cast("bigint"))), F.greatest)
        after = F.reverse(running(F.reverse(F.transform(x, lambda s: F.when(s["own"] == 0, s["start"]).otherwise(far))), F.least))
        sides = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        free = F.zip_with(x, sides, lambda s, e: F.when((s["own"] == 1) & (e["b"] <= s["start"]) & (e["a"] >= s["end"]), F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.filter(free, lambda s: s.isNotNull())

    plain = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when((F.size(found) == 0) | (F.size(base) == 0), plain).otherwise(let(both, kept))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, good to seven digits."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _pair_sums(codes: Column) -> Column:
    """Sums over neighbours for the serial correlation, in one walk."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), F.lit(None).cast("double").alias("last"), zero.alias("x"), zero.alias("y"), zero.alias("xx"), zero.alias("yy"), zero.alias("xy"))

    def step(a, c):
        x, y = a["last"], c
        return F.when(x.isNull(), F.struct(a["n"].alias("n"), y.alias("last"), *[a[k].alias(k) for k in ("x", "y", "xx", "yy", "xy")])).otherwise(
            F.struct((a["n"] + 1).alias("n"), y.alias("last"), (a["x"] + x).alias("x"), (a["y"] + y).alias("y"), (a["xx"] + x * x).alias("xx"), (a["yy"] + y * y).alias("yy"), (a["xy"] + x * y).alias("xy"))
        )

    return F.aggregate(codes, start, step)


def _encoding(plain: Column) -> Column:
    """Size of the smallest alphabet that fits; null for decimal numbers."""
    return (
        F.when(plain.rlike("^[0-9]+$"), F.lit(None))
        .when(plain.rlike("^[0-9a-f]+$"), F.lit(16))
        .when(plain.rlike("^[A-Z2-7]+$"), F.lit(32))
        .when(plain.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), F.lit(36))
        .when(plain.rlike("^[0-9A-Za-z]+$"), F.lit(62))
        .otherwise(F.lit(64))
    )


def _squares(text: Column, n: Column, chars: Column) -> Column:
    """Sum of the squared counts of chars in a text of n characters."""
    return F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(text, c, F.lit(""))), F.lit(2.0)))


def _z_chi(k: Column, n: Column, squares: Column) -> Column:
    return ((k - 1) + n * EXCESS - (k / n * squares - n)) / F.sqrt(2 * (k - 1) + 4 * n * EXCESS)


def _z_runs(n: Column, runs: Column, squares: Column) -> Column:
    """A token of one class has one run whatever it is: the test is silent then."""
    expected = 1 + n - squares / n
    spread = F.sqrt(F.greatest((expected - 1) * (n - expected) / n, F.lit(1.0)))
    return F.when(squares >= n * n, F.lit(0.0)).otherwise((runs - RUNS * expected) / spread)


def _z_serial(n: Column, sums: Column) -> Column:
    def from_sums(s):
        over = F.sqrt(F.greatest((s["n"] * s["xx"] - s["x"] * s["x"]) * (s["n"] * s["yy"] - s["y"] * s["y"]), F.lit(0.0)))
        r = let(over, lambda o: F.when(o > 0, F.abs((s["n"] * s["xy"] - s["x"] * s["y"]) / o)).otherwise(F.lit(1.0)))
        return (math.atanh(CORRELATION) - F.atanh(F.least(r, F.lit(0.999)))) * F.sqrt(n - 3)

    return let(sums, from_sums)


def randomness_p(token: Column) -> Column:
    """p of the null hypothesis that a token is structured; null where no encoding fits or it is too short."""

    def tested(t):
        k, folded, n = t["k"].cast("double"), t["folded"], F.length(t["folded"]).cast("double")
        chars = F.split(folded, "(?!^)(?!$)")
        classes = F.regexp_replace(F.translate(folded, "".join(ALPHABETS[64]), "2" * 26 + "1" * 26 + "0" * 10 + "33"), "[^0-2]", "3")
        alphabet = F.when(t["k"] == 16, ALPHABETS[16]).when(t["k"] == 32, ALPHABETS[32]).when(t["k"] == 36, ALPHABETS[36]).when(t["k"] == 62, ALPHABETS[62]).otherwise(ALPHABETS[64])
        z_runs = let(classes, lambda c: _z_runs(n, F.length(F.regexp_replace(c, r"(.)\1*", "x")).cast("double"), _squares(c, n, F.array(*[F.lit(x) for x in "0123"]))))
        z_serial = let(alphabet, lambda a: _z_serial(n, _pair_sums(F.transform(chars, lambda c: F.instr(a, c).cast("double")))))
        z = _z_chi(k, n, _squares(folded, n, F.array_distinct(chars))) + z_runs + z_serial
        return F.when(t["k"].isNotNull() & (n >= MIN_CHARS), let(z / math.sqrt(3), _upper_tail))

    def folded(plain, k):
        return F.struct(k.alias("k"), F.when((k == 36) & plain.rlike("[A-Z]"), F.lower(plain)).otherwise(F.translate(plain, "-_", "+/")).alias("folded"))

    body = F.regexp_replace(token, "=+$", "")
    plain = let(body, lambda b: F.when(b.rlike("^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), F.replace(b, F.lit("-"), F.lit(""))).otherwise(b))
    plain = let(plain, lambda b: F.when(b.rlike("^[0-9A-F]+$"), F.lower(b)).otherwise(b))
    return let(plain, lambda p: let(let(_encoding(p), lambda k: folded(p, k)), tested))


def _band(length: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(BANDS, 1):
        out = F.when(length >= least, k).otherwise(out)
    return out


def _mixed(token: Column) -> Column:
    """A digit beside letters, or three changes from lower to upper case."""
    return (token.rlike("[0-9]") & token.rlike("[A-Za-z]")) | (F.regexp_count(token, F.lit("[a-z][A-Z]")) >= 3)


def _candidates(text: Column) -> Column:
    """array<struct<start, end, band, cell>> of the tokens under test; cell: floor of -log10 p in CELLS_PER_DECADE steps."""
    tested = F.transform(
        F.filter(spans(text, TOKEN), lambda s: _mixed(s["value"])),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _band(F.length(s["value"])).alias("band"), randomness_p(s["value"]).alias("p")),
    )
    cell = lambda p: F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * CELLS_PER_DECADE), F.lit(MOST_CELLS)).cast("int")
    kept = F.transform(F.filter(tested, lambda s: s["p"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["band"].alias("band"), cell(s["p"]).alias("cell")))
    return F.when(text.rlike(TOKEN), kept).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,band:int,cell:int>>"))


def cutoffs(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """From (band, cell) rows, one row: map of band to the least cell that Benjamini-Hochberg rejects.

    A histogram of at most 5 x 401 cells comes out of the only shuffle, whatever the corpus holds.
    """
    cells = tested.groupBy("band", "cell").count()
    order = Window.partitionBy("band").orderBy(F.col("cell").desc())
    up, all_ = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("count").over(Window.partitionBy("band"))
    passed = cells.select("band", "cell", up.alias("at_most"), all_.alias("tests")).where(F.pow(F.lit(10.0), -F.col("cell") / CELLS_PER_DECADE) * F.col("tests") <= fdr * F.col("at_most"))
    least = passed.groupBy("band").agg(F.min("cell").alias("cell"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("band", "cell"))).alias("cutoffs"))


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fdr: float = FDR) -> DataFrame:
    """keep columns, and secrets: array<struct<start, kind_no, end, kind>> sorted by start, then kind.

    The kinds assign, access and hex are all matches of the patterns; random adds tokens that the battery finds
    random and that no pattern match overlaps.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    tested = docs.select(F.explode(_candidates(whole)).alias("c")).select("c.band", "c.cell")
    limits = cutoffs(tested, fdr).scalar()

    def as_kind(found: Column, k: int) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind_no"), s["end"].alias("end"), F.lit(KINDS[k]).alias("kind")))

    base = F.concat(as_kind(F.filter(spans(whole, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_CHARS), 0), as_kind(spans(whole, ACCESS), 1), as_kind(spans(whole, HEX), 2))
    rows = docs.select(*keep, base.alias("_base"), _candidates(whole).alias("_tested")).withColumn("_limits", limits)
    passed = untouched(F.filter("_tested", lambda s: s["cell"] >= F.element_at(F.col("_limits"), s["band"])), F.col("_base"))
    return rows.select(*keep, F.array_sort(F.concat("_base", as_kind(passed, 3))).alias("secrets"))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's columns from find_secrets over all documents."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda k: F.size(F.filter("secrets", lambda s: s["kind_no"] == k)).cast("long")
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(said(F.filter("secrets", lambda s: s["kind_no"] < 3)), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
        number(3).alias("n_random"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE_SQL: dict[str, str] = {}
