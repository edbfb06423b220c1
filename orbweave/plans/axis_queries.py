"""Queries on bins and on ordered nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import binning as B
from orbweave.operators import ordered as O
from orbweave.plans.adapters import CELLS, PATH, cells, every_path, path, table, with_

Q, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        Q[name] = f
        SQL[name] = sql
        return f

    return keep


def path_query(name: str, sql: str):
    """The query on every path, also as name_all."""

    def keep(f):
        query(name, sql)(lambda s, d: f(path(s, d)))
        query(f"{name}_all", sql)(lambda s, d: f(every_path(s, d)))
        return f

    return keep


def _band(animal: str) -> str:
    edges = B.OCTAVES[animal]
    return "CASE " + " ".join(f"WHEN frequency >= {e} THEN {k}" for k, e in reversed(list(enumerate(edges)))) + " END"


for _animal in ("mouse", "gerbil"):

    @query(f"octave_mean_{_animal}", with_(CELLS, f"f AS (SELECT {_band(_animal)} AS band, avg(value) AS value FROM cells GROUP BY 1)") + f"SELECT b::INT AS band, round_even(value, 6) AS value FROM range({len(B.OCTAVES[_animal])}) t(b) LEFT JOIN f ON f.band = b")
    def _(s, d, animal=_animal):
        return B.by_octave(cells(s, d), animal, "frequency", "value").select("band", F.bround("value", 6).alias("value"))


@query("octave_sum", with_(CELLS, f"f AS (SELECT {_band('mouse')} AS band, sum(value) AS value FROM cells GROUP BY 1)") + "SELECT b::INT AS band, round_even(value, 4) AS value FROM range(7) t(b) LEFT JOIN f ON f.band = b")
def _(s, d):
    return B.by_octave(cells(s, d), "mouse", "frequency", "value", "sum").select("band", F.bround("value", 4).alias("value"))


@query("transduction_efficiency", with_(CELLS) + f"SELECT dataset, {_band('mouse')} AS band, CASE WHEN count(*) FILTER (marker IN (1, 2)) = 0 THEN NULL ELSE (count(*) FILTER (marker = 1))::DOUBLE / count(*) FILTER (marker IN (1, 2)) END AS efficiency FROM cells GROUP BY 1, 2")
def _(s, d):
    return B.transduction_efficiency(cells(s, d), "mouse", "frequency", "marker", ("dataset",))


@query("fraction_bin_mean", with_(CELLS) + "SELECT greatest(1, ceil(length_fraction * 10)::INT) AS bin, round_even(avg(value), 6) AS value FROM cells GROUP BY 1")
def _(s, d):
    return B.average_by_fraction(cells(s, d), 10, "length_fraction", "value").select("bin", F.bround("value", 6).alias("value"))


_HIST = "CASE " + " ".join(f"WHEN length_fraction >= {k * (1 / 10)!r}::DOUBLE THEN {k}" for k in range(9, -1, -1)) + " END"


@query("density_by_bins", with_(CELLS, f"f AS (SELECT {_HIST} AS bin, count(*) AS c FROM cells GROUP BY 1)") + "SELECT b::INT AS bin, coalesce(c, 0) / (5000.0::DOUBLE / 10) AS density FROM range(10) t(b) LEFT JOIN f ON f.bin = b")
def _(s, d):
    return B.density_by_bins(cells(s, d), 10, "length_fraction", 5000.0)


@query("sliding_density", with_(CELLS) + "SELECT p AS point, count(*) FILTER (abs(length_fraction - (0.0::DOUBLE + p * (1.0::DOUBLE / 50))) <= 0.05::DOUBLE) AS n FROM cells, range(51) t(p) GROUP BY 1")
def _(s, d):
    return B.sliding_density(cells(s, d), "length_fraction", 0.0, 1.0, 51, 0.1)


@query("total_run_length", with_(CELLS) + "SELECT round_even(quantile_cont(value / length_fraction, 0.5), 6) AS run_length FROM cells WHERE length_fraction > 0")
def _(s, d):
    return B.total_run_length(cells(s, d), "value", "length_fraction").select(F.bround("run_length", 6).alias("run_length"))


@query(
    "otsu_threshold",
    """WITH r AS (SELECT min(l_quantity * l_tax) lo, max(l_quantity * l_tax) hi FROM lineitem), h AS (SELECT least(255, floor((l_quantity * l_tax - lo) / ((hi - lo) / 256))::INT) AS bin, count(*) AS n, any_value(lo) lo, any_value(hi) hi FROM lineitem, r GROUP BY 1),
c AS (SELECT bin, n, lo + (hi - lo) / 256 * (bin + 0.5::DOUBLE) AS center FROM h), u AS (SELECT bin, center, sum(n) OVER (ORDER BY bin) w1, sum(n * center) OVER (ORDER BY bin) s1, sum(n) OVER () w, sum(n * center) OVER () s FROM c)
SELECT round_even(center, 9) AS threshold FROM u WHERE w > w1 ORDER BY w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) * (s1 / w1 - (s - s1) / (w - w1)) DESC, bin LIMIT 1""",
)
def _(s, d):
    li = table(s, d, "lineitem").select((F.col("l_quantity") * F.col("l_tax")).alias("v"))
    return B.otsu(li, "v").select(F.bround("threshold", 9).alias("threshold"))


@query("largest_gaps", "SELECT low, high, high - low AS gap FROM (SELECT v AS low, lead(v) OVER (ORDER BY v) AS high FROM (SELECT DISTINCT value AS v FROM events)) WHERE high IS NOT NULL ORDER BY gap DESC, low LIMIT 5")
def _(s, d):
    return B.largest_gaps(table(s, d, "events"), "value", 5)


_STEP = "coalesce(sqrt(" + " + ".join(f"({c} - lag({c}) OVER w) * ({c} - lag({c}) OVER w)" for c in "xyz") + "), 0)"
_WIN = "WINDOW w AS (PARTITION BY dataset ORDER BY node_idx)"
_STEPS = f"steps AS (SELECT *, {_STEP} AS step FROM path {_WIN})"


def _arc(step: str) -> str:
    return f"""arc AS (SELECT *, CASE WHEN node_idx = max(node_idx) OVER (PARTITION BY dataset) THEN 1.0::DOUBLE ELSE length / max(length) OVER (PARTITION BY dataset) END AS length_fraction
FROM (SELECT *, sum({step}) OVER (PARTITION BY dataset ORDER BY node_idx) AS length FROM steps))"""


@path_query("arc_length", with_(PATH, _STEPS, _arc("step")) + "SELECT dataset, node_idx, round_even(length, 6) AS length, round_even(length_fraction, 9) AS length_fraction FROM arc")
def _(nodes):
    return O.arc_length(nodes).select("dataset", "node_idx", F.bround("length", 6).alias("length"), F.bround("length_fraction", 9).alias("length_fraction"))


@path_query("run_length_without_gaps", with_(PATH, _STEPS, _arc("CASE WHEN step <= 60 THEN step ELSE 0 END")) + "SELECT dataset, node_idx, round_even(length, 6) AS length, round_even(length_fraction, 9) AS length_fraction FROM arc")
def _(nodes):
    return O.arc_length(nodes, 60.0).select("dataset", "node_idx", F.bround("length", 6).alias("length"), F.bround("length_fraction", 9).alias("length_fraction"))


@path_query("path_length", with_(PATH, _STEPS) + "SELECT dataset, round_even(sum(step), 6) AS length FROM steps GROUP BY 1")
def _(nodes):
    return O.path_length(nodes).select("dataset", F.bround("length", 6).alias("length"))


@path_query(
    "moving_average",
    with_(PATH, "n AS (SELECT dataset, max(node_idx) AS m FROM path GROUP BY 1)")
    + "SELECT a.dataset, a.node_idx, " + ", ".join(f"round_even(avg(b.{c}), 6) AS {c}" for c in "xyz")
    + " FROM path a JOIN n USING (dataset), range(-2, 3) t(k), path b WHERE b.dataset = a.dataset AND b.node_idx = greatest(0, least(n.m, a.node_idx + k)) GROUP BY 1, 2",
)
def _(nodes):
    return O.moving_average(nodes, 2).select("dataset", "node_idx", *[F.bround(c, 6).alias(c) for c in "xyz"])


_GAP = "sqrt(" + " + ".join(f"(n{c} - {c}) * (n{c} - {c})" for c in "xyz") + ")"


@path_query(
    "extend_path",
    with_(PATH, f"nx AS (SELECT *, {', '.join(f'lead({c}) OVER w AS n{c}' for c in 'xyz')} FROM path {_WIN})", f"pt AS (SELECT *, coalesce(greatest(1, ceil({_GAP} / 25.0)::INT), 1) AS parts FROM nx)")
    + "SELECT dataset, node_idx, part::INT AS part, " + ", ".join(f"CASE WHEN part = 0 THEN {c} ELSE {c} + (n{c} - {c}) * part / parts END AS {c}" for c in "xyz") + " FROM (SELECT *, unnest(range(0, parts)) AS part FROM pt)",
)
def _(nodes):
    return O.extend_path(nodes, 25.0).select("dataset", "node_idx", "part", "x", "y", "z")


_T = "(VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in O.targets(5)) + ") t(target)"


@path_query(
    "equidistant_centers",
    with_(PATH, _STEPS, _arc("step"), f"nx AS (SELECT *, lead(length_fraction) OVER w AS nf, {', '.join(f'lead({c}) OVER w AS n{c}' for c in 'xyz')} FROM arc {_WIN})")
    + "SELECT dataset, target, " + ", ".join(f"round_even({c} + (n{c} - {c}) * ((target - length_fraction) / (nf - length_fraction)), 6) AS {c}" for c in "xyz")
    + f" FROM nx, {_T} WHERE target >= length_fraction AND target < nf",
)
def _(nodes):
    return O.centers(nodes, O.targets(5)).select("dataset", "target", *[F.bround(c, 6).alias(c) for c in "xyz"])


@path_query("nearest_fraction", with_(PATH, _STEPS, _arc("step")) + f"SELECT dataset, target, node_idx AS node FROM (SELECT *, row_number() OVER (PARTITION BY dataset, target ORDER BY abs(length_fraction - target), node_idx) AS k FROM arc, {_T}) WHERE k = 1")
def _(nodes):
    return O.nearest_fraction(nodes, O.targets(5))


_CROPS = "crops AS (SELECT dataset, round_even(avg(length_fraction), 6) AS fraction, round_even(avg(value), 6) AS threshold FROM cells GROUP BY 1)"


@query("fraction_limits", with_(CELLS, _CROPS) + "SELECT dataset, fraction, coalesce((fraction + lag(fraction) OVER w) / 2, 0.0::DOUBLE) AS lo, coalesce((fraction + lead(fraction) OVER w) / 2, 1.0::DOUBLE) AS hi FROM crops WINDOW w AS (ORDER BY fraction)")
def _(s, d):
    crops = cells(s, d).groupBy("dataset").agg(F.bround(F.avg("length_fraction"), 6).alias("fraction"))
    return O.fraction_limits(crops).select("dataset", "fraction", "lo", "hi")


_POINT = dict(zip("xyz", (40.0, 10.0, 5.0), strict=True))
_HERE = "sqrt(" + " + ".join(f"({c} - {v}::DOUBLE) * ({c} - {v}::DOUBLE)" for c, v in _POINT.items()) + ")"
_THERE = "sqrt(" + " + ".join(f"(n{c} - {v}::DOUBLE) * (n{c} - {v}::DOUBLE)" for c, v in _POINT.items()) + ")"


@path_query(
    "insertion_place",
    with_(PATH, f"nx AS (SELECT *, {', '.join(f'lead({c}) OVER w AS n{c}' for c in 'xyz')} FROM path {_WIN})", f"c AS (SELECT dataset, node_idx AS after, coalesce({_HERE} + {_THERE} - {_GAP}, {_HERE}) AS cost FROM nx UNION ALL SELECT dataset, -1, {_HERE} FROM path WHERE node_idx = 0)")
    + "SELECT dataset, after, round_even(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY cost, after) AS k FROM c) WHERE k = 1",
)
def _(nodes):
    return O.insertion_place(nodes, (40.0, 10.0, 5.0)).select("dataset", "after", F.bround("cost", 6).alias("cost"))


@path_query("central_path_table", with_(PATH) + "SELECT dataset, node_idx, round_even(x, 0)::INT AS x, round_even(y, 0)::INT AS y, round_even(z, 0)::INT AS z FROM path")
def _(nodes):
    return O.central_path_table(nodes).select("dataset", "node_idx", "x", "y", "z")


QUERIES, ORACLE_SQL = Q, SQL
