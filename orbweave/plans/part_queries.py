"""Queries on connected parts, Euler numbers and backgrounds of a stack of voxels that grows with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import parts as P
from orbweave.operators import volumes as V
from orbweave.operators.hulls import convex_hulls, inside_hulls
from orbweave.operators.mesh import cube, mesh_measures
from orbweave.operators.spatial import local_ripleys_k
from orbweave.plans.adapters import objects, table, with_

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, y, x, value, label: a voxel for each order with lines, in slices of 20 x 20, as many slices as there are orders."""
    k = F.col("l_orderkey")
    place = {"z": F.floor(k / 400), "y": F.floor(k / 20) % 20, "x": k % 20}
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("value"))
    return rows.select(*[v.cast("long").alias(c) for c, v in place.items()], F.col("value").cast("double").alias("value")).withColumn("label", (F.floor(F.col("z") / 12) * 4 + F.floor(F.col("y") / 10) * 2 + F.floor(F.col("x") / 10) + 1).cast("long"))


STACK = """stack AS (SELECT *, z // 12 * 4 + y // 10 * 2 + x // 10 + 1 AS label FROM (SELECT l_orderkey // 400 AS z, l_orderkey // 20 % 20 AS y, l_orderkey % 20 AS x, max(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY l_orderkey))"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_id, z, y, x, mean: an object for each customer, spread over the stack."""
    k = F.col("c_custkey") * 10
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label_id"), F.floor(k / 400).alias("z"), (F.floor(k / 20) % 20).cast("long").alias("y"), (k % 20).cast("long").alias("x"), F.col("c_acctbal").cast("double").alias("mean"))


PLACES = "places AS (SELECT c_custkey AS label_id, c_custkey * 10 // 400 AS z, c_custkey * 10 // 20 % 20 AS y, c_custkey * 10 % 20 AS x, c_acctbal::DOUBLE AS mean FROM customer)"
DEEP = 1 << 40  #: slices of the stack: no object is cut by its last one
RADIUS = 6

_CELL = "((z + 1048576) * 4398046511104 + (y + 1048576) * 2097152 + x + 1048576)"
_REACH = [
    f"own AS MATERIALIZED (SELECT label, z, y, x, {_CELL} AS cell FROM stack WHERE value > 44)",
    "near AS MATERIALIZED (SELECT a.label, a.cell AS a, b.cell AS b FROM own a JOIN own b ON a.label = b.label AND b.z BETWEEN a.z - 1 AND a.z + 1 AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1)",
    "reach AS (SELECT label, cell, cell AS root FROM own UNION SELECT n.label, n.b, r.root FROM reach r JOIN near n ON n.label = r.label AND n.a = r.cell WHERE r.root < n.b)",
    "named AS MATERIALIZED (SELECT label, cell, min(root) AS part FROM reach GROUP BY 1, 2)",
    "sizes AS (SELECT label, part, count(*) AS n FROM named GROUP BY 1, 2)",
]


def bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack(spark, sf_dir).where("value > 44")


@query("voxel_parts", with_(STACK, *_REACH).replace("WITH", "WITH RECURSIVE", 1) + "SELECT label, part, n FROM sizes WHERE n >= 2")
def _(s, d):
    return P.part_sizes(P.connected_parts(bright(s, d)), least=2)


@query("largest_parts", with_(STACK, *_REACH).replace("WITH", "WITH RECURSIVE", 1) + "SELECT o.label, o.z, o.y, o.x FROM own o JOIN named n ON n.label = o.label AND n.cell = o.cell JOIN (SELECT label, arg_min(part, (-n, part)) AS part FROM sizes GROUP BY 1) t ON t.label = n.label AND t.part = n.part")
def _(s, d):
    return P.largest_parts(bright(s, d))


@query("euler_numbers", with_(STACK, "side AS (SELECT unnest([-1, 0, 1]) AS s)", "elements AS (SELECT DISTINCT label, 2 * z + a.s AS z, 2 * y + b.s AS y, 2 * x + c.s AS x FROM stack, side a, side b, side c WHERE value > 44)") + "SELECT label, sum(CASE WHEN (abs(z % 2) + abs(y % 2) + abs(x % 2)) % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS euler FROM elements GROUP BY 1")
def _(s, d):
    return P.euler_numbers(bright(s, d))


_SCALE = (1.0, 0.5, 0.5)
_OCTANTS = "octants AS (SELECT label, z + 1 - a AS z, y + 1 - b AS y, x + 1 - c AS x, bit_or((1 << (4 * a + 2 * b + c))::INT) AS config FROM stack, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b), (VALUES (0), (1)) u(c) WHERE value > 44 GROUP BY 1, 2, 3, 4)"
_CASES = "cases AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {v!r}::DOUBLE)" for k in range(256) for a, v in [cube(k, _SCALE)]) + ") c(config, area, volume))"


@query("mesh_measures", with_(STACK, _OCTANTS, _CASES) + "SELECT label, round_even(sum(volume), 6) AS volume, round_even(sum(area), 6) AS surface FROM octants JOIN cases USING (config) GROUP BY 1")
def _(s, d):
    return mesh_measures(bright(s, d), _SCALE).select("label", *[F.bround(c, 6).alias(c) for c in ("volume", "surface")])


_FACTOR, _CHUNK = (2, 2, 2), (4, 5, 5)
_MASK = [
    "lit AS (SELECT z, y, x, value, CASE WHEN value < 12 THEN label ELSE 0 END AS label FROM stack)",
    "coarse AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(value) AS value FROM lit GROUP BY 1, 2, 3)",
    "limits AS (SELECT z // 4 AS kz, y // 5 AS ky, x // 5 AS kx, quantile_cont(value, 0.35) AS l FROM coarse GROUP BY 1, 2, 3)",
    "touched AS (SELECT DISTINCT z // 2 AS z, y // 2 AS y, x // 2 AS x FROM lit WHERE label != 0)",
    "mask AS (SELECT c.z, c.y, c.x FROM coarse c JOIN limits ON kz = c.z // 4 AND ky = c.y // 5 AND kx = c.x // 5 WHERE c.value > l AND NOT EXISTS (SELECT 1 FROM touched t WHERE t.z BETWEEN c.z - 1 AND c.z + 1 AND abs(t.z - c.z) + abs(t.y - c.y) + abs(t.x - c.x) <= 1))",
]


def lit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack(spark, sf_dir).withColumn("label", F.when(F.col("value") < 12, F.col("label")).otherwise(0))


@query("adaptive_background", with_(STACK, *_MASK) + "SELECT * FROM mask")
def _(s, d):
    return P.adaptive_background(lit(s, d), _FACTOR, _CHUNK)


def _background(rows: str) -> list[str]:
    box = ", ".join(f"greatest(0, trunc({c} - {RADIUS})::BIGINT) AS lo_{c}, least({n}, {c} + {RADIUS}) AS hi_{c}" for c, n in (("z", DEEP), ("y", 20), ("x", 20)))
    mid = ", ".join(f"lo_{c} + (hi_{c} - lo_{c}) // 2 AS m{c}" for c in "zyx")
    inside = " AND ".join(f"v.{c} >= lo_{c} AND v.{c} < hi_{c}" for c in "zyx")
    return [
        f"balls AS (SELECT *, {mid} FROM (SELECT label_id, {box} FROM places))",
        f"background AS (SELECT label_id, median(v.value) AS background FROM balls JOIN {rows} v ON {inside} AND (v.z - mz) ** 2 + (v.y - my) ** 2 + (v.x - mx) ** 2 <= {RADIUS * RADIUS} GROUP BY 1)",
    ]


@query("local_background", with_(STACK, PLACES, *_background("stack")) + "SELECT label_id, background FROM places LEFT JOIN background USING (label_id)")
def _(s, d):
    return P.local_background(places(s, d), stack(s, d), RADIUS, (DEEP, 20, 20), 3)


@query(
    "locally_normalised",
    with_(STACK, PLACES, *_MASK, "chosen AS (SELECT v.* FROM lit v SEMI JOIN mask m ON m.z = v.z // 2 AND m.y = v.y // 2 AND m.x = v.x // 2)", *_background("chosen"))
    + "SELECT label_id, mean - background AS mean FROM places LEFT JOIN background USING (label_id)",
)
def _(s, d):
    """Means of the objects less the median of the masked background around each."""
    rows = lit(s, d)
    chosen = P.masked(rows, P.adaptive_background(rows, _FACTOR, _CHUNK), _FACTOR)
    found = P.local_background(places(s, d), chosen, RADIUS, (DEEP, 20, 20), 3)
    return V.normalised(places(s, d).select("label_id", "mean"), found, ["mean"])


@query("hull_volumes", None)
def _(s, d):
    """Corners and volume of the hull of each component's objects; tests/test_hulls.py holds them against plain versions."""
    return convex_hulls(objects(s, d), ("component_labels",)).select("component_labels", "n_corners", F.bround("volume", 6).alias("volume"))


@query("ripleys_k_in_hull", None)
def _(s, d):
    """Over the density in the objects' own hull."""
    return local_ripleys_k(objects(s, d), 15.0).withColumn("ripley", F.bround("ripley", 6))


@query("objects_in_hull", None)
def _(s, d):
    """Objects of all components that lie within the hull of component 0."""
    hull = convex_hulls(objects(s, d).where("component_labels = 0"), ())
    return inside_hulls(objects(s, d).select("label_id", "component_labels", "anchor_x", "anchor_y", "anchor_z"), hull, ())


QUERIES, ORACLE_SQL = Q, SQL
