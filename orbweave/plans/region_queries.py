"""Queries on regions of labelled voxels, on nodes put into paths, and on shares and thresholds by data set."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from orbweave.operators import regions as R
from orbweave.plans.adapters import CELLS, OBJECTS, PATH, VOXELS, cells, every_path, objects, voxels, with_

Q, SQL = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


_FEATURES = [
    "s AS (SELECT label, count(*) AS area, count(*) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1))::DOUBLE AS extent, max(value) AS intensity_max, avg(value) AS intensity_mean, min(value) AS intensity_min, stddev_pop(value) AS intensity_std, "
    + ", ".join(f"var_pop({c}) AS v{c}" for c in "zyx")
    + ", -covar_pop(z, y) AS vzy, -covar_pop(z, x) AS vzx, -covar_pop(y, x) AS vyx FROM voxels WHERE label != 0 GROUP BY 1)",
    "a AS (SELECT *, 2 * (vz + vy + vx) / 3 AS q FROM s)",
    "b AS (SELECT *, vy + vx - q AS d, vz + vx - q AS e, vz + vy - q AS f FROM a)",
    "c AS (SELECT *, sqrt((d * d + e * e + f * f + 2 * (vzy * vzy + vzx * vzx + vyx * vyx)) / 6) AS p, d * (e * f - vyx * vyx) - vzy * (vzy * f - vyx * vzx) + vzx * (vzy * vyx - e * vzx) AS det FROM b)",
    "g AS (SELECT *, acos(greatest(-1, least(1, CASE WHEN p = 0 THEN 1 ELSE det / (2 * p * p * p) END))) / 3 AS angle FROM c)",
    f"h AS (SELECT *, q + 2 * p * cos(angle) AS l0, q + 2 * p * cos(angle + {2 * pi / 3}) AS l2 FROM g)",
    "ev AS (SELECT *, greatest(0, l0) AS ev0, greatest(0, 3 * q - l0 - l2) AS ev1, greatest(0, l2) AS ev2 FROM h)",
]


@query(
    "region_features",
    with_(VOXELS, *_FEATURES)
    + f"SELECT label, area, round_even(extent, 6) AS extent, round_even(pow(6 * area / {pi}, {1 / 3}), 6) AS equivalent_diameter, intensity_max::DOUBLE AS intensity_max, round_even(intensity_mean, 6) AS intensity_mean, intensity_min::DOUBLE AS intensity_min, round_even(intensity_std, 6) AS intensity_std, "
    + ", ".join(f"round_even(ev{k}, 4) + 0.0 AS ev{k}" for k in range(3))
    + ", round_even(sqrt(greatest(0, 10 * (ev0 + ev1 - ev2))), 4) AS axis_major, round_even(sqrt(greatest(0, 10 * (ev1 + ev2 - ev0))), 4) AS axis_minor FROM ev",
)
def _(s, d):
    found = R.region_features(voxels(s, d))
    digits = {"extent": 6, "equivalent_diameter": 6, "intensity_mean": 6, "intensity_std": 6, "ev0": 4, "ev1": 4, "ev2": 4, "axis_major": 4, "axis_minor": 4}
    return found.withColumns({c: F.bround(c, n) for c, n in digits.items()} | {c: F.col(c).cast("double") for c in ("intensity_max", "intensity_min")})


_OTSU = [
    "span AS (SELECT label, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM voxels WHERE label != 0 GROUP BY 1 HAVING max(value) > min(value))",
    "h AS (SELECT label, lo, hi, least(255, floor((value::DOUBLE - lo) / ((hi - lo) / 256))::INT) AS bin, count(*) AS n FROM voxels JOIN span USING (label) GROUP BY ALL)",
    "u AS (SELECT label, lo, hi, bin, sum(n) OVER w AS w1, sum(n * (2 * bin + 1)) OVER w AS s1, sum(n) OVER (PARTITION BY label) AS w, sum(n * (2 * bin + 1)) OVER (PARTITION BY label) AS s FROM h WINDOW w AS (PARTITION BY label ORDER BY bin))",
    "g AS (SELECT *, (s1 * (w - w1) - (s - s1) * w1)::DOUBLE AS gap FROM u WHERE w > w1)",
    "limits AS (SELECT label, lo + (hi - lo) / 256 * (bin + 0.5::DOUBLE) AS threshold FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY gap * gap / (w1 * (w - w1))::DOUBLE DESC, bin) = 1)",
]


@query("otsu_by_object", with_(VOXELS, *_OTSU) + "SELECT label, round_even(threshold, 6) AS threshold FROM limits")
def _(s, d):
    return R.otsu_by(voxels(s, d).where("label != 0"), "label", "value").select("label", F.bround("threshold", 6).alias("threshold"))


@query("dark_voxels", with_(VOXELS, *_OTSU) + "SELECT z, y, x, label FROM voxels JOIN limits USING (label) WHERE value < threshold")
def _(s, d):
    return R.dark_voxels(voxels(s, d))


_FACES = "(VALUES (0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) AS t(a, b, c)"


@query(
    "opening",
    with_(VOXELS, f"er AS (SELECT z + a AS z, y + b AS y, x + c AS x FROM voxels, {_FACES} WHERE value > 5 GROUP BY 1, 2, 3 HAVING count(*) = 7)") + f"SELECT DISTINCT z + a AS z, y + b AS y, x + c AS x FROM er, {_FACES}",
)
def _(s, d):
    return R.opened(voxels(s, d).where("value > 5"))


_BALL = "ball AS (SELECT a, b, c, a * a + b * b + c * c AS d FROM range(-2, 3) t(a), range(-2, 3) u(b), range(-2, 3) v(c) WHERE a * a + b * b + c * c < 6.25)"


@query(
    "extended_labels",
    with_(VOXELS, _BALL, "near AS (SELECT z + a AS z, y + b AS y, x + c AS x, label, d FROM voxels, ball WHERE label != 0 AND value > 49)") + "SELECT z, y, x, arg_min(label, d * 1000 + label) AS label FROM near WHERE z BETWEEN 0 AND 3 AND y BETWEEN 0 AND 39 AND x BETWEEN 0 AND 39 GROUP BY ALL",
)
def _(s, d):
    return R.extended_labels(voxels(s, d).where("value > 49"), 2.5, (4, 40, 40))


@query(
    "inserted_nodes",
    with_(
        PATH,
        "p AS (SELECT *, node_idx AS spot_id, node_idx * 1.5::DOUBLE AS weight FROM path)",
        "n AS (SELECT dataset, count(*) AS n, least(count(*), dataset % 6) AS place, (dataset % 7)::DOUBLE AS nx FROM p GROUP BY 1)",
        "e AS (SELECT n.*, p.x AS ax, p.y AS ay, p.z AS az, p.weight AS aw, q.x AS cx, q.y AS cy, q.z AS cz, q.weight AS cw FROM n LEFT JOIN p ON p.dataset = n.dataset AND p.node_idx = place - 1 LEFT JOIN p q ON q.dataset = n.dataset AND q.node_idx = least(place + 1, n - 1))",
        "g AS (SELECT *, sqrt((ax - nx) * (ax - nx) + (ay - 2.5) * (ay - 2.5) + (az - 1) * (az - 1)) AS da, sqrt((cx - nx) * (cx - nx) + (cy - 2.5) * (cy - 2.5) + (cz - 1) * (cz - 1)) AS db FROM e)",
    )
    + """SELECT p.dataset, node_idx + (node_idx >= place)::INT AS node_idx, spot_id, x, y, z, weight FROM p JOIN n USING (dataset)
UNION ALL SELECT dataset, place, n, nx, 2.5::DOUBLE, 1::DOUBLE, CASE WHEN place BETWEEN 1 AND n - 1 THEN round_even((da * aw + db * cw) / nullif(da + db, 0), 6) END FROM g""",
)
def _(s, d):
    path = every_path(s, d).withColumns({"spot_id": F.col("node_idx"), "weight": F.col("node_idx") * 1.5})
    points = path.groupBy("dataset").agg(F.count("*").alias("n")).select("dataset", F.least("n", F.col("dataset") % 6).alias("place"), (F.col("dataset") % 7).cast("double").alias("x"), F.lit(2.5).alias("y"), F.lit(1.0).alias("z"))
    return R.inserted_nodes(path, points, ("weight",)).withColumn("weight", F.bround("weight", 6))


_KIND = "CASE WHEN marker = 1 THEN 'one' WHEN marker_b = 1 THEN 'two' WHEN marker = 2 THEN 'none' END"


@query("share_table", with_(CELLS, f"k AS (SELECT dataset, {_KIND} AS kind FROM cells)") + "SELECT dataset, count(*) AS n, " + ", ".join(f"round_even(count(*) FILTER (kind = '{k}') / count(*)::DOUBLE, 9) AS {k}" for k in ("one", "two", "none")) + " FROM k WHERE kind IS NOT NULL GROUP BY 1")
def _(s, d):
    rows = cells(s, d).withColumn("kind", F.expr(_KIND))
    return R.share_table(rows, "dataset", "kind", ["one", "two", "none"]).select("dataset", "n", *[F.bround(k, 9).alias(k) for k in ("one", "two", "none")])


_SETS = [("first", 0, 850.0), ("first", 1, 900.5), ("first", 2, 1000.0), ("second", 0, 870.0), ("second", 1, 1100.0)]


@query(
    "labels_by_sets",
    with_(OBJECTS, "t(set_name, band, threshold) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}::DOUBLE)" for a, b, c in _SETS) + ")", "o AS (SELECT label_id, n_pixels, label_id % 4 AS band FROM objects)")
    + """SELECT s.set_name AS "set", label_id, CASE WHEN threshold IS NULL THEN 0 WHEN n_pixels >= threshold THEN 1 ELSE 2 END AS marker FROM o CROSS JOIN (SELECT DISTINCT set_name FROM t) s LEFT JOIN t ON t.set_name = s.set_name AND t.band = o.band""",
)
def _(s, d):
    o = objects(s, d).select("label_id", "n_pixels", (F.col("label_id") % 4).cast("int").alias("band"))
    return R.labels_by_sets(o, s.createDataFrame(_SETS, "set string, band int, threshold double"), "n_pixels", "band")


QUERIES, ORACLE_SQL = Q, SQL
