"""Queries on object measures."""

from __future__ import annotations

from orbweave.operators.measures import PERCENTILES, object_measures


def _object_measures(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_extendedprice")
    return object_measures(lines, "l_partkey", "l_extendedprice", background=None, digits=4)


QUERIES = {"object_measures": _object_measures}

_VALUES = {"median": "quantile_cont(l_extendedprice, 0.5)", "mean": "avg(l_extendedprice)", "stdev": "stddev_pop(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)"} | {f"percentile_{p}": f"quantile_cont(l_extendedprice, {p / 100})" for p in PERCENTILES}

ORACLE_SQL = {"object_measures": "SELECT l_partkey AS label_id, count(l_extendedprice) AS n, " + ", ".join(f"round_even({v} + 1e-7::DOUBLE, 4) AS {name}" for name, v in _VALUES.items()) + " FROM lineitem GROUP BY l_partkey"}
