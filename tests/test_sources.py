import json

import pytest
from pyspark.sql import functions as F

from orbweave.sources import tables as S


def test_text_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(k, *[float(k)] * 9, k * 10, "extra") for k in range(5)], "label_id long, " + ", ".join(f"{n}_{c} double" for n in ("anchor", "bb_min", "bb_max") for c in "xyz") + ", n_pixels long, more string")
    S.write_table(df, f"{tmp_path}/t", "tsv", one_file=True)
    got = S.read_text_table(spark, f"{tmp_path}/t", S.SEGMENTATION)
    assert got.schema == S.SEGMENTATION and got.agg(F.sum("n_pixels")).first()[0] == 100
    assert S.read_text_table(spark, f"{tmp_path}/t", columns=["label_id"]).columns == ["label_id"]
    S.write_table(df.limit(1), f"{tmp_path}/t", "tsv")
    assert S.read_text_table(spark, f"{tmp_path}/t").count() == 5
    S.write_table(df.limit(1), f"{tmp_path}/t", "tsv", force=True)
    assert S.read_text_table(spark, f"{tmp_path}/t").count() == 1
    with pytest.raises(ValueError):
        S.read_text_table(spark, f"{tmp_path}/t", S.SPOTS)


def test_json_of_one_and_of_many(spark, tmp_path):
    for name, value, n in (("a", {"x": 1}, 1), ("b", [{"x": 1}, {"x": 2}], 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        assert S.read_json(spark, f"{tmp_path}/{name}.json", "x long").count() == n
        assert len(S.parameters(json.dumps(value))) == n


def test_upserts_and_listing(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {(r.k, r.v) for r in S.upsert_keys(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    m = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3})], "o map<string,int>, n map<string,int>").select(S.merge_maps(F.col("o"), F.col("n")).alias("m")).first().m
    assert m == {"a": 1, "b": 3}
    lines = ["top/sub:", "total 3", "-rw-r--r-- 1 u g 12 Jan 1 a.tif", "drwxr-xr-x 2 u g 64 Jan 1 d", "top/other:", "-rw-r--r-- 1 u g 7 Jan 1 b.tif"]
    got = S.listing(spark.createDataFrame(list(enumerate(lines)), "n int, line string")).collect()
    assert {(r.path, r.size) for r in got} == {("top/sub/a.tif", 12), ("top/other/b.tif", 7)}
    assert [r.name for r in S.new_sources(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a",)], "name string")).collect()] == ["b"]
