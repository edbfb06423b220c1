"""Scans and sinks of tables: TSV, CSV, JSON and Parquet, with declared schemas and skip-or-force modes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()
SEGMENTATION = T.StructType([T.StructField("label_id", _L), *[T.StructField(f"{n}_{c}", _D) for n in ("anchor", "bb_min", "bb_max") for c in "xyz"], T.StructField("n_pixels", _L)])
SPOTS = T.StructType([T.StructField("spot_id", _L), *[T.StructField(c, _D) for c in "xyz"]])
POINTS = T.StructType([T.StructField(f"axis-{k}", _D) for k in range(3)])
SCORES = T.StructType([T.StructField("annotator", _S), T.StructField("file_name", _S), *[T.StructField(c, _L) for c in ("tps", "fps", "fns")]])


def read_text_table(spark: SparkSession, path: str, schema: T.StructType | None = None, separator: str = "\t", columns: list[str] | None = None) -> DataFrame:
    """A TSV or CSV with a header, on any path that Spark reads; a schema saves the pass that infers one.

    A file may have more columns than the schema: the names of the header decide, not the places.
    """
    reader = spark.read.option("sep", separator).option("header", True)
    if schema is None:
        table = reader.option("inferSchema", True).csv(path)
    else:
        raw = reader.csv(path)
        table = raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema if f.name in raw.columns])
        missing = [f.name for f in schema if f.name not in raw.columns]
        if missing:
            raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return table.select(*columns) if columns else table


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON file of one object or a list of them: a row for each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, file_name, size of the files in a folder, without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"))


def write_table(table: DataFrame, path: str, form: str = "parquet", force: bool = False, one_file: bool = False) -> None:
    """Writes Parquet, TSV, CSV or JSON; what is there stays unless force is set."""
    out = (table.coalesce(1) if one_file else table).write.mode("overwrite" if force else "ignore")
    if form in ("tsv", "csv"):
        out.option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(path)
    elif form == "json":
        out.json(path)
    else:
        out.parquet(path)


def upsert_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, new ones over old ones."""
    both = new.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_age"))).where("_k = 1").drop("_k", "_age")


def merge_maps(old, new):
    """Map column with the keys of both, new values over old ones."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def new_sources(found: DataFrame, known: DataFrame, key: str = "name") -> DataFrame:
    return found.join(known.select(key), key, "left_anti")


def listing(lines: DataFrame) -> DataFrame:
    """From (n, line) of a recursive listing ('folder:' headers, then '-rw-r--r-- 1 u g size date name'): path, size."""
    # a listing is the text of one file: its order is its own
    order = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("line", r"^(\S.*):$", 1), F.lit(""))
    rows = lines.withColumn("folder", F.last(head, ignorenulls=True).over(order))
    size, name = F.regexp_extract("line", r"^-\S+\s+\d+\s+\S+\s+\S+\s+(\d+)\s", 1), F.regexp_extract("line", r"(\S+)$", 1)
    return rows.where(size != "").select(F.concat_ws("/", "folder", name).alias("path"), size.cast("long").alias("size"))


def parameters(text: str) -> list[dict]:
    """A parameter file's text: an object or a list of them, as a list."""
    found = json.loads(text)
    return found if isinstance(found, list) else [found]
