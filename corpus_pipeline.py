"""A training-data pipeline over documents, each stage one operator of orbweave.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again for the next one. Language ID drops what it rejects (no letters, or ambiguous); line
dedup cuts blocks that an earlier document has, and drops documents of which nothing is left;
near-dedup keeps one document of each group, and of rows alike in id and text one; the mix takes documents as often as it draws them; encoding adds the ids of
the pieces.

Defined results: rows with a null text have no letters and go in the first stage; a row without an id is a document like
others; rows with one id and different texts are documents of their own, and each is kept or dropped by itself; extra columns
of the first table are left out; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import langid, linededup, mixing, neardup, pieces
from orbweave.llm.storage import checkpointed, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows it gets; keeps rows with a language that is clear."""
    model = langid.train(docs)
    found = langid.identify(docs.select(*COLUMNS), model, keep=tuple(COLUMNS))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def _key():
    """Names a row by its id and text: ids may be missing or come twice."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.line_dedup(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    return found.where(left).select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more, and of rows alike in id and text, whatever their length, one stays.

    The keys of the rows that go, and of those that come twice, are few, and are joined to the documents.
    """
    keyed = docs.select(*COLUMNS, _key().alias("row_key"))
    gone = neardup.near_duplicates(keyed, "row_key").where("not kept").select("doc_id").distinct().withColumnRenamed("doc_id", "gone_key")
    twice = checkpointed(keyed.groupBy(F.col("row_key").alias("twice_key")).count().where("count > 1").select("twice_key"))
    kept = keyed.join(gone, F.col("row_key") == F.col("gone_key"), "left_anti")
    same = F.col("row_key") == F.col("twice_key")
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["row_key"])).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, keep=("doc_id", "source"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: No SQL: the stages learn a classifier, align lines, hash and encode. tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. The folder of the stages stays, as the result is read from it."""
    out = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
