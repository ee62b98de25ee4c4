"""A corpus pipeline out of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage's
result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm import jaccard_join, langid, mixing, packing, secret_scan
from brindle.llm.workspace import Workspace, sent


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers a thousand at a time: workers share an executor's memory with the JVM, which keeps a batch too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the dictionaries learn from the labels of these documents."""
    _small_batches(spark)
    found = langid.classify(docs, langid.fit_dictionaries(docs), keep=docs.columns, names=("__lang", "__score", "__rejected"))
    return found.filter(~F.col("__rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more: that of the least id.

    Rows with one id are one document, of which one row stays.  Rows with null ids stay.
    """
    _small_batches(spark)
    linked = jaccard_join.link_documents(spark, docs, size=5, num=80, den=100)
    space = Workspace(spark, "gone")
    gone = space.save(linked.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "ids")
    left = docs.join(sent(gone, 500_000, space.told["ids"]["rows"]), "doc_id", "left_anti").select(*docs.columns)
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    if ids.filter("rows > 1").isEmpty():
        return left
    return left.withColumn("__null", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", "__null"]).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets replaced by a mark; widely copied examples stay."""
    clean = secret_scan.redact(docs, secret_scan.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of smaller sources again, twice at most."""
    _small_batches(spark)
    return mixing.mix(docs, max_repeats=2.0, keep=docs.columns, names=("__epoch", "__block", "__position")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    _small_batches(spark)
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mixture", source_mixture),
    ("packing", sequences),
]

#: No SQL says the compression, the token ids or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
