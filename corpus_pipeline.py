"""The corpus pipeline: filter, deduplicate, decontaminate, redact, pack.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns
of ``documents``; the last returns the packed pieces. Between stages the documents are written as
Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.llm import decontaminate, jaccard, packing, quality, surrogates
from eventlake.llm.queries import PII_KEY, reach_workers, tokenizer_path
from eventlake.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with row_key, a 64-bit hash of all columns and of which are null: rows share it only if they are alike.

    Stages judge and drop rows by it, since ids may repeat or be null.
    """
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)).alias("row_key"))


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose row_key is not the ``doc_id`` of a row of ``rejected``."""
    return keyed.join(rejected.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    keyed = _keyed(docs)
    return _without(keyed, quality.judge(keyed, id_col="row_key").filter("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: five-word shingles, similarity 0.8.

    It is a row of the least doc_id, nulls last. Rows without words are in no class and stay.
    """
    keyed = _keyed(docs)
    found = jaccard.classes(keyed, n=5, num=80, den=100, id_col="row_key", count_links=False).select(F.col("doc_id").alias("row_key"), "n_shingles", "component_id")
    ids = keyed.select("row_key", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    best = found.join(ids, "row_key").groupBy("component_id").agg(first.alias("first"), (F.max("n_shingles") > 0).alias("worded"))
    stay = keyed.join(best.select(F.col("first.row_key").alias("row_key"), "worded"), "row_key")
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    return stay.withColumn("nth", nth).filter("nth = 1 or not worded").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    return _without(keyed, decontaminate.leaks(keyed, benchmark, id_col="row_key", least_chars=1))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; n_chars follows the text."""
    return surrogates.replace(docs.select(*COLUMNS), PII_KEY).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii_surrogates", pii),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can express the outlier estimates or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    reach_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
