"""The ``opN_`` queries: each applies one operator to its whole table and returns its result."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import decontaminate, jaccard, katz, packing, quality, repeats, scratch, surrogates, trainorder, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers that start on this code's path import it, wherever the driver was started."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reach_workers(spark)
            return f(spark, sf_dir)

        QUERIES[name] = functools.update_wrapper(run, f)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query(
    "op6_warc",
    """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
            f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
       SELECT page_id, n AS payload_bytes, d AS payload_digest,
              CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
       FROM p LEFT JOIN f USING (d)""",
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``pages`` as WARC archives, reads them back and reports each record."""
    path = f"{scratch.shared_dir(spark)}/warc"
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = warc.read_archives(spark, path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    revisit = F.col("record_type") == "revisit"
    return records.select(
        page("record_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("declared_length")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared_digest", "^sha256:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, page("refers_to").cast("long")).alias("refers_to"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all ``documents`` into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2)


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and outlier verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


#: The rules of the URL query, as (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query("op9_url_filters")
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


#: The key of the surrogates: a secret in production, a fixed value here so that runs agree.
PII_KEY = "eventlake"


@query("op7_pii_surrogates")
def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and the types replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = surrogates.replace(docs, PII_KEY)
    return out.select("doc_id", "text", F.size("pii_types").cast("long").alias("n_mentions"), F.array_join("pii_types", ",").alias("pii_types"))


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and ``benchmark`` items that they contain within 5 per cent of edits."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of ``documents`` linked by 4-word shingles at similarity 0.85."""
    return jaccard.classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


@query("op10_training_order")
def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``documents`` as shards in training order, reads them back and joins their index."""
    path = f"{scratch.shared_dir(spark)}/shards"
    index = trainorder.materialise(table(spark, sf_dir, "documents"), path, tokenizer_path())
    found = trainorder.read_shards(spark, path)
    return index.join(found, ["slot", "shard", "byte_offset"], "full")


@query("op5_katz_scores")
def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and Katz scores of all ``documents``."""
    return katz.scores(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 400 bytes leave of every document; n_repeated counts what repeats by 256 bytes."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
